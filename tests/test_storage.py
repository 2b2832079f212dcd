import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources.catalog import Catalog
from tidemark.sources.jobs import job_info, run_due_job
from tidemark.sources.rollup import Rollup
from tidemark.sources.series import DEFAULT, Series, partition_info, series_info
from tidemark.streaming.ingest import into_series

DAY0 = dt.datetime(2026, 1, 1)
SCHEMA = "ts timestamp_ntz, host string, v long"


def minutes(spark, n, start=DAY0, step=1):
    at = F.timestamp_add("MINUTE", F.col("id").cast("int") * step, F.lit(str(start)).cast("timestamp_ntz"))
    return spark.range(n).select(at.alias("ts"), F.concat(F.lit("h"), F.col("id") % 2).alias("host"), (F.col("id") % 97).alias("v"))


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/db")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_partitions_and_retention(spark, catalog):
    df = minutes(spark, 4320)
    s = Series.create(catalog, "m", df, "ts", interval="1 hour", premake=2, now=DAY0 + dt.timedelta(days=3))
    parts = s.spec["partitions"]
    assert len(parts) == 1 + 72 + 3 and parts[DEFAULT]["rows"] == 0 and "p20260101_050000" in parts
    same(s.scan(), df)
    same(s.scan(DAY0, DAY0 + dt.timedelta(minutes=90)), df.limit(90))
    assert s.insert(minutes(spark, 10, dt.datetime(2030, 1, 1))) == 10 and s.spec["partitions"][DEFAULT]["rows"] == 10
    assert not s.drop_default() and s.migrate() == 1 and s.drop_default()
    with pytest.raises(Exception, match="no partition covers"):
        s.insert(minutes(spark, 1, dt.datetime(1999, 1, 1)))
    s.set_retention("1 day")
    assert s.apply_retention(DAY0 + dt.timedelta(days=3)) == 48
    assert s.scan().count() == 1440 + 10
    info = {r.series: r for r in series_info(catalog).collect()}["m"]
    assert info.rows == 1450 and partition_info(catalog).count() == len(s.spec["partitions"])
    s.drop()
    assert catalog.read()["series"] == {}


def test_integer_series_and_refusals(spark, catalog):
    df = spark.range(5000).select((F.col("id") - 1500).alias("n"), (F.col("id") % 10).alias("v"))
    s = Series.create(catalog, "i", df, "n", width=1000, premake=1)
    assert {"pm2000", "pm1000", "p0", "p3000", "p4000"} <= set(s.spec["partitions"])
    same(s.scan(0, 10), df.filter("n >= 0 and n < 10"))
    for bad in (dict(width=10, interval="1 day"), dict(interval="1 day"), dict(width=0), dict(width=5, premake=0), dict(width=5, space_column="n", space_partitions=2), dict(width=5, space_column="v", space_partitions=1)):
        with pytest.raises(ValueError):
            Series.create(catalog, "bad", df.schema, "n", **bad)
    with pytest.raises(ValueError):
        Series.create(catalog, "bad", df.withColumn("d", F.lit("x")).schema, "d", width=5)


def test_sealed_and_tiered_equal_plain(spark, catalog, tmp_path):
    df = minutes(spark, 2880)
    s = Series.create(catalog, "s", df, "ts", interval="1 day", space_column="host", space_partitions=2, premake=1, now=DAY0)
    first, second = "p20260101", "p20260102"
    assert s.seal(first, codec="lz4") == 1440 and s.spec["partitions"][first]["state"] == "sealed"
    same(s.scan(), df)
    late = minutes(spark, 20, DAY0, 7)
    s.insert(late)
    want = df.unionByName(late)
    same(s.scan(), want)
    n = s.delete("v = 5")
    assert n == want.filter("v = 5").count()
    want = want.filter("v != 5")
    same(s.scan(), want)
    s.set_tiering("1 day", f"file://{tmp_path}/tier")
    assert s.tier(first) == s.spec["partitions"][first]["rows"]
    same(s.scan(), want)
    assert s.update("v = 7 and host = 'h1'", {"v": "v + 1000"}) > 0
    want = want.withColumn("v", F.expr("if(v = 7 and host = 'h1', v + 1000, v)"))
    same(s.scan(), want)
    assert s.reseal(first) and s.spec["partitions"][first]["delta"] == []
    same(s.scan(), want)
    s.recall(first)
    assert s.column_sizes(first).filter("column = 'v'").agg(F.sum("rows")).first()[0] == s.spec["partitions"][first]["rows"]
    s.unseal(first)
    s.add_column("w", "int", 3)
    assert s.scan().filter("w = 3").count() == want.count()
    s.seal(second, codec="zstd")
    with pytest.raises(ValueError):
        s.seal(second)
    same(s.scan().drop("w"), want)
    assert s.tier_gc(0) >= 0


def test_adopt(spark, catalog, tmp_path):
    df = minutes(spark, 300)
    df.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{tmp_path}/old")
    s = Series.adopt(catalog, "old", f"{tmp_path}/old", "ts", interval="1 hour", premake=1, now=DAY0)
    same(s.scan().drop("day"), df)


def test_random_steps(spark, catalog):
    rng, rows = random.Random(4), {}
    s = Series.create(catalog, "r", spark.createDataFrame([], "id long, k long, s string").schema, "id", width=100, premake=1)
    make = lambda ids: spark.createDataFrame([(i, i % 37, f"s{i}") for i in ids], "id long, k long, s string")
    for step in range(14):
        what = rng.choice(["insert", "insert", "delete", "update", "seal", "reseal", "unseal", "migrate"])
        names = {n: p["state"] for n, p in s.spec["partitions"].items() if n != DEFAULT and p["rows"]}
        if what == "insert":
            ids = [i for i in rng.sample(range(500), 60) if i not in rows]
            s.insert(make(ids))
            rows |= {i: (i, i % 37, f"s{i}") for i in ids}
        elif what == "delete":
            k = rng.randrange(37)
            s.delete(f"k = {k}")
            rows = {i: r for i, r in rows.items() if r[1] != k}
        elif what == "update":
            k = rng.randrange(37)
            s.update(f"k = {k}", {"s": "concat(s, '!')"})
            rows = {i: (r[0], r[1], r[2] + "!") if r[1] == k else r for i, r in rows.items()}
        elif what == "migrate":
            s.migrate()
        else:
            for n, state in names.items():
                if state == {"seal": "live"}.get(what, "sealed") and rng.random() < 0.7:
                    getattr(s, what)(n)
        assert sorted(map(tuple, s.scan().collect())) == sorted(rows.values()), (step, what)


def truth(df, width="1 hour"):
    from tidemark.functions.bucket import bucket

    return df.groupBy(bucket("ts", width).alias("bucket"), "host").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def test_rollup_is_never_stale(spark, catalog):
    df = minutes(spark, 2880)
    s = Series.create(catalog, "src", df, "ts", interval="1 day", premake=1, now=DAY0)
    hourly = Rollup.create(catalog, "hourly", "src", bucket="1 hour", select="host, sum(v) AS total, count(*) AS n", group_by=["host"])
    daily = Rollup.create(catalog, "daily", "hourly", bucket="1 day", select="sum(total) AS total, sum(n) AS n")
    same(hourly.read(), truth(df))
    now = DAY0 + dt.timedelta(days=1, hours=12, minutes=30)
    assert hourly.refresh(now) == 1 and daily.refresh(now) == 1
    same(hourly.read(), truth(df))
    s.insert(minutes(spark, 30, DAY0, 11))
    df = df.unionByName(minutes(spark, 30, DAY0, 11))
    same(hourly.read(), truth(df))
    day = lambda d: truth(d, "1 day").groupBy("bucket").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    same(daily.read(), day(df))
    assert hourly.refresh(now) == 1 and hourly.spec["invalid"] == []
    same(daily.read(), day(df))
    daily.refresh(now)
    s.delete("v = 3")
    s.update("v = 4", {"v": "40"})
    df = df.filter("v != 3").withColumn("v", F.expr("if(v = 4, 40L, v)"))
    same(hourly.read(), truth(df))
    same(daily.read(), day(df))
    hourly.refresh(now + dt.timedelta(days=3))
    same(hourly.read(), truth(df))
    s.drop_before(DAY0 + dt.timedelta(days=1))
    kept = {r.bucket for r in hourly.read().collect()}
    assert DAY0 in kept  # raw rows are gone, their buckets stay
    s.truncate()
    assert hourly.read().filter(F.col("bucket") >= F.lit(str(DAY0 + dt.timedelta(days=1))).cast("timestamp_ntz")).count() == 0
    with pytest.raises(ValueError):
        Rollup.create(catalog, "bad", "hourly", bucket="1 day", select="avg(total) AS a")
    with pytest.raises(ValueError):
        s.drop()
    with pytest.raises(ValueError):
        hourly.drop()
    daily.drop()
    hourly.drop()
    s.drop()


def test_integer_rollup(spark, catalog):
    df = spark.range(5000).select(F.col("id").alias("n"), (F.col("id") % 10).alias("v"))
    Series.create(catalog, "ints", df, "n", width=1000, premake=1)
    r = Rollup.create(catalog, "by100", "ints", bucket_width=100, select="sum(v) AS s")
    r.refresh()
    assert r.spec["watermark"] == 4900
    same(r.read(), df.groupBy((F.col("n") - F.col("n") % 100).alias("bucket")).agg(F.sum("v").alias("s")))


def test_jobs(spark, catalog):
    s = Series.create(catalog, "j", minutes(spark, 2880), "ts", interval="1 day", premake=1, now=DAY0)
    s.set_sealing("12 hours")
    s.set_retention("30 days")
    Rollup.create(catalog, "jr", "j", bucket="1 hour", select="count(*) AS n")
    now, n = DAY0 + dt.timedelta(days=4), 0
    while run_due_job(catalog, now, clock=1e9):
        n += 1
    assert n == 4 and job_info(catalog).filter("last_ok").count() == 4
    assert "sealed" in {p["state"] for p in s.spec["partitions"].values()}
    assert not run_due_job(catalog, now, clock=1e9)


def test_stream_into_series(spark, catalog, tmp_path):
    df = minutes(spark, 600)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    s = Series.create(catalog, "st", df.schema, "ts", interval="1 day", premake=1, now=DAY0)
    r = Rollup.create(catalog, "str", "st", bucket="1 hour", select="count(*) AS n")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # nothing new the second time
        into_series(stream(), s, f"file://{tmp_path}/ck", refresh=[r]).awaitTermination()
    same(s.scan(), df)
    assert r.read().agg(F.sum("n")).first()[0] == 600


def test_many_partitions_refuse_as_few_do(spark, catalog):
    s = Series.create(catalog, "many", spark.range(0).select(F.col("id").alias("n")).schema, "n", width=1, premake=1)
    assert s.make_partitions(0, 1003) == 1003 and s.drop_default()
    assert s.insert(spark.range(7, 9).select(F.col("id").alias("n"))) == 2
    with pytest.raises(Exception, match="no partition covers"):
        s.insert(spark.range(5000, 5001).select(F.col("id").alias("n")))
    assert DEFAULT not in s.spec["partitions"] and s.scan().count() == 2


def test_batch_is_inserted_once(spark, catalog):
    s = Series.create(catalog, "b", minutes(spark, 0).schema, "ts", interval="1 day", premake=1, now=DAY0)
    assert [s.insert(minutes(spark, 5), batch=("x", n)) for n in (0, 0, 1, 0)] == [5, 0, 5, 0]
    assert s.scan().count() == 10
