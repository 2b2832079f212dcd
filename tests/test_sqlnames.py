import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bucket as B
from tidemark.functions import sqlnames
from tidemark.functions.gapfill import gapfill
from tidemark.operators.joins import asof_join, window_join

T = dt.datetime.fromisoformat


def test_buckets_equal_the_expressions(spark):
    sqlnames.register(spark)
    start = dt.datetime(2026, 1, 1)
    rows = spark.range(3000).select(F.timestamp_add("MINUTE", (F.col("id") * 173).cast("int"), F.lit(str(start)).cast("timestamp_ntz")).alias("ts")).withColumn("at", B.from_utc(F.col("ts"))).withColumn("d", F.to_date("ts"))
    rows.createOrReplaceTempView("times")
    for width in ("15 minutes", "1 week", "3 months"):
        got = spark.sql(f"SELECT ts, at, bucket('{width}', ts) a, bucket_utc('{width}', at) b, bucket_zone('{width}', at, 'America/New_York') c FROM times")
        zone = B.bucket("at", width, zone="America/New_York", kind="ltz")
        assert got.filter((F.col("a") != B.bucket("ts", width)) | (F.col("b") != B.bucket("at", width, kind="ltz")) | (F.col("c") != zone) | F.col("c").isNull()).count() == 0
    origin = "TIMESTAMP_NTZ '2000-01-31 00:00:00'"
    assert spark.sql(f"SELECT * FROM times WHERE bucket('1 month', ts, {origin}) IS NOT NULL").filter(F.expr(f"bucket('1 month', ts, {origin})") != B.bucket("ts", "1 month", origin=dt.datetime(2000, 1, 31))).count() == 0
    row = spark.sql("SELECT bucket_date('2 weeks', DATE '2026-09-22') a, bucket_date('3 months', DATE '2026-09-22', DATE '2000-02-15') b, bucket_long(10, -1) c, bucket_long(10, 1234, 5) d").first()
    assert tuple(row) == (dt.date(2026, 9, 21), dt.date(2026, 8, 15), -10, 1225)
    for bad in ("bucket('1 month 1 day', TIMESTAMP_NTZ '2026-01-01')", "bucket('0 days', TIMESTAMP_NTZ '2026-01-01')", "bucket_date('1 hour', DATE '2026-01-01')", "bucket_long(0, 1)"):
        with pytest.raises(Exception, match="width|whole days"):
            spark.sql(f"SELECT {bad}").collect()


def test_gapfill(spark):
    sqlnames.register(spark)
    for width, low, high in (("1 hour", "2026-01-01 00:30:00", "2026-01-01 03:00:00"), ("1 month", "2026-01-15 00:00:00", "2026-05-01 00:00:00"), ("3 months", "2025-12-31 00:00:00", "2026-12-31 00:00:00"), ("1 day", "2026-01-02 00:00:00", "2026-01-02 00:00:00")):
        want = sorted(r[0] for r in gapfill(spark, width, T(low), T(high), kind="ntz").collect())
        assert sorted(r[0] for r in spark.sql(f"SELECT * FROM gapfill('{width}', TIMESTAMP_NTZ '{low}', TIMESTAMP_NTZ '{high}')").collect()) == want


def test_names_that_are_written_out(spark):
    rows = spark.range(400).select((F.col("id") % 7).alias("k"), F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit("2026-01-01").cast("timestamp_ntz")).alias("ts"), F.when(F.col("id") % 3 != 0, F.col("id").cast("double")).alias("v"))
    rows.createOrReplaceTempView("r")
    rows.filter("k < 5").createOrReplaceTempView("l")
    got = sqlnames.sql(spark, "SELECT k, first(v, ts) f, last(v, ts) l, histogram(v, 0, 400, 4) h, 'first(v, ts)' AS s FROM r GROUP BY k").collect()
    want = {r.k: r for r in rows.groupBy("k").agg(F.min_by("v", "ts").alias("f"), F.max_by("v", "ts").alias("l"), F.count("v").alias("n")).collect()}
    assert all((r.f, r.l, sum(r.h), r.s) == (want[r.k].f, want[r.k].l, want[r.k].n, "first(v, ts)") for r in got) and len(got) == 7
    carried = sqlnames.sql(spark, "SELECT k, ts, locf(v) OVER (PARTITION BY k ORDER BY ts) AS c FROM r")
    assert carried.filter("c is null").count() < 7
    left, right = spark.table("l"), spark.table("r").select("k", "ts", "v")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(sqlnames.sql(spark, "SELECT * FROM asof_join('SELECT * FROM l', 'SELECT k, ts, v FROM r WHERE k <> 1', ARRAY['k'], 'ts', within => '3 minutes') j"), asof_join(left, right.filter("k <> 1"), ["k"], "ts", within="3 minutes"))
    assert same(sqlnames.sql(spark, "SELECT * FROM window_join('SELECT * FROM l', 'SELECT * FROM r', ARRAY['k'], 'ts', 'v', '30 minutes', aggregate => 'sum')"), window_join(left, right, ["k"], "ts", "v", "30 minutes", aggregate="sum"))
