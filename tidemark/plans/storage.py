"""Queries that write series and rollups in a scratch catalog and read them back."""

from __future__ import annotations

import atexit
import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.catalog import Catalog
from tidemark.sources.files import Files
from tidemark.sources.jobs import job_info, run_due_job
from tidemark.sources.rollup import Rollup
from tidemark.sources.series import DEFAULT, Series, partition_info, series_info
from tidemark.streaming.ingest import into_series

START = dt.datetime(2024, 1, 1)
_OWN: list[str] = []


def _root(spark: SparkSession) -> str:
    """A new folder that executors and driver share; of this machine only where no checkpoint folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        base = _OWN[0]
    path = f"{base.rstrip('/')}/catalog-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            if not spark.sparkContext._jsc.sc().isStopped():
                Files(spark).delete(path)
        except Exception:  # the session is going away
            pass

    atexit.register(remove)
    return path


def _series(spark: SparkSession, sf_dir: str, interval: str = "1 week") -> Series:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Series.create(Catalog(spark, _root(spark)), "events", events, "ts", interval=interval, premake=1, now=START)


def _filled(s: Series) -> list[str]:
    return [n for n, p in s.spec["partitions"].items() if n != DEFAULT and p["rows"]]


def series_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).scan()


def sealed_equals_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    for name in _filled(s):
        s.seal(name, order_by=["user_id", "ts"], codec="zstd")
    return s.scan()


def sealed_with_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    for name in _filled(s):
        s.seal(name)
    s.insert(spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 50 = 0"))
    s.delete("user_id = 3 AND event_type = 'click'")
    return s.scan()


def tiered_equals_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    for name in _filled(s)[:2]:
        s.seal(name)
        s.tier(name, _root(spark))
    return s.scan()


def retention_drop_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir, "1 day")
    s.drop_before(dt.datetime(2024, 1, 15))
    return s.scan()


def series_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    s.seal(_filled(s)[0])
    s.update("event_type = 'error'", {"value": "value + 1000"})
    return s.scan()


def partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir, "1 day")
    return partition_info(s.catalog).filter("rows > 0").select("name", "rows")


def _sealed(spark: SparkSession, sf_dir: str, order_by: list[str]) -> Series:
    """All rows sealed, and some late ones beside them."""
    s = _series(spark, sf_dir)
    for name in _filled(s):
        s.seal(name, order_by=order_by)
    s.insert(spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 50 = 0"))
    return s


def series_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sealed(spark, sf_dir, ["ts"]).scan(dt.datetime(2024, 1, 9, 12), dt.datetime(2024, 1, 11)).filter("value > 50.5")


def series_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sealed(spark, sf_dir, ["user_id", "ts"]).seek("user_id", [3, 7, 11], None, dt.datetime(2024, 1, 20)).select("user_id", "ts", "value")


def series_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sealed(spark, sf_dir, ["ts"]).ordered("ts", desc=True).limit(100).select("ts", "event_id")


def series_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sealed(spark, sf_dir, ["ts"]).analyze().select("column", "rows", "nulls")


def series_sample_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sealed(spark, sf_dir, ["ts"]).scan().sample(1.0).groupBy("event_type").agg(F.count("*").alias("n"))


def column_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    name = _filled(s)[0]
    s.seal(name)
    return s.column_sizes(name).filter("column in ('ts', 'user_id', 'value')").groupBy("column").agg(F.sum("rows").alias("rows"), (F.min("bytes") > 0).alias("stored"))


def series_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    s.seal(_filled(s)[1])
    s.delete("value < 20 OR user_id IN (5, 9)")
    return s.scan()


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which some are there already, with another value, and others are a day later."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 10 = 0")
    later = events.withColumn("ts", F.when(F.col("event_id") % 20 == 0, F.col("ts") + F.expr("INTERVAL '1' DAY")).otherwise(F.col("ts")))
    return later.withColumn("value", F.lit(-1.0))


def _upserted(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    s = _series(spark, sf_dir)
    s.seal(_filled(s)[0])
    s.upsert(_doubled(spark, sf_dir), ["event_id", "ts"], how)
    return s.scan().select("event_id", "ts", "value")


def upsert_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, "nothing")


def upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, "update")


def series_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    s.seal(_filled(s)[0])
    s.truncate()
    s.insert(spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'error'"))
    return s.scan()


def tier_gc_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collection of rubbish at the tier leaves: all that partitions name."""
    s = _series(spark, sf_dir)
    root = _root(spark)
    s.set_tiering("1 day", root)
    for name in _filled(s):
        s.seal(name)
        s.tier(name)
    s.recall(_filled(s)[0])  # what was tiered of it is replaced
    s.tier_gc(0)
    return s.scan()


def series_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sealed(spark, sf_dir, ["user_id", "ts"])
    name = _filled(s)[0]
    s.tier(name, _root(spark))
    s.delete("user_id = 4")
    s.recall(name)
    return s.scan()


def series_reseal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sealed(spark, sf_dir, ["ts"])
    s.delete("user_id = 4")
    for name in _filled(s):
        s.reseal(name)
    return s.scan()


def series_unseal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sealed(spark, sf_dir, ["ts"])
    s.delete("user_id = 4")
    for name in _filled(s):
        s.unseal(name)
    return s.scan()


def _table(spark: SparkSession, sf_dir: str) -> str:
    """The events as a Parquet table, a file a week."""
    path = f"{_root(spark)}/table"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    week = F.floor(F.timestamp_diff("DAY", F.lit("2000-01-01").cast("timestamp_ntz"), "ts") / 7)
    events.repartitionByRange(4, "ts").withColumn("_w", week).repartition("_w").sortWithinPartitions("_w").drop("_w").write.parquet(path)
    return path


def series_adopt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Series.adopt(Catalog(spark, _root(spark)), "events", _table(spark, sf_dir), "ts", interval="1 day", premake=1, now=START).scan()


def series_adopt_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Series.adopt(Catalog(spark, _root(spark)), "events", _table(spark, sf_dir), "ts", interval="1 month", premake=1, now=START, in_place=True).scan()


def _later(spark: SparkSession, sf_dir: str) -> Series:
    """A series whose rows all wait in the default partition."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = Series.create(Catalog(spark, _root(spark)), "events", events.schema, "ts", interval="1 day", premake=1, now=dt.datetime(2030, 1, 1))
    s.insert(events)
    return s


def _parts(s: Series) -> DataFrame:
    return partition_info(s.catalog).filter("rows > 0").select("name", "state", "rows")


def default_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(_later(spark, sf_dir))


def series_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _later(spark, sf_dir)
    s.migrate(batches=3)
    return _parts(s)


def make_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _later(spark, sf_dir)
    s.make_partitions(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 8))
    return _parts(s)


def premade_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = Series.create(Catalog(spark, _root(spark)), "events", events.schema, "ts", interval="1 month", premake=3, now=dt.datetime(2024, 11, 30))
    return partition_info(s.catalog).filter("state != 'default'").select("name", "rows")


def drop_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the default partition could be dropped with rows in it, and without; and whether rows are refused then."""
    s = _later(spark, sf_dir)
    told = [("with rows", s.drop_default())]
    s.migrate()
    told.append(("empty", s.drop_default()))
    try:
        s.insert(spark.createDataFrame([(1, dt.datetime(1999, 1, 1), 1)], "event_id long, ts timestamp_ntz, user_id long"))
        told.append(("refused", False))
    except Exception as e:
        told.append(("refused", "no partition covers" in str(e)))
    return spark.createDataFrame(told, "step string, done boolean")


def series_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    catalog = Catalog(spark, _root(spark))
    whole = spark.range(0).select(F.col("id").alias("n"), F.col("id").alias("v")).schema
    bad = {
        "no interval": (events.schema, "ts", {}), "both": (events.schema, "ts", {"interval": "1 day", "width": 5}), "a width of time": (events.schema, "ts", {"width": 5}),
        "text": (events.schema, "event_type", {"interval": "1 day"}), "no column": (events.schema, "at", {"interval": "1 day"}), "premake": (events.schema, "ts", {"interval": "1 day", "premake": 0}),
        "space is time": (events.schema, "ts", {"interval": "1 day", "space_column": "ts", "space_partitions": 2}), "one space": (events.schema, "ts", {"interval": "1 day", "space_column": "user_id", "space_partitions": 1}),
        "mixed": (events.schema, "ts", {"interval": "1 month 1 day"}), "zero": (whole, "n", {"width": 0}), "an interval of numbers": (whole, "n", {"interval": "1 day"}),
    }
    told = []
    for i, (name, (schema, time, how)) in enumerate(bad.items()):
        try:
            Series.create(catalog, f"bad{i}", schema, time, **how)
            told.append((name, False))
        except ValueError:
            told.append((name, True))
    s = Series.create(catalog, "fine", events.schema, "ts", interval="1 day", premake=1, now=START)
    try:
        s.insert(events.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
        told.append(("no time", False))
    except Exception as e:
        told.append(("no time", "without a time" in str(e)))
    return spark.createDataFrame(told, "what string, refused boolean")


def series_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog knows before a series is dropped, while a rollup reads it, and after."""
    s = _series(spark, sf_dir)
    r = _hourly(s)
    told = [("made", len(s.catalog.read()["series"]))]
    try:
        s.drop()
    except ValueError:
        told.append(("read by a rollup", len(s.catalog.read()["series"])))
    r.drop()
    s.drop()
    told.append(("dropped", len(s.catalog.read()["series"]) + len(s.catalog.read()["rollups"]) + len(s.catalog.read()["jobs"])))
    return spark.createDataFrame(told, "step string, n int")


def retention_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir, "1 day")
    s.set_retention("10 days")
    s.apply_retention(dt.datetime(2024, 1, 25, 5))
    return s.scan()


def jobs_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scheduled work of a series did when all of it was due, and the states it left."""
    s = _series(spark, sf_dir, "1 day")
    s.set_sealing("20 days", codec="zstd")
    s.set_tiering("25 days", _root(spark))
    s.set_retention("28 days")
    _hourly(s)
    for at in range(9):
        while run_due_job(s.catalog, dt.datetime(2024, 1, 31), clock=1e9 + 4000 * at):
            pass
    states = partition_info(s.catalog).filter("rows > 0").groupBy("state").count().select(F.concat(F.lit("partitions "), "state").alias("what"), F.col("count").alias("n"))
    jobs = job_info(s.catalog).filter("last_ok").groupBy("kind").count().select(F.concat(F.lit("job "), "kind").alias("what"), F.col("count").alias("n"))
    return states.unionByName(jobs)


def jobs_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir, "1 day")
    s.set_sealing("20 days")
    due = s.due("seal", dt.datetime(2024, 1, 25))
    s.seal(due[0])
    s.insert(spark.read.parquet(f"{sf_dir}/events.parquet").filter("ts < TIMESTAMP_NTZ '2024-01-02'"))
    changed = [(n, p["changed"]) for n, p in s.spec["partitions"].items() if p["state"] == "sealed"]
    return spark.createDataFrame([(n, 0) for n in due[1:]] + changed, "name string, changed long")


def series_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir, "1 day")
    s.seal(_filled(s)[0])
    return series_info(s.catalog).select("series", "time_column", "partitions", "rows_in_default", "rows", (F.col("sealed_bytes") > 0).alias("sealed"))


def series_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows have the default, new ones what they bring, null included."""
    s = _series(spark, sf_dir)
    s.add_column("w", "int", 7)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s.insert(events.filter("event_id % 50 = 0").withColumn("w", F.when(F.col("event_id") % 100 == 0, F.lit(1))))
    s.drop_column("props")
    return s.scan().select("event_id", "w")


def series_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = Series.create(Catalog(spark, _root(spark)), "events", events, "ts", interval="1 week", premake=1, now=START, space_column="user_id", space_partitions=4)
    s.seal(_filled(s)[0])
    return s.scan()


def series_many_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insertion that comes between a deletion's reading and its change of the catalog; neither is lost."""
    s = _series(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    write, late = s._write, []

    def slowly(*args, **how):
        out = write(*args, **how)
        if not late:
            late.append(Series(s.catalog, s.name).insert(events.filter("event_id % 50 = 0")))
        return out

    s._write = slowly
    s.delete("user_id = 4")
    return s.scan()


def _hourly(s: Series) -> Rollup:
    return Rollup.create(s.catalog, "hourly", "events", bucket="1 hour", select="event_type, count(*) AS n, sum(value) AS total", group_by=["event_type"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.round("total", 4))


def rollup_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _hourly(_series(spark, sf_dir))
    r.refresh(dt.datetime(2024, 1, 20, 10, 30))
    return _rounded(r.read())


def rollup_after_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    r = _hourly(s)
    r.refresh(dt.datetime(2024, 1, 20, 10, 30))
    s.insert(spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 50 = 0"))
    return _rounded(r.read())


def _told(spark: SparkSession, sf_dir: str, write) -> DataFrame:
    """The rollup after a write to its source."""
    s = _series(spark, sf_dir)
    r = _hourly(s)
    r.refresh(dt.datetime(2024, 1, 20, 10, 30))
    write(s)
    return _rounded(r.read())


def rollup_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, lambda s: s.delete("user_id < 20"))


def rollup_after_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, lambda s: s.update("event_type = 'error'", {"value": "value + 1000"}))


def rollup_after_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 50 = 0")
    return _told(spark, sf_dir, lambda s: (s.truncate(), s.insert(events)))


def rollup_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ranges a refresh makes anew after scattered writes, and the buckets after it."""
    s = _series(spark, sf_dir)
    r = _hourly(s)
    r.refresh(dt.datetime(2024, 1, 20, 10, 30))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for day in ("2024-01-03", "2024-01-05", "2024-01-05"):
        s.insert(events.filter(f"ts >= TIMESTAMP_NTZ '{day} 04:00:00' AND ts < TIMESTAMP_NTZ '{day} 05:00:00'"))
    ranges = r.refresh(dt.datetime(2024, 1, 20, 10, 30))
    return r.read().groupBy().agg(F.sum("n").alias("n"), F.lit(ranges).alias("ranges"), F.lit(len(r.spec["stored"])).alias("folders"))


def rollup_chain_after_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    _hourly(s).refresh(dt.datetime(2024, 1, 20, 10, 30))
    daily = Rollup.create(s.catalog, "daily", "hourly", bucket="1 day", select="sum(n) AS n, sum(total) AS total")
    daily.refresh(dt.datetime(2024, 1, 25))
    s.insert(spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 50 = 0"))
    return _rounded(daily.read())


def rollup_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last of days, from those of hours."""
    s = _series(spark, sf_dir)
    Rollup.create(s.catalog, "hours", "events", bucket="1 hour", select="min_by(struct(ts AS at, value), ts) AS f, max_by(struct(ts AS at, event_type AS value), ts) AS l").refresh(dt.datetime(2024, 1, 20, 10, 30))
    daily = Rollup.create(s.catalog, "days", "hours", bucket="1 day", select="min_by(f, f.at) AS f, max_by(l, l.at) AS l")
    daily.refresh(dt.datetime(2024, 1, 25))
    return daily.read().select("bucket", F.col("f.value").alias("first_value"), F.col("l.value").alias("last_type"))


def rollup_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _hourly(_series(spark, sf_dir))
    r.set_retention("5 days")
    r.refresh(dt.datetime(2024, 1, 20, 10, 30))
    return _rounded(r.read())


def rollup_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    hourly = _hourly(s)
    calls = {
        "avg of a rollup": lambda: Rollup.create(s.catalog, "a", "hourly", bucket="1 day", select="avg(total) AS x"),
        "distinct of a rollup": lambda: Rollup.create(s.catalog, "b", "hourly", bucket="1 day", select="count(DISTINCT n) AS x"),
        "buckets that do not nest": lambda: Rollup.create(s.catalog, "c", "hourly", bucket="90 minutes", select="sum(n) AS n"),
        "a key that is not selected": lambda: Rollup.create(s.catalog, "d", "events", bucket="1 day", select="count(*) AS n", group_by=["user id"]),
        "no source": lambda: Rollup.create(s.catalog, "e", "nothing", bucket="1 day", select="count(*) AS n"),
        "a name twice": lambda: _hourly(s),
    }
    told = []
    for name, call in calls.items():
        try:
            call()
            told.append((name, False))
        except ValueError:
            told.append((name, True))
    Rollup.create(s.catalog, "daily", "hourly", bucket="1 day", select="sum(n) AS n")
    try:
        hourly.drop()
        told.append(("read by another", False))
    except ValueError:
        told.append(("read by another", True))
    Rollup(s.catalog, "daily").drop()
    hourly.drop()
    return spark.createDataFrame([*told, ("all dropped", not s.catalog.read()["rollups"])], "what string, refused boolean")


def rollup_daily_of_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    hourly = _hourly(s)
    hourly.refresh(dt.datetime(2024, 1, 20, 10, 30))
    daily = Rollup.create(s.catalog, "daily", "hourly", bucket="1 day", select="sum(n) AS n, sum(total) AS total")
    daily.refresh(dt.datetime(2024, 1, 25))
    return _rounded(daily.read())


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = Series.create(Catalog(spark, _root(spark)), "events", events.schema, "ts", interval="1 week", premake=1, now=START)
    r = _hourly(s)
    folder = _root(spark)
    events.repartition(2).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    into_series(stream, s, f"{folder}/checkpoint", refresh=[r]).awaitTermination()
    return _rounded(r.read())
