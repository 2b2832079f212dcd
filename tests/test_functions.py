import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import aggregates as A
from tidemark.functions import bucket as B
from tidemark.functions import fill, hll, tdigest
from tidemark.functions.gapfill import gapfill, gapfilled
from tidemark.functions.width import Width

T = dt.datetime.fromisoformat
UTC = dt.timezone.utc


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_width():
    assert Width.parse("15 minutes").micros == 900_000_000 and Width.parse("1 year 2 months").months == 14
    assert Width.parse(dt.timedelta(hours=1)) == Width.parse("1h") == Width.parse("01:00:00")
    for bad in ("", "5", "1 month 1 day", "0 days", "x hours", "1.5 months"):
        with pytest.raises(ValueError):
            Width.parse(bad)


@pytest.mark.parametrize(
    "width,ts,origin,want",
    [
        ("15 minutes", "2026-09-22 10:52:31", None, "2026-09-22 10:45:00"),
        ("1 week", "2026-09-22 00:00:00", None, "2026-09-21 00:00:00"),
        ("3 months", "2026-09-22 00:00:00", None, "2026-07-01 00:00:00"),
        ("1 hour", "2026-09-22 10:52:31", "2000-01-01 00:30:00", "2026-09-22 10:30:00"),
        ("1 day", "1999-12-31 23:59:59", None, "1999-12-31 00:00:00"),
        ("1 month", "2024-02-28 00:00:00", "2000-01-31 00:00:00", "2024-01-31 00:00:00"),
        ("1 month", "2024-02-29 00:00:00", "2000-01-31 00:00:00", "2024-02-29 00:00:00"),
        ("1 month", "2024-03-30 00:00:00", "2000-01-31 00:00:00", "2024-02-29 00:00:00"),
        ("1 month", "2025-02-28 00:00:00", "2000-01-31 00:00:00", "2025-02-28 00:00:00"),
        ("1 month", "2025-03-01 00:00:00", "2000-01-31 00:00:00", "2025-02-28 00:00:00"),
    ],
)
def test_bucket_values(spark, width, ts, origin, want):
    assert one(spark, B.bucket(at(ts), width, origin=origin and T(origin))) == T(want)
    utc = F.lit(ts + "+00:00").cast("timestamp")
    got = one(spark, B.to_utc(B.bucket(utc, width, origin=origin and T(origin), kind="ltz")))
    assert got == T(want)


def test_bucket_other_kinds(spark):
    for (w, v, o), want in {(10, 1234, 0): 1230, (10, -1, 0): -10, (10, 1234, 5): 1225}.items():
        assert one(spark, B.bucket(F.lit(v), w, origin=o, kind="long")) == want
    day = F.lit("2026-09-22").cast("date")
    assert one(spark, B.bucket(day, "3 months", origin=dt.date(2000, 2, 15), kind="date")) == dt.date(2026, 8, 15)
    assert one(spark, B.bucket(day, "1 week", kind="date")) == dt.date(2026, 9, 21)
    assert one(spark, B.bucket(F.lit(None).cast("timestamp_ntz"), "1 day")) is None
    for bad in (lambda: B.bucket(day, "1 hour", kind="date"), lambda: B.bucket(day, 0, kind="long"), lambda: B.bucket(day, "1 day", zone="UTC")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe"])
def test_zone_buckets(spark, zone):
    z = ZoneInfo(zone)
    start = dt.datetime(2026, 1, 1, tzinfo=UTC)
    rows = spark.range(0, 12_000).select(F.timestamp_micros(F.lit(B.micros(start)) + F.col("id") * 43 * 60_000_000).alias("ts"))
    widths = {"15 minutes": 15, "1 hour": 60, "90 minutes": 90, "1 day": 1440, "1 month": 0}
    got = rows.select(B.to_utc(F.col("ts")).alias("ts"), *[B.to_utc(B.bucket("ts", w, zone=zone, kind="ltz")).alias(w) for w in widths]).toPandas()
    for w, minutes in widths.items():
        last = None
        for ts, b in zip(got["ts"], got[w]):
            assert b <= ts and (last is None or b >= last)
            last = b
            local = b.tz_localize("UTC").astimezone(z)
            here = ts.tz_localize("UTC").astimezone(z)
            if w == "1 day":
                assert local.date() == here.date() and (local.hour, local.minute) == (0, 0)
            elif w == "1 month":
                assert (local.year, local.month, local.day, local.hour) == (here.year, here.month, 1, 0)
            else:
                since = (local.replace(tzinfo=None) - B.ORIGIN).total_seconds() / 60
                assert since % minutes == 0 and (ts - b).total_seconds() < (minutes + 60) * 60


@pytest.mark.parametrize("zone,width", [(None, "15 minutes"), (None, "1 month"), ("America/New_York", "1 hour"), ("America/New_York", "1 day"), ("Australia/Lord_Howe", "90 minutes"), ("Australia/Lord_Howe", "1 month")])
def test_gapfill_is_the_buckets_of_a_dense_series(spark, zone, width):
    low, high = T("2026-02-20 00:07:00"), T("2026-04-10 00:00:00")
    n = int((high - low).total_seconds() // 300)
    dense = spark.range(n).select(F.timestamp_micros(F.lit(B.micros(low)) + F.col("id") * 300_000_000).alias("ts"))
    want = sorted(r.b for r in dense.select(B.bucket("ts", width, zone=zone, kind="ltz").alias("b")).distinct().collect())
    assert sorted(r.bucket for r in gapfill(spark, width, low, high, zone=zone).collect()) == want


def test_locf_and_interpolate(spark):
    rows = [(T("2026-09-22 01:10:00"), "a", 10.0), (T("2026-09-22 01:50:00"), "a", 20.0), (T("2026-09-22 04:30:00"), "a", 50.0), (T("2026-09-22 02:15:00"), "b", 7.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, host string, v double")
    g = gapfilled(df.filter("host = 'a'"), "ts", "1 hour", T("2026-09-22 00:00:00"), T("2026-09-22 07:00:00"), [F.avg("v").alias("v")])
    out = fill.interpolate(g.withColumn("carried", fill.locf("v", ["bucket"])), "v", "bucket").orderBy("bucket").collect()
    assert [r.v for r in out] == [None, 15, 26.666666666666664, 38.33333333333333, 50, None, None]
    assert [r.carried for r in out] == [None, 15, 15, 15, 50, 50, 50]
    months = spark.createDataFrame([(T(f"2025-0{m}-01 00:00:00"), v) for m, v in zip(range(1, 5), (0.0, None, None, 90.0))], "b timestamp_ntz, v double")
    assert [r.v for r in fill.interpolate(months, "v", "b", at="b").orderBy("b").collect()] == [0, 31, 59, 90]
    assert [r.v for r in fill.interpolate(months, "v", "b").orderBy("b").collect()] == [0, 30, 60, 90]
    keyed = gapfilled(df, "ts", "1 hour", T("2026-09-22 01:00:00"), T("2026-09-22 03:00:00"), [F.count("*").alias("n")], keys=["host"])
    assert keyed.count() == 4 and keyed.filter("n is null").count() == 2


def test_first_last_histogram(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", None, 9), ("b", None, 1)], "k string, at int, v int")
    got = {r.k: (r.f, r.l) for r in df.groupBy("k").agg(A.first("v", "at").alias("f"), A.last("v", "at").alias("l")).collect()}
    assert got == {"a": (None, 5), "b": (None, None)}
    values = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.999, 2.0, 9.999, 10.0, 1e9, None)], "v double")
    want = [1, 2, 1, 0, 0, 1, 2]
    assert values.agg(A.histogram("v", 0, 10, 5).alias("h")).first().h == want
    assert A.wide_histogram(values, [], "v", 0, 10, 5).first().histogram == want
    assert values.filter("v is null").agg(A.histogram("v", 0, 10, 5).alias("h")).first().h == [0] * 7
    assert values.limit(0).agg(A.histogram("v", 0, 10, 5).alias("h")).first().h is None
    assert values.select(F.lit(float("nan")).alias("v")).limit(1).agg(A.histogram("v", 0, 10, 5).alias("h")).first().h == [0] * 6 + [1]
    with pytest.raises(ValueError):
        A.histogram("v", 1, 1, 5)


def test_counters(spark):
    minute = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", minute(i), v) for i, v in enumerate([100.0, 130.0, 20.0, 50.0, None])] + [("b", minute(0), 5.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, v double")
    got = {r.k: (r.counter_delta, r.counter_rate) for r in A.counter(df, ["k"], "v", "at").collect()}
    assert got == {"a": (80, 0.4444444444444444), "b": (0, None), "c": (None, None)}
    parts = A.counter_segments(df.withColumn("half", F.minute("at") >= 2), ["k", "half"], "v", "at")
    merged = {r.k: (r.d, r.r) for r in A.merge_segments(parts, ["k"]).select("k", A.segment_delta().alias("d"), A.segment_rate().alias("r")).collect()}
    assert merged["a"] == got["a"] and merged["b"] == got["b"]


def test_hll(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("k"), F.concat(F.lit("u"), F.col("id") % 5000).alias("v"))
    sketches = hll.distinct_sketch(df, ["k"], "v")
    for r in sketches.select("k", hll.distinct_count("sketch").alias("n")).collect():
        assert abs(r.n - 5000) < 5000 * 4 * 1.04 / 64
    union, whole = hll.merge(sketches, []).first().sketch, hll.distinct_sketch(df, [], "v").first().sketch
    assert union.registers == whole.registers
    empty = hll.distinct_sketch(df.select(F.lit(None).cast("string").alias("v")).limit(3), [], "v")
    assert empty.select(hll.distinct_count("sketch").alias("n")).first().n == 0
    text = sketches.limit(1).select("sketch", hll.to_text("sketch").alias("t")).select("sketch", hll.from_text("t").alias("s")).first()
    assert text.sketch == text.s


def test_hll_counts_beside_sketches(spark):
    df = spark.range(40_000).select((F.col("id") % 4).alias("k"), F.when(F.col("id") % 4 != 3, F.col("id") % 6000 * 7).alias("v"))
    for bits in (4, 12):  # values meet in the registers of both
        plain = {r.k: r.sketch for r in hll.distinct_sketch(df, ["k"], "v", bits).collect()}
        counted = hll.distinct_sketch(df, ["k"], "v", bits, count="n").collect()
        assert {r.k: r.sketch for r in counted} == plain
        want = {r.k: r.n for r in df.groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
        assert {r.k: r.n for r in counted} == want and want[3] == 0 < want[0]


def test_tdigest(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 20_000), rng.exponential(5, 20_000)])
    df = spark.createDataFrame([(float(v), int(i % 2)) for i, v in enumerate(values)], "v double, k int").repartition(4)
    ordered = np.sort(values)
    qs = [0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999]
    whole = tdigest.percentile_sketch(df, [], "v")
    parts = tdigest.percentile_sketch(df, ["k"], "v")
    for d in (whole, tdigest.merge(parts, [])):
        r = d.select(tdigest.percentile("digest", qs).alias("q"), tdigest.sketch_count("digest").alias("n"), "digest").first()
        assert r.n == 40_000 and len(r.digest.means) < 200
        for q, x in zip(qs, r.q):
            assert abs(np.searchsorted(ordered, x) / len(ordered) - q) < (0.001 if q < 0.02 or q > 0.98 else 0.01)
    none = tdigest.percentile_sketch(df.select(F.lit(None).cast("double").alias("v")).limit(2), [], "v").select(tdigest.percentile("digest", 0.5).alias("q")).first()
    assert none.q is None
    few = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert tdigest.percentile_sketch(few, [], "v").select(tdigest.percentile("digest", [0.0, 0.5, 1.0]).alias("q")).first().q == [1.0, 2.0, 3.0]
