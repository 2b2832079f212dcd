"""All buckets of a stretch of time, as a distributed range."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bucket as B
from tidemark.functions.width import DAY, Width


def _clock(value: dt.datetime | dt.date) -> dt.datetime:
    return B.EPOCH + dt.timedelta(microseconds=B.micros(value))


def gapfill(spark: SparkSession, width, start, finish, *, origin=None, zone: str | None = None, kind: str = "ltz", name: str = "bucket") -> DataFrame:
    """Every bucket that overlaps [start, finish), in one column; the first may begin before start.

    start and finish are datetimes (without a zone: in UTC, or as written for ``ntz``), dates, or whole numbers.
    """
    if any(x is None or (isinstance(x, float) and not math.isfinite(x)) for x in (start, finish)):
        raise ValueError("a gap has two ends, both finite")
    if kind in ("long", "int"):
        first = start - (start - (origin or 0)) % width
        n = max(0, -(-(finish - first) // width))
        return spark.range(n).select((F.lit(first) + F.col("id") * width).cast("bigint" if kind == "long" else "int").alias(name))
    w = Width.parse(width)
    if kind == "date" and not w.calendar:
        raise ValueError("dates have buckets of whole days or months")
    if zone:
        if kind != "ltz":
            raise ValueError("only timestamps with a zone are bucketed by a time zone's clock")
        return _zoned(spark, w, start, finish, origin, zone, name)
    grid = _grid(spark, w, _clock(start), _clock(finish), _clock(origin) if origin else None)
    out = {"ltz": B.from_utc(F.col("g")), "ntz": F.col("g"), "date": F.col("g").cast("date")}[kind]
    return grid.select(out.alias(name))


def _grid(spark: SparkSession, w: Width, start: dt.datetime, finish: dt.datetime, origin: dt.datetime | None) -> DataFrame:
    """Column g: the grid's times from the last at or before start to the last before finish."""
    if not w.months:
        o = B.micros(origin or B.ORIGIN)
        first = B.micros(start) - (B.micros(start) - o) % w.micros
        n = max(0, -(-(B.micros(finish) - first) // w.micros)) if finish > start else 0
        return spark.range(n).select(F.timestamp_add("MICROSECOND", F.lit(first) + F.col("id") * w.micros, B.ntz(B.EPOCH)).alias("g"))
    begin = origin or B.MONTH_ORIGIN
    steps = lambda t: (t.year * 12 + t.month - begin.year * 12 - begin.month) // w.months
    low, n = steps(start) - 1, (steps(finish) - steps(start) + 3 if finish > start else 0)
    step = (F.lit(low) + F.col("id")) * w.months
    rows = spark.range(n).select((B.ntz(begin) + F.make_ym_interval(F.lit(0), step.cast("int"))).alias("g"))
    return rows.filter((F.col("g") < B.ntz(finish)) & (F.col("g") >= B._months(B.ntz(start), w.months, begin)))


def _zoned(spark: SparkSession, w: Width, start, finish, origin, zone: str, name: str) -> DataFrame:
    # The local clock is at most 26 hours from UTC.
    margin = dt.timedelta(hours=26)
    low, high = _clock(start), _clock(finish)
    if high <= low:
        return spark.range(0).select(F.col("id").cast("timestamp").alias(name))
    grid = _grid(spark, w, low - margin, high + margin, origin)
    local = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    if w.calendar:
        back = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("g"))
        found = grid.select(back.alias("c"))
    else:
        add = lambda t, n: F.timestamp_add("MICROSECOND", n, t)
        offset = lambda t: F.timestamp_diff("MICROSECOND", t, local(t))
        tries = [add(F.col("g"), -offset(add(F.col("g"), F.lit(d)))) for d in (-DAY, DAY)]
        found = grid.select("g", F.explode(F.array(*tries)).alias("c")).filter(local(F.col("c")) == F.col("g")).select("c")
    first = B._zone_bucket(B.ntz(low), w, zone, origin)
    return found.filter((F.col("c") >= first) & (F.col("c") < B.ntz(high))).distinct().select(B.from_utc(F.col("c")).alias(name))


def gapfilled(df: DataFrame, time: str, width, start, finish, aggregates: list, *, keys: list[str] | None = None, origin=None, zone: str | None = None, name: str = "bucket") -> DataFrame:
    """df aggregated by bucket (and keys), with a row for every bucket of the gap and key, even those without data."""
    keys = keys or []
    kind = B.kind_of(df, time)
    data = B.with_bucket(df, time, width, name, origin=origin, zone=zone).groupBy(name, *keys).agg(*aggregates)
    frame = gapfill(df.sparkSession, width, start, finish, origin=origin, zone=zone, kind=kind, name=name)
    if keys:  # a row for each bucket of each key is the result itself
        frame = frame.crossJoin(df.select(*keys).distinct())
    joined = frame.alias("f").join(data.alias("d"), [F.col(f"f.{c}").eqNullSafe(F.col(f"d.{c}")) for c in [name, *keys]], "left")
    values = [c for c in data.columns if c not in (name, *keys)]
    return joined.select(*[F.col(f"f.{c}") for c in [name, *keys]], *[F.col(f"d.{c}") for c in values])
