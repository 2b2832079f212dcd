"""First and last, histograms, counters that reset."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.bucket import kind_of, time_key

#: Histograms of more buckets are grouped by slot instead of counted slot by slot in one row.
WIDE = 256


def first(value: Column | str, at: Column | str) -> Column:
    """The value (null or not) at the earliest ``at``; rows without ``at`` do not count."""
    return F.min_by(value, at)


def last(value: Column | str, at: Column | str) -> Column:
    return F.max_by(value, at)


def first_state(value: Column | str, at: Column | str) -> Column:
    """What ``first`` needs to be merged: struct(at, value) of the earliest row; null if no row has ``at``."""
    c, t = (F.col(x) if isinstance(x, str) else x for x in (value, at))
    return F.min_by(F.struct(t.alias("at"), c.alias("value")), t)


def last_state(value: Column | str, at: Column | str) -> Column:
    c, t = (F.col(x) if isinstance(x, str) else x for x in (value, at))
    return F.max_by(F.struct(t.alias("at"), c.alias("value")), t)


def merge_first(state: str) -> Column:
    """The state of the earliest row of several states; its ``value`` is what ``first`` would give of all rows."""
    return F.min_by(F.col(state), F.col(f"{state}.at"))


def merge_last(state: str) -> Column:
    return F.max_by(F.col(state), F.col(f"{state}.at"))


def _slot(value: Column, low: float, high: float, n: int) -> Column:
    v = value.cast("double")
    inside = F.least(F.greatest((F.lit(float(n)) * ((v - low) / F.lit(high - low))).cast("long") + 1, F.lit(1)), F.lit(n))
    return F.when(v.isNull(), None).when(F.isnan(v) | (v >= high), n + 1).when(v < low, 0).otherwise(inside)


def _check(low: float, high: float, n: int) -> None:
    if not 1 <= n <= 100_000:
        raise ValueError("a histogram has 1 to 100000 buckets")
    if not (math.isfinite(low) and math.isfinite(high) and low < high):
        raise ValueError("a histogram's bounds are finite and in order")


def histogram(value: Column | str, low: float, high: float, n: int) -> Column:
    """An aggregate: counts below low, in n equal slots, and at or above high (NaN among them); null for no rows."""
    _check(low, high, n)
    if n > WIDE:
        raise ValueError(f"over {WIDE} buckets, use wide_histogram")
    slot = _slot(F.col(value) if isinstance(value, str) else value, low, high, n)
    return F.when(F.count(F.lit(1)) > 0, F.array(*[F.count_if(slot == i) for i in range(n + 2)]))


def wide_histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, n: int, name: str = "histogram") -> DataFrame:
    """As ``histogram`` by keys, for any number of buckets: counted by slot before slots are put together."""
    _check(low, high, n)
    counts = df.groupBy(*keys, _slot(F.col(value), low, high, n).alias("_slot")).agg(F.count("*").alias("_n"))
    pairs = F.map_from_entries(F.collect_list(F.when(F.col("_slot").isNotNull(), F.struct(F.col("_slot").cast("int"), F.col("_n")))))
    slots = F.transform(F.sequence(F.lit(0), F.lit(n + 1)), lambda i: F.coalesce(F.col("_map")[i], F.lit(0).cast("long")))
    out = counts.groupBy(*keys).agg(pairs.alias("_map"), F.count(F.lit(1)).alias("_rows"))
    return out.filter("_rows > 0").select(*keys, slots.alias(name)) if keys else out.select(F.when(F.col("_rows") > 0, slots).alias(name))


_SEGMENT = ("n", "first_at", "first_v", "last_at", "last_v", "increase")


def _steps(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    rows = df.filter(F.col(value).isNotNull() & F.col(at).isNotNull())
    w = Window.partitionBy(*keys).orderBy(at)
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v"), time_key(F.col(at), kind_of(df, at)).alias("_at"), F.lag(F.col(value).cast("double")).over(w).alias("_before"))
    return rows.withColumn("_step", F.when(F.col("_v") >= F.col("_before"), F.col("_v") - F.col("_before")).when(F.col("_before").isNotNull(), F.col("_v")).otherwise(0.0))


def counter_segments(df: DataFrame, keys: list[str], value: str, at: str, name: str = "segment") -> DataFrame:
    """What a counter did in each group, in a form that merges: count, ends, and increase with resets."""
    steps = _steps(df, keys, value, at)
    state = F.struct(
        F.count("*").alias("n"), F.min("_at").alias("first_at"), F.min_by("_v", "_at").alias("first_v"),
        F.max("_at").alias("last_at"), F.max_by("_v", "_at").alias("last_v"), F.sum("_step").alias("increase"),
    )
    return steps.groupBy(*keys).agg(state.alias(name))


def merge_segments(df: DataFrame, keys: list[str], segment: str = "segment") -> DataFrame:
    """Segments of one counter over disjoint stretches, joined in time; overlapping ones are an error."""
    w = Window.partitionBy(*keys).orderBy("_s.first_at", "_s.last_at")
    rows = df.filter(F.col(segment).isNotNull() & (F.col(f"{segment}.n") > 0)).select(*keys, F.col(segment).alias("_s"))
    rows = rows.withColumn("_b", F.lag("_s").over(w))
    gap = F.when(F.col("_s.first_v") >= F.col("_b.last_v"), F.col("_s.first_v") - F.col("_b.last_v")).otherwise(F.col("_s.first_v"))
    overlap = F.col("_b.last_at") > F.col("_s.first_at")
    rows = rows.withColumn("_j", F.when(F.col("_b").isNull(), 0.0).when(overlap, F.raise_error(F.lit("counter segments overlap in time")).cast("double")).otherwise(gap))
    state = F.struct(
        F.sum("_s.n").alias("n"), F.min("_s.first_at").alias("first_at"), F.min_by("_s.first_v", "_s.first_at").alias("first_v"),
        F.max("_s.last_at").alias("last_at"), F.max_by("_s.last_v", "_s.last_at").alias("last_v"), F.sum(F.col("_s.increase") + F.col("_j")).alias("increase"),
    )
    return rows.groupBy(*keys).agg(state.alias(segment))


def segment_delta(segment: str = "segment") -> Column:
    return F.when(F.col(f"{segment}.n") > 0, F.col(f"{segment}.increase"))


def segment_rate(segment: str = "segment") -> Column:
    """Increase a second (time in microseconds) between the ends; null for one point or no time."""
    took = F.col(f"{segment}.last_at") - F.col(f"{segment}.first_at")
    return F.when((F.col(f"{segment}.n") > 1) & (took > 0), F.col(f"{segment}.increase") / F.when(took != 0, took / 1e6))


def counter(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """counter_delta and counter_rate by keys. Groups without a point have null for both."""
    found = counter_segments(df, keys, value, at).select(*keys, segment_delta().alias("counter_delta"), segment_rate().alias("counter_rate"))
    if not keys:
        return found
    every = df.select(*keys).distinct()
    return every.alias("e").join(found.alias("f"), [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], "left").select(*[F.col(f"e.{k}") for k in keys], "counter_delta", "counter_rate")
