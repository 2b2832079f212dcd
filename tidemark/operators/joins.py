"""Joins in time: the nearest row, or an aggregate over a window around each row. One shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.bucket import kind_of, time_key
from tidemark.functions.width import Width

AGGREGATES = ("count", "sum", "avg", "min", "max", "first", "last")
#: Slices that a join without keys cuts the time line into, for each shuffle partition.
SLICES = 4


def _usable(df: DataFrame, keys: list[str], time: str) -> Column:
    ok = df[time].isNotNull()
    for k in keys:
        ok &= df[k].isNotNull()
    return ok


def _slice_width(df: DataFrame, time: str, kind: str) -> int:
    """A width that deals the times of df among the tasks of a shuffle."""
    key = time_key(F.col(time), kind)
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    n = SLICES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 if lo is None else max(1, -(-(hi - lo + 1) // n))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str | None = None, *, within=None, direction: str = "backward", prefix: str = "r_", slice_width=None) -> DataFrame:
    """Every left row once, with the nearest right row at or before it (or after: ``direction="forward"``) of equal keys.

    Right columns get ``prefix``. within: a nearest row further away does not count. Null keys and times match nothing,
    and take no part in the shuffle. slice_width: cuts time into slices that tasks share, for joins with few hot keys;
    each slice is seeded with the last right row before it. Without keys, slices are cut by themselves.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    right_time = right_time or left_time
    kind = kind_of(left, left_time)
    if kind != kind_of(right, right_time):
        raise ValueError(f"{left_time} and {right_time} are of different kinds")
    limit = None
    if within is not None:
        if kind in ("long", "int"):
            raise ValueError("within needs times, not whole numbers")
        limit = Width.parse(within, positive=False, months=False).micros
    l_time, r_time = time_key(F.col(left_time), kind), time_key(F.col(right_time), kind)
    row = F.struct(F.struct(*right.columns).alias("row"), r_time.alias("t"))
    r_rows = right.filter(_usable(right, keys, right_time)).select(*keys, r_time.alias("_t"), F.lit(0).alias("_side"), row.alias("_r"))
    l_rows = left.filter(_usable(left, keys, left_time)).select(*keys, l_time.alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    sign = 1 if direction == "backward" else -1
    both = l_rows.unionByName(r_rows, allowMissingColumns=True).withColumn("_o", F.col("_t") * sign)
    by = [*keys]
    if slice_width is not None or not keys:
        size = slice_width if isinstance(slice_width, int) else Width.parse(slice_width, months=False).micros if slice_width is not None else _slice_width(left, left_time, kind)
        both = both.withColumn("_slice", F.floor(F.col("_o") / F.lit(size)))
        each = both.groupBy(*keys, "_slice").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.col("_o"))).alias("_r"))
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        seeds = each.withColumn("_r", F.last("_r", ignorenulls=True).over(before)).filter(F.col("_r").isNotNull() & F.col("_slice").isNotNull())
        both = both.unionByName(seeds.withColumn("_t", F.col("_r.t")).withColumn("_o", F.col("_r.t") * sign).withColumn("_side", F.lit(0)), allowMissingColumns=True)
        by = [*keys, "_slice"]
    frame = Window.partitionBy(*by).orderBy("_o", "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("_side") == 0, F.col("_r")), ignorenulls=True).over(frame)
    out = both.withColumn("_m", near).filter("_side = 1")
    match = F.lit(True) if limit is None else F.abs(F.col("_t") - F.col("_m.t")) <= limit
    out = out.withColumn("_m", F.when(match, F.col("_m.row")))
    found = out.select("_l.*", *[F.col("_m")[c].alias(f"{prefix}{c}") for c in right.columns])
    rest = left.filter(~_usable(left, keys, left_time))
    nothing = rest.select("*", *[F.lit(None).cast(f.dataType).alias(f"{prefix}{f.name}") for f in right.schema.fields])
    return found.union(nothing)


def _running(aggregate: str, value: Column, at: Column, frame, newest_first: bool) -> dict[str, Column]:
    """What the rows of a frame that grows row by row say of their values."""
    if aggregate in ("min", "max"):
        return {"v": getattr(F, aggregate)(value).over(frame)}
    if aggregate in ("first", "last"):
        # The value that came last into the frame, or the one that has been in it from its beginning.
        latest = F.last(value, ignorenulls=True)
        earliest = (F.max_by if newest_first else F.min_by)(value, F.when(value.isNotNull(), at))
        return {"v": (latest if (aggregate == "last") != newest_first else earliest).over(frame)}
    return {"n": F.count(value).over(frame), "v": F.sum(value).over(frame)}


def window_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, value: str, before, after="0", aggregate: str = "avg", right_time: str | None = None, *, name: str = "value") -> DataFrame:
    """Every left row once, with an aggregate (a double) of right values at times in [t - before, t + after].

    Null values are in no window. An empty window gives null (0 for count), a left row with a null key or time null.

    Time is cut into slices as long as a window, which therefore ends in one slice and begins in that or the one
    before: it is the end of the one and the beginning of the other. Both are running aggregates, so that the work is
    linear however long the windows are, and exact. Right rows go to their own slice and to the next; tasks share the
    slices of a key, or of all rows where there are no keys.
    """
    if aggregate not in AGGREGATES:
        raise ValueError(f"aggregate is one of {', '.join(AGGREGATES)}")
    right_time = right_time or left_time
    kind = kind_of(left, left_time)
    if kind in ("long", "int"):
        raise ValueError("a window join needs times, not whole numbers")
    if kind != kind_of(right, right_time):
        raise ValueError(f"{left_time} and {right_time} are of different kinds")
    low, high = (Width.parse(x, positive=False, months=False).micros for x in (before, after))
    size = low + high + 1
    l_time, r_time = time_key(F.col(left_time), kind), time_key(F.col(right_time), kind)
    of = lambda t: F.expr(f"_t div {size}") - F.when(F.expr(f"_t < 0 and _t % {size} != 0"), 1).otherwise(0)
    rights = right.filter(_usable(right, keys, right_time) & F.col(value).isNotNull()).select(*keys, r_time.alias("_t"), F.col(value).cast("double").alias("_v")).withColumn("_s", of("_t"))
    no_time, no_value = F.lit(None).cast("long"), F.lit(None).cast("double")
    here = F.struct(F.col("_s"), F.col("_t").alias("_up"), no_time.alias("_down"), F.col("_v"), no_value.alias("_old"))
    older = F.struct((F.col("_s") + 1).alias("_s"), no_time.alias("_up"), F.col("_t").alias("_down"), no_value.alias("_v"), F.col("_v").alias("_old"))
    rights = rights.select(*keys, F.explode(F.array(here, older)).alias("_x")).select(*keys, "_x.*", F.lit(0).alias("_side"))
    lefts = left.filter(_usable(left, keys, left_time)).select(*keys, F.struct(*left.columns).alias("_l"), (l_time + high).alias("_t")).withColumn("_s", of("_t"))
    lefts = lefts.select(*keys, "_s", F.col("_t").alias("_up"), (F.col("_t") - (size - 1)).alias("_down"), F.lit(1).alias("_side"), "_l")
    rows = lefts.unionByName(rights, allowMissingColumns=True)
    dealt = Window.partitionBy(*keys, "_s")
    upward = dealt.orderBy("_up", "_side").rowsBetween(Window.unboundedPreceding, 0)
    downward = dealt.orderBy(F.col("_down").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    begun = _running(aggregate, F.col("_v"), F.col("_up"), upward, False)
    ended = _running(aggregate, F.col("_old"), F.col("_down"), downward, True)
    for k, c in begun.items():
        rows = rows.withColumn(f"_new_{k}", c)
    for k, c in ended.items():
        rows = rows.withColumn(f"_old_{k}", c)
    new, old = F.col("_new_v"), F.col("_old_v")
    total = F.coalesce(new + old, new, old)
    out = {
        "count": lambda: F.col("_new_n") + F.col("_old_n"),
        "sum": lambda: total,
        "avg": lambda: total / F.nullif(F.col("_new_n") + F.col("_old_n"), F.lit(0)),
        "min": lambda: F.least(new, old),
        "max": lambda: F.greatest(new, old),
        "first": lambda: F.coalesce(old, new),
        "last": lambda: F.coalesce(new, old),
    }[aggregate]()
    found = rows.filter("_side = 1").select("_l.*", out.cast("double").alias(name))
    return found.union(left.filter(~_usable(left, keys, left_time)).select("*", F.lit(None).cast("double").alias(name)))
