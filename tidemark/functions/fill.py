"""Filling gaps in ordered rows, by window functions over one sort per direction.

Without keys, or with few hot ones, a window is one task. ``slice_width`` cuts
the line of the order column (a time or a whole number) into slices that tasks
share: what comes into a slice from those before and after it is a row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.bucket import KINDS, kind_of, time_key
from tidemark.functions.width import Width

#: The slice of rows whose order column is null: after all others.
LAST = 1 << 62


def locf(value: Column | str, order_by: list, partition_by: list | None = None) -> Column:
    """The value or, where it is null, the last one before it that is not."""
    w = Window.partitionBy(*(partition_by or [])).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def _sliced(df: DataFrame, order_by: str, slice_width) -> DataFrame:
    """df with its slice in _s."""
    size = slice_width if isinstance(slice_width, int) else Width.parse(slice_width, months=False).micros
    return df.withColumn("_s", F.coalesce(F.floor(time_key(F.col(order_by), kind_of(df, order_by)) / F.lit(size)), F.lit(LAST)))


def _with(df: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of seeds, a row for each of keys and _s."""
    names = [*keys, "_s"]
    own = seeds.withColumnsRenamed({c: f"_seed_{c}" for c in names})
    on = [F.col(c).eqNullSafe(F.col(f"_seed_{c}")) for c in names]
    return df.join(own, on, "left").drop(*[f"_seed_{c}" for c in names])


def carried(df: DataFrame, value: str, order_by: str, partition_by: list[str] | None = None, *, slice_width, name: str | None = None) -> DataFrame:
    """df with ``locf`` of ``value``, worked out in slices."""
    keys = partition_by or []
    rows = _sliced(df, order_by, slice_width)
    each = rows.groupBy(*keys, "_s").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order_by))).alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    rows = _with(rows, each.select(*keys, "_s", F.last("_v", ignorenulls=True).over(before).alias("_seed")), keys)
    return rows.withColumn(name or value, F.coalesce(locf(value, [F.col(order_by).asc_nulls_last()], [*keys, "_s"]), "_seed")).drop("_s", "_seed")


def interpolate(df: DataFrame, value: str, order_by: str, partition_by: list[str] | None = None, *, at: str | None = None, name: str | None = None, slice_width=None) -> DataFrame:
    """df with nulls of ``value`` on the line between their neighbours: by row position, or by the time column ``at``.

    Values before the first anchor and after the last stay null, as do rows whose ``at`` is null; where both anchors
    have one time, the left value holds.
    """
    keys = partition_by or []
    rows = df.withColumn("_s", F.lit(0).cast("long")) if slice_width is None else _sliced(df, order_by, slice_width)
    inner = [*keys, "_s"]
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*inner).orderBy(F.col(order_by).asc_nulls_last())).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    if slice_width is not None and at is None:
        counts = rows.groupBy(*inner).agg(F.count("*").alias("_c"))
        rows = _with(rows, counts.select(*inner, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base")), keys).withColumn("_n", F.col("_n") + F.col("_base")).drop("_base")
    x = F.col("_n") if at is None else time_key(F.col(at), KINDS[dict(df.dtypes)[at]])
    rows = rows.withColumn("_x", x.cast("double")).withColumn("_v", F.col(value).cast("double"))
    rows = rows.withColumn("_a", F.when(F.col("_v").isNotNull() & F.col("_x").isNotNull(), F.struct(F.col("_v").alias("v"), F.col("_x").alias("x"))))
    along = Window.partitionBy(*inner).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    # The other way round the frame would be recomputed for every row.
    against = Window.partitionBy(*inner).orderBy(F.col("_n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    p, q = F.last("_a", ignorenulls=True).over(along), F.last("_a", ignorenulls=True).over(against)
    if slice_width is not None:
        known = F.when(F.col("_a").isNotNull(), F.col("_n"))
        ends = rows.groupBy(*inner).agg(F.max_by("_a", known).alias("_last"), F.min_by("_a", known).alias("_first"))
        later = Window.partitionBy(*keys).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
        rows = _with(rows, ends.select(*inner, F.last("_last", ignorenulls=True).over(earlier).alias("_before"), F.last("_first", ignorenulls=True).over(later).alias("_after")), keys)
        p, q = F.coalesce(p, "_before"), F.coalesce(q, "_after")
    work = rows.withColumn("_p", p).withColumn("_q", q)
    lv, lx, nv, nx = F.col("_p.v"), F.col("_p.x"), F.col("_q.v"), F.col("_q.x")
    line = F.when(nx == lx, lv).otherwise(lv + (nv - lv) * (F.col("_x") - lx) / F.when(nx != lx, nx - lx))
    out = F.when(F.col("_v").isNotNull(), F.col("_v")).when(F.col("_p").isNotNull() & F.col("_q").isNotNull() & F.col("_x").isNotNull(), line)
    return work.withColumn("_out", out).drop("_s", "_x", "_n", "_v", "_a", "_p", "_q", "_before", "_after", *([] if name else [value])).withColumnRenamed("_out", name or value)
