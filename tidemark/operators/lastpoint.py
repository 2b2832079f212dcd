"""The last (or first) row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_point(df: DataFrame, keys: list[str], time: str, *, desc: bool = True, nulls: str | None = None) -> DataFrame:
    """One whole row a key: that with the greatest time (least, with ``desc=False``).

    nulls: where rows without a time stand, ``first`` or ``last``; by default first when descending, last when
    ascending. With nulls last the answer is a partial aggregate; otherwise a window with a group limit.
    """
    nulls = nulls or ("first" if desc else "last")
    if nulls not in ("first", "last"):
        raise ValueError("nulls is first or last")
    nullable = df.schema[time].nullable
    if nulls == "last" or not nullable:
        pick = F.max_by if desc else F.min_by
        row = F.struct(*df.columns)
        some = df.groupBy(*keys).agg(F.coalesce(pick(row, time), F.first(row)).alias("_row"))
        return some.select("_row.*")
    c = F.col(time)
    order = c.desc_nulls_first() if desc else c.asc_nulls_first()
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_k = 1").drop("_k")
