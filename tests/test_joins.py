import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.joins import AGGREGATES, asof_join, window_join
from tidemark.operators.lastpoint import last_point

BASE = dt.datetime(2026, 1, 1)


def sides(spark):
    at = lambda c: F.timestamp_add("SECOND", c, F.lit("2026-01-01").cast("timestamp_ntz"))
    right = spark.range(3000).select(F.concat(F.lit("h"), F.col("id") % 50).alias("host"), at(F.col("id") * 7).alias("ts"), F.col("id").cast("double").alias("v"))
    left = spark.range(1500).select(F.concat(F.lit("h"), F.col("id") % 53).alias("host"), at(F.col("id") * 13 + 3).alias("ts"), F.col("id").alias("kind"))
    odd = lambda df, *vals: df.unionByName(spark.createDataFrame(list(vals), df.schema))
    return odd(left, (None, BASE, -1), ("h1", None, -2)), odd(right, (None, BASE, -1.0), ("h1", None, -2.0))


@pytest.mark.parametrize("keys", [["host"], []])
@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("within", [None, "60 seconds"])
@pytest.mark.parametrize("cut", [None, "20 minutes"])
def test_asof_matches_brute_force(spark, keys, direction, within, cut):
    left, right = sides(spark)
    got = asof_join(left, right, keys, "ts", direction=direction, within=within, slice_width=cut).collect()
    rights = [r for r in right.collect() if r.ts is not None and (r.host is not None or not keys)]
    limit = dt.timedelta(seconds=60) if within else None
    want = {}
    for x in left.collect():
        ok = [r for r in rights if x.ts is not None and (not keys or r.host == x.host) and (r.ts <= x.ts if direction == "backward" else r.ts >= x.ts)]
        best = (max if direction == "backward" else min)(ok, key=lambda r: r.ts, default=None)
        want[x.kind] = best.ts if best and (limit is None or abs(best.ts - x.ts) <= limit) else None
    assert len(got) == len(want) and {r.kind: r.r_ts for r in got} == want
    assert got[0].asDict().keys() == {"host", "ts", "kind", "r_host", "r_ts", "r_v"}


def test_window_join_matches_brute_force(spark):
    left, right = sides(spark)
    right = right.withColumn("v", F.when(F.col("v") % 97 != 0, F.col("v")))
    rights = [r for r in right.collect() if r.ts is not None and r.host is not None and r.v is not None]
    lefts = left.filter("kind % 10 = 0 or kind < 0").collect()
    for how in AGGREGATES:
        got = {r.kind: r.value for r in window_join(left, right, ["host"], "ts", "v", "10 minutes", "1 minute", how).collect()}
        for x in lefts:
            if x.host is None or x.ts is None:
                assert got[x.kind] is None
                continue
            near = sorted((r.ts, r.v) for r in rights if r.host == x.host and x.ts - dt.timedelta(minutes=10) <= r.ts <= x.ts + dt.timedelta(minutes=1))
            v = [b for _, b in near]
            want = {"count": float(len(v)), "sum": sum(v), "avg": sum(v) / len(v) if v else 0, "min": min(v, default=0), "max": max(v, default=0), "first": v[0] if v else 0, "last": v[-1] if v else 0}[how]
            assert got[x.kind] == (pytest.approx(want) if v or how == "count" else None)


def test_refusals(spark):
    left, right = sides(spark)
    for bad in (lambda: asof_join(left, right, ["host"], "ts", direction="sideways"), lambda: asof_join(left, right, ["host"], "ts", within="1 month"), lambda: window_join(left, right, ["host"], "ts", "v", "1 minute", aggregate="mode")):
        with pytest.raises(ValueError):
            bad()


def test_last_point(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "w"), (None, 5, "v")]
    df = spark.createDataFrame(rows, "k string, t int, s string")
    pick = lambda **kw: {r.k: r.s for r in last_point(df, ["k"], "t", **kw).collect()}
    assert pick() == {"a": "z", "b": "w", None: "v"}
    assert pick(nulls="last") == {"a": "y", "b": "w", None: "v"}
    assert pick(desc=False) == {"a": "x", "b": "w", None: "v"}
