"""Connected components by alternating large and small stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    across = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, less than itself, that is no u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"), (F.col("v") > F.col("u")).alias("wrong"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"), F.lit(False).alias("wrong")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"), F.max("wrong").alias("wrong"))
    return nodes.filter("wrong or below > 1 or (below = 1 and above = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """For edges (u, v) of longs: (u, v) with v the least node of u's component, for every u that is not itself least.

    Rounds end when the edges are stars, so that none is made to see that nothing changes. They grow as the logarithm of a component's size.
    """
    edges = materialize(edges.filter("u != v").select("u", "v").distinct(), "edges")
    while not _are_stars(edges):
        done, edges = edges, materialize(_small_star(_large_star(edges)), "stars")
        discard(done)
    return edges
