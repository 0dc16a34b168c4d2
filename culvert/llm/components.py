"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.llm.exchange import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest
    node reachable. Self-loops and repeated edges are fine; no edges give no rows.

    Each step is joins and grouped minima, written to the shared folder; a hub's edges are split
    by Spark's skew join and combined before the shuffle.
    """
    loops = edges.filter("a = b").select("a", "b")
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a")
        now = written(
            linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        )
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.unionByName(loops).select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
