"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentkit.llm.storage import stage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of *edges* (a, b longs): label is the least node of the component.

    Each round links the larger neighbours of a node to its least neighbour, then the smaller ones;
    minima are pre-aggregated before the shuffle, and a node with most of the edges meets a single
    row in the join, which Spark can split.  Rounds grow with the logarithm of the longest path.
    An edge table without rows gives no rows; loops, repeated and null edges are ignored.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _signature(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = stage(small.union(least.select("a", F.col("low").alias("b"))).distinct(), "edges")
        last, seen = seen, _signature(now)
        if last == seen:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
