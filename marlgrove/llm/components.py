"""Connected components by alternating stars; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, itself included."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_least(both), both["a"] == F.col("node"))
    return joined.filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: with a > b."""
    joined = edges.join(_least(edges), edges["a"] == F.col("node"))
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component, never the node itself) from pairs of longs a, b.

    Every node of an edge but the roots is in the result once. Each round's edges are checkpointed. Rounds
    go on until the edges stay as they are, after a number of them that grows with the logarithm of the nodes."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    seen = None
    while True:
        edges = _small_star(_large_star(edges)).checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
