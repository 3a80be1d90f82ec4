"""Connected components by alternating large-star and small-star steps, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or to itself)."""
    both = _directed(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node itself, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node), for each node of an edge. Nulls and loops link nothing. Each round is
    written to the shared folder; the rounds grow with the logarithm of the longest chain."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    pairs = materialise(pairs, "links")
    state = None
    while True:
        pairs = materialise(_small_star(_large_star(pairs)).where("a <> b").distinct(), "links")
        seen = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    nodes = pairs.groupBy("a").agg(F.min("b").alias("b"))
    roots = pairs.select(F.col("b").alias("a")).distinct().join(nodes.select("a"), "a", "left_anti").withColumn("b", F.col("a"))
    return nodes.union(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, component) with further links (a, b) between its nodes or others; only the graph of components is searched."""
    if links.isEmpty():
        return found
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    above = components(ends).select(F.col("node").alias("component"), F.col("component").alias("above"))
    moved = found.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    new = above.join(found.select(F.col("component")).distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("above").alias("component"))
    return moved.union(new)
