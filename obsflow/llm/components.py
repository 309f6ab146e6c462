"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.plans import runtime


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links`` (a, b bigint): the smallest node it reaches.

    Each round hangs every larger neighbour of a node, then every smaller one, below the
    smallest neighbour; the edges end up as stars around the smallest nodes.  A node's
    neighbours are never gathered: their minimum is an aggregate that is joined back.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = runtime.checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        sym = edges.select(both.alias("e")).select("e.a", "e.b")
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        edges = runtime.checkpoint(small.distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
