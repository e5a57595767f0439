"""Connected components of a table of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of links (a, b), both long; root is the smallest node that can be reached.

    Each round hangs neighbours on the smallest node around them, so paths shorten by half; it ends when a round changes
    nothing.  Every round's links are a scratch table.  The smallest neighbour is a table of its own before it is joined,
    so that a node with very many links is a skewed join of two exchanges, which Spark splits.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = _sign(edges)
    while sign[0]:
        both = scratch.keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large, "large")
        low = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.keep(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        scratch.drop(edges, both, least, large, low)
        edges, was = now, sign
        if (sign := _sign(edges)) == was:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
