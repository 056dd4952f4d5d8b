"""Connected components of a graph of integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feaslens.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) reaches, by alternating large and small stars.

    Each round is written to the shared folder. The number of rounds grows with the square of the logarithm of the nodes at most.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    pairs = stored(pairs, "edges")
    while not _flat(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour is hung on the smallest neighbour of the node (or the node itself).
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: the smaller neighbours and the node itself are hung on the smallest neighbour.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = stored(small.filter("u <> v").distinct(), "edges")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _flat(pairs: DataFrame) -> bool:
    """Whether every node has one parent at most, and no parent has one."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        pairs.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    bad = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).filter("child > 1 or child = 1 and parent = 1")
    return bad.isEmpty()
