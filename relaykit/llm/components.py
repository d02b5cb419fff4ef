"""Connected components of an undirected graph, by alternating star contraction on shuffled edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaykit.llm.common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with a link to another one; ``component`` is the smallest node of its part.

    Each round lets every node point to the smallest node it knows of (large star: the larger neighbours of a
    node; small star: itself and the smaller ones). Rounds needed grow with the logarithm of the longest path.
    Links with a null end, and links from a node to itself, count for nothing. Repeated links count once.
    An empty table gives an empty result. Only minima are gathered, so a node with very many links is no problem.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # Large star: neighbours above u move to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = (
            moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = cut(small)
        # Settled when no node has two targets and no target points on.
        targets = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if targets.filter("n > 1").isEmpty() and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        edges = after
