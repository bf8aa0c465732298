"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def _with_min(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) and m, the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour not larger than u, and u itself, is linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_min(down)
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def _tangled(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one; else all is stars around the smallest."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).filter("down > 1 or down > 0 and up > 0").count() > 0


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v), in any direction, repeated or not. (node, component), component the smallest node that is reachable.

    Nodes without an edge to another node are left out. A hub's edges are joined with one row, so that skewed hubs can
    be split at run time; the number of rounds grows with the logarithm of the number of nodes.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while _tangled(edges):
        edges = cut(small_star(large_star(edges)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
