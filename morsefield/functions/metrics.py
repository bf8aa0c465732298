"""Distances between two array<double> columns as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def _total(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def _safe(num: Column, den: Column, other: float = 0.0) -> Column:
    return F.when(den == 0, F.lit(other)).otherwise(num / F.when(den == 0, F.lit(1.0)).otherwise(den))


def _cosine(a: Column, b: Column) -> Column:
    return 1 - _safe(_sum(a, b, lambda x, y: x * y), F.sqrt(_total(a, lambda x: x * x)) * F.sqrt(_total(b, lambda x: x * x)))


def _centred(a: Column) -> Column:
    return F.transform(F.array(_total(a) / F.size(a)), lambda m: F.transform(a, lambda x: x - m))[0]


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0) -> Column:
    """euclidean, sqeuclidean, manhattan (cityblock), chebyshev, minkowski, cosine, correlation, hamming, canberra, braycurtis, jaccard."""
    if metric == "euclidean":
        return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "sqeuclidean":
        return _sum(a, b, lambda x, y: (x - y) * (x - y))
    if metric in ("manhattan", "cityblock", "l1"):
        return _sum(a, b, lambda x, y: F.abs(x - y))
    if metric == "chebyshev":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    if metric == "minkowski":
        return F.pow(_sum(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p))
    if metric == "cosine":
        return _cosine(a, b)
    if metric == "correlation":
        return _cosine(_centred(a), _centred(b))
    if metric == "hamming":
        return _sum(a, b, lambda x, y: (x != y).cast("double")) / F.size(a)
    if metric == "canberra":
        return _sum(a, b, lambda x, y: _safe(F.abs(x - y), F.abs(x) + F.abs(y)))
    if metric == "braycurtis":
        return _safe(_sum(a, b, lambda x, y: F.abs(x - y)), _sum(a, b, lambda x, y: F.abs(x + y)))
    if metric == "jaccard":
        return _safe(_sum(a, b, lambda x, y: (x != y).cast("double")), _sum(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("double")))
    raise ValueError(f"unknown metric {metric!r}")


def pairwise(points: DataFrame, metric: str = "euclidean", p: float = 2.0, *, max_distance: float | None = None, ordered: bool = False) -> DataFrame:
    """(cloud_id, src, dst, w) of the pairs within each cloud; src < dst unless ordered (then all pairs but the diagonal).

    One equi-join on cloud_id; a bound on the distance is a filter of that join. metric may be a callable on two columns.
    """
    a = points.select("cloud_id", F.col("point_id").alias("src"), F.col("coords").alias("_a"))
    b = points.select("cloud_id", F.col("point_id").alias("dst"), F.col("coords").alias("_b"))
    w = metric(F.col("_a"), F.col("_b")) if callable(metric) else distance(F.col("_a"), F.col("_b"), metric, p)
    out = a.join(b, "cloud_id").filter("src <> dst" if ordered else "src < dst").select("cloud_id", "src", "dst", w.alias("w"))
    return out if max_distance is None else out.filter(F.col("w") <= max_distance)


def symmetric(edges: DataFrame) -> DataFrame:
    """Each undirected edge in both directions."""
    return edges.unionByName(edges.select("cloud_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
