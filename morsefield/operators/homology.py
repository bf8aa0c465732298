"""Persistent homology of collections: one cloud, graph or image a group, kernels in grouped Arrow functions.

Before a kernel runs, its input is reduced to the columns it needs; edges above a threshold never reach it. Output
(cloud_id, hdim, birth, death), raw; ``diagrams.finish`` applies the conventions on essential classes and infinite deaths.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import complexes as cx
from ..functions.metrics import pairwise

OUT = "cloud_id long, hdim int, birth double, death double"


def _frame(key, found) -> pd.DataFrame:
    return pd.DataFrame([(key, d, b, e) for d, b, e in found if b < e], columns=["cloud_id", "hdim", "birth", "death"])


def _by_cloud(points: DataFrame, kernel, top: int, coeff: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("point_id")["coords"].tolist(), float)
        return _frame(pdf["cloud_id"].iloc[0], (p for p in cx.persistence(kernel(x), coeff) if p[0] <= top))

    return points.select("cloud_id", "point_id", "coords").groupBy("cloud_id").applyInPandas(one, OUT)


def _euclidean(x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    """Edges (src, dst, w), in either direction, as a symmetric matrix; rows with src = dst are vertices (and their weights)."""
    ids = np.unique(np.r_[pdf["src"], pdf["dst"]])
    s, t = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
    d = np.full((len(ids), len(ids)), np.inf)
    np.fill_diagonal(d, 0)
    d[t, s] = pdf["w"]
    d[s, t] = pdf["w"]
    return d


def _edges_of(points: DataFrame, metric, limit: float, p: float) -> DataFrame:
    e = pairwise(points, metric, p, max_distance=None if limit == math.inf else limit)
    return e.unionByName(points.select("cloud_id", F.col("point_id").alias("src"), F.col("point_id").alias("dst"), F.lit(0.0).alias("w")))


#: Metrics that kernels compute from coordinates; others, and callables, come as edges.
MATRIX = {
    "euclidean": lambda x, p: _euclidean(x),
    "sqeuclidean": lambda x, p: ((x[:, None] - x[None]) ** 2).sum(-1),
    "manhattan": lambda x, p: np.abs(x[:, None] - x[None]).sum(-1),
    "cityblock": lambda x, p: np.abs(x[:, None] - x[None]).sum(-1),
    "l1": lambda x, p: np.abs(x[:, None] - x[None]).sum(-1),
    "chebyshev": lambda x, p: np.abs(x[:, None] - x[None]).max(-1, initial=0.0),
    "minkowski": lambda x, p: (np.abs(x[:, None] - x[None]) ** p).sum(-1) ** (1 / p),
}


def rips(data: DataFrame, metric="euclidean", dimensions: tuple[int, ...] = (0, 1), coeff: int = 2, max_edge_length: float = math.inf, collapse_edges: bool = False, p: float = 2.0) -> DataFrame:
    """Vietoris-Rips persistence of clouds (cloud_id, point_id, coords), or of edges (cloud_id, src, dst, w) with metric 'precomputed'.

    Coordinates go to the kernel, n rows a cloud. Edges longer than the enclosing distance change nothing and are left out;
    collapse_edges also leaves out or delays dominated ones before cliques are listed, which changes no diagram.
    """
    top = max(dimensions)

    def diagram(cloud, d: np.ndarray) -> pd.DataFrame:
        if top == 0:
            deaths = cx.minimum_spanning(d, max_edge_length)
            found = [(0, 0.0, w) for w in deaths] + [(0, 0.0, math.inf)] * (len(d) - len(deaths))
        else:
            limit = min(max_edge_length, cx.enclosing_distance(d))
            found = cx.persistence(cx.flag_complex(cx.collapsed_edges(d, limit) if collapse_edges else d, top + 1, limit), coeff)
        return _frame(cloud, (x for x in found if x[0] in dimensions))

    if not callable(metric) and metric in MATRIX:

        def of_points(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.array(pdf.sort_values("point_id")["coords"].tolist(), float)
            return diagram(pdf["cloud_id"].iloc[0], MATRIX[metric](x.reshape(len(pdf), -1), p))

        return data.select("cloud_id", "point_id", "coords").groupBy("cloud_id").applyInPandas(of_points, OUT)
    edges = data.filter(F.col("w") <= max_edge_length) if metric == "precomputed" else _edges_of(data, metric, max_edge_length, p)
    of_edges = lambda pdf: diagram(pdf["cloud_id"].iloc[0], _matrix(pdf))
    return edges.select("cloud_id", "src", "dst", "w").groupBy("cloud_id").applyInPandas(of_edges, OUT)


def dtm_weights(points: DataFrame, n_neighbors: int = 3, r: float = 2.0, metric: str = "euclidean") -> DataFrame:
    """(cloud_id, v, w): twice the distance to measure, from the nearest others by a ranking window."""
    w = Window.partitionBy("cloud_id", "src").orderBy("w", "dst")
    near = pairwise(points, metric, ordered=True).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n_neighbors)
    return near.groupBy("cloud_id", F.col("src").alias("v")).agg((2 * F.pow(F.sum(F.pow("w", F.lit(float(r)))) / (n_neighbors + 1), F.lit(1.0 / r))).alias("w"))


def weighted_edges(points: DataFrame, weights: DataFrame, p: float = 1.0, metric: str = "euclidean") -> DataFrame:
    """(cloud_id, src, dst, w): src < dst edges, and vertex weights in the rows src = dst."""
    a, b = weights.toDF("cloud_id", "src", "_a"), weights.toDF("cloud_id", "dst", "_b")
    e = pairwise(points, metric).join(a, ["cloud_id", "src"]).join(b, ["cloud_id", "dst"])
    x, y, d = F.col("_a"), F.col("_b"), F.col("w")
    big = F.greatest(x, y)
    if p == math.inf:
        t = F.greatest(d, big)
    elif p == 1:
        t = F.when(2 * d <= F.abs(x - y), big).otherwise((2 * d + x + y) / 2)
    elif p == 2:
        root = F.sqrt(((x + y) * (x + y) + 4 * d * d) * ((x - y) * (x - y) + 4 * d * d)) / (4 * F.when(d > 0, d).otherwise(1.0))
        t = F.when(2 * d <= F.sqrt(F.abs(x * x - y * y)), big).otherwise(root)
    else:
        raise ValueError("p has to be 1, 2 or inf")
    return e.select("cloud_id", "src", "dst", t.alias("w")).unionByName(weights.select("cloud_id", F.col("v").alias("src"), F.col("v").alias("dst"), "w"))


def weighted_rips(points: DataFrame, weights="DTM", p: float = 1.0, n_neighbors: int = 3, r: float = 2.0, metric: str = "euclidean", dimensions=(0, 1), coeff: int = 2, max_edge_weight: float = math.inf) -> DataFrame:
    """weights: 'DTM', or a DataFrame (cloud_id, v, w)."""
    own = dtm_weights(points, n_neighbors, r, metric) if isinstance(weights, str) else weights
    edges = weighted_edges(points, own, p, metric).filter(F.col("w") <= max_edge_weight)
    top = max(dimensions)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        loops = pdf[pdf["src"] == pdf["dst"]].sort_values("src")
        ids = loops["src"].to_numpy()
        rest = pdf[(pdf["src"] != pdf["dst"]) & pdf["src"].isin(ids) & pdf["dst"].isin(ids)]
        d = np.full((len(ids), len(ids)), np.inf)
        s, t = np.searchsorted(ids, rest["src"]), np.searchsorted(ids, rest["dst"])
        d[s, t] = d[t, s] = rest["w"]
        found = cx.persistence(cx.flag_complex(d, top + 1, max_edge_weight, loops["w"].to_numpy(float)), coeff)
        return _frame(pdf["cloud_id"].iloc[0], (x for x in found if x[0] in dimensions))

    return edges.groupBy("cloud_id").applyInPandas(one, OUT)


def sparse_rips(points: DataFrame, epsilon: float = 0.1, dimensions=(0, 1), coeff: int = 2, max_edge_length: float = math.inf) -> DataFrame:
    top = max(dimensions)
    return _by_cloud(points, lambda x: cx.sparse_rips(_euclidean(x), epsilon, top + 1, max_edge_length), top, coeff).filter(F.col("hdim").isin(list(dimensions)))


def weak_alpha(points: DataFrame, dimensions=(0, 1), coeff: int = 2, max_edge_length: float = math.inf) -> DataFrame:
    """Flag complex on the edges of the Delaunay triangulation."""
    top = max(dimensions)

    def kernel(x: np.ndarray) -> list:
        d = np.full((len(x), len(x)), np.inf)
        for i, j in cx.delaunay_edges(x):
            d[i, j] = d[j, i] = math.dist(x[i], x[j])
        return cx.flag_complex(d, top + 1, max_edge_length)

    return _by_cloud(points, kernel, top, coeff).filter(F.col("hdim").isin(list(dimensions)))


def cech(points: DataFrame, dimensions=(0, 1), coeff: int = 2, max_edge_length: float = math.inf) -> DataFrame:
    """Radius of the smallest enclosing ball; max_edge_length is such a radius."""
    top = max(dimensions)
    return _by_cloud(points, lambda x: cx.cech_complex(x, top + 1, max_edge_length), top, coeff).filter(F.col("hdim").isin(list(dimensions)))


def flagser(edges: DataFrame, directed: bool = True, filtration: str = "max", dimensions=(0, 1), coeff: int = 2, max_edge_weight: float = math.inf) -> DataFrame:
    """Directed flag complexes of (cloud_id, src, dst, w); rows src = dst are vertices with their weights."""
    top = max(dimensions)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[pdf["src"], pdf["dst"]])
        w = np.full((len(ids), len(ids)), np.inf)
        np.fill_diagonal(w, 0)
        w[np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])] = pdf["w"]
        found = cx.persistence(cx.directed_flag_complex(w, top + 1, max_edge_weight, filtration, directed), coeff)
        return _frame(pdf["cloud_id"].iloc[0], (x for x in found if x[0] in dimensions))

    return edges.select("cloud_id", "src", "dst", "w").groupBy("cloud_id").applyInPandas(one, OUT)


def directed_cliques(edges: DataFrame, size: int) -> DataFrame:
    """(cloud_id, n): ordered cliques of 1 to 4 vertices, by joining edges with themselves."""
    e = edges.filter("src <> dst").select("cloud_id", "src", "dst")
    if size == 2:
        return e.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    ab, ac, bc = e.toDF("cloud_id", "a", "b"), e.toDF("cloud_id", "a", "c"), e.toDF("cloud_id", "b", "c")
    abc = ab.join(bc, ["cloud_id", "b"]).join(ac, ["cloud_id", "a", "c"])
    if size == 4:
        abc = abc.join(e.toDF("cloud_id", "c", "d"), ["cloud_id", "c"]).join(e.toDF("cloud_id", "b", "d"), ["cloud_id", "b", "d"]).join(e.toDF("cloud_id", "a", "d"), ["cloud_id", "a", "d"])
    return abc.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))


def cubical(img: DataFrame, dimensions=(0, 1), coeff: int = 2, periodic: tuple[bool, ...] | None = None) -> DataFrame:
    """Sublevel persistence of long images (img_id, r, c[, z], v)."""
    ax = [a for a in ("r", "c", "z") if a in img.columns]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full([int(pdf[a].max()) + 1 for a in ax], np.inf)
        grid[tuple(pdf[a].to_numpy(int) for a in ax)] = pdf["v"]
        found = cx.pixel_components(grid, periodic) if max(dimensions) == 0 else cx.persistence(cx.cubical_complex(grid, periodic), coeff)
        return _frame(pdf["img_id"].iloc[0], (x for x in found if x[0] in dimensions))

    return img.select("img_id", *ax, "v").groupBy("img_id").applyInPandas(one, OUT)


def betti_curve_at(dgm: DataFrame, thresholds: list[float], id_col: str = "cloud_id") -> DataFrame:
    """(id, hdim, t, n): classes alive at each threshold (birth <= t < death)."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds)))
    return dgm.select(id_col, "hdim", "birth", "death", t.alias("t")).filter((F.col("birth") <= F.col("t")) & (F.col("t") < F.col("death"))).groupBy(id_col, "hdim", "t").agg(F.count(F.lit(1)).alias("n"))


# --- local homology --------------------------------------------------------------------------------------------------


def knn_neighborhood(points: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(cloud_id, src, dst): the k nearest points of each point, itself first."""
    own = points.select("cloud_id", F.col("point_id").alias("src"), F.col("point_id").alias("dst"), F.lit(0.0).alias("w"))
    e = pairwise(points, metric, ordered=True).unionByName(own)
    w = Window.partitionBy("cloud_id", "src").orderBy("w", (F.col("src") != F.col("dst")), "dst")
    return e.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).select("cloud_id", "src", "dst")


def radius_neighborhood(points: DataFrame, radius: float, metric: str = "euclidean") -> DataFrame:
    """(cloud_id, src, dst): points within the radius, itself among them."""
    own = points.select("cloud_id", F.col("point_id").alias("src"), F.col("point_id").alias("dst"))
    return pairwise(points, metric, max_distance=radius, ordered=True).select("cloud_id", "src", "dst").unionByName(own)


def local_rips(points: DataFrame, neighborhoods: tuple[float, float] = (1, 2), kind: str = "radius", metric: str = "euclidean", dimensions=(1, 2), coeff: int = 2) -> DataFrame:
    """Persistence of each point's larger neighbourhood with the annulus around the smaller one coned off.

    (cloud_id, point_id, hdim, birth, death). The two sizes are put in order.
    """
    small, large = sorted(neighborhoods)
    f = radius_neighborhood if kind == "radius" else (lambda p, n, m: knn_neighborhood(p, int(n), m))
    near, wide = f(points, small, metric), f(points, large, metric)
    both = wide.join(near.withColumn("_close", F.lit(True)), ["cloud_id", "src", "dst"], "left")
    own = both.join(points.select("cloud_id", F.col("point_id").alias("dst"), "coords"), ["cloud_id", "dst"]).select("cloud_id", "src", "dst", "coords", F.coalesce("_close", F.lit(False)).alias("close"))
    top = max(dimensions)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["close", "dst"], ascending=[False, True])
        x, close = np.array(pdf["coords"].tolist(), float), pdf["close"].to_numpy(bool)
        n = len(x)
        d = np.zeros((n + 1, n + 1))
        d[:n, :n] = _euclidean(x)
        d[n, :n] = d[:n, n] = np.where(close, np.inf, 0.0)
        found = cx.persistence(cx.flag_complex(d, top + 1), coeff)
        k, s = pdf["cloud_id"].iloc[0], pdf["src"].iloc[0]
        return pd.DataFrame([(k, s, *p) for p in found if p[0] in dimensions and p[1] < p[2]], columns=["cloud_id", "point_id", "hdim", "birth", "death"])

    return own.groupBy("cloud_id", "src").applyInPandas(one, "cloud_id long, point_id int, hdim int, birth double, death double")
