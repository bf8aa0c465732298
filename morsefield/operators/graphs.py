"""Clouds and graphs: rescaled distances, neighbour graphs, geodesics, transitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import pairwise
from .timeseries import ordinal_pattern


def consistent_rescaling(points: DataFrame, metric: str = "euclidean", neighbor_rank: int = 1) -> DataFrame:
    """(cloud_id, src, dst, w / sqrt(rho(src) * rho(dst))), rho the distance to the neighbour of that rank (rank 0: itself)."""
    e = pairwise(points, metric, ordered=True)
    if neighbor_rank == 0:
        return e.withColumn("w", F.lit(float("inf")))
    w = Window.partitionBy("cloud_id", "src").orderBy("w", "dst")
    rho = e.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == neighbor_rank).select("cloud_id", F.col("src").alias("v"), F.col("w").alias("rho"))
    a, b = rho.toDF("cloud_id", "src", "_ra"), rho.toDF("cloud_id", "dst", "_rb")
    return e.join(a, ["cloud_id", "src"]).join(b, ["cloud_id", "dst"]).select("cloud_id", "src", "dst", F.try_divide("w", F.sqrt(F.col("_ra") * F.col("_rb"))).alias("w"))


def consecutive_rescaling(points: DataFrame, metric: str = "euclidean", factor: float = 0.0) -> DataFrame:
    """All ordered pairs; only the entries (i, i + 1) are multiplied by the factor, not their mirror images."""
    e = pairwise(points, metric, ordered=True)
    return e.withColumn("w", F.when(F.col("dst") == F.col("src") + 1, F.col("w") * factor).otherwise(F.col("w")))


def knn_graph(points: DataFrame, n_neighbors: int = 4, mode: str = "connectivity", metric: str = "euclidean", p: float = 2.0) -> DataFrame:
    """Directed edges to the nearest others (ties: lower point_id); w is 1 or the distance."""
    w = Window.partitionBy("cloud_id", "src").orderBy("w", "dst")
    e = pairwise(points, metric, p, ordered=True).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n_neighbors).drop("_k")
    return e if mode == "distance" else e.withColumn("w", F.lit(1.0))


def shortest_paths(n: int, s: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """All shortest paths of n vertices with edges s -> t of lengths w >= 0, inf where there is none.

    Sparse graphs: all edges into a vertex are relaxed at once, for a block of sources at a time, until nothing changes.
    Dense ones: by allowing one more vertex on the way after another.
    """
    if 8 * len(s) >= n * n:
        d = np.full((n, n), np.inf)
        np.minimum.at(d, (s, t), w)
        np.fill_diagonal(d, 0)
        for k in range(n):
            np.minimum(d, d[:, k, None] + d[None, k], out=d)
        return d
    order = np.argsort(t, kind="stable")
    s, t, w = s[order], t[order], w[order]
    into, first = np.unique(t, return_index=True)
    out = np.full((n, n), np.inf)
    np.fill_diagonal(out, 0)
    for k in range(0, n if len(s) else 0, 256):
        d = out[k : k + 256]
        while True:
            new = np.minimum(d[:, into], np.minimum.reduceat(d[:, s] + w, first, axis=1))
            if not (new < d[:, into]).any():
                break
            d[:, into] = new
    return out


def geodesic_distance(edges: DataFrame, directed: bool = False, unweighted: bool = False) -> DataFrame:
    """(cloud_id, src, dst, w) of the reachable ordered pairs: all shortest paths of each graph, one graph a group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[pdf["src"], pdf["dst"]])
        s, t = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
        w = np.ones(len(pdf)) if unweighted else pdf["w"].to_numpy(float)
        if not directed:
            s, t, w = np.r_[s, t], np.r_[t, s], np.r_[w, w]
        d = shortest_paths(len(ids), s, t, w)
        i, j = np.nonzero(np.isfinite(d))
        return pd.DataFrame({"cloud_id": pdf["cloud_id"].iloc[0], "src": ids[i].astype("int32"), "dst": ids[j].astype("int32"), "w": d[i, j]})

    return edges.select("cloud_id", "src", "dst", "w").groupBy("cloud_id").applyInPandas(one, "cloud_id long, src int, dst int, w double")


def transition_graph(rows: DataFrame, state, by: str = "series_id") -> DataFrame:
    """(by, src, dst, n): transitions between different successive states; rows: (by, t, ...), state: a Column.

    States are numbered within each collection in ascending order. Each occurrence counts.
    """
    own = rows.select(by, "t", state.alias("_s"))
    own = own.withColumn("_id", F.dense_rank().over(Window.partitionBy(by).orderBy("_s")) - 1)
    nxt = F.lead("_id").over(Window.partitionBy(by).orderBy("t"))
    return own.withColumn("_n", nxt).filter("_n is not null and _n <> _id").groupBy(by, F.col("_id").alias("src"), F.col("_n").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def ordinal_transitions(vectors: DataFrame) -> DataFrame:
    return transition_graph(vectors, ordinal_pattern(F.col("vector")))
