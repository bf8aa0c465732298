"""Queries on clouds of embeddings and on graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import pairwise
from ..operators import graphs
from ..operators import timeseries as ts
from ..sources import tables
from .registry import query, r
from .timeseries import PATTERN, S

C = "c AS (SELECT vec_id // 10 AS cloud_id, (vec_id % 10)::INT AS point_id, embedding::DOUBLE[] AS x FROM embeddings)"
METRICS = {
    "euclidean": "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "sqeuclidean": "list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "manhattan": "list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2])))",
    "chebyshev": "list_max(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2])))",
    "minkowski": "pow(list_sum(list_transform(list_zip(a.x, b.x), lambda p: pow(abs(p[1] - p[2]), 3))), 1.0 / 3)",
    "cosine": "1 - list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.x, lambda v: v * v))) * sqrt(list_sum(list_transform(b.x, lambda v: v * v))))",
    "canberra": "list_sum(list_transform(list_zip(a.x, b.x), lambda p: CASE WHEN p[1] = 0 AND p[2] = 0 THEN 0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END))",
    "braycurtis": "list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2]))) / list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] + p[2])))",
    "hamming": "list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] <> p[2])::INT)) / len(a.x)::DOUBLE",
    "jaccard": "list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] <> p[2])::INT)) / list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] <> 0 OR p[2] <> 0)::INT))::DOUBLE",
}


def edges_sql(metric: str = "euclidean", on: str = "a.point_id < b.point_id", cloud: str = C) -> str:
    return f"{cloud}, e AS (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst, {METRICS[metric]} AS w FROM c a JOIN c b ON a.cloud_id = b.cloud_id AND {on})"


ORDERED = "a.point_id <> b.point_id"

for _m in METRICS:

    @query(f"cloud_pairwise_{_m}", f"WITH {edges_sql(_m)} SELECT cloud_id, src, dst, round(w, 6) + 0.0 AS w FROM e")
    def _(spark, sf, m=_m):
        return pairwise(tables.clouds(spark, sf), m, 3.0).withColumn("w", r("w"))


@query("cloud_pairwise_correlation", f"WITH {C}, l AS (SELECT cloud_id, point_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM c), k AS (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst, 1 - corr(a.v, b.v) AS w FROM l a JOIN l b ON a.cloud_id = b.cloud_id AND a.i = b.i AND a.point_id < b.point_id GROUP BY ALL) SELECT cloud_id, src, dst, round(w, 6) + 0.0 AS w FROM k")
def _(spark, sf):
    return pairwise(tables.clouds(spark, sf), "correlation").withColumn("w", r("w"))


@query("cloud_check", f"WITH {C} SELECT cloud_id, count(*) AS points, min(len(x))::BIGINT AS dims, NULL::VARCHAR AS problem FROM c GROUP BY ALL")
def _(spark, sf):
    return tables.check_clouds(tables.clouds(spark, sf))


@query("cloud_consistent_rescaling", f"""WITH {edges_sql(on=ORDERED)}, k AS (SELECT cloud_id, src AS v, min(w) AS rho FROM e GROUP BY ALL)
SELECT e.cloud_id, src, dst, round(w / sqrt(a.rho * b.rho), 6) + 0.0 AS w FROM e JOIN k a ON a.cloud_id = e.cloud_id AND a.v = src JOIN k b ON b.cloud_id = e.cloud_id AND b.v = dst""")
def _(spark, sf):
    return graphs.consistent_rescaling(tables.clouds(spark, sf)).withColumn("w", r("w"))


@query("cloud_consecutive_rescaling", f"WITH {edges_sql(on=ORDERED)} SELECT cloud_id, src, dst, round(CASE WHEN dst = src + 1 THEN w * 0.5 ELSE w END, 6) + 0.0 AS w FROM e")
def _(spark, sf):
    return graphs.consecutive_rescaling(tables.clouds(spark, sf), factor=0.5).withColumn("w", r("w"))


KNN = f"{edges_sql(on=ORDERED)}, g AS (SELECT cloud_id, src, dst, w FROM e QUALIFY row_number() OVER (PARTITION BY cloud_id, src ORDER BY w, dst) <= 3)"


@query("graph_knn_connectivity", f"WITH {KNN} SELECT cloud_id, src, dst, 1.0::DOUBLE AS w FROM g")
def _(spark, sf):
    return graphs.knn_graph(tables.clouds(spark, sf), 3)


@query("graph_knn_distance", f"WITH {KNN} SELECT cloud_id, src, dst, round(w, 6) + 0.0 AS w FROM g")
def _(spark, sf):
    return graphs.knn_graph(tables.clouds(spark, sf), 3, "distance").withColumn("w", r("w"))


def _geodesic(undirected: bool, weight: str) -> str:
    both = "UNION ALL SELECT cloud_id, dst, src, w FROM g" if undirected else ""
    steps = ", ".join(f"p{k} AS (SELECT cloud_id, src, dst, min(w) AS w FROM (SELECT * FROM p{k - 1} UNION ALL SELECT a.cloud_id, a.src, b.dst, a.w + b.w FROM p{k - 1} a JOIN p{k - 1} b ON a.cloud_id = b.cloud_id AND a.dst = b.src) GROUP BY ALL)" for k in range(1, 5))
    return f"""WITH {KNN.replace("g AS (", "g0 AS (")}, g AS (SELECT cloud_id, src, dst, {weight} AS w FROM g0), u AS (SELECT cloud_id, src, dst, w FROM g {both} UNION ALL SELECT DISTINCT cloud_id, src, src, 0.0 FROM g UNION ALL SELECT DISTINCT cloud_id, dst, dst, 0.0 FROM g),
 p0 AS (SELECT cloud_id, src, dst, min(w) AS w FROM u GROUP BY ALL), {steps} SELECT cloud_id, src, dst, round(w, 6) + 0.0 AS w FROM p4"""


for _name, _und, _unw in (("weighted", True, False), ("unweighted", True, True), ("directed", False, False)):

    @query(f"graph_geodesic_{_name}", _geodesic(_und, "1.0::DOUBLE" if _unw else "w"))
    def _(spark, sf, und=_und, unw=_unw):
        g = graphs.knn_graph(tables.clouds(spark, sf), 3, "distance")
        return graphs.geodesic_distance(g, not und, unw).withColumn("w", r("w"))


def _transitions(state: str, extra: str) -> str:
    return f"""WITH {extra}, i AS (SELECT series_id, t, dense_rank() OVER (PARTITION BY series_id ORDER BY {state}) - 1 AS id FROM {"a" if "a AS" in extra else "s"}), n AS (SELECT series_id, id AS src, lead(id) OVER (PARTITION BY series_id ORDER BY t) AS dst FROM i)
SELECT series_id, src, dst, count(*) AS n FROM n WHERE dst IS NOT NULL AND dst <> src GROUP BY ALL"""


def _long(df):
    return df.select("series_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "n")


@query("graph_transition_ordinal", _transitions("pattern", PATTERN))
def _(spark, sf):
    return _long(graphs.ordinal_transitions(ts.takens(tables.series(spark, sf), 1, 3)))


@query("graph_transition_event_type", _transitions("event_type", S))
def _(spark, sf):
    return _long(graphs.transition_graph(tables.series(spark, sf), F.col("event_type")))
