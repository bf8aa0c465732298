"""Queries on persistent homology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import pairwise
from ..operators import curves, graphs, images
from ..operators import diagrams as dg
from ..operators import homology as ph
from ..operators import timeseries as ts
from ..operators.pipeline import make_pipeline
from ..sources import tables
from .clouds_graphs import ORDERED, C, edges_sql
from .images import I
from .reduction import REDUCED, SIMPLICES, diagram, flag_cells, report
from .registry import query, r
from .timeseries import DAILY

INF = float("inf")


def out(dgm, digits=6):
    return dgm.select("cloud_id", "hdim", r("birth", digits).alias("birth"), r("death", digits).alias("death"))


def h0_sql(half: float = 1.0, limit: str = "1e300", cloud: str = C) -> str:
    """Finite H0 deaths: an edge is in the minimum spanning tree if its ends aren't linked by shorter edges."""
    return f"""WITH RECURSIVE {edges_sql(cloud=cloud)}, sym AS (SELECT cloud_id, src, dst, w FROM e UNION ALL SELECT cloud_id, dst, src, w FROM e),
 reach AS (SELECT cloud_id, src, dst, w, src AS node FROM e UNION SELECT k.cloud_id, k.src, k.dst, k.w, y.dst FROM reach k JOIN sym y ON y.cloud_id = k.cloud_id AND y.src = k.node AND y.w < k.w)
SELECT cloud_id, 0::INT AS hdim, 0.0::DOUBLE AS birth, round(w * {half}, 6) + 0.0 AS death FROM e WHERE w <= {limit} AND NOT EXISTS (SELECT 1 FROM reach k WHERE k.cloud_id = e.cloud_id AND k.src = e.src AND k.dst = e.dst AND k.node = e.dst)"""


VERTICES = "SELECT cloud_id AS id, point_id AS v, 0.0::DOUBLE AS f FROM c"


def rips_sql(metric: str = "euclidean", limit: str = "1e300", dims: str = "IN (0, 1)") -> str:
    """The whole diagram, essential classes with infinite deaths included, by reducing the boundary matrix."""
    return diagram(edges_sql(metric), flag_cells(VERTICES, f"SELECT cloud_id AS id, src AS a, dst AS b, w AS f FROM e WHERE w <= {limit}"), dims=dims)


PLANE = C.replace("embedding::DOUBLE[]", "(embedding[1:2])::DOUBLE[]")


def plane(spark, sf):
    return tables.clouds(spark, sf, 10, 2)


@query("ph_rips_h0", h0_sql())
def _(spark, sf):
    return out(dg.finish(ph.rips(tables.clouds(spark, sf), dimensions=(0,)).toDF("sample_id", "hdim", "birth", "death"), 1e9).toDF("cloud_id", "hdim", "birth", "death"))


@query("ph_rips_h0_threshold", rips_sql(limit="1.4", dims="= 0"))
def _(spark, sf):
    return out(ph.rips(tables.clouds(spark, sf), dimensions=(0,), max_edge_length=1.4))


@query("ph_rips_threshold", rips_sql(limit="1.4"))
def _(spark, sf):
    return out(ph.rips(tables.clouds(spark, sf), max_edge_length=1.4))


@query("ph_finish", f"WITH {C} SELECT cloud_id, 0::INT AS hdim, 0.0::DOUBLE AS birth, 99.0::DOUBLE AS death FROM c WHERE point_id > 0")
def _(spark, sf):
    # below the shortest edge nothing is linked: all classes but one get the value for infinity
    d = ph.rips(tables.clouds(spark, sf), dimensions=(0,), max_edge_length=0.0).toDF("sample_id", "hdim", "birth", "death")
    return dg.finish(d, 99.0).toDF("cloud_id", "hdim", "birth", "death")


C5 = "c AS (SELECT vec_id // 5 AS cloud_id, (vec_id % 5)::INT AS point_id, embedding::DOUBLE[] AS x FROM embeddings)"
TH = (1.3, 1.4, 1.5)
#: Up to five points a flag complex has no classes above dimension 1, so that beta1 = beta0 - Euler characteristic.
BETTI1 = f"""WITH RECURSIVE {edges_sql(cloud=C5)}, th AS (SELECT unnest({list(TH)})::DOUBLE AS t), a AS (SELECT cloud_id, t, src, dst FROM e, th WHERE w <= t),
 sym AS (SELECT cloud_id, t, src, dst FROM a UNION ALL SELECT cloud_id, t, dst, src FROM a),
 reach AS (SELECT cloud_id, t, point_id AS node, point_id AS root FROM c, th UNION SELECT k.cloud_id, k.t, y.dst, k.root FROM reach k JOIN sym y ON y.cloud_id = k.cloud_id AND y.t = k.t AND y.src = k.node),
 b0 AS (SELECT cloud_id, t, count(*) AS b0 FROM (SELECT cloud_id, t, node, min(root) AS m FROM reach GROUP BY ALL) WHERE m = node GROUP BY ALL),
 v AS (SELECT cloud_id, count(*) AS n FROM c GROUP BY ALL), k2 AS (SELECT cloud_id, t, count(*) AS n FROM a GROUP BY ALL),
 t3 AS (SELECT x.cloud_id, x.t, x.src AS p, x.dst AS q, y.dst AS s FROM a x JOIN a y ON y.cloud_id = x.cloud_id AND y.t = x.t AND y.src = x.dst JOIN a z ON z.cloud_id = x.cloud_id AND z.t = x.t AND z.src = x.src AND z.dst = y.dst),
 t4 AS (SELECT m.*, y.dst AS u FROM t3 m JOIN a y ON y.cloud_id = m.cloud_id AND y.t = m.t AND y.src = m.s JOIN a z ON z.cloud_id = m.cloud_id AND z.t = m.t AND z.src = m.q AND z.dst = y.dst JOIN a w ON w.cloud_id = m.cloud_id AND w.t = m.t AND w.src = m.p AND w.dst = y.dst),
 k3 AS (SELECT cloud_id, t, count(*) AS n FROM t3 GROUP BY ALL), k4 AS (SELECT cloud_id, t, count(*) AS n FROM t4 GROUP BY ALL),
 k5 AS (SELECT cloud_id, t, (count(*) = 10)::INT AS n FROM a GROUP BY ALL)
SELECT b0.cloud_id, 1::INT AS hdim, b0.t, b0 - (v.n - coalesce(k2.n, 0) + coalesce(k3.n, 0) - coalesce(k4.n, 0) + coalesce(k5.n, 0)) AS n FROM b0 JOIN v USING (cloud_id) LEFT JOIN k2 USING (cloud_id, t) LEFT JOIN k3 USING (cloud_id, t) LEFT JOIN k4 USING (cloud_id, t) LEFT JOIN k5 USING (cloud_id, t)
WHERE b0 - (v.n - coalesce(k2.n, 0) + coalesce(k3.n, 0) - coalesce(k4.n, 0) + coalesce(k5.n, 0)) > 0"""


@query("ph_rips_betti1_curve", BETTI1)
def _(spark, sf):
    return ph.betti_curve_at(ph.rips(tables.clouds(spark, sf, 5), dimensions=(1,)), list(TH))


@query("ph_rips_diagram", rips_sql())
def _(spark, sf):
    return out(ph.rips(tables.clouds(spark, sf)))


# no torsion in the plane of so few points, so that the diagram is the same over every field
@query("ph_rips_diagram_mod3", rips_sql())
def _(spark, sf):
    return out(ph.rips(tables.clouds(spark, sf), coeff=3))


@query("ph_rips_manhattan_h0", rips_sql("manhattan", dims="= 0"))
def _(spark, sf):
    return out(ph.rips(tables.clouds(spark, sf), "manhattan", (0,)))


@query("ph_rips_precomputed_h0", rips_sql(dims="= 0"))
def _(spark, sf):
    return out(ph.rips(pairwise(tables.clouds(spark, sf)), "precomputed", (0,)))


@query("ph_rips_collapsed", rips_sql())
def _(spark, sf):
    return out(ph.rips(tables.clouds(spark, sf), collapse_edges=True))


DTM = f"{edges_sql(on=ORDERED)}, k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY cloud_id, src ORDER BY w, dst) <= 3), d AS (SELECT cloud_id, src AS v, 2 * sqrt(sum(w * w) / 4) AS w FROM k GROUP BY ALL)"


@query("ph_dtm_weights", f"WITH {DTM} SELECT cloud_id, v, round(w, 6) + 0.0 AS w FROM d")
def _(spark, sf):
    return ph.dtm_weights(tables.clouds(spark, sf)).withColumn("w", r("w"))


WEIGHTED = {
    1: "CASE WHEN 2 * e.w <= abs(a.w - b.w) THEN greatest(a.w, b.w) ELSE (2 * e.w + a.w + b.w) / 2 END",
    2: "CASE WHEN 2 * e.w <= sqrt(abs(a.w * a.w - b.w * b.w)) THEN greatest(a.w, b.w) ELSE sqrt(((a.w + b.w) * (a.w + b.w) + 4 * e.w * e.w) * ((a.w - b.w) * (a.w - b.w) + 4 * e.w * e.w)) / (4 * e.w) END",
    "inf": "greatest(e.w, a.w, b.w)",
}
for _p, _sql in WEIGHTED.items():

    @query(f"ph_weighted_edges_{_p}", f"WITH {DTM} SELECT e.cloud_id, e.src, e.dst, round({_sql}, 6) + 0.0 AS w FROM e JOIN d a ON a.cloud_id = e.cloud_id AND a.v = e.src JOIN d b ON b.cloud_id = e.cloud_id AND b.v = e.dst WHERE e.src < e.dst UNION ALL SELECT cloud_id, v, v, round(w, 6) + 0.0 FROM d")
    def _(spark, sf, p=_p):
        pts = tables.clouds(spark, sf)
        return ph.weighted_edges(pts, ph.dtm_weights(pts), float(p)).withColumn("w", r("w"))


@query("ph_weighted_rips", diagram(DTM, flag_cells("SELECT cloud_id AS id, v, w AS f FROM d", f"SELECT e.cloud_id AS id, e.src AS a, e.dst AS b, {WEIGHTED[1]} AS f FROM e JOIN d a ON a.cloud_id = e.cloud_id AND a.v = e.src JOIN d b ON b.cloud_id = e.cloud_id AND b.v = e.dst WHERE e.src < e.dst")))
def _(spark, sf):
    return out(ph.weighted_rips(tables.clouds(spark, sf)))


#: Edges of triangles whose circumcircle holds no point.
DELAUNAY = f"""{PLANE}, q AS (SELECT cloud_id, point_id AS v, x[1] AS x, x[2] AS y, x[1] * x[1] + x[2] * x[2] AS z FROM c),
 tri AS (SELECT a.cloud_id, a.v AS i, b.v AS j, d.v AS k, a.x AS ax, a.y AS ay, 2 * (a.x * (b.y - d.y) + b.x * (d.y - a.y) + d.x * (a.y - b.y)) AS t,
   a.z * (b.y - d.y) + b.z * (d.y - a.y) + d.z * (a.y - b.y) AS ux, a.z * (d.x - b.x) + b.z * (a.x - d.x) + d.z * (b.x - a.x) AS uy
  FROM q a JOIN q b ON b.cloud_id = a.cloud_id AND b.v > a.v JOIN q d ON d.cloud_id = a.cloud_id AND d.v > b.v),
 ok AS (SELECT * FROM tri WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.cloud_id = tri.cloud_id AND (q.x - ux / t) * (q.x - ux / t) + (q.y - uy / t) * (q.y - uy / t) < ((ax - ux / t) * (ax - ux / t) + (ay - uy / t) * (ay - uy / t)) * (1 - 1e-9))),
 side AS (SELECT cloud_id, i AS a, j AS b FROM ok UNION SELECT cloud_id, i, k FROM ok UNION SELECT cloud_id, j, k FROM ok),
 e AS (SELECT s.cloud_id, a, b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS w FROM side s JOIN q p ON p.cloud_id = s.cloud_id AND p.v = s.a JOIN q ON q.cloud_id = s.cloud_id AND q.v = s.b)"""


def weak_alpha_sql(dims: str = "IN (0, 1)") -> str:
    return diagram(DELAUNAY, flag_cells(VERTICES, "SELECT cloud_id AS id, a, b, w AS f FROM e"), dims=dims)


# triangulations are for few dimensions: clouds of the first two coordinates
@query("ph_weak_alpha_h0", weak_alpha_sql("= 0"))
def _(spark, sf):
    return out(ph.weak_alpha(plane(spark, sf), (0,)))


@query("ph_weak_alpha", weak_alpha_sql())
def _(spark, sf):
    return out(ph.weak_alpha(plane(spark, sf)))


#: Of a triangle with half sides f: half the longest side if it is not acute, else the radius of the circumcircle.
BALL = """CASE WHEN 2 * greatest(x.f, y.f, z.f) * greatest(x.f, y.f, z.f) >= x.f * x.f + y.f * y.f + z.f * z.f THEN greatest(x.f, y.f, z.f)
  ELSE 2 * x.f * y.f * z.f / sqrt((x.f + y.f + z.f) * (y.f + z.f - x.f) * (x.f + z.f - y.f) * (x.f + y.f - z.f)) END"""


def cech_sql(dims: str = "IN (0, 1)") -> str:
    return diagram(edges_sql(), flag_cells(VERTICES, "SELECT cloud_id AS id, src AS a, dst AS b, w / 2 AS f FROM e", BALL), dims=dims)


@query("ph_cech_h0", cech_sql("= 0"))
def _(spark, sf):
    return out(ph.cech(tables.clouds(spark, sf), (0,)))


@query("ph_cech", cech_sql())
def _(spark, sf):
    return out(ph.cech(tables.clouds(spark, sf)))


def sparse_sql(eps: float, cloud: str = C) -> str:
    """Points in the order of farthest next, each with its distance to those before, and edges changed or left out by these radii."""
    factor = eps * (1 - eps) / 2
    return diagram(
        f"""{edges_sql(on="true", cloud=cloud)}, dists AS (SELECT cloud_id, src, list(w ORDER BY dst) AS line FROM e GROUP BY ALL),
 walk AS (SELECT cloud_id, [0] AS path, ['inf'::DOUBLE] AS radius, line AS gap FROM dists WHERE src = 0 UNION ALL
  SELECT w.cloud_id, path || [next], radius || [gap[next + 1]], list_transform(list_zip(gap, line), lambda p: least(p[1], p[2])) FROM
   (SELECT *, list_position(open, list_max(open)) - 1 AS next FROM (SELECT *, list_transform(gap, lambda g, i: CASE WHEN list_contains(path, i - 1) THEN -1 ELSE g END) AS open FROM walk WHERE len(path) < len(gap))) w JOIN dists ON dists.cloud_id = w.cloud_id AND dists.src = w.next),
 place AS (SELECT cloud_id, unnest(path) AS point_id, generate_subscripts(path, 1) AS spot, unnest(radius) AS radius FROM walk WHERE len(path) = len(gap)),
 near AS (SELECT e.cloud_id, i.spot AS a, j.spot AS b, i.radius AS ri, j.radius AS rj, CASE WHEN w * {eps!r}::DOUBLE <= 2 * j.radius THEN w WHEN w * {eps!r}::DOUBLE > i.radius + j.radius THEN NULL ELSE (w - j.radius / {eps!r}::DOUBLE) * 2 END AS f, w
  FROM e JOIN place i ON i.cloud_id = e.cloud_id AND i.point_id = e.src JOIN place j ON j.cloud_id = e.cloud_id AND j.point_id = e.dst WHERE i.spot < j.spot)""",
        flag_cells("SELECT cloud_id AS id, spot AS v, 0.0::DOUBLE AS f FROM place", f"SELECT cloud_id AS id, a, b, f FROM near WHERE f IS NOT NULL AND f * {factor!r}::DOUBLE <= rj").replace("cell AS (", "raw AS (")
        + f", cell AS (SELECT * FROM raw WHERE k = 0 OR f * {factor!r}::DOUBLE <= (SELECT min(radius) FROM place WHERE place.cloud_id = raw.id AND list_contains(raw.key, place.spot)))",
    )


@query("ph_sparse_rips_exact_h0", rips_sql(dims="= 0"))
def _(spark, sf):
    return out(ph.sparse_rips(tables.clouds(spark, sf), 0.0, (0,)))


@query("ph_sparse_rips", sparse_sql(0.5))
def _(spark, sf):
    return out(ph.sparse_rips(tables.clouds(spark, sf), 0.5))


# points of high dimension are all far apart; in the plane this leaves edges out and makes others longer
@query("ph_sparse_rips_plane", sparse_sql(0.9, PLANE))
def _(spark, sf):
    return out(ph.sparse_rips(plane(spark, sf), 0.9))


DIRECTED = "g AS (SELECT user_id AS cloud_id, i AS src, j AS dst, count(*) AS n FROM (SELECT user_id, i, lead(i) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS i FROM events)) WHERE j <> i GROUP BY ALL)"


def transitions(spark, sf):
    g = graphs.transition_graph(tables.series(spark, sf), F.col("event_type"))
    return g.select(F.col("series_id").alias("cloud_id"), "src", "dst", (1.0 / F.col("n")).alias("w"))


@query("ph_flag_directed_counts", f"""WITH {DIRECTED}, t AS (SELECT a.cloud_id, a.src AS p, a.dst AS q, b.dst AS s FROM g a JOIN g b ON a.cloud_id = b.cloud_id AND a.dst = b.src JOIN g c ON c.cloud_id = a.cloud_id AND c.src = a.src AND c.dst = b.dst),
 u AS (SELECT t.cloud_id FROM t JOIN g a ON a.cloud_id = t.cloud_id AND a.src = t.s JOIN g b ON b.cloud_id = t.cloud_id AND b.src = t.q AND b.dst = a.dst JOIN g c ON c.cloud_id = t.cloud_id AND c.src = t.p AND c.dst = a.dst)
SELECT cloud_id, 2::INT AS size, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT cloud_id, 3::INT, count(*) FROM t GROUP BY ALL UNION ALL SELECT cloud_id, 4::INT, count(*) FROM u GROUP BY ALL""")
def _(spark, sf):
    g = transitions(spark, sf)
    own = [ph.directed_cliques(g, k).select("cloud_id", F.lit(k).alias("size"), "n") for k in (2, 3, 4)]
    return own[0].unionByName(own[1]).unionByName(own[2])


@query("ph_flag_directed", diagram(DIRECTED, flag_cells("SELECT DISTINCT cloud_id AS id, unnest([src, dst]) AS v, 0.0::DOUBLE AS f FROM g", "SELECT cloud_id AS id, src AS a, dst AS b, 1.0::DOUBLE / n AS f FROM g")))
def _(spark, sf):
    return out(ph.flagser(transitions(spark, sf)))


@query("ph_flag_undirected", rips_sql())
def _(spark, sf):
    return out(ph.flagser(pairwise(tables.clouds(spark, sf)), directed=False))


CT = (-0.5, 0.0, 0.5)
#: beta0 by 8-neighbour components of active pixels, beta1 = beta0 - Euler characteristic of the closed cells.
CUBICAL = f"""WITH RECURSIVE {I}, th AS (SELECT unnest({list(CT)})::DOUBLE AS t), a AS (SELECT img_id, t, r, c, r * 8 + c AS id FROM px, th WHERE v <= t),
 reach AS (SELECT img_id, t, id AS node, id AS root FROM a UNION SELECT l.img_id, l.t, b.id, l.root FROM reach l JOIN a b ON b.img_id = l.img_id AND b.t = l.t AND abs(b.r - l.node // 8) <= 1 AND abs(b.c - l.node % 8) <= 1),
 b0 AS (SELECT img_id, t, count(*) AS b0 FROM (SELECT img_id, t, node, min(root) AS m FROM reach GROUP BY ALL) WHERE m = node GROUP BY ALL),
 cell AS (SELECT DISTINCT img_id, t, 2 * r + 1 + dy AS y, 2 * c + 1 + dx AS x FROM a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
 chi AS (SELECT img_id, t, sum(CASE WHEN (y % 2 + x % 2) = 1 THEN -1 ELSE 1 END)::BIGINT AS chi FROM cell GROUP BY ALL)"""


@query("ph_cubical_h0_curve", f"{CUBICAL} SELECT img_id, 0::INT AS hdim, t, b0 AS n FROM b0")
def _(spark, sf):
    return ph.betti_curve_at(ph.cubical(tables.images(spark, sf), (0,)), list(CT)).withColumnRenamed("cloud_id", "img_id")


@query("ph_cubical_betti1_curve", f"{CUBICAL} SELECT img_id, 1::INT AS hdim, t, b0 - chi AS n FROM b0 JOIN chi USING (img_id, t) WHERE b0 > chi")
def _(spark, sf):
    return ph.betti_curve_at(ph.cubical(tables.images(spark, sf), (1,)), list(CT)).withColumnRenamed("cloud_id", "img_id")


#: All cells of the grid: odd places are pixels' interiors, even ones the lines between.
CELLS = f"""{I}, cell AS (SELECT img_id AS id, [y, x] AS key, y % 2 + x % 2 AS k, min(v) AS f FROM (SELECT img_id, 2 * r + 1 + dy AS y, 2 * c + 1 + dx AS x, v FROM px, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) GROUP BY ALL)"""
SIDES = "face AS (SELECT id, key, unnest(CASE WHEN key[1] % 2 = 1 THEN [[key[1] - 1, key[2]], [key[1] + 1, key[2]]] ELSE [] END || CASE WHEN key[2] % 2 = 1 THEN [[key[1], key[2] - 1], [key[1], key[2] + 1]] ELSE [] END) AS fkey FROM cell)"


@query("ph_cubical", f"WITH RECURSIVE {CELLS}, {SIDES}, {REDUCED} {report()}")
def _(spark, sf):
    return out(ph.cubical(tables.images(spark, sf)))


@query("local_knn_neighborhoods", f"WITH {edges_sql(on=ORDERED)} SELECT cloud_id, src, dst FROM e QUALIFY row_number() OVER (PARTITION BY cloud_id, src ORDER BY w, dst) <= 3 UNION ALL SELECT cloud_id, point_id, point_id FROM c")
def _(spark, sf):
    return ph.knn_neighborhood(tables.clouds(spark, sf), 4)


@query("local_radius_neighborhoods", f"WITH {edges_sql(on=ORDERED)} SELECT cloud_id, src, dst FROM e WHERE w <= 1.4 UNION ALL SELECT cloud_id, point_id, point_id FROM c")
def _(spark, sf):
    return ph.radius_neighborhood(tables.clouds(spark, sf), 1.4)


def local_sql(near: str, wide: str) -> str:
    """Rips of each point's wide neighbourhood with a further vertex that is at 0 to all that are not near."""
    own = f"""{edges_sql(on=ORDERED)}, n AS ({near}), m AS ({wide}), mem AS (SELECT m.cloud_id, m.src, m.cloud_id * 64 + m.src AS id, m.dst, n.dst IS NOT NULL AS close FROM m LEFT JOIN n ON n.cloud_id = m.cloud_id AND n.src = m.src AND n.dst = m.dst)"""
    cells = flag_cells(
        "SELECT id, dst AS v, 0.0::DOUBLE AS f FROM mem UNION ALL SELECT DISTINCT id, 99, 0.0::DOUBLE FROM mem",
        "SELECT a.id, a.dst AS a, b.dst AS b, e.w AS f FROM mem a JOIN mem b ON b.id = a.id AND b.dst > a.dst JOIN e ON e.cloud_id = a.cloud_id AND e.src = a.dst AND e.dst = b.dst UNION ALL SELECT id, dst, 99, 0.0::DOUBLE FROM mem WHERE NOT close",
    )
    return f"WITH RECURSIVE {own}, {cells}, {SIMPLICES}, {REDUCED} SELECT id // 64 AS cloud_id, (id % 64)::INT AS point_id, hdim::INT AS hdim, round(birth, 6) + 0.0 AS birth, round(death, 6) + 0.0 AS death FROM dgm WHERE hdim = 1 AND birth < death"


def knn_sql(k: int) -> str:
    return f"SELECT cloud_id, src, dst FROM e QUALIFY row_number() OVER (PARTITION BY cloud_id, src ORDER BY w, dst) < {k} UNION ALL SELECT cloud_id, point_id, point_id FROM c"


def radius_sql(radius: float) -> str:
    return f"SELECT cloud_id, src, dst FROM e WHERE w <= {radius} UNION ALL SELECT cloud_id, point_id, point_id FROM c"


@query("local_knn_rips", local_sql(knn_sql(3), knn_sql(6)))
def _(spark, sf):
    d = ph.local_rips(tables.clouds(spark, sf), (3, 6), "knn", dimensions=(1,))
    return d.select("cloud_id", "point_id", "hdim", r("birth").alias("birth"), r("death").alias("death"))


@query("local_radius_rips", local_sql(radius_sql(1.3), radius_sql(1.45)))
def _(spark, sf):
    d = ph.local_rips(tables.clouds(spark, sf), (1.3, 1.45), "radius", dimensions=(1,))
    return d.select("cloud_id", "point_id", "hdim", r("birth").alias("birth"), r("death").alias("death"))


PIPE = f"""WITH RECURSIVE {DAILY}, k AS (SELECT x.window_id, x.var AS a, y.var AS b, (1 - corr(x.value, y.value)) / 2 AS w, count(*) AS n FROM d x JOIN d y ON x.window_id = y.window_id AND x.t = y.t AND x.var < y.var GROUP BY ALL),
 e AS (SELECT window_id AS cloud_id, a AS src, b AS dst, w FROM k WHERE n > 1), sym AS (SELECT cloud_id, src, dst, w FROM e UNION ALL SELECT cloud_id, dst, src, w FROM e),
 reach AS (SELECT cloud_id, src, dst, w, src AS node FROM e UNION SELECT q.cloud_id, q.src, q.dst, q.w, y.dst FROM reach q JOIN sym y ON y.cloud_id = q.cloud_id AND y.src = q.node AND y.w < q.w),
 m AS (SELECT cloud_id, w FROM e WHERE NOT EXISTS (SELECT 1 FROM reach q WHERE q.cloud_id = e.cloud_id AND q.src = e.src AND q.dst = e.dst AND q.node = e.dst))
SELECT cloud_id AS sample_id, 0::INT AS hdim, round(sqrt(sum(w * w / 4)), 6) + 0.0 AS amplitude FROM m GROUP BY ALL"""


@query("pipe_timeseries_amplitude", PIPE)
def _(spark, sf):
    """Correlation of event types by week, its Rips H0, and the amplitude of that diagram, in one plan."""

    def as_edges(d):
        ids = d.select("a").distinct().select("a", (F.dense_rank().over(dg.Window.orderBy("a")) - 1).cast("int").alias("i"))
        own = d.join(F.broadcast(ids), "a").join(F.broadcast(ids.toDF("b", "j")), "b").filter("i <= j")
        return own.select(F.col("window_id").alias("cloud_id"), F.col("i").alias("src"), F.col("j").alias("dst"), F.col("d").alias("w"))

    steps = make_pipeline(
        ts.pearson_dissimilarity,
        as_edges,
        lambda e: ph.rips(e, "precomputed", (0,)).filter(F.col("death") < INF).toDF("sample_id", "hdim", "birth", "death"),
        lambda d: dg.amplitude(d, "wasserstein"),
    )
    return steps.fit_transform(tables.daily(spark, sf)).withColumn("amplitude", r("amplitude"))


RADIAL = f"""{I}, h AS (SELECT img_id, r, c, v > 0 AS on_, sqrt((c - 3.5) * (c - 3.5) + (r - 3.5) * (r - 3.5)) AS d FROM px), x AS (SELECT img_id, r, c, CASE WHEN on_ THEN d ELSE (SELECT max(d) FROM h) + 1 END AS v FROM h)"""


@query("pipe_image_features", f"{CUBICAL.replace(I, RADIAL).replace('FROM px, th', 'FROM x, th').replace(str(list(CT)), '[1.0, 2.0, 3.0, 4.0]')} SELECT img_id AS sample_id, 0::INT AS channel, max(b0)::DOUBLE AS feature FROM b0 GROUP BY ALL")
def _(spark, sf):
    """Radial filtration of binary images, its cubical H0, the Betti numbers at four radii, and their maximum."""
    img = images.radial(tables.binary_images(spark, sf), (3.5, 3.5))
    b = ph.betti_curve_at(ph.cubical(img, (0,)), [1.0, 2.0, 3.0, 4.0])
    return curves.features(b.select(F.col("cloud_id").alias("sample_id"), F.col("hdim").alias("channel"), F.col("t").alias("bin"), F.col("n").alias("y")), "max")
