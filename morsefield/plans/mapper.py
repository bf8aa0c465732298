"""Queries on Mapper: customers filtered by balance and nation, and clouds of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapper, plotdata
from ..sources import tables
from .clouds_graphs import METRICS, ORDERED, C, edges_sql
from .registry import query, r

N, G = 8, 0.3


def customers(spark, sf):
    return tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_acctbal").alias("value"), F.col("c_nationkey").cast("double").alias("nation"))


def uniform_sql(value: str = "c_acctbal", name: str = "i", n: int = N) -> str:
    return f"""l_{name} AS (SELECT min({value})::DOUBLE AS a, (max({value}) - min({value}))::DOUBLE / {n - (n - 1) * G!r}::DOUBLE AS size FROM customer),
 {name} AS (SELECT k::INT AS set_id, CASE WHEN k = 0 THEN '-inf'::DOUBLE ELSE a + k * {1 - G!r}::DOUBLE * size END AS lo, CASE WHEN k = {n - 1} THEN 'inf'::DOUBLE ELSE a + k * {1 - G!r}::DOUBLE * size + size END AS hi FROM l_{name}, range({n}) g(k)),
 m_{name} AS (SELECT c_custkey AS point_id, set_id FROM customer JOIN {name} ON {value} > lo AND {value} < hi)"""


#: Repeated sets go, the first stays; the others are numbered anew.
PRUNE = """h AS (SELECT set_id, list(point_id ORDER BY point_id) AS members FROM {m} GROUP BY set_id), k AS (SELECT min(set_id) AS set_id FROM h GROUP BY members),
 w AS (SELECT set_id, (row_number() OVER (ORDER BY set_id) - 1)::INT AS new_id FROM k), cover AS (SELECT point_id, new_id AS set_id FROM {m} JOIN w USING (set_id))"""
UNIFORM = f"{uniform_sql()}, {PRUNE.format(m='m_i')}"


def uniform(spark, sf):
    return mapper.prune(mapper.cover_1d(customers(spark, sf), N, G))


@query("mapper_projection", "SELECT c_custkey AS point_id, c_acctbal AS value FROM customer")
def _(spark, sf):
    return mapper.projection(customers(spark, sf), ["value"])


@query("mapper_eccentricity", f"WITH {edges_sql(on=ORDERED)} SELECT cloud_id, src AS point_id, round(sqrt(sum(w * w)), 6) + 0.0 AS ecc FROM e GROUP BY ALL")
def _(spark, sf):
    return mapper.eccentricity(tables.clouds(spark, sf)).withColumn("ecc", r("ecc"))


@query("mapper_eccentricity_inf", f"WITH {edges_sql(on=ORDERED)} SELECT cloud_id, src AS point_id, round(max(w), 6) + 0.0 AS ecc FROM e GROUP BY ALL")
def _(spark, sf):
    return mapper.eccentricity(tables.clouds(spark, sf), float("inf")).withColumn("ecc", r("ecc"))


@query("mapper_entropy", f"WITH {C}, l AS (SELECT cloud_id, point_id, abs(unnest(x)) AS v FROM c), t AS (SELECT *, v / sum(v) OVER (PARTITION BY cloud_id, point_id) AS p FROM l) SELECT cloud_id, point_id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) + 0.0 AS entropy FROM t GROUP BY ALL")
def _(spark, sf):
    return mapper.row_entropy(tables.clouds(spark, sf)).withColumn("entropy", r("entropy"))


@query("mapper_cover_intervals", f"WITH {uniform_sql()} SELECT set_id, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi FROM i")
def _(spark, sf):
    limits = mapper.intervals(customers(spark, sf), N, G)
    return limits.select("set_id", r("lo").alias("lo"), r("hi").alias("hi"))


@query("mapper_cover_uniform", f"WITH {UNIFORM} SELECT point_id, set_id FROM cover")
def _(spark, sf):
    return uniform(spark, sf)


@query("mapper_cover_balanced", f"""WITH d AS (SELECT c_custkey AS point_id, (dense_rank() OVER (ORDER BY c_acctbal) - 1)::DOUBLE AS x FROM customer), l AS (SELECT (max(x) + 1) / {N - (N - 1) * G!r}::DOUBLE AS size FROM d),
 i AS (SELECT k::INT AS set_id, -0.5 + k * {1 - G!r}::DOUBLE * size AS lo, -0.5 + k * {1 - G!r}::DOUBLE * size + size AS hi FROM l, range({N}) g(k)), m AS (SELECT point_id, set_id FROM d JOIN i ON x > lo AND x < hi), {PRUNE.format(m="m")} SELECT point_id, set_id FROM cover""")
def _(spark, sf):
    return mapper.prune(mapper.cover_1d(customers(spark, sf), N, G, "balanced"))


CUBE = f"{uniform_sql('c_acctbal', 'i', 4)}, {uniform_sql('c_nationkey', 'j', 4)}, m AS (SELECT point_id, a.set_id * 4 + b.set_id AS set_id FROM m_i a JOIN m_j b USING (point_id)), {PRUNE.format(m='m')}"


@query("mapper_cover_cubical", f"WITH {CUBE} SELECT point_id, set_id FROM cover")
def _(spark, sf):
    return mapper.cubical_cover(customers(spark, sf), ["value", "nation"], 4, G)


#: Each pullback set is split by nation.
REFINED = f"{UNIFORM}, refined AS (SELECT point_id, set_id, (c_nationkey % 3)::INT AS label FROM cover JOIN customer ON c_custkey = point_id)"
NODES = f"{REFINED}, nodes AS (SELECT (row_number() OVER (ORDER BY min(point_id), set_id, label) - 1)::BIGINT AS node_id, set_id, label, count(*) AS size, min(point_id) AS first FROM refined GROUP BY set_id, label)"
EDGES = f"{NODES}, mem AS (SELECT node_id, set_id, point_id FROM refined JOIN nodes USING (set_id, label)), edges AS (SELECT a.node_id AS src, b.node_id AS dst, count(*) AS weight FROM mem a JOIN mem b ON a.point_id = b.point_id AND a.node_id < b.node_id AND a.set_id <> b.set_id GROUP BY ALL)"


def refined(spark, sf):
    return mapper.cluster_by(customers(spark, sf), uniform(spark, sf), F.col("nation") % 3)


@query("mapper_refined_cover", f"WITH {REFINED} SELECT * FROM refined")
def _(spark, sf):
    return refined(spark, sf)


@query("mapper_nerve_nodes", f"WITH {NODES} SELECT * FROM nodes")
def _(spark, sf):
    return mapper.nerve_nodes(refined(spark, sf))


@query("mapper_nerve_edges", f"WITH {EDGES} SELECT * FROM edges WHERE weight >= 5")
def _(spark, sf):
    return mapper.nerve_edges(refined(spark, sf), 5)


#: Each pullback set is split by whether the balance is over 2000, so that some nodes lie in others.
SPLIT = EDGES.replace("(c_nationkey % 3)::INT AS label", "(c_acctbal > 2000)::INT AS label")
#: Pairs in node order: the second goes into the first if it lies in it, else the first into the second; the last such pair
#: decides, and mappings are followed to their end.
CONTRACTED = f"""{SPLIT}, pair AS (SELECT e.*, CASE WHEN weight = b.size THEN dst WHEN weight = a.size THEN src END AS v, CASE WHEN weight = b.size THEN src WHEN weight = a.size THEN dst END AS onto FROM edges e JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst),
 last AS (SELECT v, onto FROM pair WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY v ORDER BY src DESC, dst DESC) = 1),
 follow AS (SELECT node_id AS v, node_id AS spot, 0 AS n FROM nodes UNION ALL SELECT f.v, last.onto, n + 1 FROM follow f JOIN last ON last.v = f.spot WHERE n < 100),
 goal AS (SELECT v, spot FROM follow QUALIFY row_number() OVER (PARTITION BY v ORDER BY n DESC) = 1)"""


def contracted(spark, sf):
    split = mapper.cluster_by(customers(spark, sf), uniform(spark, sf), F.col("value") > 2000)
    return mapper.nerve_contracted(split)


@query("mapper_nerve_contracted", f"WITH RECURSIVE {CONTRACTED} SELECT a.spot AS src, b.spot AS dst, weight FROM pair JOIN goal a ON a.v = src JOIN goal b ON b.v = dst WHERE pair.v IS NULL")
def _(spark, sf):
    return contracted(spark, sf)[1]


@query("mapper_nerve_contracted_nodes", f"WITH RECURSIVE {CONTRACTED} SELECT nodes.* FROM nodes WHERE node_id NOT IN (SELECT v FROM last)")
def _(spark, sf):
    return contracted(spark, sf)[0]


@query("mapper_node_colors", f"WITH {NODES} SELECT node_id, round(avg(c_acctbal), 4) + 0.0 AS color FROM refined JOIN nodes USING (set_id, label) JOIN customer ON c_custkey = point_id GROUP BY ALL")
def _(spark, sf):
    return mapper.node_statistic(refined(spark, sf), customers(spark, sf), "value").withColumn("color", r("color", 4))


@query("plot_mapper_graph", f"WITH {NODES}, z AS (SELECT node_id, max(c_acctbal) AS color FROM refined JOIN nodes USING (set_id, label) JOIN customer ON c_custkey = point_id GROUP BY ALL) SELECT node_id, set_id, label, size, round(color / 10.0 ** (floor(log10(abs(color))) - 2)) * 10.0 ** (floor(log10(abs(color))) - 2) AS color FROM nodes JOIN z USING (node_id)")
def _(spark, sf):
    own = refined(spark, sf)
    return plotdata.mapper_graph(mapper.nerve_nodes(own), mapper.node_statistic(own, customers(spark, sf), "value", F.max))


def points(spark, sf):
    return tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("coords"))


def _sets(spark, sf):
    values = points(spark, sf).select("point_id", F.col("coords")[0].alias("value"))
    return mapper.prune(mapper.cover_1d(values, 20, 0.2))


def cover_sql(column: int, name: str, n: int, overlap: float) -> str:
    """Points of the embeddings in the open intervals of a uniform cover of one coordinate."""
    v = f"embedding[{column}]::DOUBLE"
    return f"""l_{name} AS (SELECT min({v}) AS a, (max({v}) - min({v})) / {n - (n - 1) * overlap!r}::DOUBLE AS size FROM embeddings),
 i_{name} AS (SELECT k::INT AS set_id, CASE WHEN k = 0 THEN '-inf'::DOUBLE ELSE a + k * {1 - overlap!r}::DOUBLE * size END AS lo, CASE WHEN k = {n - 1} THEN 'inf'::DOUBLE ELSE a + k * {1 - overlap!r}::DOUBLE * size + size END AS hi FROM l_{name}, range({n}) g(k)),
 m_{name} AS (SELECT vec_id AS point_id, set_id FROM embeddings JOIN i_{name} ON {v} > lo AND {v} < hi)"""


#: Distances of different points in the same set of the cover.
INSIDE = f"""own AS (SELECT set_id::BIGINT AS set_id, point_id, embedding::DOUBLE[] AS x FROM cover JOIN embeddings ON vec_id = point_id),
 d AS (SELECT a.set_id, a.point_id AS p, b.point_id AS q, {METRICS["euclidean"]} AS w FROM own a JOIN own b ON a.set_id = b.set_id AND a.point_id <> b.point_id)"""
SETS = f"{cover_sql(1, 'v', 20, 0.2)}, {PRUNE.format(m='m_v')}, {INSIDE}"


def dbscan_sql(eps: float, least: int) -> str:
    """Clusters are the components of core points, numbered by their first; a border point is of the first that reaches it."""
    return f"""core AS (SELECT set_id, point_id FROM own WHERE (SELECT count(*) FROM d WHERE d.set_id = own.set_id AND d.p = own.point_id AND w <= {eps}) + 1 >= {least}),
 near AS (SELECT d.set_id, p, q FROM d JOIN core ON core.set_id = d.set_id AND core.point_id = d.q WHERE w <= {eps}),
 reach AS (SELECT set_id, point_id AS node, point_id AS root FROM core UNION SELECT r.set_id, n.q, r.root FROM reach r JOIN near n ON n.set_id = r.set_id AND n.p = r.node),
 part AS (SELECT set_id, node, min(root) AS root FROM reach GROUP BY ALL),
 named AS (SELECT set_id, node, dense_rank() OVER (PARTITION BY set_id ORDER BY root) - 1 AS label FROM part),
 found AS (SELECT set_id, node AS point_id, label FROM named UNION ALL SELECT n.set_id, n.p, min(label) FROM near n JOIN named ON named.set_id = n.set_id AND named.node = n.q WHERE NOT EXISTS (SELECT 1 FROM core WHERE core.set_id = n.set_id AND core.point_id = n.p) GROUP BY ALL),
 refined AS (SELECT own.point_id, own.set_id, coalesce(label, -1)::INT AS label FROM own LEFT JOIN found USING (set_id, point_id))"""


#: Merges of single linkage are the edges of the minimum spanning tree: those whose ends are not linked by shorter ones.
MERGES = """reach AS (SELECT set_id, p, q, w, p AS node FROM d WHERE p < q UNION SELECT k.set_id, k.p, k.q, k.w, d.q FROM reach k JOIN d ON d.set_id = k.set_id AND d.p = k.node AND d.w < k.w),
 tree AS (SELECT d.*, row_number() OVER (PARTITION BY set_id ORDER BY w) AS i FROM d WHERE p < q AND NOT EXISTS (SELECT 1 FROM reach k WHERE k.set_id = d.set_id AND k.p = d.p AND k.q = d.q AND k.node = d.q))"""
#: The first of the merges are made; clusters are numbered by their first points. kept: (set_id, kept).
CUT = """step AS (SELECT set_id, p AS a, q AS b FROM tree JOIN kept USING (set_id) WHERE i <= kept), link AS (SELECT set_id, a, b FROM step UNION ALL SELECT set_id, b, a FROM step),
 walk AS (SELECT set_id, point_id AS node, point_id AS root FROM own UNION SELECT r.set_id, l.b, r.root FROM walk r JOIN link l ON l.set_id = r.set_id AND l.a = r.node),
 part AS (SELECT set_id, node, min(root) AS root FROM walk GROUP BY ALL)
SELECT node AS point_id, set_id, (dense_rank() OVER (PARTITION BY set_id ORDER BY root) - 1)::INT AS label FROM part"""
SIMPLE = "kept AS (SELECT set_id, coalesce(min(CASE WHEN gap >= 0.3 * top THEN i - 1 END), count(*)) AS kept FROM (SELECT *, w - lag(w, 1, 0.0) OVER (PARTITION BY set_id ORDER BY i) AS gap, max(w) OVER (PARTITION BY set_id) AS top FROM tree) GROUP BY set_id)"
HISTOGRAM = """ends AS (SELECT set_id, min(w) AS lo, max(w) AS hi, count(*) AS n FROM tree GROUP BY ALL),
 edge AS (SELECT set_id, bins, k, k * ((hi - lo) / bins) + lo AS lower, CASE WHEN k + 1 = bins THEN hi ELSE (k + 1) * ((hi - lo) / bins) + lo END AS upper, hi FROM ends, range(5, 100) b(bins), range(100) g(k) WHERE k < bins AND n > 1 AND bins <= greatest(5, n + 1)),
 bare AS (SELECT * FROM edge e WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.set_id = e.set_id AND t.w >= e.lower AND (t.w < e.upper OR e.upper = e.hi AND t.w <= e.upper))),
 one AS (SELECT set_id, lower FROM bare QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY bins, k) = 1),
 kept AS (SELECT set_id, (SELECT count(*) FROM tree t WHERE t.set_id = one.set_id AND t.w <= lower) AS kept FROM one UNION ALL SELECT set_id, 1 FROM ends WHERE n = 1)"""

for _name, _f, _sql in (
    ("first_simple_gap", mapper.first_simple_gap, f"{MERGES}, {SIMPLE}, {CUT}"),
    ("first_histogram_gap", mapper.first_histogram_gap, f"{MERGES}, {HISTOGRAM}, {CUT}"),
    ("dbscan", lambda x: mapper.dbscan(x, 1.35, 3), f"{dbscan_sql(1.35, 3)} SELECT point_id, set_id, label FROM refined"),
):

    @query(f"mapper_{_name}", f"WITH RECURSIVE {SETS}, {_sql}")
    def _(spark, sf, f=_f):
        return mapper.cluster_sets(points(spark, sf), _sets(spark, sf), f)


def _graph(spark, sf):
    first_two = lambda p: p.select("point_id", F.col("coords")[0].alias("f0"), F.col("coords")[1].alias("f1"))
    return mapper.MapperPipeline(filter=first_two, n_intervals=4, overlap_frac=0.3, clusterer=lambda x: mapper.dbscan(x, 1.35, 3)).fit_transform(points(spark, sf))


PLANE_SETS = f"{cover_sql(1, 'a', 4, 0.3)}, {cover_sql(2, 'b', 4, 0.3)}, m AS (SELECT point_id, a.set_id * 4 + b.set_id AS set_id FROM m_a a JOIN m_b b USING (point_id)), {PRUNE.format(m='m')}, {INSIDE}, {dbscan_sql(1.35, 3)}"
GRAPH = f"{PLANE_SETS}, nodes AS (SELECT (row_number() OVER (ORDER BY min(point_id), set_id, label) - 1)::BIGINT AS node_id, set_id, label, count(*) AS size, min(point_id) AS first FROM refined GROUP BY set_id, label)"


@query("mapper_graph_dbscan_nodes", f"WITH RECURSIVE {GRAPH} SELECT * FROM nodes")
def _(spark, sf):
    return _graph(spark, sf)[0]


@query("mapper_graph_dbscan", f"WITH RECURSIVE {GRAPH}, mem AS (SELECT node_id, set_id, point_id FROM refined JOIN nodes USING (set_id, label)) SELECT a.node_id AS src, b.node_id AS dst, count(*) AS weight FROM mem a JOIN mem b ON a.point_id = b.point_id AND a.node_id < b.node_id AND a.set_id <> b.set_id GROUP BY ALL")
def _(spark, sf):
    return _graph(spark, sf)[1]
