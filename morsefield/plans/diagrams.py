"""Queries on synthetic diagrams of users' events, and on curves made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, homology, plotdata
from ..operators import diagrams as dg
from ..sources import tables
from .registry import query, r, r_many

D = """e AS (SELECT user_id AS sample_id, (length(event_type) % 3)::INT AS hdim, value AS v, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
 d AS (SELECT sample_id, hdim, least(v, b) AS birth, greatest(v, b) AS death FROM e WHERE b IS NOT NULL),
 f AS (SELECT * FROM (SELECT DISTINCT sample_id FROM d), (SELECT DISTINCT hdim FROM d))"""

def q(name, sql, cte=D):
    return query(name, f"WITH {cte}{',' if not sql.startswith('SELECT') else ''} {sql}")


@q("dgm_from_events", "SELECT * FROM d")
def _(spark, sf):
    return tables.diagrams(spark, sf)


@q("dgm_validate", "SELECT sample_id, hdim, count(*) AS points, count(*) FILTER (death < birth) AS below FROM d GROUP BY ALL")
def _(spark, sf):
    return tables.check_diagrams(tables.diagrams(spark, sf))


@q("dgm_filtering", "SELECT * FROM d WHERE hdim NOT IN (0, 1) OR death - birth > 30")
def _(spark, sf):
    return dg.filtering(tables.diagrams(spark, sf), 30.0, [0, 1])


@q("dgm_subdiagrams", "SELECT * FROM d WHERE hdim = 1")
def _(spark, sf):
    return dg.subdiagrams(tables.diagrams(spark, sf), [1])


@q("dgm_forget_dimension", "SELECT sample_id, -1::INT AS hdim, birth, death FROM d")
def _(spark, sf):
    return dg.forget_dimension(tables.diagrams(spark, sf))


@q("dgm_scaler", "SELECT sample_id, hdim, round(birth / s, 6) + 0.0 AS birth, round(death / s, 6) + 0.0 AS death FROM d, (SELECT max((death - birth) / 2) AS s FROM d)")
def _(spark, sf):
    d = tables.diagrams(spark, sf)
    return dg.scaled(d, dg.scale_of(d)).select("sample_id", "hdim", r("birth").alias("birth"), r("death").alias("death"))


@q("dgm_scaler_inverse", "SELECT sample_id, hdim, round(birth, 6) + 0.0 AS birth, round(death, 6) + 0.0 AS death FROM d")
def _(spark, sf):
    d = tables.diagrams(spark, sf)
    s = dg.scale_of(d)
    return dg.scaled(dg.scaled(d, s), s, inverse=True).select("sample_id", "hdim", r("birth").alias("birth"), r("death").alias("death"))


GRID = "g AS (SELECT hdim, lo, (CASE WHEN hi = lo THEN max(hi) OVER () ELSE hi END - lo) / {m} AS step FROM (SELECT hdim, min(birth) AS lo, max(death) AS hi FROM d GROUP BY hdim))"
IGRID = """n AS (SELECT f.hdim, min(coalesce(k, 0)) AS a, max(k) AS z FROM f LEFT JOIN (SELECT sample_id, hdim, count(*) AS k FROM d GROUP BY ALL) USING (sample_id, hdim) GROUP BY f.hdim),
 g0 AS (SELECT hdim, min(birth) AS blo, max(birth) AS bhi, min(death - birth) AS l0, max(death - birth) AS lhi FROM d GROUP BY hdim),
 g AS (SELECT hdim, blo, (bhi - blo) / {m} AS bstep, CASE WHEN a < z THEN least(l0, 0.0) ELSE l0 END AS llo, (lhi - CASE WHEN a < z THEN least(l0, 0.0) ELSE l0 END) / {m} AS lstep FROM g0 JOIN n USING (hdim))"""


@q("dgm_grid", f"{GRID.format(m=19)} SELECT hdim, round(lo, 6) + 0.0 AS lo, round(step, 6) + 0.0 AS step FROM g")
def _(spark, sf):
    return dg.grid(tables.diagrams(spark, sf), 20).select("hdim", r("lo").alias("lo"), r("step").alias("step"))


@q("dgm_image_grid", f"{IGRID.format(m=19)} SELECT hdim, round(blo, 6) + 0.0 AS blo, round(bstep, 6) + 0.0 AS bstep, round(llo, 6) + 0.0 AS llo, round(lstep, 6) + 0.0 AS lstep FROM g")
def _(spark, sf):
    return dg.image_grid(tables.diagrams(spark, sf), 20).select("hdim", *(r(c).alias(c) for c in ("blo", "bstep", "llo", "lstep")))


ENT = "t AS (SELECT sample_id, hdim, death - birth AS l, sum(death - birth) OVER (PARTITION BY sample_id, hdim) AS s FROM d), h AS (SELECT sample_id, hdim, sum(CASE WHEN l > 0 THEN -(l / s) * log2(l / s) ELSE 0 END) AS h, max(s) AS s FROM t WHERE s > 0 GROUP BY ALL)"


@q("dgm_entropy", f"{ENT} SELECT sample_id, hdim, round(coalesce(h, -1.0), 6) + 0.0 AS entropy FROM f LEFT JOIN h USING (sample_id, hdim)")
def _(spark, sf):
    return dg.entropy(tables.diagrams(spark, sf)).withColumn("entropy", r("entropy"))


@q("dgm_entropy_normalized", f"{ENT} SELECT sample_id, hdim, round(coalesce(h / log2(s), -1.0), 6) + 0.0 AS entropy FROM f LEFT JOIN h USING (sample_id, hdim)")
def _(spark, sf):
    return dg.entropy(tables.diagrams(spark, sf), normalize=True).withColumn("entropy", r("entropy"))


@q("dgm_number_of_points", "SELECT sample_id, hdim, count(*) FILTER (death <> birth) AS n FROM f LEFT JOIN d USING (sample_id, hdim) GROUP BY ALL")
def _(spark, sf):
    return dg.number_of_points(tables.diagrams(spark, sf))


for _kind, _re, _im in (
    ("R", "birth", "death"),
    ("S", "(death - birth) / (sqrt(2.0) * sqrt(birth * birth + death * death)) * birth", "(death - birth) / (sqrt(2.0) * sqrt(birth * birth + death * death)) * death"),
    ("T", "(death - birth) / 2 * (cos(sqrt(birth * birth + death * death)) - sin(sqrt(birth * birth + death * death)))", "(death - birth) / 2 * (cos(sqrt(birth * birth + death * death)) + sin(sqrt(birth * birth + death * death)))"),
):
    # the first coefficients are -sum(z) and (sum(z) ** 2 - sum(z ** 2)) / 2
    @q(
        f"dgm_complex_polynomial_{_kind.lower()}",
        f"k AS (SELECT sample_id, hdim, {_re} AS x, {_im} AS y FROM d WHERE birth <> death),"
        " p AS (SELECT f.sample_id, f.hdim, coalesce(sum(x), 0) AS a, coalesce(sum(y), 0) AS b, coalesce(sum(x * x - y * y), 0) AS c, coalesce(sum(2 * x * y), 0) AS d FROM f LEFT JOIN k USING (sample_id, hdim) GROUP BY ALL)"
        " SELECT sample_id, hdim, 1::INT AS k, round(-a / 1000, 6) + 0.0 AS re, round(-b / 1000, 6) + 0.0 AS im FROM p"
        " UNION ALL SELECT sample_id, hdim, 2::INT, round((a * a - b * b - c) / 2 / 1e6, 6) + 0.0, round((2 * a * b - d) / 2 / 1e6, 6) + 0.0 FROM p",
    )
    def _(spark, sf, kind=_kind):
        unit = F.when(F.col("k") == 1, 1e3).otherwise(1e6)
        return dg.complex_polynomial(tables.diagrams(spark, sf), 2, kind).select("sample_id", "hdim", "k", r(F.col("re") / unit).alias("re"), r(F.col("im") / unit).alias("im"))


N = 12


def _cells(n, cte):
    return f"{cte.format(m=n - 1)}, x AS (SELECT f.sample_id, f.hdim, i::INT AS bin, g.lo + i * g.step AS t, g.step AS step FROM f JOIN g USING (hdim), range({n}) b(i))"


TENT = "greatest(0.0, (death - birth) / 2 - abs(t - (birth + death) / 2))"
BETTI = f"{_cells(N, GRID)}, y AS (SELECT sample_id, hdim, 0::INT AS layer, bin, any_value(step) AS step, count(*) FILTER (birth <= t AND t < death)::DOUBLE AS y FROM x LEFT JOIN d USING (sample_id, hdim) GROUP BY ALL)"
LAND = f"{_cells(N, GRID)}, v AS (SELECT sample_id, hdim, bin, step, {TENT} AS y, row_number() OVER (PARTITION BY sample_id, hdim, bin ORDER BY {TENT} DESC) - 1 AS layer FROM x JOIN d USING (sample_id, hdim)), y AS (SELECT x.sample_id, x.hdim, l::INT AS layer, x.bin, x.step, coalesce(v.y, 0.0) AS y FROM x CROSS JOIN range({{k}}) r(l) LEFT JOIN v ON v.sample_id = x.sample_id AND v.hdim = x.hdim AND v.bin = x.bin AND v.layer = l)"
SIL = f"{_cells(N, GRID)}, m AS (SELECT *, CASE WHEN {{p}} > 8 AND max(death - birth) OVER (PARTITION BY sample_id, hdim) > 0 THEN max(death - birth) OVER (PARTITION BY sample_id, hdim) ELSE 1.0 END AS m FROM d), y AS (SELECT x.sample_id, x.hdim, 0::INT AS layer, bin, any_value(step) AS step, coalesce(sum(pow((death - birth) / m, {{p}}) * {TENT}) / nullif(sum(pow((death - birth) / m, {{p}})), 0), 0.0) AS y FROM x LEFT JOIN m USING (sample_id, hdim) GROUP BY ALL)"
OUT = " SELECT sample_id, hdim, layer, bin, round(y, 6) + 0.0 AS y FROM y"


@q("dgm_betti_curve", BETTI + OUT)
def _(spark, sf):
    return dg.curves(tables.diagrams(spark, sf), "betti", N).withColumn("y", r("y"))


@q("dgm_landscape", LAND.format(k=3) + OUT)
def _(spark, sf):
    return dg.curves(tables.diagrams(spark, sf), "landscape", N, n_layers=3).withColumn("y", r("y"))


for _p in (1.0, 10.0):

    @q(f"dgm_silhouette_{_p:g}", SIL.format(p=_p) + OUT)
    def _(spark, sf, p=_p):
        return dg.curves(tables.diagrams(spark, sf), "silhouette", N, power=p).withColumn("y", r("y"))


M = 6
SIGMA = 20.0


def _gauss(d: str, s: str) -> str:
    return f"(CASE WHEN abs({d}) <= floor(4 * {s} + 0.5) THEN exp(-0.5 * ({d}) * ({d}) / ({s} * {s})) ELSE 0.0 END)"


def _mass(s: str) -> str:
    return f"list_sum(list_transform(range(-floor(4 * {s} + 0.5)::BIGINT, floor(4 * {s} + 0.5)::BIGINT + 1), lambda k: exp(-0.5 * k * k / ({s} * {s}))))"


GAUSS = f"""{GRID.format(m=M - 1)}, s AS (SELECT *, {SIGMA} / step AS s, {_mass(f'({SIGMA} / step)')} AS m FROM g),
 p AS (SELECT sample_id, hdim, s, step, m, least(floor((birth - lo) / step), {M - 1}) AS x, least(floor((death - lo) / step), {M - 1}) AS y FROM d JOIN s USING (hdim) WHERE birth <> death),
 i AS (SELECT f.sample_id, f.hdim, a::INT AS "row", b::INT AS col FROM f, range({M}) r1(a), range({M}) r2(b)),
 y AS (SELECT i.sample_id, i.hdim, i."row", i.col, any_value(step * step) AS cell, coalesce(sum({_gauss('col - x', 's')} * {_gauss(f'{M - 1} - "row" - y', 's')} - {_gauss(f'{M - 1} - "row" - x', 's')} * {_gauss('col - y', 's')}) / any_value(m * m * step * step), 0.0) AS v FROM i LEFT JOIN p USING (sample_id, hdim) GROUP BY ALL)"""


def _image(weight: str) -> str:
    return f"""{IGRID.format(m=M - 1)}, s AS (SELECT *, {SIGMA} / bstep AS sb, {SIGMA} / lstep AS sl, {_mass(f'({SIGMA} / bstep)')} AS mb, {_mass(f'({SIGMA} / lstep)')} AS ml FROM g),
 p AS (SELECT sample_id, hdim, sb, sl, bstep, lstep, mb * ml AS m, least(floor((birth - blo) / bstep), {M - 1}) AS x, least(floor((greatest(death - birth, llo) - llo) / lstep), {M - 1}) AS y, llo FROM d JOIN s USING (hdim) WHERE greatest(death - birth, llo) <> 0),
 w AS (SELECT *, {weight} AS w FROM p),
 i AS (SELECT f.sample_id, f.hdim, a::INT AS "row", b::INT AS col FROM f, range({M}) r1(a), range({M}) r2(b)),
 y AS (SELECT i.sample_id, i.hdim, i."row", i.col, any_value(bstep * lstep) AS cell, coalesce(sum(w * {_gauss('col - x', 'sb')} * {_gauss(f'{M - 1} - "row" - y', 'sl')}) / any_value(m * bstep * lstep), 0.0) AS v FROM i LEFT JOIN w USING (sample_id, hdim) GROUP BY ALL)"""


ROUT = ' SELECT sample_id, hdim, "row", col, round(v, 8) + 0.0 AS v FROM y'


@q("dgm_heat_kernel", GAUSS + ROUT)
def _(spark, sf):
    return dg.rasters(tables.diagrams(spark, sf), "heat", M, sigma=SIGMA).withColumn("v", r("v", 8))


@q("dgm_persistence_image", _image("1.0") + ROUT)
def _(spark, sf):
    return dg.rasters(tables.diagrams(spark, sf), "persistence_image", M, sigma=SIGMA).withColumn("v", r("v", 8))


@q("dgm_persistence_image_linear", _image("llo + y * lstep") + ROUT.replace("8", "6"))
def _(spark, sf):
    return dg.rasters(tables.diagrams(spark, sf), "persistence_image", M, sigma=SIGMA, weight=lambda x: x).withColumn("v", r("v", 6))


AMP = "SELECT sample_id, hdim, round(coalesce({a}, 0.0), 6) + 0.0 AS amplitude FROM f LEFT JOIN d USING (sample_id, hdim) GROUP BY ALL"


@q("dgm_amplitude_bottleneck", AMP.format(a="max((death - birth) / 2)"))
def _(spark, sf):
    return dg.amplitude(tables.diagrams(spark, sf), "bottleneck").withColumn("amplitude", r("amplitude"))


@q("dgm_amplitude_wasserstein", AMP.format(a="sqrt(sum(pow((death - birth) / 2, 2)))"))
def _(spark, sf):
    return dg.amplitude(tables.diagrams(spark, sf), "wasserstein").withColumn("amplitude", r("amplitude"))


@q("dgm_amplitude_order", "SELECT sample_id, round(sqrt(sum(a * a)), 6) + 0.0 AS amplitude FROM (SELECT sample_id, hdim, max((death - birth) / 2) AS a FROM d GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    return dg.amplitude(tables.diagrams(spark, sf), "bottleneck", order=2.0).withColumn("amplitude", r("amplitude"))


KINDS = {
    "betti": (BETTI, "y", "step", {"n_bins": N}),
    "landscape": (LAND.format(k=2), "y", "step", {"n_bins": N, "n_layers": 2}),
    "silhouette": (SIL.format(p=1.0), "y", "step", {"n_bins": N}),
    "heat": (GAUSS, "v", "cell", {"n_bins": M, "sigma": SIGMA}),
    "persistence_image": (_image("1.0"), "v", "cell", {"n_bins": M, "sigma": SIGMA}),
}
for _m, (_cte, _v, _cell, _params) in KINDS.items():

    @q(f"dgm_amplitude_{_m}", f"{_cte} SELECT sample_id, hdim, round(coalesce(sqrt(sum({_v} * {_v}) * any_value({_cell})), 0.0), 6) + 0.0 AS amplitude FROM y GROUP BY ALL")
    def _(spark, sf, m=_m, params=_params):
        return dg.amplitude(tables.diagrams(spark, sf), m, **params).withColumn("amplitude", r("amplitude"))

    _keys = '"row", col' if _v == "v" else "layer, bin"

    @q(f"dgm_distance_{_m}", f"{_cte}, c AS (SELECT hdim, any_value({_cell}) AS cell FROM y WHERE {_cell} IS NOT NULL GROUP BY hdim) SELECT a.sample_id AS i, b.sample_id AS j, hdim, round(sqrt(sum((a.{_v} - b.{_v}) * (a.{_v} - b.{_v})) * any_value(c.cell)), 5) + 0.0 AS d FROM y a JOIN y b USING (hdim, {_keys}) JOIN c USING (hdim) GROUP BY ALL")
    def _(spark, sf, m=_m, params=_params):
        return dg.distances(tables.diagrams(spark, sf), m, **params).withColumn("d", r_many("d", 5))


TRIANGLES = """c AS (SELECT vec_id // 3 AS sample_id, vec_id % 3 AS i, embedding::DOUBLE[] AS x FROM embeddings),
 e AS (SELECT a.sample_id, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS w FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.i < b.i),
 l AS (SELECT sample_id, (list({'b': 0.0::DOUBLE, 'd': w} ORDER BY w))[1:2] AS p FROM e GROUP BY ALL)"""


def triangles(spark, sf):
    """H0 diagrams of clouds of three points: the two shorter sides."""
    d = homology.rips(tables.clouds(spark, sf, 3), dimensions=(0,))
    return dg.finish(d.withColumnRenamed("cloud_id", "sample_id"), 1e9)


def _matching(cost: str, total: str) -> str:
    """Two points a diagram: nobody matched, one pair, or two pairs; what is left goes to the diagonal."""
    return f"""pr AS (SELECT a.sample_id AS i, b.sample_id AS j, 0::INT AS hdim, a.p[1] AS a1, a.p[2] AS a2, b.p[1] AS b1, b.p[2] AS b2 FROM l a, l b),
 m AS (SELECT i, j, hdim, unnest([{", ".join(_options(cost, total))}]) AS c FROM pr)"""


def _options(cost: str, total: str) -> list[str]:
    inf = "1e300::DOUBLE"
    diag = lambda p: f"coalesce(({p}.d - {p}.b) / 2, 0.0)"
    pair = lambda p, q: f"CASE WHEN {p} IS NULL OR {q} IS NULL THEN {inf} ELSE greatest(abs({p}.b - {q}.b), abs({p}.d - {q}.d)) END"
    out = [[diag("a1"), diag("a2"), diag("b1"), diag("b2")]]
    for p, p2 in (("a1", "a2"), ("a2", "a1")):
        for o, o2 in (("b1", "b2"), ("b2", "b1")):
            out.append([pair(p, o), diag(p2), diag(o2)])
    out += [[pair("a1", "b1"), pair("a2", "b2")], [pair("a1", "b2"), pair("a2", "b1")]]
    return [total.format(", ".join(cost.format(c) for c in own)) for own in out]


@q("dgm_distance_bottleneck", _matching("{}", "greatest({})") + " SELECT i, j, hdim, round(min(c), 6) + 0.0 AS d FROM m GROUP BY ALL", TRIANGLES)
def _(spark, sf):
    return dg.distances(triangles(spark, sf), "bottleneck").withColumn("d", r_many("d"))


@q("dgm_distance_wasserstein", _matching("least({}, 1e100) ** 2", "list_sum([{}])") + " SELECT i, j, hdim, round(sqrt(min(c)), 6) + 0.0 AS d FROM m GROUP BY ALL", TRIANGLES)
def _(spark, sf):
    return dg.distances(triangles(spark, sf), "wasserstein").withColumn("d", r_many("d"))


CURVE = BETTI + ", v AS (SELECT sample_id, hdim AS channel, bin, y FROM y)"
for _f, _sql in {
    "max": "max(y)", "min": "min(y)", "mean": "avg(y)", "std": "stddev_pop(y)", "median": "median(y)",
    "argmax": "min(bin) FILTER (y = m)", "argmin": "min(bin) FILTER (y = l)", "average": "sum(y * (bin + 1)) / sum(bin + 1)",
}.items():

    @q(f"curve_{_f}", f"{CURVE}, w AS (SELECT *, max(y) OVER p AS m, min(y) OVER p AS l FROM v WINDOW p AS (PARTITION BY sample_id, channel)) SELECT sample_id, channel, round({_sql}, 6)::DOUBLE + 0.0 AS feature FROM w GROUP BY ALL")
    def _(spark, sf, f=_f):
        c = dg.curves(tables.diagrams(spark, sf), "betti", N).select("sample_id", F.col("hdim").alias("channel"), "bin", "y")
        return curves.features(c, f, [float(k + 1) for k in range(N)] if f == "average" else None).withColumn("feature", r("feature"))


@q("curve_derivative", f"{CURVE} SELECT sample_id, channel, (bin - 2)::INT AS bin, y - 2 * b + a AS y FROM (SELECT *, lag(y) OVER p AS b, lag(y, 2) OVER p AS a FROM v WINDOW p AS (PARTITION BY sample_id, channel ORDER BY bin)) WHERE bin >= 2")
def _(spark, sf):
    c = dg.curves(tables.diagrams(spark, sf), "betti", N).select("sample_id", F.col("hdim").alias("channel"), "bin", "y")
    return curves.derivative(c, 2)


@q("plot_diagram_data", "w AS (SELECT *, min(birth) OVER p AS lo, max(death) OVER p AS hi FROM d WINDOW p AS (PARTITION BY sample_id)) SELECT sample_id, hdim, birth, death AS y, round(lo - 0.02 * (hi - lo), 6) + 0.0 AS axis_lo, round(hi + 0.02 * (hi - lo), 6) + 0.0 AS axis_hi, count(*) AS multiplicity FROM w WHERE birth <> death GROUP BY ALL")
def _(spark, sf):
    p = plotdata.diagram(tables.diagrams(spark, sf))
    return p.withColumn("axis_lo", r("axis_lo")).withColumn("axis_hi", r("axis_hi"))


@q("plot_betti_surface", BETTI + " SELECT sample_id, bin, y FROM y WHERE hdim = 1")
def _(spark, sf):
    return plotdata.betti_surface(dg.curves(tables.diagrams(spark, sf), "betti", N), 1)


