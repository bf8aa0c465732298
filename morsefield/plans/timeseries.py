"""Queries on series: a user's events in order of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..sources import tables
from .registry import query, r

S = """s AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, event_type,
 count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
DAILY = """d AS (SELECT floor(date_diff('day', DATE '1970-01-01', ts::DATE) / 7)::BIGINT AS window_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS t,
 event_type AS var, sum(value) AS value FROM events GROUP BY ALL)"""


def _windows(size: int, stride: int) -> str:
    return f"""WITH {S}, w AS (SELECT series_id, t - {size - 1} AS b, t + 1 AS e FROM s WHERE t >= {size - 1} AND (n - 1 - t) % {stride} = 0)
SELECT w.series_id, w.e AS window_end, s.t - w.b AS pos, s.value FROM w JOIN s ON s.series_id = w.series_id AND s.t >= w.b AND s.t < w.e"""


def _exploded(spark, sf, size, stride):
    w = ts.sliding_window(tables.series(spark, sf), size, stride)
    return w.select("series_id", F.col("end").alias("window_end"), F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query("ts_sliding_window", _windows(5, 3))
def _(spark, sf):
    return _exploded(spark, sf, 5, 3)


@query("ts_tumbling_window", _windows(6, 6))
def _(spark, sf):
    return _exploded(spark, sf, 6, 6)


@query("ts_slice_windows", f'WITH {S} SELECT series_id, t - 4 AS "begin", t + 1 AS "end" FROM s WHERE t >= 4 AND (n - 1 - t) % 3 = 0')
def _(spark, sf):
    return ts.slice_windows(tables.series(spark, sf), 5, 3)


@query("ts_window_resample_y", f"WITH {S} SELECT series_id, t, value FROM s WHERE t >= 4 AND (n - 1 - t) % 3 = 0")
def _(spark, sf):
    return ts.resample_to_windows(tables.series(spark, sf), 5, 3).select("series_id", "t", "value")


def _takens_sql(phase: str) -> str:
    return f"""WITH {S}, l AS (SELECT series_id, t, n, lag(value, 4) OVER w AS x0, lag(value, 2) OVER w AS x1, value AS x2 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, t, x0, x1, x2 FROM l WHERE t >= 4 AND {phase} % 2 = 0"""


def _three(v):
    return v.select("series_id", "t", *(F.get("vector", F.lit(k)).alias(f"x{k}") for k in range(3)))


@query("ts_takens_fixed", _takens_sql("(n - 1 - t)"))
def _(spark, sf):
    return _three(ts.takens(tables.series(spark, sf), 2, 3, 2))


@query("ts_takens_from_start", _takens_sql("(t - 4)"))
def _(spark, sf):
    return _three(ts.takens(tables.series(spark, sf), 2, 3, 2, ensure_last_value=False))


@query("ts_takens_multivariate", f"""WITH {DAILY}, l AS (SELECT t, var, lag(value) OVER (PARTITION BY var ORDER BY t) AS x0, value AS x1 FROM d),
 v AS (SELECT t, unnest([struct_pack(k := 0, x := x0), struct_pack(k := 1, x := x1)]) AS p, dense_rank() OVER (ORDER BY var) - 1 AS i FROM l WHERE x0 IS NOT NULL)
SELECT t, 2 * (dense_rank() OVER (PARTITION BY t ORDER BY i) - 1) + p.k AS pos, round(p.x, 6) + 0.0 AS x FROM v""")
def _(spark, sf):
    d = tables.daily(spark, sf).select(F.lit(0).alias("series_id"), "var", "t", "value")
    d = d.withColumn("day", F.col("t")).withColumn("t", F.row_number().over(ts.Window.partitionBy("var").orderBy("day")).cast("long") - 1)
    days = d.select("var", "t", "day")
    v = ts.takens(d, 1, 2, by=("series_id", "var")).join(days, ["var", "t"]).select("series_id", F.col("day").alias("t"), "var", "vector")
    own = F.array_sort(F.collect_list(F.struct("var", "vector")))
    flat = v.groupBy("series_id", "t").agg(F.flatten(F.transform(own, lambda x: x["vector"])).alias("vector"))
    return flat.select("t", F.posexplode("vector").alias("pos", "x")).select("t", F.col("pos").cast("long").alias("pos"), r("x").alias("x"))


MI = f"""{S}, p AS (SELECT d.delay, a.series_id, a.value AS y, b.value AS x FROM (SELECT unnest([1, 2, 3]) AS delay) d JOIN s a ON a.t >= d.delay JOIN s b ON b.series_id = a.series_id AND b.t = a.t - d.delay),
 g AS (SELECT *, min(x) OVER q AS xl, max(x) OVER q AS xh, min(y) OVER q AS yl, max(y) OVER q AS yh FROM p WINDOW q AS (PARTITION BY series_id, delay)),
 b AS (SELECT series_id, delay, least(floor((x - CASE WHEN xh > xl THEN xl ELSE xl - 0.5 END) / CASE WHEN xh > xl THEN xh - xl ELSE 1.0 END * 8), 7)::BIGINT AS bx,
   least(floor((y - CASE WHEN yh > yl THEN yl ELSE yl - 0.5 END) / CASE WHEN yh > yl THEN yh - yl ELSE 1.0 END * 8), 7)::BIGINT AS b_y FROM g),
 c AS (SELECT series_id, delay, bx, b_y, count(*) AS k FROM b GROUP BY ALL),
 t AS (SELECT *, k / sum(k) OVER (PARTITION BY series_id, delay) AS p, sum(k) OVER (PARTITION BY series_id, delay, bx) / sum(k) OVER (PARTITION BY series_id, delay) AS px,
   sum(k) OVER (PARTITION BY series_id, delay, b_y) / sum(k) OVER (PARTITION BY series_id, delay) AS py FROM c),
 m AS (SELECT series_id, delay, sum(p * ln(p / (px * py))) AS mi FROM t GROUP BY ALL)"""


@query("ts_mutual_information", f"WITH {MI} SELECT series_id, delay::BIGINT AS delay, round(mi, 6) + 0.0 AS mi FROM m")
def _(spark, sf):
    return ts.mutual_information(tables.series(spark, sf), [1, 2, 3], 8).select("series_id", F.col("delay").cast("long").alias("delay"), r("mi").alias("mi"))


def false_sql(delays: str, dimensions: int) -> str:
    """(series_id, delay, dimension, n_false): nearest delay vectors by a join of each series with itself. delays: (series_id, delay)."""
    x = ", ".join(f"(SELECT value FROM z o WHERE o.series_id = z.series_id AND o.i = z.i - {k} * delay) AS x{k}" for k in range(dimensions))
    far = " UNION ALL ".join(f"SELECT a.series_id, a.delay, a.n, a.sd, a.i, b.i AS o, {d} AS d, {' + '.join(f'(a.x{k} - b.x{k}) * (a.x{k} - b.x{k})' for k in range(d))} AS sq FROM v a JOIN v b ON a.series_id = b.series_id AND a.i <> b.i" for d in range(1, dimensions + 1))
    return f"""z AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n, stddev_pop(value) OVER (PARTITION BY series_id) AS sd FROM s),
 v AS (SELECT z.*, delay, {x} FROM z JOIN {delays} USING (series_id)), pr AS ({far}),
 nn AS (SELECT series_id, delay, n, sd, d, n - (d - 1) * delay AS m, i - (d - 1) * delay AS j, o - (d - 1) * delay AS near, sqrt(sq) AS gap FROM pr WHERE sq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, d, i ORDER BY sq, o) = 1),
 hit AS (SELECT g.series_id, g.d FROM nn g JOIN nn h ON h.series_id = g.series_id AND h.d = g.d AND h.j = g.j + g.d * g.delay JOIN z a ON a.series_id = g.series_id AND a.i = h.n - h.m + h.j JOIN z b ON b.series_id = g.series_id AND b.i = h.near
  WHERE g.gap > 0 AND abs(a.value - b.value) / g.gap > 10 AND g.gap < 2 * g.sd),
 ff AS (SELECT series_id, delay, d::INT AS dimension, (SELECT count(*) FROM hit WHERE hit.series_id = k.series_id AND hit.d = dims.d) AS n_false FROM (SELECT DISTINCT series_id, delay FROM v) k, (SELECT unnest(range(1, {dimensions + 1})) AS d) dims)"""


BEST_DELAY = MI.replace("[1, 2, 3]", "[1, 2]").replace("* 8)", "* 100)").replace("), 7)", "), 99)")


@query("ts_takens_search", f"""WITH {BEST_DELAY}, best AS (SELECT series_id, delay FROM m QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(mi, 9), delay) = 1), {false_sql("best", 5)},
 sc AS (SELECT *, abs(n_false - 2 * f1 + f2) / ((f1 + 1) * dimension) AS sc FROM (SELECT *, lead(n_false) OVER w AS f1, lead(n_false, 2) OVER w AS f2 FROM ff WINDOW w AS (PARTITION BY series_id ORDER BY dimension)))
SELECT series_id, delay::BIGINT AS delay, dimension::BIGINT AS dimension FROM sc WHERE dimension BETWEEN 2 AND 3 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sc, dimension) = 1""")
def _(spark, sf):
    found = ts.search_embedding(tables.series(spark, sf), 2, 3)
    return found.select("series_id", F.col("delay").cast("long").alias("delay"), F.col("dimension").cast("long").alias("dimension"))


@query("ts_false_neighbours", f"WITH {S}, one AS (SELECT DISTINCT series_id, 1 AS delay FROM s), {false_sql('one', 3)} SELECT series_id, dimension, n_false FROM ff")
def _(spark, sf):
    return ts.false_neighbours(tables.series(spark, sf), 1, [1, 2, 3])


@query("ts_resampler", f"WITH {S} SELECT series_id, t, value FROM s WHERE t % 3 = 0")
def _(spark, sf):
    return ts.resample(tables.series(spark, sf), 3).select("series_id", "t", "value")


@query("ts_stationarize_return", f"WITH {S}, l AS (SELECT series_id, t, value, lag(value) OVER (PARTITION BY series_id ORDER BY t) AS b FROM s) SELECT series_id, t, round((value - b) / nullif(value, 0), 6) + 0.0 AS value FROM l WHERE t > 0")
def _(spark, sf):
    return ts.stationarize(tables.series(spark, sf)).select("series_id", "t", r("value").alias("value"))


@query("ts_stationarize_log_return", f"WITH {S}, l AS (SELECT series_id, t, ln(abs(value) + 1) AS v, lag(ln(abs(value) + 1)) OVER (PARTITION BY series_id ORDER BY t) AS b FROM s) SELECT series_id, t, round(v - b, 6) + 0.0 AS value FROM l WHERE t > 0")
def _(spark, sf):
    own = tables.series(spark, sf).withColumn("value", F.abs("value") + 1)
    return ts.stationarize(own, "log-return").select("series_id", "t", r("value").alias("value"))


def _label_sql(f: str, future: int, classes: bool) -> str:
    q = "(SELECT series_id, quantile_cont(abs(f), 0.25) AS q1, quantile_cont(abs(f), 0.75) AS q2 FROM w WHERE f IS NOT NULL GROUP BY ALL)"
    label = "((abs(f) >= q1)::INT + (abs(f) >= q2)::INT)::BIGINT" if classes else "f"
    out = f"lead(label, {future}) OVER (PARTITION BY series_id ORDER BY t)"
    return f"""WITH {S}, w AS (SELECT series_id, t, value, CASE WHEN t >= 5 THEN {f}(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS f FROM s),
 k AS (SELECT w.*, {label} AS label FROM w JOIN {q} USING (series_id)), l AS (SELECT series_id, t, value, {out} AS label FROM k)
SELECT series_id, t, value, {"label" if classes else "round(label, 6) + 0.0 AS label"} FROM l WHERE label IS NOT NULL"""


for _n in (1, 7):

    @query(f"ts_labeller_max_{_n}", _label_sql("max", _n, True))
    def _(spark, sf, n=_n):
        return ts.label(tables.series(spark, sf), 6, "max", [25, 75], n)


@query("ts_labeller_std", _label_sql("stddev_pop", 2, False))
def _(spark, sf):
    return ts.label(tables.series(spark, sf), 6, "std", None, 2).withColumn("label", r("label"))


PATTERN = f"""{S}, v AS (SELECT series_id, t, [lag(value, 2) OVER w, lag(value, 1) OVER w, value] AS v FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)),
 a AS (SELECT series_id, t, (CASE WHEN v[1] <= v[2] AND v[1] <= v[3] THEN CASE WHEN v[2] <= v[3] THEN '0,1,2' ELSE '0,2,1' END
   WHEN v[2] < v[1] AND v[2] <= v[3] THEN CASE WHEN v[1] <= v[3] THEN '1,0,2' ELSE '1,2,0' END
   ELSE CASE WHEN v[1] <= v[2] THEN '2,0,1' ELSE '2,1,0' END END) AS pattern FROM v WHERE t >= 2)"""


@query("ts_permutation_entropy", f"WITH {PATTERN}, c AS (SELECT series_id, pattern, count(*) AS k FROM a GROUP BY ALL), p AS (SELECT series_id, k / sum(k) OVER (PARTITION BY series_id) AS p FROM c) SELECT series_id, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY ALL")
def _(spark, sf):
    v = ts.takens(tables.series(spark, sf), 1, 3)
    return ts.permutation_entropy(v).select("series_id", r("entropy").alias("entropy"))


def _pearson(d: str) -> str:
    return f"""WITH {DAILY}, c AS (SELECT x.window_id, x.var AS a, y.var AS b, corr(x.value, y.value) AS rho, count(*) AS k FROM d x JOIN d y USING (window_id, t) GROUP BY ALL)
SELECT window_id, a, b, CASE WHEN a = b THEN 0.0 ELSE round({d}, 6) + 0.0 END::DOUBLE AS d FROM c WHERE k > 1"""


@query("ts_pearson_dissimilarity", _pearson("(1 - rho) / 2"))
def _(spark, sf):
    return ts.pearson_dissimilarity(tables.daily(spark, sf)).withColumn("d", r("d"))


@query("ts_pearson_dissimilarity_abs", _pearson("1 - abs(rho)"))
def _(spark, sf):
    return ts.pearson_dissimilarity(tables.daily(spark, sf), True).withColumn("d", r("d"))
