"""Operators on small fixtures, streams, pipelines, and a few queries against their SQL."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from morsefield.functions import complexes as cx
from morsefield.functions import matching
from morsefield.operators import curves, graphs, homology, images, mapper, plotdata
from morsefield.operators import diagrams as dg
from morsefield.operators import timeseries as ts
from morsefield.operators.pipeline import Function, Pipeline, for_each_entry, make_pipeline
from morsefield.sources import tables
from morsefield.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dgm5(spark):
    rows = [(0, 0, 0.0, 0.0), (0, 0, 0.0, 1.0), (0, 0, 2.0, 3.0), (0, 1, 4.0, 6.0), (0, 1, 2.0, 6.0)]
    return spark.createDataFrame(rows, "sample_id long, hdim int, birth double, death double")


def by_dim(df, name):
    return [r[name] for r in df.orderBy("hdim").collect()]


def test_diagram_features(dgm5):
    assert np.allclose(by_dim(dg.entropy(dgm5), "entropy"), [1, 0.91829583405])
    assert np.allclose(by_dim(dg.entropy(dgm5, normalize=True), "entropy"), [1, 0.355245321276])
    assert by_dim(dg.number_of_points(dgm5), "n") == [2, 2]
    poly = {(r.hdim, r.k): (r.re, r.im) for r in dg.complex_polynomial(dgm5, 3).collect()}
    assert np.allclose(poly[0, 1], (-2, -4)) and np.allclose(poly[1, 1], (-6, -12))
    z = np.poly([2 + 6j, 4 + 6j])
    assert np.allclose(poly[1, 2], (z[2].real, z[2].imag)) and poly[1, 3] == (0, 0)
    assert by_dim(dg.amplitude(dgm5, "bottleneck"), "amplitude") == [0.5, 2.0]
    assert dg.filtering(dgm5, 1.0, [0]).count() == 2
    assert by_dim(dg.amplitude(dg.scaled(dgm5, dg.scale_of(dgm5)), "bottleneck"), "amplitude") == [0.25, 1.0]


def test_distance_to_the_empty_diagram_is_the_amplitude(spark, dgm5):
    empty = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 1.0, 1.0)], dgm5.schema)
    both = dgm5.unionByName(empty)
    for metric, params in (("bottleneck", {}), ("wasserstein", {}), ("betti", {"n_bins": 9}), ("landscape", {"n_bins": 9, "n_layers": 2}), ("silhouette", {"n_bins": 9}), ("heat", {"n_bins": 5, "sigma": 1.0}), ("persistence_image", {"n_bins": 5, "sigma": 1.0})):
        a = {r.hdim: r.amplitude for r in dg.amplitude(both, metric, **params).filter("sample_id = 0").collect()}
        d = {r.hdim: r.d for r in dg.distances(both, metric, **params).filter("i = 0 and j = 1").collect()}
        assert np.allclose([a[0], a[1]], [d[0], d[1]]), metric


def test_heat_is_antisymmetric_and_curves(dgm5):
    v = {(r.row, r.col): r.v for r in dg.rasters(dgm5, "heat", 5, sigma=1.0).filter("hdim = 1").collect()}
    assert all(math.isclose(v[i, j], -v[4 - j, 4 - i], abs_tol=1e-12) for i in range(5) for j in range(5))
    c = dg.curves(dgm5, "betti", 5).filter("hdim = 1").orderBy("bin")
    assert [r.y for r in c.collect()] == [1, 1, 2, 2, 0]
    own = c.select("sample_id", F.col("hdim").alias("channel"), "bin", "y")
    assert curves.features(own, "argmax").first().feature == 2
    assert [r.y for r in curves.derivative(own).orderBy("bin").collect()] == [0, 1, 0, -2]
    assert curves.vectors(own).first().feature == [1, 1, 2, 2, 0]
    assert plotdata.diagram(dgm5).filter("hdim = 0").count() == 2


def test_series(spark):
    ramp = spark.createDataFrame([(0, t, float(t % 10)) for t in range(20)], "series_id long, t long, value double")
    y = [r.label for r in ts.label(ramp, 6, "max", None, 1).orderBy("t").collect()]
    assert y == [5, 6, 7, 8] + [9] * 6 + [5, 6, 7, 8, 9]
    w = ts.sliding_window(ramp, 4, 3).orderBy("begin").collect()
    assert [r.begin for r in w] == [1, 4, 7, 10, 13, 16] and w[-1]["values"] == [6, 7, 8, 9]
    assert ts.resample_to_windows(ramp, 1).count() == 0
    v = ts.takens(ramp, 2, 3, 4).orderBy("t").collect()
    assert v[-1].t == 19 and v[-1].vector == [5, 7, 9]
    perm = spark.createDataFrame([(0, i, v) for i, v in enumerate([[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [7.0, 6.0, 5.0]])], "series_id long, t long, vector array<double>")
    assert math.isclose(ts.permutation_entropy(perm).first().entropy, 0.91829583, rel_tol=1e-7)
    with pytest.raises(ValueError):
        ts.search_embedding(ramp, 2, 1)
    with pytest.raises(ValueError):
        ts.stationarize(ramp, "other")


def test_clouds(spark):
    pts = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 2.0]), (0, 2, [5.0, 6.0])], "cloud_id long, point_id int, coords array<double>")
    d = {(r.src, r.dst): r.w for r in graphs.consistent_rescaling(pts).collect()}
    a, b, c = math.sqrt(5), math.sqrt(61), math.sqrt(32)
    assert math.isclose(d[0, 1], a / math.sqrt(a * a)) and math.isclose(d[0, 2], b / math.sqrt(a * c)) and math.isclose(d[1, 2], c / math.sqrt(a * c))
    k = {(r.src, r.dst) for r in graphs.knn_graph(pts, 1).collect()}
    assert k == {(0, 1), (1, 0), (2, 1)}
    far = {(r.src, r.dst): r.w for r in graphs.geodesic_distance(graphs.knn_graph(pts, 1, "distance")).collect()}
    assert math.isclose(far[0, 2], a + c)
    same = homology.weighted_rips(pts, pts.select("cloud_id", F.col("point_id").alias("v"), F.lit(0.0).alias("w")))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, homology.rips(pts).collect()))
    assert tables.check_clouds(pts).first().problem is None
    with pytest.raises(Exception, match="no"):
        tables.require(pts, F.size("coords") > 5, "no").collect()


def test_images_against_iterated_dilation(spark):
    rng = np.random.default_rng(3)
    masks = rng.random((4, 5, 6)) > 0.8
    masks[0], masks[1] = False, True
    rows = [(k, r, c, bool(masks[k, r, c])) for k in range(4) for r in range(5) for c in range(6)]
    img = spark.createDataFrame(rows, "img_id long, r int, c int, on boolean")

    def steps(m, n):
        out, cur = np.where(m, 0.0, 11.0), m.copy()
        for i in range(1, n + 1):
            p = np.pad(cur, 1)
            new = cur | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
            out[new & ~cur] = i
            cur = new
        return out

    for n in (None, 2):
        got = {(r.img_id, r.r, r.c): r.v for r in images.dilation(img, n).collect()}
        ero = {(r.img_id, r.r, r.c): r.v for r in images.erosion(img, n).collect()}
        for k in range(4):
            want, other = steps(masks[k], n or 11), steps(~masks[k], n or 11)
            assert all(got[k, r, c] == want[r, c] and ero[k, r, c] == other[r, c] for r in range(5) for c in range(6))
    assert images.pad(img).count() == 4 * 7 * 8
    solid = spark.createDataFrame([(0, r, c, z, True) for r in range(3) for c in range(4) for z in range(2)], "img_id long, r int, c int, z int, on boolean")
    assert images.density(solid, 1.0).agg(F.max("v")).first()[0] == 6
    assert images.height(solid).agg(F.max("v")).first()[0] == pytest.approx(6 / math.sqrt(3))


def test_cover_and_nerve(spark):
    rng = np.random.default_rng(4)
    vals = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.random(60))], "point_id long, value double")
    for kind in ("uniform", "balanced"):
        cover = mapper.prune(mapper.cover_1d(vals, 5, 0.4, kind))
        assert cover.select("point_id").distinct().count() == 60
        assert [r.set_id for r in cover.select("set_id").distinct().orderBy("set_id").collect()] == list(range(5))
    with pytest.raises(Exception, match="one filter value"):
        mapper.cover_1d(vals.withColumn("value", F.lit(1.0)), 3, 0.1).collect()
    refined = spark.createDataFrame([(p, s, 0) for s, ps in enumerate(([0, 1, 2, 3], [1, 2], [3, 4, 5], [5, 6], [6])) for p in ps], "point_id long, set_id long, label int")
    nodes, edges = mapper.nerve_contracted(refined)
    members = {tuple(sorted(r.point_id for r in refined.filter(F.col("set_id") == n.set_id).collect())) for n in nodes.collect()}
    assert members == {(0, 1, 2, 3), (3, 4, 5), (5, 6)}
    assert sorted(r.weight for r in edges.collect()) == [1, 1]
    assert mapper.nerve_edges(refined).count() == 4
    assert mapper.MapperPipeline(n_intervals=3).set_params(overlap_frac=0.2).get_params()["overlap_frac"] == 0.2
    with pytest.raises(KeyError):
        mapper.MapperPipeline(eps=1)


def test_pipelines(spark):
    s = spark.createDataFrame([(0, t, float(t)) for t in range(12)], "series_id long, t long, value double")
    p = make_pipeline(lambda d: ts.resample(d, 2), ts.stationarize)
    assert [n for n, _ in p.steps] == ["<lambda>", "stationarize"]
    q = Pipeline([("half", Function(lambda d: ts.resample(d, 2), lambda y: ts.resample(y, 2)))])
    x, y = q.fit_transform_resample(s, s)
    assert x.count() == y.count() == 6
    with pytest.raises(ValueError):
        q.inverse_transform(x)
    out = for_each_entry(s, "series_id", lambda pdf: pdf.head(1), "series_id long, t long, value double")
    assert out.count() == 1


def test_streams(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("t", windows.tumbling(stream), "complete"), ("c", windows.count_windows(stream, 5, 2), "append")):
        q = df.writeStream.format("memory").queryName(f"out_{name}").outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("out_t").agg(F.sum("n")).first()[0] == e.count()
    sizes = e.groupBy("user_id").count().collect()
    assert spark.table("out_c").count() == sum(max(0, (r["count"] - 5) // 2 + 1) for r in sizes)
    assert all(len(r["values"]) == 5 for r in spark.table("out_c").collect())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 450 and df.columns == ["cloud_id", "hdim", "birth", "death"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["ts_takens_fixed", "dgm_landscape", "img_signed_distance", "ph_rips_h0", "ph_cubical_betti1_curve", "mapper_nerve_edges", "graph_geodesic_weighted", "pipe_timeseries_amplitude"])
def test_query_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(f"select {', '.join(f'\"{x}\"' for x in cols)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))


def test_principal_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] @ np.linalg.qr(rng.normal(size=(5, 5)))[0] + 7
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, coords array<double>")
    got = np.array([[r.f0, r.f1] for r in sorted(mapper.principal(points).collect())])
    c = x - x.mean(0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:2]
    want = c @ axes.T
    assert np.allclose(np.abs(got), np.abs(want))
    assert all(a[np.abs(a).argmax()] > 0 for a in (np.linalg.lstsq(c, got, rcond=None)[0]).T)
    nodes, edges = mapper.MapperPipeline(n_intervals=3, clusterer=lambda y: mapper.dbscan(y, 4.0, 2)).fit_transform(points)
    assert nodes.count() > 1 and set(edges.columns) == {"src", "dst", "weight"}


def test_ranks_by_ranges(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 300, 1000).tolist() + [None]
    df = spark.createDataFrame([(None if x is None else float(x),) for x in v], "value double")
    want = {float(x): float(k) for k, x in enumerate(sorted({x for x in v if x is not None}))}
    assert {r.value: r.rank for r in mapper.dense_ranks(df).collect()} == want


def test_clusterers_with_weights(spark):
    x = np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [9.0]])
    assert mapper.kmeans(x, 3).tolist() == [0, 0, 0, 1, 1, 2]
    assert mapper.kmeans(x, 9).tolist() == [0, 1, 2, 3, 4, 5]
    assert mapper.kmeans(np.array([[0.0], [1.0], [3.0]]), 1, weights=np.array([1, 0, 1])).tolist() == [0, 0, 0]
    for linkage in ("single", "complete", "average", "ward"):
        assert mapper.agglomerative(x, 3, linkage).tolist() == [0, 0, 0, 1, 1, 2]
    assert mapper.agglomerative(x, linkage="single", distance_threshold=1.0).tolist() == [0, 0, 0, 1, 1, 2]
    assert mapper.dbscan(x, 0.5, 3).tolist() == [0, 0, 0, -1, -1, -1]
    assert mapper.dbscan(x, 0.5, 3, weights=np.array([1, 1, 1, 2, 1, 3])).tolist() == [0, 0, 0, 1, 1, 2]
    points = spark.createDataFrame([(i, v.tolist(), w) for i, (v, w) in enumerate(zip(x, [1.0, 1.0, 1.0, 2.0, 1.0, 3.0], strict=True))], "point_id long, coords array<double>, w double")
    cover = points.select("point_id", F.lit(0).alias("set_id"))
    got = mapper.cluster_sets(points, cover, lambda y, weights: mapper.dbscan(y, 0.5, 3, weights=weights), "w")
    assert [r.label for r in sorted(got.collect())] == [0, 0, 0, 1, 1, 2]


def test_distances_to_other_diagrams(spark):
    """Samples of the two collections may have the same number; all pairs count."""
    a = [(0, 0, 0.0, 1.0), (1, 0, 0.0, 2.0)]
    b = [(0, 0, 0.0, 4.0), (1, 0, 0.0, 1.0)]
    left, right = (spark.createDataFrame(x, "sample_id long, hdim int, birth double, death double") for x in (a, b))
    got = {(r.i, r.j): round(r.d, 9) for r in dg.distances(left, "bottleneck", other=right).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 0.0, (1, 0): 2.0, (1, 1): 1.0}
    own = {(r.i, r.j): round(r.d, 9) for r in dg.distances(left, "bottleneck").collect()}
    assert own == {(0, 0): 0.0, (1, 1): 0.0, (0, 1): 1.0, (1, 0): 1.0}


def test_sparse_filtration_leaves_edges_out():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(10, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert len(cx.sparse_rips(d, 0.9, 1)) < len(cx.flag_complex(d, 1))


def test_distances_in_blocks(spark, monkeypatch):
    """Diagrams meet in blocks: every pair once and both ways, whatever the number of blocks, also where one diagram is empty."""
    monkeypatch.setattr(dg, "BLOCK_ROWS", 4)
    rows = [(s, h, float(s % 5), float(s % 5 + 1 + s % 3)) for s in range(23) for h in (0, 1) if h == 0 or s != 7]
    dgm = spark.createDataFrame(rows, "sample_id long, hdim int, birth double, death double")
    own = {(s, h): [(b, d)] for s, h, b, d in rows}
    for metric in ("bottleneck", "wasserstein"):
        got = dg.distances(dgm, metric).collect()
        assert len(got) == len({(r.i, r.j, r.hdim) for r in got}) == 2 * 23 * 23
        f = getattr(matching, metric)
        assert all(r.d == pytest.approx(f(own.get((r.i, r.hdim), []), own.get((r.j, r.hdim), []))) for r in got)
    ys = {(r.sample_id, r.hdim): (r.ys, r.cell) for r in dg.vectors(dgm, "landscape", n_bins=6, n_layers=2).collect()}
    got = dg.distances(dgm, "landscape", n_bins=6, n_layers=2).collect()
    assert len(got) == len({(r.i, r.j, r.hdim) for r in got}) == 2 * 23 * 23
    for r in got:
        (x, cell), (y, _) = ys[r.i, r.hdim], ys[r.j, r.hdim]
        assert r.d == pytest.approx(np.sqrt(np.sum(np.subtract(x, y) ** 2) * cell))


def test_curves_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dg, "STEP", 64)
    rng = np.random.default_rng(3)
    points = {i: np.sort(rng.random((n, 2)), axis=1) for i, n in enumerate([1, 40, 3, 2, 7, 1])}
    rows = [(i, 0, float(b), float(d)) for i, p in points.items() for b, d in p] + [(6, 0, 0.2, None), (6, 0, 0.1, 0.8), (7, 1, 0.5, 0.5)]
    dgm = spark.createDataFrame(rows, "sample_id long, hdim int, birth double, death double")
    ends = [x for r in rows if r[1] == 0 for x in r[2:] if x is not None]
    t = min(ends) + np.arange(9) * ((max(ends) - min(ends)) / 8)
    for metric, params in (("betti", {}), ("landscape", {"n_layers": 2}), ("silhouette", {"power": 10.0})):
        v = dg.vectors(dgm, metric, n_bins=9, **params)
        # evaluated as built-in lambdas, the weights of a diagram were computed anew for each bin and point
        assert "MapInArrow" in v._jdf.queryExecution().executedPlan().toString()
        got = {(r.sample_id, r.hdim): r.ys for r in v.collect()}
        assert len(got) == 16 and not any(got[7, 0])
        for i, p in points.items():
            b, d = p[:, :1], p[:, 1:]
            tents = np.maximum(0, (d - b) / 2 - abs(t - (b + d) / 2))
            layers = np.zeros((2, 9))
            layers[: len(p)] = -np.sort(-tents, axis=0)[:2]
            w = ((d - b) / (d - b).max()) ** 10
            expected = {"betti": ((b <= t) & (t < d)).sum(0), "landscape": layers.ravel(), "silhouette": (w * tents).sum(0) / w.sum()}[metric]
            assert np.allclose(got[i, 0], expected), (metric, i)
        lone = np.maximum(0, 0.35 - abs(t - 0.45))
        assert got[6, 0] == [None] * 9 if metric == "silhouette" else np.allclose(got[6, 0][:9], (0.1 <= t) & (t < 0.8) if metric == "betti" else lone)


def test_false_neighbours_in_rows(spark, monkeypatch):
    """Counts of one kernel a series, its rows of distances a few at a time, against the definition; with nulls and a NaN."""
    monkeypatch.setattr(ts, "STEP", 16)
    rng = np.random.default_rng(5)
    series = {s: [float(x) for x in np.round(np.cumsum(rng.normal(size=n)), 1)] for s, n in enumerate([1, 3, 30, 41, 12])}
    series[3][7], series[4][5] = None, math.nan
    df = spark.createDataFrame([(s, t, x) for s, v in series.items() for t, x in enumerate(v)] + [(None, 0, 1.0)], "series_id long, t long, value double")
    last = lambda x: (math.isnan(x), x)
    for delay, stride in ((1, 1), (2, 1), (1, 3)):
        out = ts.false_neighbours(df, delay, [3, 1, 2], stride)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()  # a series was joined with itself, pair by pair
        got = {(r.series_id, r.dimension): r.n_false for r in out.collect()}
        assert got.keys() == {(s, d) for s in series for d in (1, 2, 3)}
        for s, v in series.items():
            sd = float(np.std([x for x in v if x is not None]))
            for d in (1, 2, 3):
                n, m = len(v), (len(v) - 1 - (d - 1) * delay) // stride + 1
                at = {m - 1 - (n - 1 - i) // stride: [v[i - k * delay] for k in range(d)] for i in range(n) if (n - 1 - i) % stride == 0 and i >= (d - 1) * delay}
                at = {j: x for j, x in at.items() if None not in x}
                near = {j: min((last(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))), o) for o, y in at.items() if o != j) for j, x in at.items() if len(at) > 1}
                count = 0
                for j, ((_, sq), _) in near.items():
                    if j + d * delay in near and not sq <= 0:
                        a, b = v[n - m + j + d * delay], v[near[j + d * delay][1]]
                        if a is not None and b is not None:
                            gap = math.sqrt(sq)
                            count += last(abs(a - b) / gap) > last(10.0) and last(2 * sd) > last(gap)
                assert got[s, d] == count, (s, d, delay, stride)
    assert sum(got.values()) > 0


def test_distances_leave_in_strips(spark, monkeypatch):
    """Tables of two blocks leave the worker as lists; nulls and zeros of the diagonal are kept, and so is rounding."""
    from morsefield.plans.registry import r_many

    monkeypatch.setattr(dg, "BLOCK_ROWS", 3)
    rows = [(s, 0, float(s % 4), float(s % 4 + 1 + s % 3)) for s in range(8)] + [(8, 0, 0.5, None)]
    dgm = spark.createDataFrame(rows, "sample_id long, hdim int, birth double, death double")
    for other in (None, dgm):
        out = dg.distances(dgm, "silhouette", n_bins=6, other=other)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "posexplode" in plan and "Union" not in plan
        got = {(r.i, r.j): r.d for r in out.collect()}
        assert len(got) == 81
        assert all((d is None) == (8 in (i, j) and not (i == j and other is None)) for (i, j), d in got.items())
        assert all(d == got[j, i] and (i != j or d == 0.0) for (i, j), d in got.items() if 8 not in (i, j))
    x = [0.0, 0.000005, 1.25, 2.5, 1234.567895, 1e300, math.inf, 3.0000049]
    numbers = spark.createDataFrame([(v,) for v in [*x, math.nan]], "v double")
    assert [r.d for r in numbers.filter("v = v and v != double('NaN')").select(r_many("v", 5).alias("d")).collect()] == [0.0, 0.00001, 1.25, 2.5, 1234.56789, 1e300, math.inf, 3.0]  # as DuckDB's round; by decimal strings the fifth is 1234.5679
    assert [r.d for r in numbers.select(r_many("v", 0).alias("d")).collect()][2:4] == [1.0, 3.0]
    assert math.isnan(numbers.filter(F.isnan("v")).select(r_many("v", 5).alias("d")).first().d)
