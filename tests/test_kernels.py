"""Kernels against definitions, on small inputs."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from morsefield.functions import complexes as cx
from morsefield.functions import matching
from morsefield.functions.params import Interval, validate
from morsefield.operators import graphs, mapper

CLOUDS = st.lists(st.tuples(st.floats(-5, 5), st.floats(-5, 5)), min_size=3, max_size=7, unique=True).map(lambda p: np.round(np.array(p), 3))


def dist(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def finite(found, d):
    return sorted(round(e, 9) for k, b, e in found if k == d and e < math.inf and e > b)


@settings(max_examples=40, deadline=None)
@given(CLOUDS)
def test_rips_identities(x):
    d = dist(x)
    cells = cx.flag_complex(d, 3)
    two, three = cx.persistence(cells, 2), cx.persistence(cells, 3)
    assert finite(two, 0) == finite(three, 0) == sorted(round(w, 9) for w in cx.minimum_spanning(d) if w > 0)
    assert sorted(x for x in two if x[1] < x[2]) == sorted(x for x in three if x[1] < x[2]) or len(x) >= 6
    for t in np.unique(d)[::3]:
        chi = sum((-1) ** k for v, k, *_ in cells if v <= t and k < 3)
        betti = [sum(k == j and b <= t < e for k, b, e in cx.persistence([c for c in cells if c[1] < 3], 2)) for j in range(3)]
        assert chi == betti[0] - betti[1] + betti[2]
    assert sorted(cx.persistence(cx.sparse_rips(d, 0.0, 2))) == sorted(cx.persistence(cx.flag_complex(d, 2)))
    flag = cx.persistence(cx.directed_flag_complex(d.copy(), 2, directed=False))
    assert sorted(map(repr, (z for z in flag if z[1] < z[2]))) == sorted(map(repr, (z for z in cx.persistence(cx.flag_complex(d, 2)) if z[1] < z[2])))


def test_circle_has_one_long_loop():
    t = np.arange(8) * math.pi / 4 + np.array([0, 0.05, -0.04, 0.02, 0, -0.03, 0.04, 0.01])
    x = np.c_[np.cos(t), np.sin(t)]
    loops = [p for p in cx.persistence(cx.flag_complex(dist(x), 2)) if p[0] == 1 and p[1] < p[2]]
    assert len(loops) == 1 and loops[0][2] > math.sqrt(3)
    d = np.full((8, 8), np.inf)
    for i, j in cx.delaunay_edges(x):
        d[i, j] = d[j, i] = dist(x)[i, j]
    alpha = cx.persistence(cx.flag_complex(d, 2))
    assert finite(alpha, 0) == finite(cx.persistence(cx.flag_complex(dist(x), 1)), 0)
    cech = cx.persistence(cx.cech_complex(x, 2))
    assert np.allclose([2 * v for v in finite(cech, 0)], finite(alpha, 0))


@settings(max_examples=30, deadline=None)
@given(CLOUDS)
def test_delaunay_holds_the_spanning_tree(x):
    if len(x) < 4 or np.linalg.matrix_rank(x - x.mean(0), tol=1e-3) < 2:
        return
    d = np.full((len(x), len(x)), np.inf)
    for i, j in cx.delaunay_edges(x):
        d[i, j] = d[j, i] = dist(x)[i, j]
    assert np.allclose(cx.minimum_spanning(d), cx.minimum_spanning(dist(x)))


def test_too_few_points_for_a_triangulation():
    with pytest.raises(ValueError):
        cx.delaunay_edges(np.zeros((3, 2)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=4), min_size=3, max_size=4))
def test_cubical_euler_identity(rows):
    cells = cx.cubical_complex(np.array(rows, float))
    found = cx.persistence(cells)
    for t in range(4):
        chi = sum((-1) ** k for v, k, *_ in cells if v <= t)
        assert chi == sum((-1) ** k for k, b, e in found if b <= t < e)
    assert not [x for x in found if x[0] == 1 and x[2] == math.inf]
    torus = cx.persistence(cx.cubical_complex(np.array(rows, float), (True, True)), 3)
    assert sorted(x[0] for x in torus if x[2] == math.inf) == [0, 1, 1, 2]


def brute(a, b, total):
    """Best matching by trying all."""
    n, m, best = len(a), len(b), math.inf
    cost = lambda p, q: max(abs(p[0] - q[0]), abs(p[1] - q[1]))
    life = lambda p: (p[1] - p[0]) / 2
    for k in range(min(n, m) + 1):
        for i in itertools.combinations(range(n), k):
            for j in itertools.permutations(range(m), k):
                c = [cost(a[x], b[y]) for x, y in zip(i, j, strict=True)] + [life(a[x]) for x in range(n) if x not in i] + [life(b[y]) for y in range(m) if y not in j]
                best = min(best, total(c))
    return best


POINTS = st.lists(st.tuples(st.integers(0, 9), st.integers(1, 9)).map(lambda p: (float(p[0]), float(p[0] + p[1]))), max_size=4)


@settings(max_examples=80, deadline=None)
@given(POINTS, POINTS)
def test_matchings(a, b):
    assert matching.bottleneck(a, b) == brute(a, b, lambda c: max(c, default=0.0))
    assert math.isclose(matching.wasserstein(a, b, 2), math.sqrt(brute(a, b, lambda c: sum(x * x for x in c))), abs_tol=1e-9)


def test_weighted_edges_solve_their_equation():
    rng = np.random.default_rng(1)
    d, w = dist(rng.random((6, 2))), rng.random(6) / 4
    for p in (1, 2):
        t = cx.weighted_edges(d.copy(), w, p)
        for i, j in itertools.combinations(range(6), 2):
            if 2 * d[i, j] > abs(w[i] ** p - w[j] ** p) ** (1 / p):
                gap = (t[i, j] ** p - w[i] ** p) ** (1 / p) + (t[i, j] ** p - w[j] ** p) ** (1 / p)
                assert math.isclose(gap, 2 * d[i, j], rel_tol=1e-9)
    assert np.allclose(cx.weighted_edges(d.copy(), np.zeros(6), 1), d)


def test_unpublished_filtrations_are_refused():
    for rule in ("max3", "pmean", "nonsense"):
        with pytest.raises(ValueError):
            cx.directed_flag_complex(np.zeros((2, 2)), 1, rule=rule)


def test_clusterings():
    x = np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [9.0]])
    assert mapper.first_simple_gap(x).tolist() == [0, 0, 0, 1, 1, 2]
    assert mapper.dbscan(x, 0.5, 2).tolist() == [0, 0, 0, 1, 1, -1]
    for linkage in ("single", "complete", "average", "ward"):
        merges = mapper.linkage_tree(x, linkage)
        assert mapper.cut_tree(6, merges, 3).tolist() == [0, 0, 0, 1, 1, 2]
        assert [m[2] for m in merges] == sorted(m[2] for m in merges)
    assert mapper.first_histogram_gap(x).max() >= 1
    with pytest.raises(ValueError):
        mapper.linkage_tree(x, "ward", "cosine")


def test_interval_and_validation():
    i = Interval(0, 1, "left")
    assert 0 in i and 1 not in i and (i + 1).right == 2 and (i * -1).closed == "right" and i.mid == 0.5
    assert Interval(0, 1).overlaps(Interval(0.5, 2)) and not Interval(0, 1, "left").overlaps(Interval(1, 2, "left"))
    rules = {"n": {"type": int, "in": Interval(1, math.inf, "left")}, "xs": {"type": list, "of": {"type": int}}}
    validate({"n": 3, "xs": [1]}, rules)
    for bad, error in (({"n": 0}, ValueError), ({"n": "a"}, TypeError), ({"m": 1}, KeyError), ({"xs": ["a"]}, TypeError)):
        with pytest.raises(error):
            validate(bad, rules)


def _bars(found, top=1):
    return sorted((d, round(b, 9), round(e, 9)) for d, b, e in found if d <= top and b < e)


def test_edge_collapse_changes_no_diagram():
    rng = np.random.default_rng(21)
    fewer = 0
    for k in range(40):
        x = rng.normal(size=(rng.integers(2, 16), 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        if k % 4 == 0:  # ties
            d = np.ceil(d * 3)
            np.fill_diagonal(d, 0)
        limit = np.inf if k % 3 else 1.5
        e = cx.collapsed_edges(d, limit)
        assert _bars(cx.persistence(cx.flag_complex(e, 3))) == _bars(cx.persistence(cx.flag_complex(d, 3, limit)))
        assert _bars(cx.persistence(cx.flag_complex(d, 2, min(limit, cx.enclosing_distance(d))))) == _bars(cx.persistence(cx.flag_complex(d, 2, limit)))
        fewer += np.isfinite(e).sum() < 0.8 * np.isfinite(d).sum()
    assert fewer > 10


def test_components_of_pixels():
    rng = np.random.default_rng(22)
    for k in range(30):
        img = rng.integers(0, 6, size=(rng.integers(1, 6), rng.integers(1, 6)) if k % 3 else (3, 2, 4)).astype(float)
        wrap = tuple(bool(x) for x in rng.integers(0, 2, img.ndim)) if k % 2 and min(img.shape) > 2 else None
        assert _bars(cx.pixel_components(img, wrap), 0) == _bars([p for p in cx.persistence(cx.cubical_complex(img, wrap)) if p[0] == 0], 0)


def test_shortest_paths_of_sparse_and_dense_graphs():
    rng = np.random.default_rng(23)
    for n, m in ((1, 0), (5, 0), (40, 60), (300, 700), (12, 100), (30, 112)):
        s, t, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m).astype(float)
        want = np.full((n, n), np.inf)
        np.minimum.at(want, (s, t), w)
        np.fill_diagonal(want, 0)
        for k in range(n):
            want = np.minimum(want, want[:, k, None] + want[None, k])
        assert np.array_equal(graphs.shortest_paths(n, s, t, w), want)


def test_tables_of_matchings():
    """Diagrams of few points are taken together, others pair by pair; either way each pair has the distance of its own matching."""
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 2, 3, 1, 0, 3, 5]
    pts = np.sort(rng.integers(0, 9, (sum(sizes), 2)).astype(float), axis=1)
    ends = np.r_[0, np.cumsum(sizes)]
    own = [[tuple(q) for q in pts[a:b]] for a, b in zip(ends, ends[1:], strict=False)]
    for metric, f in (("bottleneck", matching.bottleneck), ("wasserstein", lambda a, b: matching.wasserstein(a, b, 3.0))):
        got = matching.table(pts, ends, pts, ends, metric, 3.0)
        np.testing.assert_allclose(got, [[f(a, b) for b in own] for a in own], atol=1e-9)


def plain_dbscan(d, eps, least, w):
    near = d <= eps
    core, labels, k = (near * w[None]).sum(1) >= least, np.full(len(d), -1), 0
    for i in range(len(d)):
        if core[i] and labels[i] < 0:
            todo, labels[i] = [i], k
            while todo:
                for v in np.flatnonzero(near[todo.pop()] & (labels < 0)):
                    labels[v] = k
                    todo += [v] * bool(core[v])
            k += 1
    return labels


@given(st.integers(0, 10**6), st.sampled_from([0.0, 1.0, 2.0, 3.0]))
@settings(max_examples=40, deadline=None)
def test_clusterings_of_grid_points(seed, eps):
    """Points of a grid: many distances equal eps, and many points are equal."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, (120, 2)).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for w in (np.ones(len(x)), rng.integers(-1, 3, len(x)).astype(float)):
        want = plain_dbscan(d, eps, 3, w).tolist()
        assert mapper.dbscan(x, eps, 3, weights=w).tolist() == want
        assert mapper.dbscan(d, eps, 3, "precomputed", weights=w).tolist() == want
    assert mapper.linkage_tree(x) == mapper.linkage_tree(d, affinity="precomputed")


def test_clusterings_in_linear_memory():
    """A set of 3,000 points of 64 coordinates: their differences take 4.6 GB, their distances 72 MB."""
    x = np.random.default_rng(3).normal(size=(3000, 64)) / 8
    tracemalloc.start()
    for f in (lambda: mapper.dbscan(x, 1.35, 3), lambda: mapper.first_simple_gap(x), lambda: mapper.first_histogram_gap(x)):
        f()
        assert tracemalloc.get_traced_memory()[1] < 64e6
    tracemalloc.stop()
