"""Exact distances between diagrams by optimal matchings; points may also be matched with the diagonal."""

from __future__ import annotations

import itertools

import numpy as np


def _costs(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> np.ndarray:
    """Square matrix: points of a, then diagonal places for b, against points of b, then diagonal places for a."""
    n, m = len(a), len(b)
    x, y = np.array(a, float).reshape(-1, 2), np.array(b, float).reshape(-1, 2)
    c = np.zeros((n + m, n + m))
    c[:n, :m] = np.abs(x[:, None] - y[None]).max(-1)
    c[:n, m:] = ((x[:, 1] - x[:, 0]) / 2)[:, None]
    c[n:, :m] = ((y[:, 1] - y[:, 0]) / 2)[None, :]
    return c


def _perfect(allowed: np.ndarray) -> bool:
    """Whether a bipartite graph has a perfect matching (augmenting paths)."""
    n = len(allowed)
    mate = np.full(n, -1)
    for start in range(n):
        seen = np.zeros(n, bool)
        stack, back = [(start, iter(np.flatnonzero(allowed[start])))], {}
        found = -1
        while stack and found < 0:
            u, it = stack[-1]
            for v in it:
                if not seen[v]:
                    seen[v] = True
                    back[v] = u
                    if mate[v] < 0:
                        found = v
                    else:
                        stack.append((mate[v], iter(np.flatnonzero(allowed[mate[v]]))))
                    break
            else:
                stack.pop()
        if found < 0:
            return False
        v = found
        while True:
            u = back[v]
            nxt = np.flatnonzero(mate == u)
            mate[v] = u
            if u == start:
                break
            v = [w for w in nxt if w != v][0]
    return True


def bottleneck(a, b) -> float:
    if not a and not b:
        return 0.0
    c = _costs(a, b)
    values = np.unique(c)
    lo, hi = 0, len(values) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if _perfect(c <= values[mid]):
            hi = mid
        else:
            lo = mid + 1
    return float(values[lo])


def assignment(c: np.ndarray) -> float:
    """Least total cost of a perfect matching: shortest augmenting paths with potentials."""
    n = len(c)
    u, v, mate = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        mate[0], j0 = i, 0
        least, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[j0] = True
            i0 = mate[j0]
            free = ~used[1:]
            cur = c[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < least[1:])
            least[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[mate[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if mate[j0] == 0:
                break
        while j0:
            mate[j0] = mate[way[j0]]
            j0 = way[j0]
    return float(c[mate[1:] - 1, np.arange(n)].sum())


def wasserstein(a, b, p: float = 2.0) -> float:
    if not a and not b:
        return 0.0
    return assignment(_costs(a, b) ** p) ** (1 / p)


#: Partial matchings of two diagrams up to which all are tried at once.
FEW = 40


def partial_matchings(n: int, m: int) -> list[tuple[tuple[int, int], ...]]:
    """All sets of pairs of n and m points in which none occurs twice."""
    return [tuple(zip(own, far, strict=True)) for k in range(min(n, m) + 1) for own in itertools.combinations(range(n), k) for far in itertools.permutations(range(m), k)]


def _count(n: int, m: int) -> int:
    total = term = 1
    for k in range(min(n, m)):
        term = term * (n - k) * (m - k) // (k + 1)
        total += term
        if total > FEW:
            break
    return total


def _try_all(x: np.ndarray, y: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of diagrams x (rows, n, 2) and y (rows, m, 2) of n and m points, by all partial matchings."""
    n, m = x.shape[1], y.shape[1]
    power = (lambda c: c) if metric == "bottleneck" else (lambda c: c**p)
    join = np.maximum if metric == "bottleneck" else np.add
    own = [power((x[:, u, 1] - x[:, u, 0]) / 2)[:, None] for u in range(n)]
    far = [power((y[:, v, 1] - y[:, v, 0]) / 2)[None] for v in range(m)]
    pair = {(u, v): power(np.maximum(np.abs(x[:, None, u, 0] - y[None, :, v, 0]), np.abs(x[:, None, u, 1] - y[None, :, v, 1]))) for u in range(n) for v in range(m)}
    best = None
    for some in partial_matchings(n, m):
        us, vs = {u for u, _ in some}, {v for _, v in some}
        cost = np.zeros((len(x), len(y)))
        for c in [*(pair[q] for q in some), *(own[u] for u in range(n) if u not in us), *(far[v] for v in range(m) if v not in vs)]:
            join(cost, c, out=cost)
        best = cost if best is None else np.minimum(best, cost, out=best)
    return best if metric == "bottleneck" else best ** (1 / p)


def table(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """Distances of each diagram of one list to each of another. Points of the k-th of a are a[a_ends[k] : a_ends[k + 1]]."""
    na, nb = np.diff(a_ends), np.diff(b_ends)
    out = np.zeros((len(na), len(nb)))
    f = bottleneck if metric == "bottleneck" else (lambda u, v: wasserstein(u, v, p))
    finite = np.isfinite(a).all() and np.isfinite(b).all()
    for n in np.unique(na):
        for m in np.unique(nb):
            u, v = np.flatnonzero(na == n), np.flatnonzero(nb == m)
            if finite and _count(int(n), int(m)) <= FEW:
                x, y = a[a_ends[u][:, None] + np.arange(n)], b[b_ends[v][:, None] + np.arange(m)]
                out[np.ix_(u, v)] = _try_all(x, y, metric, p)
                continue
            for s in u:
                left = [tuple(q) for q in a[a_ends[s] : a_ends[s + 1]]]
                out[s, v] = [f(left, [tuple(q) for q in b[b_ends[t] : b_ends[t + 1]]]) for t in v]
    return out
