"""MinHash near-dedup: many universal hash minima, banding, signature verification, connected components.

1. Every text becomes the set of its 5-word shingles (64-bit hashes) and ``HASHES`` minima of multiply-add hashes. Texts
   of the same set are one class, whose smallest doc_id stands for it from here on, so exact copies cost nothing more.
2. Bands of a few minima are bucket keys, as many a band as leave two sets at the threshold without a shared key with
   probability 1e-6 at most: 25 bands of 5 at 0.85 (4e-7), 31 of 4 at 0.8 (8e-8).
3. A bucket's candidates are not all its pairs: each member outside the bucket's largest component is paired with one
   pivot inside it, in a few turns with changing pivots, so there are no more pairs than rows. Pairs whose signatures agree
   too little (over 5 standard deviations below the threshold) are dropped; of the others the most similar one of each
   document is confirmed on the full sets.
4. Components follow from confirmed links by alternating large-star and small-star, after every turn from the stars of the
   turn before. Of the pairs left between components all are confirmed at the end.
5. What pivots can miss, a link between two members of a bucket that are still in different components, is looked for by
   a prefix filter of the sets left: shingles are ordered, those of one component only first, then rare ones first, and
   sets at the threshold must share one of the first of each. So texts that share much but less than the threshold
   (a common template) mostly meet nobody. The buckets of those that do are dealt in blocks of bounded size; a task has two
   blocks, compares sizes and signatures, a pair only in the first band that it shares, and then the full sets, and
   hands on the links that join components. That keeps the result whole, and no list of pairs is ever written.

Defined results. Without words or text a set is empty and linked with nothing; with fewer than five words the
whole sequence is the only shingle. Rows that repeat a doc_id are one document; if their texts differ, it has the links of
all of them. A row without a doc_id is linked with nothing: component_id is null and kept is true. Order
and ties don't matter: a component's id is its smallest doc_id. An empty table gives no rows. Other columns are
ignored, or handed on unchanged by ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, bounded_batches, cut, lean, small, table
from ._shingles import mix, shingle_hashes
from .components import connected_components

HASHES = 125
BLOCK = 512
#: Members that are compared with as many others at a time, and shingles whose incidence is held at a time.
TILE = 256
WIDE = 4096
#: Shingles of a block: 16 MB.
SPAN = 1 << 21
#: Turns of pairing with pivots, the first one on FIRST_BANDS bands.
TURNS = 2
FIRST_BANDS = 4
_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, (HASHES, 1), dtype=np.uint64)


def banding(percent: int) -> tuple[int, int]:
    """(bands, minima a band) for a threshold: the most minima a band that miss a pair at it once in a million at most."""
    s = percent / 100
    rows = max((r for r in range(2, 12) if (1 - s**r) ** (HASHES // r) <= 1e-6), default=1)
    return HASHES // rows, rows


def least_agreeing(percent: int) -> int:
    """Of HASHES bytes of two signatures those that have to agree: 5.25 standard deviations below what the threshold expects."""
    s = percent / 100
    return max(0, math.floor(HASHES * s - 5.25 * math.sqrt(HASHES * s * (1 - s))))


def minima(x: np.ndarray) -> np.ndarray:
    """HASHES minima of a set of shingle hashes, the high 32 bits of each."""
    best = np.full(HASHES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 1024):
            np.minimum(best, (_A * x[None, k : k + 1024] + _B).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def _sets(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    hashes, n = shingle_hashes([t.as_py() or b"" for t in batch.column(at)])
    return [np.unique(x) for x in np.split(hashes, np.cumsum(n)[:-1])]


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set key (k1, k2), keys of the bands, and the low byte of each minimum."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                n, k1, k2, sigs = [], [], [], []
                for x in _sets(batch, 1):
                    with np.errstate(over="ignore"):
                        k1.append(int(mix(x).sum(dtype=np.uint64)))
                        k2.append(int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                    n.append(len(x))
                    sigs.append(minima(x).tobytes() if len(x) else None)
                u = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), u(k1), u(k2), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "k1", "k2", "signature"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(work), "doc_id long, n_shingles long, k1 long, k2 long, signature binary")


def _agreeing(pairs: DataFrame, bytes_of: DataFrame, least: int) -> DataFrame:
    """pairs (x, p) whose signatures agree enough, with the number of bytes that do."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, p = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            same = (x == p).sum(axis=1)
            on = pa.array(same >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(on), b.column(1).filter(on), pa.array(same, pa.int64()).filter(on)], names=["x", "p", "same"])

    mine = bytes_of.select(F.col("rep").alias("x"), F.col("low").alias("low_x"))
    theirs = bytes_of.select(F.col("rep").alias("p"), F.col("low").alias("low_p"))
    return pairs.join(mine, "x").join(theirs, "p").select("x", "p", "low_x", "low_p").mapInArrow(lean(work), "x long, p long, same long")


#: Pairs or ids up to which they are broadcast (16 bytes each, so 32 MB at most); more are joined by shuffling.
BROADCAST_PAIRS = 1_000_000


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, shingles): the full sets of the documents in ids (rep), a written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in _sets(batch, 1)], pa.binary())], names=["rep", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
    return rows.join(small(ids, BROADCAST_PAIRS), "rep", "left_semi").mapInArrow(lean(work), "rep long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v): pairs (a written table) with 100 * |intersection| >= percent * |union| on the full sets.

    Sets are brought to their pairs and then joined by pair, so that a pivot of many pairs is no hot key.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            on = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(on), b.column(1).filter(on)], names=["u", "v"])

    own = small(pairs.select("x", "p"), BROADCAST_PAIRS)
    mine = sets.select(F.col("rep").alias("x"), F.col("shingles").alias("s")).join(own, "x")
    theirs = sets.select(F.col("rep").alias("p"), F.col("shingles").alias("t")).join(own, "p")
    return mine.join(theirs, ["x", "p"]).select("x", "p", "s", "t").mapInArrow(lean(work), "u long, v long")


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """pairs whose ends are in different components so far."""
    a, b = comp.toDF("x", "_cx"), comp.toDF("p", "_cp")
    both = pairs.join(a, "x", "left").join(b, "p", "left")
    return both.filter(F.coalesce("_cx", "x") != F.coalesce("_cp", "p")).select(*pairs.columns)


class _Links:
    """Tested pairs and components so far. Links are kept as stars: each node with its component."""

    def __init__(self, docs: DataFrame, percent: int):
        spark = docs.sparkSession
        self.docs, self.percent = docs, percent
        self.tested = spark.createDataFrame([], "x long, p long")
        self.comp = spark.createDataFrame([], "node long, component long")

    def confirm(self, pairs: DataFrame) -> None:
        """Test pairs (x, p) on the full sets and bring components up to date."""
        pairs = cut(pairs.select("x", "p"), "tested")
        if not pairs.head(1):
            return
        ids = cut(pairs.select(F.col("x").alias("rep")).unionByName(pairs.select(F.col("p").alias("rep"))).distinct(), "participants")
        sets = cut(_full_sets(self.docs, ids), "sets")
        self.tested = self.tested.unionByName(pairs)
        self.join_up(_confirmed(pairs, sets, self.percent))

    def join_up(self, links: DataFrame) -> None:
        """Bring components up to date with links (u, v)."""
        stars = self.comp.select(F.col("node").alias("u"), F.col("component").alias("v"))
        self.comp = cut(connected_components(stars.unionByName(links)), "components")

    def open(self, pairs: DataFrame) -> DataFrame:
        """pairs that are neither tested nor inside a component."""
        return _across(pairs.join(self.tested, ["x", "p"], "left_anti"), self.comp)

    def best(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (x, p, same) the most similar one of each x."""
        top = pairs.groupBy("x").agg(F.max(F.struct("same", (-F.col("p")).alias("_p"))).alias("_best"))
        return top.select("x", (-F.col("_best._p")).alias("p"))


def _state(classes: DataFrame, comp: DataFrame) -> DataFrame:
    """(rep, comp, size, n_shingles, signature): size is that of the component so far."""
    sizes = comp.groupBy(F.col("component").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    named = cut(comp.join(sizes, F.col("component") == F.col("_k")).select(F.col("node").alias("_r"), "component", "_n"), "named")
    both = classes.join(small(named, BROADCAST_PAIRS), classes["rep"] == named["_r"], "left")
    return both.select("rep", F.coalesce("component", "rep").alias("comp"), F.coalesce("_n", F.lit(1)).alias("size"), "n_shingles", "signature")


def _bands(state: DataFrame, bands: int, rows: int) -> DataFrame:
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("signature", 4 * rows * b + 1, 4 * rows)) for b in range(bands)))
    return state.select("rep", "comp", "size", "n_shingles", F.explode(keys).alias("key"))


def _pairs_with_pivots(state: DataFrame, turn: int, percent: int) -> DataFrame:
    """(x, p): each member of a bucket that is outside its largest component, with one member of that component.

    The pivot is the member of least hash, another one each turn. In the first turn, on a few bands only, all
    members are on their own and the pivot is the one of smallest id.
    """
    bands, rows = banding(percent)
    b = _bands(state, FIRST_BANDS if turn == 0 else bands, rows)
    if turn == 0:
        pivots = b.groupBy("key").agg(F.min("rep").alias("q"), F.max("rep").alias("_z")).filter("q <> _z").select("key", "q", F.col("q").alias("_c"))
    else:
        top = F.max(F.struct("size", F.col("comp").alias("c"), F.xxhash64("rep", F.lit(turn)).alias("h"), "rep")).alias("top")
        pivots = b.groupBy("key").agg(top, F.min("comp").alias("_a"), F.max("comp").alias("_z")).filter("_a <> _z").select("key", F.col("top.rep").alias("q"), F.col("top.c").alias("_c"))
    found = b.join(pivots, (b["key"] == pivots["key"]) & (F.col("comp") != F.col("_c")) & (F.col("rep") != F.col("q")))
    return found.select(F.greatest("rep", "q").alias("x"), F.least("rep", "q").alias("p")).distinct()


def _left(docs: DataFrame, state: DataFrame, percent: int) -> DataFrame | None:
    """(rep, comp, signature) of the members of buckets that still hold several components, a written table."""
    own = _bands(state, *banding(percent))
    spread = own.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b and n > 2").select("key")
    reps = own.join(spread, "key", "left_semi").select(F.col("rep").alias("_r")).distinct()
    left = cut(state.join(reps, F.col("rep") == F.col("_r"), "left_semi").select("rep", "comp", "signature"), "left")
    return left if left.head(1) else None


def _spelled(sets: DataFrame) -> DataFrame:
    """(rep, k, n, s): a row for each shingle s of each set; k tells sets of one rep apart, n is the size of the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(1)]
            n = np.array([len(v) for v in x], np.int64)
            with np.errstate(over="ignore"):
                k = np.array([mix(v).sum(dtype=np.uint64) for v in x], np.uint64).view(np.int64)
            s = np.concatenate([*x, np.zeros(0, np.uint64)]).view(np.int64)
            cols = [pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(k, n)), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(s)]
            yield pa.RecordBatch.from_arrays(cols, names=["rep", "k", "n", "s"])

    return sets.mapInArrow(lean(work), "rep long, k long, n int, s long")


def _postings(sets: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """(s, rep, comp, n): the shingles by which a set can be found by sets of other components.

    Two sets at the threshold share one of the first n - ceil(threshold * n) + 1 shingles of each, in any order that holds
    for all of them. First in that order come the shingles that only one component has: they find nobody, so a set
    that has enough of its own is done with; then the others, rare ones first.
    """
    spelled = cut(_spelled(sets).join(small(left.select("rep", "comp").distinct(), BROADCAST_PAIRS), "rep"), "spelled")
    of = spelled.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("_a"), F.max("comp").alias("_z")).filter("_a <> _z").select("s", "df")
    own = spelled.join(of, "s").groupBy("rep", "k", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("own"))
    first = F.expr(f"n - (n * {percent} + 99) div 100 + 1 - (n - size(own))")
    found = own.filter(first > 0).select("rep", "comp", "n", F.explode(F.slice("own", 1, first.cast("int"))).alias("o"))
    return found.select(F.col("o.s").alias("s"), "rep", "comp", "n").distinct()


def _meeting(postings: DataFrame) -> DataFrame:
    """(rep): the sets that share one of their first shingles with a set of another component, a written table."""
    held = cut(postings, "postings")
    of = held.groupBy("s").agg(F.min("comp").alias("_a"), F.max("comp").alias("_z")).filter("_a <> _z").select("s")
    return cut(held.join(of, "s", "left_semi").select("rep").distinct(), "meeting")


def _in_blocks(state: DataFrame, percent: int) -> DataFrame:
    """(key, lo, hi, mine, rep, comp, signature): the members of each bucket with several components, for each pair of blocks.

    A block has about BLOCK rows, and sets of about SPAN shingles in all; rows of the component with the most rows in the bucket are dealt to
    one series of blocks, the others to a second one. A row of the first meets all blocks of the second; one of the second all
    blocks of the first and those of its own series. mine: whether the row is in block lo (0) or hi (1).
    """
    own = cut(_bands(state, *banding(percent)), "left-bands")
    by = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("w"))
    of = by.groupBy("key").agg(F.sum("c").alias("_n"), F.sum("w").alias("_w"), F.max(F.struct("c", "comp", "w")).alias("_top")).filter("_n > _top.c")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / SPAN)).cast("int")
    rest = blocks(F.col("_n") - F.col("_top.c"), F.col("_w") - F.col("_top.w"))
    of = of.select("key", F.col("_top.comp").alias("major"), blocks(F.col("_top.c"), F.col("_top.w")).alias("nm"), rest.alias("no"))
    first = F.col("comp") == F.col("major")
    at = F.pmod(F.xxhash64("rep"), F.when(first, F.col("nm")).otherwise(F.col("no")).cast("long")).cast("int")
    pair = lambda lo, hi, mine: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), mine.cast("int").alias("mine"))
    others = F.sequence(F.lit(0), F.col("no") - 1)
    major = F.transform(others, lambda o: pair(F.col("at"), F.col("nm") + o, F.lit(0)))
    across = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda m: pair(m, F.col("nm") + F.col("at"), F.lit(1)))
    among = F.transform(F.filter(others, lambda o: o != F.col("at")), lambda o: pair(F.col("nm") + F.least(o, F.col("at")), F.col("nm") + F.greatest(o, F.col("at")), F.col("at") > o))
    some = own.join(of, "key").withColumn("at", at).withColumn("b", F.explode(F.when(first, major).otherwise(F.concat(across, among))))
    return some.select("key", "b.*", "rep", "comp").join(state.select("rep", "signature"), "rep")


def _shared(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of xs with ys, by products of incidence matrices over some thousand common shingles at a time."""
    xv, yv = np.concatenate(xs), np.concatenate(ys)
    common = np.intersect1d(xv, yv)
    out = np.zeros((len(xs), len(ys)), np.float32)
    if not len(common):
        return out.astype(np.int64)

    def placed(sets: list[np.ndarray], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, v), len(common) - 1)
        on = common[at] == v
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets])[on], at[on]

    (xr, xc), (yr, yc) = placed(xs, xv), placed(ys, yv)
    for k in range(0, len(common), WIDE):
        a, b = (np.zeros((len(n), min(WIDE, len(common) - k)), np.float32) for n in (xs, ys))
        for m, r, c in ((a, xr, xc), (b, yr, yc)):
            on = (c >= k) & (c < k + WIDE)
            m[r[on], c[on] - k] = 1
        out += a @ b.T
    return out.astype(np.int64)


class _Group:
    """Members of two blocks of a bucket, and the links among them that join components."""

    def __init__(self, percent: int, rep: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], signatures: np.ndarray):
        self.percent, self.least, self.rep, self.sets = percent, least_agreeing(percent), rep, sets
        self.low = signatures.astype(np.uint8)  # the low byte of each minimum
        self.n = np.array([len(x) for x in sets], np.int64)
        names, self.comp = np.unique(comp, return_inverse=True)
        self.up = np.arange(len(names))
        bands, rows = banding(percent)
        self.bands = signatures[:, : bands * rows].reshape(len(rep), bands, rows)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            x = self.up[x]
        return x

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pairs (i, j) of members."""
        a, b = np.unique(i), np.unique(j)
        if len(i) < 2 * (len(a) + len(b)):
            return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
        return _shared([self.sets[x] for x in a], [self.sets[y] for y in b])[np.searchsorted(a, i), np.searchsorted(b, j)]

    def tile(self, u: np.ndarray, v: np.ndarray, band: int) -> Iterator[tuple[int, int]]:
        """Links between the members u and v (numbers) that have ``band`` as the first band in which they agree."""
        top = np.array([self.root(c) for c in range(len(self.up))])
        ok = top[self.comp[u]][:, None] != top[self.comp[v]][None]
        ok &= 100 * np.minimum(self.n[u][:, None], self.n[v][None]) >= self.percent * np.maximum(self.n[u][:, None], self.n[v][None])
        for k in range(band):
            ok &= (self.bands[u][:, k][:, None] != self.bands[v][:, k][None]).any(-1)
        p, q = np.nonzero(ok)
        same = [(self.low[u[p[k : k + TILE * 32]]] == self.low[v[q[k : k + TILE * 32]]]).sum(axis=1) for k in range(0, len(p), TILE * 32)]
        alike = np.concatenate([*same, np.zeros(0, int)]) >= self.least
        p, q = p[alike], q[alike]
        if not len(p):
            return
        i, j = u[p], v[q]
        both = np.zeros(len(i), np.int64)
        # runs of members whose sets have about SPAN / 4 shingles in all
        run = lambda own: (np.cumsum(self.n[own]) * 4 // SPAN)[np.searchsorted(own, (i, j)[own is b])]
        a, b = np.unique(i), np.unique(j)
        part = np.stack([run(a), run(b)], axis=1)
        for x, y in np.unique(part, axis=0):
            on = np.flatnonzero((part[:, 0] == x) & (part[:, 1] == y))
            both[on] = self.shared(i[on], j[on])
        hit = 100 * both >= self.percent * (self.n[i] + self.n[j] - both)
        for x, y in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
            c, d = self.root(self.comp[x]), self.root(self.comp[y])
            if c != d:
                self.up[max(c, d)] = min(c, d)
                yield int(self.rep[x]), int(self.rep[y])


def _links_left(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of different components in the blocks of dealt; one is handed on if it joins something."""
    bands, rows = banding(percent)

    def group(t: pa.Table) -> Iterator[tuple[int, int]]:
        mine, lo = t.column(3).to_numpy(), t.column(1)[0].as_py()
        signatures = np.frombuffer(b"".join(t.column(6).to_pylist()), "<u4").reshape(-1, HASHES)
        members = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(7)]
        g = _Group(percent, t.column(4).to_numpy(), t.column(5).to_numpy(), members, signatures)
        # the band of this bucket is one in which all its members agree
        agree = (g.bands == g.bands[:1]).all(axis=(0, 2))
        band = int(np.flatnonzero(agree)[0]) if agree.any() else 0
        a, b = np.flatnonzero(mine == 0), np.flatnonzero(mine == 1)
        for x, y in ((a, b), (b, b)) if lo == 0 else ((a, b),):
            for i in range(0, len(x), TILE):
                for j in range(i if x is y else 0, len(y), TILE):
                    yield from g.tile(x[i : i + TILE], y[j : j + TILE], band)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 3):
            out = list(group(t))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = dealt.join(sets.select("rep", "shingles"), "rep").select("key", "lo", "hi", "mine", "rep", "comp", "signature", "shingles")
    return held.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(lean(work), "u long, v long")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = [b.column(c).to_numpy() for c in range(keys)]
        turn = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
        for f, t in zip(np.r_[0, turn], np.r_[turn, b.num_rows], strict=True):
            name = tuple(x[f] for x in k)
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(int(f), int(t - f)))
            last = name
    if held:
        yield pa.Table.from_batches(held)


def _finish(docs: DataFrame, classes: DataFrame, found: _Links, percent: int) -> None:
    """Find the links that pivots have missed: between members of a bucket that are still in different components."""
    state = _state(classes, found.comp)
    left = _left(docs, state, percent)
    if left is None:
        return
    sets = cut(_full_sets(docs, left.select("rep")), "sets")
    meeting = _meeting(_postings(sets, left, percent))
    some = cut(state.join(small(meeting, BROADCAST_PAIRS), "rep", "left_semi"), "meeting-state")
    found.join_up(_links_left(_in_blocks(some, percent), sets, percent))


def near_groups(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each input row."""
    with Scratch(docs.sparkSession) as own:
        prof = own.keep(cut(profiles(docs), "profiles"))
        named = prof.filter("doc_id is not null and n_shingles > 0")
        one = F.min(F.struct("doc_id", "signature")).alias("one")
        classes = named.groupBy("n_shingles", "k1", "k2").agg(one).select("n_shingles", "k1", "k2", F.col("one.doc_id").alias("rep"), F.col("one.signature").alias("signature"))
        classes = own.keep(cut(classes, "classes"))
        low = cut(classes.select("rep", F.concat(*(F.substring("signature", 4 * k + 1, 1) for k in range(HASHES))).alias("low")), "low")
        found, pending = _Links(docs, percent), None
        for turn in range(TURNS):
            pairs = cut(_agreeing(cut(_pairs_with_pivots(_state(classes, found.comp), turn, percent), "pairs"), low, least_agreeing(percent)), "agreeing")
            pending = pairs if pending is None else pending.unionByName(pairs)
            found.confirm(found.best(found.open(pairs)))
        found.confirm(found.open(pending.select("x", "p").distinct()))
        _finish(docs, classes, found, percent)
        comp = own.keep(found.comp)
        named_by = classes.select("n_shingles", "k1", "k2", "rep").join(comp.toDF("rep", "component"), "rep", "left")
        named_by = named_by.select("n_shingles", "k1", "k2", F.coalesce("component", "rep").alias("component"))
        out = prof.drop("signature").join(named_by, ["n_shingles", "k1", "k2"], "left")
        mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return out.select("doc_id", "n_shingles", mine.alias("component_id"), F.coalesce(F.col("doc_id") == mine, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """docs without the documents that are not the smallest of their component."""
    with Scratch(docs.sparkSession) as own:
        lost = own.keep(cut(near_groups(docs, percent=percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_lost")).distinct(), "lost"))
    return docs.join(lost, docs["doc_id"] == lost["_lost"], "left_anti")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
