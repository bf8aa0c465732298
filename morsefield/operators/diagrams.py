"""Persistence diagrams (sample_id, hdim, birth, death): preprocessing, features, vectorisations, amplitudes, distances.

Diagrams are not padded; every operator that has to say something about an empty diagram gets the (sample, dimension)
pairs from ``frame``. Vectorisations work on one array of points a diagram: one shuffle, then array expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed

ANY_DIMENSION = -1
KEY = ("sample_id", "hdim")


def frame(dgm: DataFrame) -> DataFrame:
    """All pairs of a sample and a dimension; there are few dimensions."""
    return dgm.select("sample_id").distinct().crossJoin(F.broadcast(dgm.select("hdim").distinct()))


def _life() -> Column:
    return F.col("death") - F.col("birth")


# --- preprocessing ---------------------------------------------------------------------------------------------------


def forget_dimension(dgm: DataFrame) -> DataFrame:
    return dgm.withColumn("hdim", F.lit(ANY_DIMENSION))


def filtering(dgm: DataFrame, epsilon: float = 0.01, dimensions: list[int] | None = None) -> DataFrame:
    """Points of these dimensions (default: all) that live longer than epsilon, and all other points."""
    keep = _life() > epsilon
    return dgm.filter(keep if dimensions is None else ~F.col("hdim").isin(dimensions) | keep)


def subdiagrams(dgm: DataFrame, dimensions: list[int]) -> DataFrame:
    return dgm.filter(F.col("hdim").isin(dimensions))


def scale_of(dgm: DataFrame, metric: str = "bottleneck", function=F.max, **params) -> DataFrame:
    """One row: scale, a function (an aggregate, by default the maximum) of all amplitudes."""
    return amplitude(dgm, metric, **params).agg(function("amplitude").alias("scale"))


def scaled(dgm: DataFrame, scale: DataFrame, inverse: bool = False) -> DataFrame:
    s = F.col("scale")
    by = (lambda c: F.col(c) * s) if inverse else (lambda c: F.col(c) / F.when(s == 0, 1.0).otherwise(s))
    return dgm.crossJoin(F.broadcast(scale)).select(*KEY, by("birth").alias("birth"), by("death").alias("death"))


def finish(dgm: DataFrame, infinity: float, reduced: bool = True, essential_last: bool = True) -> DataFrame:
    """Raw kernel output to a diagram: one essential H0 class goes, infinite deaths become ``infinity``, no point lives 0 or less."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("birth") if essential_last else F.asc("birth"))
    never = (F.col("hdim") == 0) & (F.col("death") == float("inf"))
    if reduced:
        gone = dgm.filter(never).withColumn("_k", F.row_number().over(w)).filter("_k > 1").drop("_k")
        dgm = dgm.filter(~never).unionByName(gone)
    return dgm.withColumn("death", F.when(F.col("death") == float("inf"), F.lit(float(infinity))).otherwise(F.col("death"))).filter("birth < death")


# --- features --------------------------------------------------------------------------------------------------------


def number_of_points(dgm: DataFrame) -> DataFrame:
    n = dgm.groupBy(*KEY).agg(F.sum((F.col("death") != F.col("birth")).cast("long")).alias("n"))
    return frame(dgm).join(n, list(KEY), "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("n"))


def entropy(dgm: DataFrame, normalize: bool = False, nan_fill_value: float = -1.0) -> DataFrame:
    """Base-2 entropy of lifetimes; normalized by the logarithm of their sum. Diagrams without lifetime get the fill value."""
    total = F.sum(_life()).over(Window.partitionBy(*KEY))
    p = F.col("life") / F.col("total")
    own = dgm.select(*KEY, _life().alias("life"), total.alias("total")).filter("total > 0")
    h = own.groupBy(*KEY).agg(F.sum(F.when(F.col("life") > 0, -p * F.log2(p)).otherwise(0.0)).alias("h"), F.max("total").alias("total"))
    value = F.col("h")
    if normalize:
        value = F.when(F.col("total") == 1, F.when(F.col("h") == 0, F.lit(nan_fill_value)).otherwise(F.lit(1.7976931348623157e308))).otherwise(F.col("h") / F.log2("total"))
    return frame(dgm).join(h, list(KEY), "left").select(*KEY, F.coalesce(value, F.lit(float(nan_fill_value))).alias("entropy"))


def _root(kind: str) -> tuple[Column, Column]:
    b, d = F.col("birth"), F.col("death")
    if kind == "R":
        return b, d
    norm = F.sqrt(b * b + d * d)
    if kind == "S":
        f = F.when(norm == 0, 0.0).otherwise((d - b) / (F.sqrt(F.lit(2.0)) * F.when(norm == 0, 1.0).otherwise(norm)))
        return f * b, f * d
    if kind == "T":
        f = (d - b) / 2
        return f * (F.cos(norm) - F.sin(norm)), f * (F.cos(norm) + F.sin(norm))
    raise ValueError(f"unknown polynomial type {kind!r}")


def complex_polynomial(dgm: DataFrame, n_coefficients: int = 10, kind: str = "R") -> DataFrame:
    """(sample_id, hdim, k, re, im): coefficients after the leading 1 of the polynomial whose roots are the points."""
    re, im = _root(kind)
    roots = dgm.filter("birth <> death").select(*KEY, F.struct(re.alias("re"), im.alias("im")).alias("z")).groupBy(*KEY).agg(F.array_sort(F.collect_list("z")).alias("zs"))
    one = F.array(F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im")))
    nothing = F.array(F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")))

    def times(a: Column, z: Column) -> Column:
        """a(x) * (x - z), highest power first; only the first coefficients are kept, later ones never reach them."""
        up, down = F.concat(a, nothing), F.concat(nothing, a)
        new = F.zip_with(up, down, lambda u, v: F.struct((u["re"] - v["re"] * z["re"] + v["im"] * z["im"]).alias("re"), (u["im"] - v["re"] * z["im"] - v["im"] * z["re"]).alias("im")))
        return F.slice(new, 1, n_coefficients + 1)

    own = frame(dgm).join(roots.select(*KEY, F.aggregate("zs", one, times).alias("cs")), list(KEY), "left")
    at = lambda part: F.coalesce(F.get(F.col("cs"), F.col("k"))[part], F.lit(0.0))
    return own.select(*KEY, "cs", F.explode(F.sequence(F.lit(1), F.lit(n_coefficients))).alias("k")).select(*KEY, "k", at("re").alias("re"), at("im").alias("im"))


# --- vectorisations --------------------------------------------------------------------------------------------------


def grid(dgm: DataFrame, n_bins: int = 100) -> DataFrame:
    """(hdim, lo, step): a common range of births and deaths; a dimension without extent borrows the largest maximum."""
    g = dgm.groupBy("hdim").agg(F.min(F.least("birth", "death")).alias("lo"), F.max(F.greatest("birth", "death")).alias("hi"))
    top = F.max("hi").over(Window.partitionBy(F.lit(1)))
    return g.withColumn("hi", F.when(F.col("hi") == F.col("lo"), top).otherwise(F.col("hi"))).select("hdim", "lo", ((F.col("hi") - F.col("lo")) / (n_bins - 1)).alias("step"))


def image_grid(dgm: DataFrame, n_bins: int = 100) -> DataFrame:
    """(hdim, blo, bstep, llo, lstep): ranges of births and of lifetimes; lifetimes begin at 0 where diagrams differ in size."""
    n = frame(dgm).join(dgm.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), list(KEY), "left").groupBy("hdim").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.max("n").alias("most"))
    g = dgm.groupBy("hdim").agg(F.min("birth").alias("blo"), F.max("birth").alias("bhi"), F.min(_life()).alias("llo"), F.max(_life()).alias("lhi")).join(F.broadcast(n), "hdim")
    g = g.withColumn("llo", F.when(F.col("least") < F.col("most"), F.least("llo", F.lit(0.0))).otherwise(F.col("llo")))
    every = Window.partitionBy(F.lit(1))
    for x in ("b", "l"):
        g = g.withColumn(f"{x}hi", F.when(F.col(f"{x}hi") == F.col(f"{x}lo"), F.max(f"{x}hi").over(every)).otherwise(F.col(f"{x}hi")))
    return g.select("hdim", "blo", ((F.col("bhi") - F.col("blo")) / (n_bins - 1)).alias("bstep"), "llo", ((F.col("lhi") - F.col("llo")) / (n_bins - 1)).alias("lstep"))


def _arrays(dgm: DataFrame, limits: DataFrame) -> DataFrame:
    pts = dgm.groupBy(*KEY).agg(F.collect_list(F.struct(F.col("birth").alias("b"), F.col("death").alias("d"))).alias("pts"))
    none = F.array().cast("array<struct<b:double,d:double>>")
    return frame(dgm).join(pts, list(KEY), "left").withColumn("pts", F.coalesce("pts", none)).join(F.broadcast(limits), "hdim")


#: Vectorisations on a line.
CURVES = ("betti", "landscape", "silhouette")
#: Numbers that a step of ``_curves`` holds a column of, and values in a batch that leaves it.
STEP = 2**18


def _curves(own: DataFrame, metric: str, n_bins: int, n_layers: int, power: float) -> DataFrame:
    """(sample_id, hdim, ys, cell) of the points pts on the grid lo, step; the points of many diagrams are taken at once.

    Nulls are as in SQL: a null point isn't counted by betti, has no height in landscape, and leaves silhouette null.
    """
    import numpy as np
    import pyarrow as pa

    def heights(b, d, null, at, lo, step):
        size = np.diff(at)
        full, of = size > 0, np.repeat(np.arange(len(size)), size)
        starts = at[:-1][full]
        out = np.zeros((len(size), n_layers if metric == "landscape" else 1, n_bins))
        if not len(b):
            return out
        if metric == "silhouette":
            w, total = d - b, np.zeros(len(size))
            if power > 8:
                top = np.maximum.reduceat(w, starts)
                w = w / np.repeat(np.where(top <= 0, 1.0, top), size[full])
            w = w**power
            total[full] = np.add.reduceat(w, starts)
        width = max(1, STEP // len(b))
        for k in range(0, n_bins, width):
            t = (lo[:, None] + np.arange(k, min(n_bins, k + width)) * step[:, None])[of]
            cols = slice(k, k + t.shape[1])
            if metric == "betti":  # a death that is no number comes after all others, as in SQL
                inside = (b[:, None] <= t) & ((t < d[:, None]) | np.isnan(d)[:, None]) & ~null[:, None]
                out[full, 0, cols] = np.add.reduceat(inside, starts, axis=0, dtype=float)
                continue
            tent = np.maximum(0.0, ((d - b) / 2)[:, None] - np.abs(t - ((b + d) / 2)[:, None]))
            tent[null] = 0.0
            if metric == "silhouette":
                sums = np.add.reduceat(w[:, None] * tent, starts, axis=0)
                out[full, 0, cols] = np.where(total[full, None] == 0, 0.0, sums / np.where(total[full, None] == 0, 1.0, total[full, None]))
            else:
                for i in np.flatnonzero(full):
                    highest = np.sort(tent[at[i] : at[i + 1]], axis=0)[::-1][:n_layers]
                    out[i, : len(highest), cols] = highest
        return out

    def work(batches):
        for whole in batches:
            pts = whole.column("pts")
            sizes = pts.value_lengths().to_numpy()
            ends = pts.flatten()
            b, d = (ends.field(c) for c in ("b", "d"))
            none = (b.is_null().to_numpy(zero_copy_only=False) | d.is_null().to_numpy(zero_copy_only=False))
            b, d = (x.to_numpy(zero_copy_only=False).astype(float) for x in (b, d))
            lo, step = (whole.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lo", "step"))
            bare = whole.column("lo").is_null().to_numpy(zero_copy_only=False) | whole.column("step").is_null().to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(sizes)]
            i = 0
            while i < len(sizes):
                # as many diagrams as have few points together, one at least
                j = max(i + 1, min(int(np.searchsorted(at, at[i] + STEP // n_bins, side="right")) - 1, i + max(1, STEP // (n_bins * n_layers))))
                own = slice(at[i], at[j])
                no_height = none[own] | np.repeat(bare[i:j], sizes[i:j])
                with np.errstate(all="ignore"):
                    ys = heights(b[own], d[own], no_height, at[i : j + 1] - at[i], lo[i:j], step[i:j]).reshape(j - i, -1)
                mask = None
                if metric == "silhouette" and none[own].any():
                    lost = np.zeros(j - i, bool)
                    lost[np.repeat(np.arange(j - i), sizes[i:j])[none[own]]] = True
                    mask = np.repeat(lost, ys.shape[1])
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, ys.size + 1, ys.shape[1], dtype=np.int32)), pa.array(ys.ravel(), mask=mask))
                part = whole.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("sample_id"), part.column("hdim"), values, part.column("step")], names=[*KEY, "ys", "cell"])
                i = j

    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.select(*KEY, "lo", "step", "pts").mapInArrow(work, f"sample_id {types['sample_id']}, hdim {types['hdim']}, ys array<double>, cell double")


def _pictures(own: DataFrame, n_bins: int, antisymmetric: bool) -> DataFrame:
    """own with a column ys: sums of truncated Gaussians at the pixels px (x, y, w), row by row, lifetimes or deaths downwards.

    The kernels are separable: a point is two rows of values, and a picture a product of two matrices. antisymmetric: less
    its mirror image at the diagonal. Pictures leave the worker a few at a time.
    """
    import numpy as np
    import pyarrow as pa

    names = own.columns
    t = np.arange(n_bins)

    def bumps(at: list, s: float) -> np.ndarray:
        d = t[None] - np.asarray(at, float)[:, None]
        return np.where(np.abs(d) <= np.floor(4 * s + 0.5), np.exp(-0.5 * d * d / (s * s)), 0.0)

    def work(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 32):
                b = whole.slice(k, 32)
                ys = []
                for px, sx, sy, scale in zip(*(b.column(names.index(c)).to_pylist() for c in ("px", "sx", "sy", "scale")), strict=True):
                    if not px:
                        ys.append(np.zeros(n_bins * n_bins))
                        continue
                    m = (bumps([q["y"] for q in px], sy) * np.array([[q["w"]] for q in px])).T @ bumps([q["x"] for q in px], sx)
                    ys.append((m - m.T if antisymmetric else m)[::-1].ravel() / scale)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ys, pa.list_(pa.float64()))], names=[*names, "ys"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(work, f"{schema}, ys array<double>")


def _mass(sigma: Column) -> Column:
    r = F.floor(4 * sigma + 0.5).cast("int")
    return F.aggregate(F.sequence(-r, r), F.lit(0.0), lambda s, k: s + F.exp(-0.5 * k * k / (sigma * sigma)))


def vectors(dgm: DataFrame, metric: str, *, fit: DataFrame | None = None, n_bins: int = 100, n_layers: int = 1, power: float = 1.0, sigma: float = 0.1, weight=None) -> DataFrame:
    """(sample_id, hdim, ys, cell): the vectorisation as an array, and the size of a cell of its grid.

    betti, landscape (layer by layer), silhouette; heat and persistence_image row by row. fit: diagrams that set the grid.
    """
    base = dgm if fit is None else fit
    if metric == "persistence_image":
        own = _arrays(dgm, image_grid(base, n_bins)).filter("true")
        sb = F.when(F.col("bstep") > 0, sigma / F.col("bstep"))
        sl = F.when(F.col("lstep") > 0, sigma / F.col("lstep"))
        own = own.withColumn("sb", sb).withColumn("sl", sl).withColumn("mb", _mass(F.col("sb"))).withColumn("ml", _mass(F.col("sl")))
        bmax, lmax = F.col("blo") + (n_bins - 1) * F.col("bstep"), F.col("llo") + (n_bins - 1) * F.col("lstep")
        clip = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
        life = lambda p: clip(p["d"] - p["b"], F.col("llo"), lmax)
        pixel = lambda v, lo, step: F.floor((v - F.col(lo)) / F.col(step)).cast("int")
        w = weight or (lambda x: F.lit(1.0))
        pts = F.transform(F.filter("pts", lambda p: life(p) != 0), lambda p: F.struct(pixel(clip(p["b"], F.col("blo"), bmax), "blo", "bstep").alias("x"), pixel(life(p), "llo", "lstep").alias("y")))
        own = own.withColumn("px", F.when(F.col("sb").isNotNull() & F.col("sl").isNotNull(), F.transform(pts, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), w(F.col("llo") + q["y"] * F.col("lstep")).alias("w")))))
        scale = F.col("mb") * F.col("ml") * F.col("bstep") * F.col("lstep")
        own = own.select(*KEY, "px", F.col("sb").alias("sx"), F.col("sl").alias("sy"), scale.alias("scale"), (F.col("bstep") * F.col("lstep")).alias("cell"))
    else:
        own = _arrays(dgm, grid(base, n_bins))
        if metric in CURVES:
            return _curves(own, metric, n_bins, n_layers, power)
        if metric == "heat":
            own = own.withColumn("s", F.when(F.col("step") > 0, F.least(sigma / F.col("step"), F.lit(1e5 * n_bins)))).withColumn("m", _mass(F.col("s")))
            hi = F.col("lo") + (n_bins - 1) * F.col("step")
            clip = lambda v: F.least(F.greatest(v, F.col("lo")), hi)
            pixel = lambda v: F.floor((clip(v) - F.col("lo")) / F.col("step")).cast("int")
            pts = F.transform(F.filter("pts", lambda p: clip(p["b"]) != clip(p["d"])), lambda p: F.struct(pixel(p["b"]).alias("x"), pixel(p["d"]).alias("y"), F.lit(1.0).alias("w")))
            own = own.withColumn("px", F.when(F.col("step") > 0, pts))
            area = F.col("step") * F.col("step")
            own = own.select(*KEY, "px", F.col("s").alias("sx"), F.col("s").alias("sy"), (F.col("m") * F.col("m") * area).alias("scale"), area.alias("cell"))
        else:
            raise ValueError(f"no vectorisation {metric!r}")
    return _pictures(own, n_bins, metric == "heat").select(*KEY, "ys", "cell")


def curves(dgm: DataFrame, metric: str, n_bins: int = 100, **params) -> DataFrame:
    """(sample_id, hdim, layer, bin, y) of betti, landscape or silhouette."""
    v = vectors(dgm, metric, n_bins=n_bins, **params)
    return v.select(*KEY, F.posexplode("ys").alias("k", "y")).select(*KEY, F.floor(F.col("k") / n_bins).cast("int").alias("layer"), (F.col("k") % n_bins).alias("bin"), "y")


def rasters(dgm: DataFrame, metric: str, n_bins: int = 100, **params) -> DataFrame:
    """(sample_id, hdim, row, col, v) of heat or persistence_image."""
    v = vectors(dgm, metric, n_bins=n_bins, **params)
    return v.select(*KEY, F.posexplode("ys").alias("k", "v")).select(*KEY, F.floor(F.col("k") / n_bins).cast("int").alias("row"), (F.col("k") % n_bins).alias("col"), "v")


# --- amplitudes and distances ----------------------------------------------------------------------------------------


def _norm(ys: Column, p: float, cell: Column) -> Column:
    total = F.aggregate(ys, F.lit(0.0), lambda s, y: s + F.pow(F.abs(y), F.lit(float(p))))
    return F.pow(total * cell, F.lit(1.0 / p))


def amplitude(dgm: DataFrame, metric: str = "landscape", *, p: float = 2.0, order: float | None = None, **params) -> DataFrame:
    """(sample_id, hdim, amplitude): distance to the empty diagram; with order, (sample_id, amplitude) over dimensions."""
    half = _life() / 2
    if metric == "bottleneck":
        a = dgm.groupBy(*KEY).agg(F.max(half).alias("a"))
    elif metric == "wasserstein":
        a = dgm.groupBy(*KEY).agg(F.pow(F.sum(F.pow(half, F.lit(float(p)))), F.lit(1.0 / p)).alias("a"))
    else:
        a = vectors(dgm, metric, **params).select(*KEY, _norm(F.col("ys"), p, F.col("cell")).alias("a"))
    out = frame(dgm).join(a, list(KEY), "left").select(*KEY, F.coalesce("a", F.lit(0.0)).alias("amplitude"))
    return out if order is None else out.groupBy("sample_id").agg(F.pow(F.sum(F.pow("amplitude", F.lit(float(order)))), F.lit(1.0 / order)).alias("amplitude"))


#: Numbers in a block of diagrams at most, and diagrams in one.
BLOCK_VALUES, BLOCK_ROWS = 2**19, 1024


def _block_pairs(a: DataFrame, b: DataFrame | None, kernel, width: int) -> DataFrame:
    """(i, j, hdim, d) of all pairs of rows of a and b (sample_id, hdim, x, cell), by kernel(left, right, cell) on arrays of blocks.

    b None: the pairs of a, each computed once and given both ways, with 0 between a row and itself. width: numbers in an x, roughly. Diagrams are
    gathered in blocks of bounded size, and pairs of blocks are dealt to tasks, so that a pair is a row of the result only.
    """
    same = b is None
    a = checkpointed(a)
    sides = [a] if same else [a, checkpointed(b)]
    sizes = [x.groupBy("hdim").count().agg(F.max("count"), F.count(F.lit(1))).first() for x in sides]
    rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, width), max(64, max(most or 0 for most, _ in sizes) // 16)))
    counts = [math.ceil((most or 0) / rows) or 1 for most, _ in sizes]
    # pairs of blocks are few bytes for their work: their number and not their size sets the number of tasks
    n_met = sizes[0][1] * (counts[0] * (counts[0] + 1) // 2 if same else counts[0] * counts[1])
    tasks = max(1, min(2 * n_met, 2000), n_met * 2 * rows * width * 8 // 2**26)

    def blocks(df: DataFrame, n: int, of: str) -> DataFrame:
        own = df.withColumn(f"_b{of}", F.pmod(F.xxhash64("sample_id"), F.lit(n)).cast("int"))
        return own.groupBy("hdim", f"_b{of}").agg(F.first("cell").alias(f"cell{of}"), F.collect_list(F.struct(F.col("sample_id").alias("id"), "x")).alias(of))

    def meet(df: DataFrame, of: str, low, high) -> DataFrame:
        return df.withColumn(f"_b{'j' if of == 'i' else 'i'}", F.explode(F.sequence(low, high)))

    left, right = blocks(sides[0], counts[0], "i"), blocks(sides[-1], counts[-1], "j")
    left = meet(left, "i", F.col("_bi") if same else F.lit(0), F.lit(counts[-1] - 1))
    right = meet(right, "j", F.lit(0), F.col("_bj") if same else F.lit(counts[0] - 1))
    keys = ["hdim", "_bi", "_bj"]
    met = left.repartition(tasks, *keys).join(right.drop("cellj").repartition(tasks, *keys), keys).select("hdim", (F.col("_bi") == F.col("_bj")).alias("own"), F.col("celli").alias("cell"), "i", "j")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def one_list(v):
            return pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)

        for batch in batches:
            for k in range(batch.num_rows):
                hdim, own, cell = (batch.column(c)[k].as_py() for c in range(3))
                own = own and same
                l, r = batch.column(3)[k].values, batch.column(4)[k].values
                if own:  # both sides hold the same diagrams: in the same order
                    l, r = (v.take(pa.array(np.argsort(v.field("id").to_numpy()))) for v in (l, r))
                i, j = l.field("id").to_numpy(), r.field("id").to_numpy()
                table = np.ma.zeros((len(i), len(j)))
                for at, d in kernel(l.field("x"), r.field("x"), cell):
                    table[at] = d
                if own:
                    below, mirrored = np.tril_indices(len(i), -1), table.T.copy()
                    table[below] = mirrored[below]
                    table[np.diag_indices(len(i))] = 0.0
                # tables leave the worker in strips, as lists: rows of pairs would each take a long way through Arrow
                for x, y, d in ((i, j, table),) if own or not same else ((i, j, table), (j, i, table.T)):
                    step = max(1, 2**15 // max(1, len(y)))
                    for at in range(0, len(x), step):
                        strip = d[at : at + step]
                        mask = None if np.ma.getmask(strip) is np.ma.nomask or not strip.mask.any() else strip.mask.ravel()
                        values = pa.array(np.ascontiguousarray(np.ma.getdata(strip)).ravel(), mask=mask)
                        yield pa.RecordBatch.from_arrays([pa.array([hdim], pa.int32()), *(one_list(v) for v in (pa.array(x[at : at + step]), pa.array(y), values))], names=["hdim", "is", "js", "ds"])

    strips = met.mapInArrow(work, "hdim int, is array<long>, js array<long>, ds array<double>").select("hdim", "is", "js", F.size("js").alias("n"), F.posexplode("ds").alias("k", "d"))
    return strips.select(F.get("is", F.expr("int(k div n)")).alias("i"), F.get("js", F.col("k") % F.col("n")).alias("j"), "hdim", "d")


def _norms(p: float):
    """Kernel of ``_block_pairs``: norms of differences of vectors, a few vectors at a time."""
    import numpy as np

    def kernel(l, r, cell):
        parts = [v.flatten() for v in (l, r)]
        x, y = (v.to_numpy(zero_copy_only=False).reshape(len(o), -1) for v, o in zip(parts, (l, r), strict=True))
        nulls = [v.is_null().to_numpy(zero_copy_only=False).reshape(len(o), -1).any(1) if v.null_count else None for v, o in zip(parts, (l, r), strict=True)]
        yt = np.ascontiguousarray(y.T)
        step = max(1, 2**15 // len(y))
        for at in range(0, len(x), step):
            xs = x[at : at + step]
            total, gap = np.zeros((len(xs), len(y))), np.empty((len(xs), len(y)))
            for k in range(x.shape[1]):
                np.subtract(xs[:, k, None], yt[k][None], out=gap)
                total += np.multiply(gap, gap, out=gap) if p == 2 else np.abs(gap) ** p
            d = np.full(total.shape, np.nan) if cell is None else np.sqrt(total * cell) if p == 2 else (total * cell) ** (1 / p)
            if cell is None or any(n is not None for n in nulls):
                own, far = (np.zeros(len(v), bool) if n is None else n for n, v in zip(nulls, (x, y), strict=True))
                d = np.ma.array(d, mask=np.full(d.shape, True) if cell is None else own[at : at + step, None] | far[None])
            yield slice(at, at + step), d

    return kernel


def distances(dgm: DataFrame, metric: str = "landscape", *, other: DataFrame | None = None, p: float = 2.0, order: float | None = None, **params) -> DataFrame:
    """(i, j, hdim, d) between the diagrams of dgm and of other (default: dgm itself, each pair once and mirrored)."""
    same = other is None
    dgm = checkpointed(dgm)  # grids, frames and points are read from it several times
    fit = dgm if same else checkpointed(other)
    if metric in ("bottleneck", "wasserstein"):
        own = lambda df: _lists(df).select(*KEY, F.col("pts").alias("x"), F.lit(1.0).alias("cell"))
        kernel, width = _matchings(metric, p), 2 * (dgm.unionByName(fit).groupBy(*KEY).count().agg(F.max("count")).first()[0] or 1)
    else:
        own = lambda df: vectors(df, metric, fit=fit, **params).select(*KEY, F.col("ys").alias("x"), "cell")
        n = params.get("n_bins", 100)
        kernel, width = _norms(p), n * n if metric in ("heat", "persistence_image") else n * params.get("n_layers", 1)
    out = _block_pairs(own(dgm), None if same else own(fit), kernel, width)
    return out if order is None else out.groupBy("i", "j").agg(F.pow(F.sum(F.pow("d", F.lit(float(order)))), F.lit(1.0 / order)).alias("d"))


def _lists(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<b:double,d:double>>")
    pts = df.filter("birth <> death").groupBy(*KEY).agg(F.collect_list(F.struct(F.col("birth").alias("b"), F.col("death").alias("d"))).alias("pts"))
    return frame(df).join(pts, list(KEY), "left").select(*KEY, F.coalesce("pts", none).alias("pts"))


def _matchings(metric: str, p: float):
    """Kernel of ``_block_pairs``: optimal matchings; diagrams of a few points are taken together by their sizes."""
    import numpy as np

    from ..functions import matching

    def kernel(l, r, cell):
        sides = []
        for v in (l, r):
            ends = v.flatten()
            pts = np.stack([ends.field(c).to_numpy(zero_copy_only=False) for c in ("b", "d")], axis=1)
            sides.append((pts, np.r_[0, np.cumsum(v.value_lengths().to_numpy())]))
        (a, sa), (b, sb) = sides
        step = max(1, 2**15 // len(r))
        for at in range(0, len(l), step):
            yield slice(at, at + step), matching.table(a, sa[at : at + step + 1], b, sb, metric, p)

    return kernel
