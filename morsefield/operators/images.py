"""Image operators on long images (img_id, r, c[, z], v or on), as projections and joins within an image."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def axes(img: DataFrame) -> list[str]:
    return [a for a in ("r", "c", "z") if a in img.columns]


def _shape(img: DataFrame) -> DataFrame:
    w = Window.partitionBy("img_id")
    for a in axes(img):
        img = img.withColumn(f"_n{a}", F.max(a).over(w) + 1)
    return img


def binarize(img: DataFrame, threshold: float = 0.5) -> DataFrame:
    """v / (largest value of the collection) > threshold."""
    top = img.agg(F.max("v").alias("_top"))
    return img.crossJoin(F.broadcast(top)).select("img_id", *axes(img), (F.col("v") / F.col("_top") > threshold).alias("on"))


def invert(img: DataFrame, max_value: float | None = None) -> DataFrame:
    """NOT for binary images; max_value (or the largest value of the collection) - v for grey ones."""
    if "on" in img.columns:
        return img.withColumn("on", ~F.col("on"))
    if max_value is not None:
        return img.withColumn("v", F.lit(float(max_value)) - F.col("v"))
    return img.crossJoin(F.broadcast(img.agg(F.max("v").alias("_top")))).withColumn("v", F.col("_top") - F.col("v")).drop("_top")


def pad(img: DataFrame, padding: tuple[int, ...] | None = None, value: bool = False) -> DataFrame:
    """padding pixels of value on both sides of each axis: a grid of each image's size, left-joined with its pixels."""
    ax = axes(img)
    padding = padding or (1,) * len(ax)
    grid = img.groupBy("img_id").agg(*(F.max(a).alias(f"_m{a}") for a in ax))
    for a, p in zip(ax, padding, strict=True):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), (F.col(f"_m{a}") + 2 * p).cast("int"))))
    moved = img.select("img_id", *((F.col(a) + p).cast("int").alias(a) for a, p in zip(ax, padding, strict=True)), "on")
    return grid.join(moved, ["img_id", *ax], "left").select("img_id", *ax, F.coalesce("on", F.lit(value)).alias("on"))


def to_cloud(img: DataFrame) -> DataFrame:
    """(img_id, coords) of the active pixels: (column, rows - 1 - row[, z])."""
    rest = [F.col("z").cast("double")] if "z" in img.columns else []
    return _shape(img).filter("on").select("img_id", F.array(F.col("c").cast("double"), (F.col("_nr") - 1 - F.col("r")).cast("double"), *rest).alias("coords"))


def _outside(img: DataFrame, value: Column, name: str) -> DataFrame:
    """Active pixels get value, inactive ones 1 more than the largest value any pixel of the grid could get."""
    own = _shape(img).withColumn("_v", value).withColumn("_top", F.max("_v").over(Window.partitionBy("img_id")) + 1)
    keep = F.col("on") & F.col("_v").isNotNull()
    return own.select("img_id", *axes(img), F.when(keep, F.col("_v")).otherwise(F.col("_top")).alias(name))


def height(img: DataFrame, direction: tuple[float, ...] | None = None, name: str = "v") -> DataFrame:
    """Scalar product of (column, row, z) with the unit direction; along negative components coordinates run from -(n-1) to 0."""
    order = [a for a in ("c", "r", "z") if a in img.columns]
    direction = direction or (1.0,) * len(order)
    norm = math.sqrt(sum(d * d for d in direction))
    value = F.lit(0.0)
    for a, d in zip(order, direction, strict=True):
        at = F.col(a) if d >= 0 else F.col(a) - (F.col(f"_n{a}") - 1)
        value = value + at * F.lit(d / norm)
    return _outside(img, value, name)


def radial(img: DataFrame, center: tuple[float, ...] | None = None, radius: float = math.inf, metric: str = "euclidean", name: str = "v") -> DataFrame:
    """Distance of (column, row, z) to the center, within the radius."""
    from ..functions.metrics import distance

    order = [a for a in ("c", "r", "z") if a in img.columns]
    center = center or (0.0,) * len(order)
    d = distance(F.array(*(F.col(a).cast("double") for a in order)), F.array(*(F.lit(float(x)) for x in center)), metric)
    return _outside(img, F.when(d <= radius, d), name)


def _nearest(img: DataFrame, wanted: bool) -> DataFrame:
    """(img_id, axes, d): L1 distance of each pixel to the nearest pixel that is ``wanted``, null if there is none.

    Steps of a cross-shaped structuring element on a full grid walk the L1 metric. The distance is separable: nearest
    along rows first, then over columns, so an n x n image costs n ** 3 pairs and not n ** 4.
    """
    ax = axes(img)
    own = img.withColumn("_d", F.when(F.col("on") == wanted, 0))
    for a in reversed(ax):
        rest = ["img_id", *(b for b in ax if b != a)]
        line = own.groupBy(*rest).agg(F.collect_list(F.struct(F.col(a).alias("at"), F.col("_d").alias("d"))).alias("_line"))
        far = F.filter("_line", lambda s: s["d"].isNotNull())
        near = lambda x: F.array_min(F.transform(F.col("_far"), lambda s: F.abs(s["at"] - x) + s["d"]))
        done = line.withColumn("_far", far).withColumn("_out", F.transform("_line", lambda s: F.struct(s["at"].alias("at"), near(s["at"]).alias("d"))))
        own = done.select(*rest, F.explode("_out").alias("_o")).select(*rest, F.col("_o.at").alias(a), F.col("_o.d").alias("_d"))
    return own.select("img_id", *ax, F.col("_d").alias("d"))


def _limit(img: DataFrame) -> Column:
    return sum((F.col(f"_n{a}") for a in axes(img)[1:]), F.col(f"_n{axes(img)[0]}"))


def dilation(img: DataFrame, n_iterations: int | None = None, name: str = "v") -> DataFrame:
    """Steps of dilation until a pixel is active; the sum of the sides where it is not within n_iterations."""
    both = _shape(img).join(_nearest(img, True), ["img_id", *axes(img)])
    ok = F.col("d") <= (F.lit(n_iterations) if n_iterations else _limit(img))
    return both.select("img_id", *axes(img), F.when(ok, F.col("d")).otherwise(_limit(img)).cast("double").alias(name))


def erosion(img: DataFrame, n_iterations: int | None = None, name: str = "v") -> DataFrame:
    """Steps of erosion until a pixel is inactive."""
    return dilation(img.withColumn("on", ~F.col("on")), n_iterations, name)


def signed_distance(img: DataFrame, n_iterations: int | None = None, name: str = "v") -> DataFrame:
    """Minus the distance to the active pixels outside, the distance to the inactive ones less 1 inside."""
    ax = axes(img)
    both = _shape(img).join(_nearest(img, True), ["img_id", *ax]).join(_nearest(img, False).withColumnRenamed("d", "e"), ["img_id", *ax])
    n = F.lit(n_iterations) if n_iterations else _limit(img)
    inside = F.when(F.col("e") <= n, F.col("e") - 1).otherwise(_limit(img))
    outside = F.when(F.col("d") <= n, -F.col("d")).otherwise(-_limit(img))
    return both.select("img_id", *ax, F.when(F.col("on"), inside).otherwise(outside).cast("double").alias(name))


def density(img: DataFrame, radius: float = 3.0, metric: str = "euclidean", name: str = "v") -> DataFrame:
    """Number of active pixels within the radius, the pixel itself included: each active pixel adds to the ball around it.

    The ball is a fixed list of offsets, so the work is pixels x ball and the join is an aggregation on (image, pixel).
    """
    ax = axes(img)
    r = int(math.ceil(radius))
    span = range(-r, r + 1)
    offsets = [(i, j, k) for i in span for j in span for k in (span if "z" in ax else (0,))]
    size = {"euclidean": lambda o: math.sqrt(sum(x * x for x in o)), "manhattan": lambda o: sum(map(abs, o)), "cityblock": lambda o: sum(map(abs, o)), "chebyshev": lambda o: max(map(abs, o))}[metric]
    ball = [o for o in offsets if size(o) <= radius]
    spread = F.explode(F.array(*(F.struct(*((F.col(a) + d).alias(a) for a, d in zip(ax, o, strict=False))) for o in ball)))
    hits = img.filter("on").select("img_id", spread.alias("_p")).groupBy("img_id", *(F.col(f"_p.{a}").alias(a) for a in ax)).agg(F.count(F.lit(1)).alias("_k"))
    return img.join(hits, ["img_id", *ax], "left").select("img_id", *ax, F.coalesce("_k", F.lit(0)).cast("double").alias(name))
