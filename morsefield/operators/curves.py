"""Curves (sample_id, channel, bin, y): features and derivatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: argmax and argmin take the first bin among equals.
FEATURES = {
    "max": F.max,
    "min": F.min,
    "mean": F.mean,
    "std": F.stddev_pop,
    "median": F.median,
    "argmax": None,
    "argmin": None,
    "average": None,
}


def features(curves: DataFrame, function="max", weights: list[float] | None = None) -> DataFrame:
    """(sample_id, channel, feature). function: a name for all channels, a dict channel -> name (None drops it), or an aggregate."""
    if isinstance(function, dict):
        parts = [features(curves.filter(F.col("channel") == c), f, weights) for c, f in function.items() if f is not None]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out
    if function == "argmax":
        agg = F.max(F.struct("y", (-F.col("bin")).alias("k")))
        return curves.groupBy("sample_id", "channel").agg(agg.alias("s")).select("sample_id", "channel", (-F.col("s.k")).cast("double").alias("feature"))
    if function == "argmin":
        agg = F.min(F.struct("y", "bin"))
        return curves.groupBy("sample_id", "channel").agg(agg.alias("s")).select("sample_id", "channel", F.col("s.bin").cast("double").alias("feature"))
    if function == "average":
        w = F.element_at(F.array(*map(F.lit, weights)), (F.col("bin") + 1).cast("int")) if weights else F.lit(1.0)
        return curves.groupBy("sample_id", "channel").agg((F.sum(F.col("y") * w) / F.sum(w)).alias("feature"))
    f = FEATURES[function] if isinstance(function, str) else function
    return curves.groupBy("sample_id", "channel").agg(f("y").cast("double").alias("feature"))


def vectors(curves: DataFrame) -> DataFrame:
    """The identity feature: each curve as one array."""
    own = F.array_sort(F.collect_list(F.struct("bin", "y")))
    return curves.groupBy("sample_id", "channel").agg(F.transform(own, lambda s: s["y"]).alias("feature"))


def derivative(curves: DataFrame, order: int = 1) -> DataFrame:
    """Differences of successive bins, order times; bins count from 0 again. A curve of order bins or fewer has none."""
    w = Window.partitionBy("sample_id", "channel").orderBy("bin")
    for _ in range(order):
        curves = curves.withColumn("_b", F.lag("y").over(w)).filter("_b is not null").select("sample_id", "channel", (F.col("bin") - 1).alias("bin"), (F.col("y") - F.col("_b")).alias("y"))
    return curves
