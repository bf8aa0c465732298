"""What plots show, as DataFrames; drawing is left to any client."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def point_cloud(points: DataFrame, dimension: int = 2) -> DataFrame:
    return points.select("cloud_id", "point_id", *(F.get("coords", F.lit(k)).alias("xyz"[k]) for k in range(dimension)))


def diagram(dgm: DataFrame) -> DataFrame:
    """Distinct off-diagonal points with multiplicity, infinite deaths put 10 % above the range, and the axis limits."""
    inf = float("inf")
    w = Window.partitionBy("sample_id")
    finite = lambda c: F.when(F.abs(c) != inf, F.col(c))
    own = dgm.withColumn("_lo", F.min(F.least(finite("birth"), finite("death"))).over(w)).withColumn("_hi", F.max(F.greatest(finite("birth"), finite("death"))).over(w))
    own = own.withColumn("_any", F.max((F.col("death") == inf).cast("int")).over(w) > 0).withColumn("_range", F.col("_hi") - F.col("_lo"))
    extra = F.when(F.col("_any"), 0.12).otherwise(0.02) * F.col("_range")
    own = own.withColumn("y", F.when(F.col("death") == inf, F.col("_hi") + 0.1 * F.col("_range")).otherwise(F.col("death")))
    own = own.withColumn("axis_lo", F.col("_lo") - extra).withColumn("axis_hi", F.col("_hi") + extra).filter("birth <> death")
    return own.groupBy("sample_id", "hdim", "birth", "y", "axis_lo", "axis_hi").agg(F.count(F.lit(1)).alias("multiplicity"))


def heatmap(rasters: DataFrame, sample: int, hdim: int) -> DataFrame:
    return rasters.filter((F.col("sample_id") == sample) & (F.col("hdim") == hdim)).select("row", "col", "v")


def betti_curves(curves: DataFrame, sample: int) -> DataFrame:
    return curves.filter(F.col("sample_id") == sample).select("hdim", "bin", "y")


def betti_surface(curves: DataFrame, hdim: int) -> DataFrame:
    return curves.filter(F.col("hdim") == hdim).select("sample_id", "bin", "y")


def significant(value, digits: int = 3):
    """A column rounded to this many significant digits."""
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(value)))
    return F.when(value == 0, 0.0).otherwise(F.rint(value * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places))


def mapper_graph(nodes: DataFrame, colors: DataFrame, digits: int = 3) -> DataFrame:
    """(node_id, set_id, label, size, color): what a drawing of the graph needs, without a layout."""
    return nodes.join(colors, "node_id", "left").select("node_id", "set_id", "label", "size", significant(F.col("color"), digits).alias("color"))
