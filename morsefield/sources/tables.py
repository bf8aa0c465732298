"""Parquet tables as the engine's data model, readers and writers, and input checks.

Clouds (cloud_id, point_id, coords), images (img_id, shape, px) and their long form (img_id, r, c, v), series
(series_id, t, value), diagrams (sample_id, hdim, birth, death), edges (cloud_id, src, dst, w).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """parquet, orc, csv, json or any source on the classpath."""
    return spark.read.format(fmt).options(**options).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options) -> None:
    df.write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clouds(spark: SparkSession, sf: str, points: int = 10, dims: int | None = None) -> DataFrame:
    coords = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / points).alias("cloud_id"), (F.col("vec_id") % points).cast("int").alias("point_id"), (F.slice(coords, 1, dims) if dims else coords).alias("coords")
    )


def images(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 grey images in long form."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("img_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    return e.select("img_id", F.floor(F.col("i") / 8).cast("int").alias("r"), (F.col("i") % 8).alias("c"), "v")


def binary_images(spark: SparkSession, sf: str) -> DataFrame:
    return images(spark, sf).select("img_id", "r", "c", (F.col("v") > 0).alias("on"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("series_id"), (F.row_number().over(w) - 1).cast("long").alias("t"), "value", "event_type")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(window_id, t, var, value): sums of value by event type and day, in windows of 7 days."""
    d = table(spark, sf, "events").select(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.col("event_type").alias("var"), "value")
    d = d.groupBy("day", "var").agg(F.sum("value").alias("value"))
    return d.select(F.floor(F.col("day") / 7).alias("window_id"), F.col("day").alias("t"), "var", "value")


def diagrams(spark: SparkSession, sf: str) -> DataFrame:
    """A synthetic diagram a user: a point spans two successive values; its dimension comes from the event type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("value").over(w)
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("sample_id"), (F.length("event_type") % 3).cast("int").alias("hdim"), F.least("value", before).alias("birth"), F.greatest("value", before).alias("death"), before.alias("before")
    )
    return e.filter("before is not null").drop("before")


def check_clouds(points: DataFrame, *, distance_matrices: bool = False) -> DataFrame:
    """(cloud_id, points, dims, problem): problem is null for a sound cloud."""
    bad = F.exists("coords", lambda x: F.isnan(x) | x.isNull() | (~F.lit(distance_matrices) & (F.abs(x) == float("inf"))))
    g = points.groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("points"), F.countDistinct("point_id").alias("ids"), F.min(F.size("coords")).alias("dims"), F.max(F.size("coords")).alias("most"), F.max(bad.cast("int")).alias("bad")
    )
    problem = F.when(F.col("bad") > 0, "not finite").when(F.col("dims") != F.col("most"), "ragged points").when(F.col("ids") != F.col("points"), "repeated points")
    return g.select("cloud_id", "points", F.col("dims").cast("long").alias("dims"), problem.alias("problem"))


def check_diagrams(dgm: DataFrame) -> DataFrame:
    """(sample_id, hdim, points, below): below counts points that die before they are born."""
    return dgm.groupBy("sample_id", "hdim").agg(F.count(F.lit(1)).alias("points"), F.sum((F.col("death") < F.col("birth")).cast("long")).alias("below"))


def require(df: DataFrame, condition, message: str) -> DataFrame:
    """df, failing at run time on the first row that breaks the condition."""
    return df.filter(F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
