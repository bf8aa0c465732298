"""Exact dedup with a heavy-hitter split.

Each text is reduced to the SHA-256 of its text with A-Z lower-cased. A frequent-items sketch of the Misra-Gries
family (``approx_top_k``: mergeable counters, at most ``tracked`` of them, so every digest with more than
about n/tracked rows is surely among its items) names candidates; one exact count confirms them. Confirmed digests (at most
``heavy`` rows, so the broadcast is bounded by that parameter) are settled on the map side, and what is left holds
no large group, so that it can be shuffled by digest as usual.

Defined results. Null text counts as empty. Among rows of equal text the one with the largest doc_id stays; if that
row itself is repeated, exactly one of its copies has kept = true. A null doc_id is smaller than any other; a group
of null ids only has a null keep_id and keeps one row. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, lower_az, table

HEAVY = 256
TRACKED = 4096


def exact_groups(docs: DataFrame, *, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    digest = F.unhex(F.sha2(lower_az(F.coalesce(F.col("text"), F.lit(""))), 256))
    rows = docs.select("doc_id", digest.alias("digest")).withColumn("key", F.xxhash64("digest"))
    rows = cut(rows, "digests")
    # the sketch takes integers: the 64-bit key stands for the digest here, the exact count below uses the digest
    top = rows.agg(F.expr(f"approx_top_k(key, {heavy}, {tracked})").alias("top")).select(F.explode("top").alias("top"))
    top = top.filter(F.col("top.count") > 1).select(F.col("top.item").alias("key"))
    winners = (
        rows.join(F.broadcast(top), "key", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("win_id"), F.count(F.lit(1)).alias("win_size"))
    )
    winners = cut(winners.orderBy(F.desc("win_size"), "digest").limit(heavy), "winners")
    split = rows.select("doc_id", "digest").join(F.broadcast(winners), "digest", "left")
    lost = F.col("win_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("win_id"))
    settled = split.filter(lost).select(
        "doc_id", F.col("win_id").alias("keep_id"), F.col("win_size").alias("group_size"), F.lit(False).alias("kept"), "digest"
    )
    same = Window.partitionBy("digest")
    rest = split.filter(~lost).select(
        "doc_id",
        F.coalesce("win_id", F.max("doc_id").over(same)).alias("keep_id"),
        F.coalesce("win_size", F.count(F.lit(1)).over(same)).alias("group_size"),
        (F.row_number().over(same.orderBy(F.desc_nulls_last("doc_id"))) == 1).alias("kept"),
        "digest",
    )
    return settled.unionByName(rest).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS d
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY d) AS keep_id, count(*) OVER (PARTITION BY d) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY d) AS kept, d AS text_sha256
FROM n
"""
