"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 30-bit hash of its doc_id and text length. A source's target is a number of whole passes over it and a rest;
the rest is met by the rows whose hash lies below the source's threshold. The threshold is found without sorting
rows: sizes are summed by source and the leading 10 bits of the hash, running sums over these at most 1024 buckets of
a source find the bucket where the budget is crossed, and only the rows of that bucket are summed again by the next
10 bits, then by the last 10. A threshold for a larger budget is never smaller, so selections for growing targets are
nested. The hash depends on the row alone, so reruns agree.

Targets: sources ordered by code point, null last, weigh ``weights`` repeating; they share ``share`` times all sizes,
no source more than ``cap`` times its own, what is above being shared again by weight until none is above. That
water level has a closed form over the sources ordered by cap / weight.

Defined results. Null or blank text has size 0 and is never taken. Rows that repeat a doc_id and text share a hash and
are taken or left together. A null source is a source of its own, the last. A source of size 0 has target 0. An empty table gives no
rows. Other columns are ignored, or handed on unchanged by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, cut, free_name, small, table, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BITS = 10
LEVELS = 3


def row_hash(doc_id: Column, text: Column) -> Column:
    """30 bits; MD5, so that any SQL engine can say the same."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.length(text), F.lit(0)).cast("string"))
    return F.shiftright(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), 2)


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: (source, source_size), a row a source. Adds target. One window over the sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*(F.lit(w) for w in weights))
    t = sizes.withColumn("w", F.element_at(choices, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    t = t.withColumn("c", F.lit(cap) * F.col("source_size"))
    level = Window.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(everything)
    # if all sources before this one are at their cap, the others share what is left at this price a weight
    price = (total - F.coalesce(F.sum("c").over(before), F.lit(0.0))) / F.sum("w").over(after)
    t = t.withColumn("price", price)
    fits = F.when(F.col("price") * F.col("w") <= F.col("c"), F.col("price"))
    # once a source fits below its cap, capping it all the same only lowers the price: the level is the largest that fits
    t = t.withColumn("level", F.max(fits).over(everything))
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("c")).otherwise(F.least(F.col("c"), F.col("level") * F.col("w"))).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows: (source, size, h); budgets: (source, budget). (source, threshold): rows with h below it sum to about budget.

    The last cell is included where that comes nearer to the budget than leaving it out.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        down = BITS * (LEVELS - 1 - level)
        mine = rows.withColumn("prefix", F.shiftright("h", down + BITS)).withColumn("cell", F.shiftright("h", down))
        mine = mine.join(small(state.select(F.col("source").alias("_s"), F.col("prefix").alias("_p"))), F.col("source").eqNullSafe(F.col("_s")) & (F.col("prefix") == F.col("_p")))
        hist = mine.groupBy("source", "cell").agg(F.sum("size").alias("n"))  # at most 1024 rows a source
        hist = hist.withColumn("sum", F.sum("n").over(Window.partitionBy("source").orderBy("cell")))
        hist = hist.select(F.col("source").alias("_s"), "cell", "n", "sum")
        both = state.join(hist, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("upto", F.col("below") + F.coalesce("sum", F.lit(0)))
        # the first cell that crosses the budget; where none does, everything here is taken
        crossing = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("cell", (F.col("upto") - F.col("n")).alias("below"), "upto")))
        state = both.groupBy("source", "budget", "prefix").agg(crossing.alias("x"), F.max("upto").alias("most"))
        last = level == LEVELS - 1
        nearer = F.col("x.upto") - F.col("budget") < F.col("budget") - F.col("x.below")
        end = F.shiftleft(F.col("prefix") + 1, BITS)
        found = F.col("x").isNotNull()
        state = state.select(
            "source",
            "budget",
            F.when(found, F.col("x.cell") + (nearer.cast("long") if last else F.lit(0))).otherwise(end).alias("prefix"),
            F.when(found, F.col("x.below")).otherwise(F.col("most")).alias("below"),
        )
        state = cut(state, "thresholds")
    return state.select("source", F.col("prefix").alias("threshold"))


def mix_plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, source, size, h) and (plan: source, source_size, target, passes, threshold)."""
    with Scratch(docs.sparkSession) as own:
        rows = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
        rows = own.keep(cut(rows, "sizes"))
        sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        goal = cut(targets(sizes, weights=weights, share=share, cap=cap), "targets")
        goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))).otherwise(0))
        budgets = goal.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"))
        limits = thresholds(rows, budgets).withColumnRenamed("source", "_s")
        plan = goal.join(limits, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return rows, own.keep(cut(plan, "mix"))


def _with_plan(rows: DataFrame, plan: DataFrame, mark: str) -> DataFrame:
    """rows with the columns of their source's plan, named with ``mark`` in front."""
    own = small(plan.select(*(F.col(c).alias(f"{mark}{c}") for c in plan.columns)))
    return rows.join(own, F.col("source").eqNullSafe(F.col(f"{mark}source")), "left")


def copies(h: Column, mark: str) -> Column:
    return (F.col(f"{mark}passes") + (h < F.col(f"{mark}threshold")).cast("long")).cast("int")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, a row for each input row."""
    rows, plan = mix_plan(docs, **how)
    return _with_plan(rows, plan, "_m_").select(
        "doc_id", "size", F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"), (F.col("size") * copies(F.col("h"), "_m_")).alias("taken")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken; rows of size 0 are left out."""
    _, plan = mix_plan(docs, **how)
    mark = free_name(docs, "_mix_")
    n = F.when(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) > 0, copies(row_hash(F.col("doc_id"), F.col("text")), mark)).otherwise(0)
    own = _with_plan(docs, plan, mark)
    return own.withColumn(f"{mark}copy", F.explode(F.array_repeat(F.lit(0), n))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(length(text), 0)::VARCHAR), 1, 8))::BIGINT >> 2 AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 2.0::DOUBLE * source_size AS c,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM s),
p AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(c) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price
  FROM w),
l AS (SELECT *, max(CASE WHEN price * w <= c THEN price END) OVER () AS level FROM p),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN c ELSE least(c, level * w) END AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
r AS (
  SELECT d.doc_id, d.size, d.source, b.source_size, b.target, b.passes, b.target - b.passes * b.source_size AS budget, d.h,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
x AS (SELECT source, min(CASE WHEN upto > budget THEN h END) AS cell FROM r GROUP BY source),
y AS (
  SELECT r.*, x.cell, max(CASE WHEN r.upto <= r.budget THEN r.upto ELSE 0 END) OVER (PARTITION BY r.source) AS below,
         min(CASE WHEN r.upto > r.budget THEN r.upto END) OVER (PARTITION BY r.source) AS upper
  FROM r JOIN x ON r.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN cell IS NULL OR h < cell OR (h = cell AND upper - budget < budget - below) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM y
"""
