"""Quality rules: a learned decision list over text statistics.

Statistics are computed by built-in expressions only. The learner is sequential covering: each rule is grown on one
part of the labelled rows by adding the threshold condition of best FOIL gain, pruned on the other part, and accepted
while it is precise enough there; what it covers is removed and the next rule is sought. The result is an ordered list
of conjunctions, emitted as one ``CASE WHEN`` expression.

The learner sees a histogram, not rows: each statistic is cut at a fixed list of quantiles, so that the labelled rows
aggregate to at most (cuts + 1) ** features cells whatever their number. The labelled sample is bounded by ``sample``
rows (those of smallest hash of doc_id), a documented bound on the fit alone; statistics and verdicts cover every row.

Defined results. Null or blank text has no words: all statistics are 0, base_failed is true and kept false. Rows of
repeated ids are judged one by one. Labels that are null, or that are missing altogether, are not learned from; with no
labelled row of low quality the list is empty and keeps whatever the base keeps. An empty table gives no rows. Other
columns are ignored by ``quality_report`` and carried through unchanged by ``keep_by_quality``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, cut, free_name, let, table, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
SAMPLE = 50_000
QUANTILES = (0.01, 0.03, 0.07, 0.15, 0.5, 0.85, 0.93, 0.97, 0.99)
#: What rules look at: ratios, so that they mean the same at every length; null where the denominator is 0.
FEATURES = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "words": ("n_words", None),
}


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 5-word window found twice or more in this text."""
    none = F.lit(0).cast("long")

    def covered(s: Column) -> Column:
        """s: sorted structs (window hash, start). Starts of repeated windows, then the length of their union."""
        twin = lambda e, k: ((k > 0) & (s[k - 1]["g"] == e["g"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["g"] == e["g"]))
        starts = F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("at"), none.alias("n"))
        step = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(let(pairs, covered))

    def windows(h: Column) -> Column:
        starts = F.slice(h, 1, F.size(h) - (WINDOW - 1))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, none).otherwise(let(hashes, lambda h: let(windows(h), count)))


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """docs and one struct column ``name`` with the statistics of text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit("[^\\x20\\x09-\\x0D]")))
    words, lines = f"{name}_words", f"{name}_lines"
    # the one-element explode keeps the optimizer from copying the whole computation into every later use
    return (
        docs.withColumn(words, words_of(F.col("text")))
        .withColumn(lines, full)
        .withColumn(
            name,
            F.explode(F.array(F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_words(F.col(words)).cast("long").alias("n_repeat_words"),
            ))),
        )
        .drop(words, lines)
    )


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, value: Column) -> Column:
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Reject what meets every condition."""

    conditions: tuple[Condition, ...]
    precision: float


def _features(s: str) -> dict[str, Column]:
    return {k: F.col(f"{s}.{n}") / (F.nullif(F.col(f"{s}.{d}"), F.lit(0)) if d else F.lit(1)) for k, (n, d) in FEATURES.items()}


def decision(rules: list[Rule], s: str) -> Column:
    """Number of the first rule that rejects, as an ordered CASE WHEN; null where none does."""
    values = _features(s)
    out = None
    for k, rule in enumerate(rules):
        met = F.lit(True)
        for c in rule.conditions:
            met = met & c.column(values[c.feature])
        out = F.when(met, F.lit(k)) if out is None else out.when(met, F.lit(k))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def cover(cells: np.ndarray, weights: np.ndarray, cuts: list[list[float]], *, min_precision: float, min_rows: int, max_rules: int, max_conditions: int) -> list[Rule]:
    """Sequential covering. cells: a row of bin numbers a cell; weights: (grow bad, grow good, prune bad, prune good)."""
    names, rules = list(FEATURES), []
    left = np.ones(len(cells), bool)
    tests = [(f, above, k) for f in range(len(names)) for k in range(len(cuts[f])) for above in (True, False)]
    met = {t: (cells[:, t[0]] > t[2]) if t[1] else (cells[:, t[0]] <= t[2]) for t in tests}
    total = lambda on, k: float(weights[on, k].sum())
    while len(rules) < max_rules:
        on, grown = left.copy(), []
        while len(grown) < max_conditions and (p0 := total(on, 0)) > 0 and (n0 := total(on, 1)) > 0:
            best, most = None, 0.0
            for t in tests:
                both = on & met[t]
                p, n = total(both, 0), total(both, 1)
                if p > 0 and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > most + 1e-9:
                    best, most = t, gain
            if best is None:
                break
            grown.append(best)
            on &= met[best]

        def worth(conditions: list) -> tuple[float, float, np.ndarray]:
            hit = left.copy()
            for t in conditions:
                hit &= met[t]
            p, n = total(hit, 2), total(hit, 3)
            return ((p - n) / (p + n) if p + n else -1.0), p + n, hit

        if not grown:
            break
        pruned = max((grown[: k + 1] for k in range(len(grown))), key=lambda c: (round(worth(c)[0], 9), -len(c)))
        _, seen, hit = worth(pruned)
        p, n = total(hit, 0) + total(hit, 2), total(hit, 1) + total(hit, 3)
        held_out = total(hit, 2) / seen if seen else 0.0
        if p + n < min_rows or held_out < min_precision or p / (p + n) < min_precision:
            break
        rules.append(Rule(tuple(Condition(names[f], above, cuts[f][k]) for f, above, k in pruned), p / (p + n)))
        left &= ~hit
    return rules


def learn(docs: DataFrame, labels: DataFrame, **how) -> list[Rule]:
    """The decision list for documents of quality 0. The sample has the labels of smallest hash of doc_id; how: see _learned."""
    with Scratch(docs.sparkSession):
        return _learned(docs, labels, **how)


def _learned(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, min_precision: float = 0.9, min_rows: int = 6, max_rules: int = 12, max_conditions: int = 4) -> list[Rule]:
    chosen = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").alias("_bad"))
    chosen = chosen.groupBy("_id").agg((F.min("_bad") == 0).cast("long").alias("_bad")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    seen = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    stats = with_statistics(seen, "_s").filter(~base_failed("_s"))
    stats = cut(stats.select("_id", "_bad", *(v.alias(k) for k, v in _features("_s").items())), "labelled")
    cuts_row = stats.agg(*(F.percentile_approx(k, list(QUANTILES), 100_000).alias(k) for k in FEATURES)).first()
    if cuts_row is None or any(cuts_row[k] is None for k in FEATURES):
        return []
    cuts = [sorted(set(cuts_row[k])) for k in FEATURES]
    gaps = stats.agg(*(f(F.when(on, F.col(k))).alias(f"{k}{i}{side}") for k, cs in zip(FEATURES, cuts, strict=True) for i, c in enumerate(cs) for side, f, on in (("a", F.max, F.col(k) <= c), ("b", F.min, F.col(k) > c)))).first()
    bins = [sum(((F.col(k) > c).cast("int") for c in cs), F.lit(0)).alias(k) for k, cs in zip(FEATURES, cuts, strict=True)]
    part = F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(3)) == 0
    # at most (cuts + 1) ** features rows, however many labels there are
    cells = (
        stats.select(part.alias("_prune"), "_bad", *bins)
        .groupBy(*FEATURES)
        .agg(*(F.sum(((F.col("_prune") == lit) & (F.col("_bad") == bad)).cast("long")).alias(f"w{i}") for i, (lit, bad) in enumerate(((False, 1), (False, 0), (True, 1), (True, 0)))))
        .collect()
    )
    cells.sort()
    grid = np.array([[r[k] for k in FEATURES] for r in cells], int).reshape(-1, len(FEATURES))
    # a cell with bin b lies above cut k if b > k
    weights = np.array([[r[f"w{i}"] for i in range(4)] for r in cells], float).reshape(-1, 4)
    # a threshold stands in the middle of the gap between the values on its two sides
    middle = [[(gaps[f"{k}{i}a"] + gaps[f"{k}{i}b"]) / 2 if gaps[f"{k}{i}b"] is not None else c for i, c in enumerate(cs)] for k, cs in zip(FEATURES, cuts, strict=True)]
    return cover(grid, weights, middle, min_precision=min_precision, min_rows=min_rows, max_rules=max_rules, max_conditions=max_conditions)


def quality_report(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (number of the rejecting rule or null) and kept, a row for each input row."""
    s = with_statistics(docs.select("doc_id", "text"), "_s")
    return s.select(
        "doc_id",
        *(F.col(f"_s.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed("_s").alias("base_failed"),
        decision(rules, "_s").alias("rule"),
        (~base_failed("_s") & decision(rules, "_s").isNull()).alias("kept"),
    )


def keep_by_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that the base and the list keep, with their columns as they are."""
    mark = free_name(docs, "_quality_statistics")
    kept = with_statistics(docs, mark)
    return kept.filter(~base_failed(mark) & decision(rules, mark).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_report(docs, learn(docs, table(spark, sf_dir, "labels")))
