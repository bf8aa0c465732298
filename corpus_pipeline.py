"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes what a stage returns
as Parquet in the shared folder and reads it back as the next one's documents, so no stage is computed twice and a lost
executor costs the running stage only.

Defined results. Stages give the results that their operators' docstrings define. Rows that repeat a doc_id are judged one by
one by the quality rules and the line dedup; the near-duplicate stage takes them as one document and keeps or drops them all. A
null text fails the base of the quality rules, so it goes in the first stage; a row without a doc_id is linked with
nothing and is packed without one. Very long texts are read whole. Ties (equal sizes, hashes, lengths) are settled by the
operators by doc_id or place. Further columns are carried through the first four stages, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from morsefield.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from morsefield.llm._common import Scratch, cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base nor the learned decision list rejects."""
    return quality_rules.keep_by_quality(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them share."""
    return line_dedup.drop_common_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component of similarity 0.8, the one of smallest doc_id."""
    return near_dedup.drop_near_copies(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Learned rules, hashed shingles and token ids are not for SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as all_stages:
        for name, stage in STAGES:
            with Scratch(spark) as own:  # what the stage wrote on its way
                docs = own.keep(cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}"))
        all_stages.keep(docs)
    return docs
