"""What the corpus operators share: shared-folder scratch tables and text expressions.

``WS`` is the white space of the data contracts, ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import ctypes
import uuid
from typing import ClassVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"
WS_RE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows or 8 MB where the session has Spark's defaults (10,000 rows, 64 MB).

    Python workers hold a few batches at a time, and rows are whole texts of any length.
    """
    for key, default, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "8m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def lean(work):
    """work, a function on Arrow batches, after whose last batch the Python worker gives back memory that it holds unused.

    Workers are used again by later tasks, and an executor has several; what one of them once needed is not to add up.
    """

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
            trim(0)

    return run


def document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text as UTF-8 bytes, null as empty."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def text_key(doc_id: int | None, data: bytes) -> int:
    """One 64-bit number for a doc_id and its text."""
    return xxhash.xxh3_64_intdigest(data + b"|" + str(doc_id).encode())


def signed(v) -> pa.Array:
    """Unsigned 64-bit numbers as Spark's long."""
    return pa.array(np.asarray(v, np.uint64).view(np.int64))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one under /tmp in local mode (as in tests), else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir("file:///tmp/morsefield-checkpoints")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Tables that an operator writes on its way. ``with Scratch(spark) as own`` removes at its end those not kept.

    own.keep(df) names a table of ``cut`` that the result still reads. Where the block fails, its tables stay for a look.
    """

    written: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> Scratch:
        self.since = len(Scratch.written)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(getattr(df, "scratch_path", None))
        return df

    def __exit__(self, kind, *_) -> None:
        mine, Scratch.written[self.since :] = Scratch.written[self.since :], []
        if kind is not None:
            return
        for path in mine:
            if path in self.kept:
                Scratch.written.append(path)  # for the block around this one
            else:
                there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    Scratch.written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


#: Rows up to which a written table of a few numbers or short strings a row is broadcast: some tens of MB at most.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df (a written table, so that counting is cheap), to be broadcast if it has few rows; else joined by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


def lower_az(text: Column) -> Column:
    """A-Z only. For pure ASCII the built-in lower() does the same at a fraction of the cost."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; empty for null or blank text."""
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(text.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RE))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, though a lambda inside body refers to it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)
