"""Passages of many words that stand in several documents, by words and not by bytes.

A window is ``words`` words in a row. Of the grams of ``GRAM`` words in a window the one of least hash is its anchor, so equal
windows have equal anchors; successive windows of one anchor are a stretch. A stretch whose windows are all found in another
document is seen by the stretch's hash alone. Of the other stretches only those whose anchor has several kinds of stretches
are compared window by window, one stretch of each kind: a second pass over the texts gives the window hashes of these alone,
so that none are kept of all the others.

Defined results. Words are ``[^\\x20\\x09-\\x0D]+`` of the text as it is; null text has none. Repeats within one
document are not counted, nor between rows of the same doc_id and text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, document_rows, lean, signed, small, text_key
from ._shingles import powers, range_hashes, word_hashes

WORDS = 51
GRAM = 8
#: Anchors (8 bytes each) up to which they are broadcast.
MANY_ANCHORS = 1_000_000


def _least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each w entries in a row."""
    at = np.arange(len(h), dtype=np.uint64)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at
    full = np.concatenate([key, np.full(-len(key) % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - w + 1
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _chained(h: np.ndarray) -> np.ndarray:
    p, _ = powers(len(h) + 1)
    out = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * p[: len(h)], out=out[1:])
    return out


def word_stretches(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, stretch hash, number of windows, window hashes of all stretches one after the other)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    hashes, n_words = word_hashes(texts, fold=False)
    if len(hashes) < words:
        return none
    chain, first = _chained(hashes), np.concatenate([[0], np.cumsum(n_words)])
    g = np.arange(len(hashes) - GRAM + 1)
    gram = range_hashes(chain, g, g + GRAM)
    anchor = _least_in_window(gram, words - GRAM + 1)
    owner = np.repeat(np.arange(len(texts)), n_words)
    w = np.arange(len(anchor))
    w = w[w + words <= first[owner[: len(anchor)] + 1]]  # windows within one text
    if not len(w):
        return none
    a = anchor[w]
    turn = np.flatnonzero((np.diff(a) != 0) | (np.diff(w) != 1)) + 1
    s, e = np.r_[0, turn], np.r_[turn, len(w)]
    at = a[s]
    with np.errstate(over="ignore"):
        whole = range_hashes(chain, w[s], w[e - 1] + words) + (at - w[s]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        window = range_hashes(chain, w, w + words) >> np.uint64(32)
    return owner[w[s]], gram[at], whole, e - s, window.astype("<u4")


def _all_stretches(docs: DataFrame, words: int, with_windows: bool) -> DataFrame:
    """(key, anchor, whole) of all stretches, and their window hashes of 4 bytes one after the other."""
    names = ["key", "anchor", "whole", "windows"][: 3 + with_windows]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, 64):
                batch = whole_batch.slice(k, 64)
                texts = batch.column(1).to_pylist()
                keys = np.array([text_key(d, t) for d, t in zip(batch.column(0).to_pylist(), texts, strict=True)], np.uint64)
                owner, anchor, whole, n, window = word_stretches(texts, words)
                if len(owner):
                    ends = np.concatenate([[0], np.cumsum(n) * 4]).astype(np.int32)
                    windows = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(window.tobytes())])
                    yield pa.RecordBatch.from_arrays([signed(keys[owner]), signed(anchor), signed(whole), windows][: len(names)], names=names)

    return document_rows(docs).mapInArrow(lean(work), "key long, anchor long, whole long" + ", windows binary" * with_windows)


def shared_stretches(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """(key, n_shared): for the documents that share a passage of ``words`` words with another, the stretches that hold one."""
    every = cut(_all_stretches(docs, words, False), "word-stretches")
    ends = every.groupBy("anchor", "whole").agg(F.min("key").alias("a"), F.max("key").alias("z"))
    kinds = cut(ends.select("anchor", "whole", (F.col("a") != F.col("z")).alias("twice")), "word-kinds")
    open_ = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("d"), F.min("twice").alias("all")).filter("d > 1 and not all").select("anchor")
    open_ = cut(open_, "word-anchors")
    # of each kind with such an anchor one stretch, with its windows
    some = _all_stretches(docs, words, True).join(small(open_, MANY_ANCHORS), "anchor", "left_semi")
    some = some.groupBy("anchor", "whole").agg(F.min(F.struct("key", "windows")).alias("o")).select("anchor", "whole", "o.key", "o.windows")
    some = cut(some, "word-windows")
    place = F.explode(F.sequence(F.lit(0), (F.octet_length("windows") / 4 - 1).cast("int")))
    windows = some.select("anchor", "whole", "key", "windows", place.alias("i")).select("anchor", "whole", "key", F.substring("windows", 4 * F.col("i") + 1, F.lit(4)).alias("w"))
    both = windows.groupBy("anchor", "w").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a <> z").select("anchor", "w")
    met = windows.select("anchor", "whole", "w").join(both, ["anchor", "w"], "left_semi").select("anchor", "whole")
    marked = cut(kinds.filter("twice").select("anchor", "whole").unionByName(met).distinct(), "word-marks")
    return every.join(marked, ["anchor", "whole"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n_shared"))
