"""Suffix-array dedup: every byte inside a repeated string of ``length`` bytes is found, wherever in the corpus it repeats.

Sharding. A window is a string of ``length`` bytes. Of the 50-byte grams in a window the one of least hash is its
anchor; that depends on the window's content alone, so equal windows have equal anchors at equal places. Successive
windows of a text mostly share their anchor: they make up one stretch, about 1 per 175 bytes of text. Equal windows
therefore lie in stretches of the same anchor gram, and stretches are what is counted and shuffled, as two 64-bit hashes.

1. A stretch found twice with the same bytes is repeated as a whole. Of equal stretches one stands for all.
2. Anchors with two or more different stretches need a closer look, on the bytes of one stretch of each kind. Within
   such an anchor the stretches are suffixes cut at the anchor: they are sorted by what follows it (a suffix array,
   sparse: one suffix a stretch), with the longest common prefixes of neighbours. A stack scan of these gives the
   tree of common-prefix intervals. In each interval the members are ordered by what precedes the anchor, read
   backwards; where that shows different left extensions, the interval is a maximal repeat, and the depth on the
   right plus the depth on the left is its length. All members of repeats of ``length`` bytes or more are marked.
3. An anchor with more than ``CROWD`` different stretches (say the edge of a passage that a third of all texts share)
   is not gathered in one task. There windows are compared by hash: first in aligned blocks of 16 windows,
   counted by an ordinary aggregation, then, for the blocks that are only partly repeated, one by one. That
   gives the same marks, so the crowd size decides about speed only.

The marks of a kind are one range, as all its windows hold the anchor. Ranges are joined back to all stretches of the
kind, one row each at most, and each text gets the union of its ranges.

Defined results. Null text counts as empty; texts shorter than ``length`` have nothing removed, and lengths are in
UTF-8 bytes. Overlapping occurrences and those in the same text count. Rows are occurrences of their own even if they
repeat a doc_id and a text: then both lose everything of ``length`` bytes or more. A null doc_id is allowed. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, cut, document_rows, lean, signed, table, text_key
from ._shingles import mix, prefix_hashes, range_hashes
from .passages import WORDS, shared_stretches

LENGTH = 400
GRAM = 50
CROWD = 500
BLOCK = 16
#: Windows that are looked at at a time.
CHUNK = 1 << 17


# --- in memory: enhanced suffix array -------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of at least this depth, inner ones first, by a scan with a stack.

    lcp[k] belongs to the suffixes k and k + 1.
    """
    stack: list[tuple[int, int]] = []  # (depth, first)
    for k, depth in enumerate([*lcp, 0]):
        first = k
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if d >= least:
                yield d, first, k
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def maximal_repeats(members: list[tuple[bytes, int]], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from the anchor on, members) of the repeats through the anchors.

    members: (bytes, place of the anchor). Each repeat is at least ``length`` bytes long and cannot be extended to
    the right (its members are a common-prefix interval of the suffixes) nor to the left (they are an interval of the
    reversed prefixes too, so their left extensions differ); all its occurrences are given.
    """
    n = len(members)
    after = [b[a:] for b, a in members]
    before = [b[:a][::-1] for b, a in members]
    suffix = sorted(range(n), key=after.__getitem__)
    lcp = [common_prefix(after[x], after[y]) for x, y in zip(suffix, suffix[1:], strict=False)]
    prefix = sorted(range(n), key=before.__getitem__)
    rank = [0] * n
    for k, i in enumerate(prefix):
        rank[i] = k
    back = [common_prefix(before[x], before[y]) for x, y in zip(prefix, prefix[1:], strict=False)]
    deepest = max(map(len, before), default=0)
    for right, first, last in intervals(lcp, max(1, length - deepest)):
        own = sorted(rank[i] for i in suffix[first : last + 1])
        left = [min(back[x:y]) for x, y in zip(own, own[1:], strict=False)]
        need = length - right
        if need <= 0:
            yield 0 if not left else min(left), right, [prefix[r] for r in own]
            need = 1
        for depth, a, b in intervals(left, need):
            yield depth, right, [prefix[r] for r in own[a : b + 1]]


def marks(members: list[tuple[bytes, int]], length: int) -> list[tuple[int, int] | None]:
    """For each member the range of its bytes that lies in repeats."""
    if len(members) == 2:
        (x, a), (y, b) = members
        right, left = common_prefix(x[a:], y[b:]), common_prefix(x[:a][::-1], y[:b][::-1])
        return [(a - left, a + right), (b - left, b + right)] if left + right >= length else [None, None]
    out: list[tuple[int, int] | None] = [None] * len(members)
    for left, right, own in maximal_repeats(members, length):
        for i in own:
            a = members[i][1]
            f, t = out[i] or (a, a)
            out[i] = min(f, a - left), max(t, a + right)
    return out


# --- texts into stretches -------------------------------------------------------------------------------------------


def stretches(data: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, stretch hash, first byte, number of bytes, bytes before the anchor), in chunks of windows."""
    for at in range(0, len(data) - length + 1, CHUNK):
        x = np.frombuffer(data, np.uint8)[at : at + CHUNK + length - 1]
        p = prefix_hashes(x)
        g = np.arange(len(x) - GRAM + 1)
        h = range_hashes(p, g, g + GRAM)
        w = length - GRAM + 1
        key = (h & np.uint64(0xFFFFFFFF00000000)) | g.astype(np.uint64)
        full = np.concatenate([key, np.full(-len(key) % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(full, axis=1).ravel()
        behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(x) - length + 1
        anchor = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turn = np.flatnonzero(np.diff(anchor))
        s, e = np.r_[0, turn + 1], np.r_[turn, n - 1]
        a = anchor[s]
        with np.errstate(over="ignore"):
            whole = mix(range_hashes(p, s, e + length) + (a - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield h[a], whole, s + at, e - s + length, a - s


def _all_stretches(docs: DataFrame, length: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, keys = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = t.as_py()
                if len(data) >= length:
                    k = text_key(d, data)
                    for own in stretches(data, length):
                        parts.append(own)
                        keys.append(np.full(len(own[0]), k, np.uint64))
            if parts:
                anchor, whole, first, n, before = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), signed(anchor), signed(whole), pa.array(first), pa.array(n.astype(np.int32)), pa.array(before.astype(np.int32))], names=["key", "anchor", "whole", "first", "size", "before"])

    return document_rows(docs).mapInArrow(lean(work), "key long, anchor long, whole long, first long, size int, before int")


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, whole, before, crowded, bytes) of the stretches in wanted (key, anchor, whole, first, size, before, crowded)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([signed([text_key(d, x) for d, x in zip(b.column(0).to_pylist(), t, strict=True)]), b.column(1)], names=["key", "text"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, own in zip(b.column(0), b.column(1), strict=True):
                data = t.as_py()
                rows += [(s["anchor"], s["whole"], s["before"], s["crowded"], data[s["first"] : s["first"] + s["size"]]) for s in own.as_py()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["anchor", "whole", "before", "crowded", "bytes"])

    texts = document_rows(docs).mapInArrow(lean(keyed), "key long, text binary")
    own = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "whole", "first", "size", "before", "crowded")).alias("own"))
    found = texts.join(own, "key").select("text", "own").mapInArrow(lean(take), "anchor long, whole long, before int, crowded boolean, bytes binary")
    return found


def _by_suffix_array(kinds: DataFrame, length: int) -> DataFrame:
    """Marks (anchor, whole, from, to) of anchors that are not crowded."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = {}, None, []

        def close() -> None:
            if len(held) > 1:
                for whole, m in zip(held, marks(list(held.values()), length), strict=True):
                    if m:
                        out.append((at, whole, *m))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "whole", "from", "to"])

        for b in batches:
            for anchor, whole, before, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if anchor != at:
                    close()
                    held, at = {}, anchor
                held[whole] = (data.as_py(), before)
            yield flush()
        close()
        yield flush()

    own = kinds.filter("not crowded").select("anchor", "whole", "before", "bytes")
    parts = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(lean(work), "anchor long, whole long, from int, to int")


def _by_blocks(kinds: DataFrame, blocks: DataFrame | None, step: int, length: int) -> DataFrame:
    """Blocks of ``step`` windows: (anchor, whole, from, to, core, part, partial).

    Places are counted from the anchor back, so that blocks of different stretches are aligned. core: hash of what
    all windows of the aligned block have in common; part: hash of the bytes of those windows that the stretch has.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            some = b.num_columns > 4
            for k, (anchor, whole, before) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                data = b.column(3)[k].as_py()
                least = before - (len(data) - length)  # windows begin 'least' to 'before' bytes before the anchor
                salt = anchor.to_bytes(8, "little", signed=True)
                wanted = b.column(4)[k].as_py() if some else [(0, before + 1)]
                for lo, hi in ([(x["lo"], x["hi"]) for x in wanted] if some else wanted):
                    for o in range(max(lo, least) // step * step, min(hi, before + 1), step):
                        f, t = max(o, least), min(o + step - 1, before)
                        if f > t:
                            continue
                        core = data[before - o if before >= o else 0 : before + length - o - step + 1] if step > 1 else b""
                        part = data[before - t : before - f + length]
                        tag = salt + o.to_bytes(4, "little")
                        rows.append((anchor, whole, before - t, before - f + length, o, xxhash.xxh3_64_intdigest(tag + core), xxhash.xxh3_64_intdigest(tag + f.to_bytes(4, "little", signed=True) + part)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            arrays = [pa.array(c, t) for c, t in zip(cols[:5], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, signed(np.array(cols[5], np.uint64)), signed(np.array(cols[6], np.uint64))], names=["anchor", "whole", "from", "to", "o", "core", "part"])

    own = kinds.filter("crowded").select("anchor", "whole", "before", "bytes")
    if blocks is not None:
        own = own.join(blocks, ["anchor", "whole"])
    return own.mapInArrow(lean(work), "anchor long, whole long, from int, to int, o int, core long, part long")


def _crowds(kinds: DataFrame, length: int) -> DataFrame:
    """Marks of crowded anchors: blocks found twice as they are, then single windows of blocks that are found in part."""
    rows = cut(_by_blocks(kinds, None, BLOCK, length), "blocks")
    parts = rows.groupBy("anchor", "core", "part").agg(F.count(F.lit(1)).alias("n"))
    cores = parts.groupBy("anchor", "core").agg(F.count(F.lit(1)).alias("kinds"))
    known = rows.join(parts, ["anchor", "core", "part"]).join(cores, ["anchor", "core"])
    whole = known.filter("n > 1").select("anchor", "whole", "from", "to")
    partly = known.filter("kinds > 1").groupBy("anchor", "whole").agg(F.collect_list(F.struct(F.col("o").alias("lo"), (F.col("o") + BLOCK).alias("hi"))).alias("blocks"))
    single = cut(_by_blocks(kinds, partly, 1, length), "windows")
    twice = single.groupBy("anchor", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return whole.unionByName(single.join(twice, ["anchor", "part"], "left_semi").select("anchor", "whole", "from", "to"))


def repeated_spans(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """(key, spans): for texts that have any, ranges of bytes that lie in repeated strings; they may overlap."""
    every = cut(_all_stretches(docs, length), "stretches")
    one = F.min(F.struct("key", "first", "size", "before")).alias("one")
    kinds = every.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), one).select("anchor", "whole", "n", "one.*")
    kinds = cut(kinds, "kinds")
    of = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("least"))
    # where every kind is found twice, all windows are marked anyway
    of = of.filter("d > 1 and least = 1").select("anchor", (F.col("d") > CROWD).alias("crowded"))
    wanted = kinds.join(of, "anchor").drop("n")
    seen = cut(_bytes_of(docs, wanted).dropDuplicates(["anchor", "whole"]), "seen")
    found = kinds.filter("n > 1").select("anchor", "whole", F.lit(0).alias("from"), F.col("size").alias("to"))
    found = found.unionByName(_by_suffix_array(seen, length)).unionByName(_crowds(seen, length))
    # all windows of a stretch hold its anchor, so the union of its marks is one range
    found = cut(found.groupBy("anchor", "whole").agg(F.min("from").alias("from"), F.max("to").alias("to")), "marks")
    placed = every.select("key", "anchor", "whole", "first").join(found, ["anchor", "whole"])
    spans = F.struct((F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to")).alias("to"))
    return placed.groupBy("key").agg(F.array_sort(F.collect_set(spans)).alias("spans"))  # equal rows of a table have one key


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for f, t in spans:
        if out and f <= out[-1][1]:
            out[-1][1] = max(out[-1][1], t)
        else:
            out.append([f, t])
    return [(f, t) for f, t in out]


def repeat_report(docs: DataFrame, *, length: int = LENGTH, kept: bool = False, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row for each input row; with kept also the bytes that stay.

    With words also n_shared (stretches with a passage of so many words that another document has) and shares_passage.
    """
    spark = docs.sparkSession
    with Scratch(spark) as own:
        spans = own.keep(cut(repeated_spans(docs, length=length), "spans"))
    if words:
        with Scratch(spark) as own:
            shared = own.keep(cut(shared_stretches(docs, words=words), "shared"))
        spans = spans.join(shared, "key", "full")
    else:
        spans = spans.withColumn("n_shared", F.lit(None).cast("long"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), signed([text_key(d, x) for d, x in zip(b.column(0).to_pylist(), t, strict=True)]), b.column(1)], names=["doc_id", "key", "text"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, own in zip(b.column(1), b.column(2), strict=True):
                data = t.as_py()
                gone = _union([(s["from"], s["to"]) for s in own.as_py() or []])
                ends = [0, *(x for s in gone for x in s), len(data)]
                rest = b"".join(data[f:t] for f, t in zip(ends[::2], ends[1::2], strict=True))
                rows.append((len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest if kept else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            out = dict(zip(["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], (pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)), strict=True))
            if not kept:
                out.pop("kept")
            if words:
                n = b.column(3).fill_null(0)
                out |= {"n_shared": n, "shares_passage": pc.greater(n, 0)}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), **out})

    texts = document_rows(docs).mapInArrow(lean(keyed), "doc_id long, key long, text binary")
    both = texts.join(spans, "key", "left").select("doc_id", "text", "spans", "n_shared")
    return both.mapInArrow(lean(work), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept + ", n_shared long, shares_passage boolean" * bool(words))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"), words=WORDS)
