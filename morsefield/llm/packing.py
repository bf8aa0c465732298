"""Best-fit packing planned over a length histogram.

Documents are tokenized and cut into pieces of at most ``room`` tokens. What is planned is not documents but the
histogram of piece lengths, at most ``room`` numbers however large the corpus: best-fit decreasing places all pieces
of one length at a time into ranges of sequences with equal free room. The plan is a list of runs (length, ranks,
sequences, offset); its size depends on ``room`` and not on the number of documents. Pieces are ranked within their
length by counts per hash bucket, so that no length, not even one that holds a third of all pieces, meets in one task,
and take the slot of their rank in the plan.

Token ids equal those of the tokenizer file: the byte-level pre-tokens of a text are looked up in a bounded cache and
missing ones are encoded by byte-pair ranks read from the same file; the tests hold the ids against the tokenizers library.
The file's added tokens (``<|endoftext|>``) are single ids wherever they stand in a text, as in that library by default.

Defined results. Null text counts as empty: one piece that holds the end id alone. Rows are pieces of their own even
where ids or texts repeat; a null doc_id is allowed. Only documents of more than ``room`` tokens are cut, and only
their first piece may be short. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, cut, lean, table

ROOM = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters whose classes are the same in every library: others are left to the tokenizer's own splitting.
_PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Pre-tokens that an encoder remembers, and characters of a long text that it encodes at a time.
CACHE = 120_000
PART = 1 << 15


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """text -> ids as little-endian unsigned 32-bit bytes. Added tokens are ordinary text here; see MarkedEncoder."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if all(c in of for c in token)}
        special = {t: i for t, i in vocab.items() if t.startswith("<|") and t.endswith("|>")}
        for t in special:
            ranks.pop(t.encode(), None)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
        self.piece = self.bpe._core_bpe.encode_single_piece  # of one pre-token, without splitting it again
        self.cache: dict[str, bytes] = {}

    def _slow(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if len(text) <= 2 * PART:
            return self._part(text)
        # a space between two other characters begins a pre-token whatever stands around it, so parts are encoded one by one
        cuts, at = [0], PART
        while m := _GAP.search(text, at):
            cuts.append(m.start())
            at = m.start() + PART
        cuts.append(len(text))
        return b"".join(self._part(text[f:t]) for f, t in zip(cuts, cuts[1:], strict=False))

    def _part(self, text: str) -> bytes:
        if not text:
            return b""
        if not _PLAIN.fullmatch(text):
            return self._slow(text)
        parts = _SPLIT.findall(text)
        cache = self.cache
        found = list(map(cache.get, parts))
        if None in found:
            if len(cache) > CACHE:  # the first half stays: frequent pre-tokens come early
                cache = self.cache = dict(itertools.islice(cache.items(), CACHE // 2))
            for k, x in enumerate(found):
                if x is None:
                    p = parts[k]
                    if (x := cache.get(p)) is None:
                        x = array("I", self.piece(p.encode())).tobytes()
                        if len(p) <= 40:
                            cache[p] = x
                    found[k] = x
        return b"".join(found)


class MarkedEncoder:
    """As Encoder, but texts are split at the file's added tokens first, which are one id each."""

    def __init__(self, path: str):
        self.plain = Encoder(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in or look at what stands beside them are not supported")
        self.ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        # of tokens that begin at the same place the longest one counts
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) + ")") if added else None

    def __call__(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        parts = self.marks.split(text)
        return b"".join(self.ids[p] if k % 2 else self.plain(p) for k, p in enumerate(parts))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> MarkedEncoder:
    """One for all tasks of a Python worker: it takes a second to build."""
    return MarkedEncoder(path)


def cut_pieces(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % room or room
    return [(0, first), *((s, room) for s in range(first, n, room))]


def pieces(docs: DataFrame, *, path: str, room: int = ROOM, end: int = END, ids: bool = False) -> DataFrame:
    """A row for each piece; with ids also the token ids themselves as bytes."""
    tail = np.array([end], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(t.as_py() or "") + tail
                for k, (s, n) in enumerate(cut_pieces(len(data) // 4, room)):
                    own = data[4 * s : 4 * (s + n)]
                    out.append((d, k, s, n, zlib.crc32(own), own if ids else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + ids], names=names[: 5 + ids])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(work), PIECES + ", ids binary" * ids)


def plan(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts. Runs (length, first rank, number, first sequence, offset), ranks from 0.

    Sequences of equal free room are interchangeable, so they are kept as ranges of numbers by that room; all pieces
    of a length go to the ranges of least sufficient room, one piece to each sequence at a time, and then to new ones.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, number)]
    rooms: list[int] = []  # sorted rooms that have ranges
    runs, new = [], 0

    def put(r: int, first: int, n: int) -> None:
        if r > 0 and n > 0:
            if not free[r]:
                bisect.insort(rooms, r)
            free[r].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                r = rooms[k]
                first, n = free[r].pop()
                if not free[r]:
                    rooms.pop(k)
                use = min(n, left)
                put(r, first + use, n - use)
            else:
                per = room // length  # of one length, as many as fit go into each new sequence
                full, rest = divmod(left, per)
                if full:
                    for j in range(per):
                        runs.append((length, rank, full, new, j * length))
                        rank += full
                    put(room - per * length, new, full)
                    new += full
                for j in range(rest):
                    runs.append((length, rank, 1, new, j * length))
                    rank += 1
                if rest:
                    put(room - rest * length, new, 1)
                    new += 1
                break
            runs.append((length, rank, use, first, room - r))
            put(r - length, first, use)
            rank += use
            left -= use
    return runs


def pack(docs: DataFrame, *, path: str | None = None, room: int = ROOM, end: int = END, ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    own = cut(pieces(docs, path=path or tokenizer_path(), room=room, end=end, ids=ids), "pieces")
    # a bucket holds rows of all lengths; ranks are (rows of the length in earlier buckets) + (rank in the own bucket)
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= room rows
    runs = plan(histogram, room)
    runs.sort()
    shared = spark.sparkContext.broadcast([np.array(c, np.int64) for c in zip(*runs, strict=True)] or [np.zeros(0, np.int64)] * 5)
    step = max(histogram.values(), default=0) + 1
    spread = counts.withColumn("before", F.sum("n").over(_before())).select("length", "bucket", F.col("before") - F.col("n"))
    spread = spread.toDF("_length", "_bucket", "before")
    names = own.columns
    # a task is dealt whole buckets; only rows of one bucket and length meet in one sort group
    dealt = keyed.join(spread, (F.col("length") == F.col("_length")) & (F.col("bucket") == F.col("_bucket"))).drop("_length", "_bucket")
    ranked = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "length", "doc_id", "piece", "ids_crc32")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, _, seqs, offsets = shared.value
        key = lengths * step + ranks
        last, at = (None, None), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            length, bucket, before = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "bucket", "before"))
            begins = np.flatnonzero(np.r_[True, (length[1:] != length[:-1]) | (bucket[1:] != bucket[:-1])])
            within = np.arange(n) - np.repeat(begins, np.diff(np.r_[begins, n]))
            if (length[0], bucket[0]) == last:
                within[: begins[1] if len(begins) > 1 else n] += at
            last, at = (length[-1], bucket[-1]), int(within[-1]) + 1
            rank = before + within
            run = np.searchsorted(key, length * step + rank, "right") - 1
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            arrays += [pa.array(seqs[run] + rank - ranks[run]), pa.array(offsets[run])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    return ranked.select(*names, "bucket", "before").mapInArrow(lean(place), schema + ", sequence_id long, offset long")


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
