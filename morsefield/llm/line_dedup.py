"""Line dedup by a sharded minimal perfect hash.

Keys (lines stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lower-cased) are reduced to 128-bit hashes and counted once
per document; the count is an ordinary aggregation with map-side combine, so no line is hot. The distinct hashes that
reach ``least`` documents are split into shards by their leading bits; each shard becomes a minimal perfect hash (a
cascade of bit arrays, about 3 bits a key) that indexes two compact arrays: 64-bit fingerprints and 32-bit counts.
Shards are written to the shared folder. Documents are not joined with lines: each task probes the shards for its
lines, one shard in memory at a time. A hash that was never inserted lands in some slot, whose fingerprint refuses it.

A shard holds about ``shard_keys`` keys (2.5 MB at the default), so what a task holds is bounded however many lines
there are; the number of shards grows with the lines. Shards are written under a temporary name and renamed, so a
retried or speculative task leaves the same bytes.

Defined results. Null text counts as one empty line, and stays null where texts are handed on. Blank lines have an
empty key and always stay. Rows are documents: those that repeat a doc_id, or have none, count one by one, here and in the SQL. A document loses
every line whose key is found in at least ``least`` documents; if it loses all of them its text is empty. An empty
table gives no rows. Other columns are ignored, or handed on unchanged by ``drop_common_lines``.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, WS, bounded_batches, cut, lean, shared_dir, table

LEAST = 10
SHARD_KEYS = 200_000
#: Bits of a level of the cascade per key that is left.
GAMMA = 2.0
_AZ = bytes.maketrans(UPPER.encode(), LOWER.encode())
_STRIP = WS.encode()


def line_hash(line: bytes) -> bytes | None:
    """16 bytes, or None for a blank line."""
    key = line.strip(_STRIP)
    return xxhash.xxh3_128_digest(key.translate(_AZ)) if key else None


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: keys alone at their place in a level's bit array stay there."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # boolean arrays
        self.ranks, at = [], 0
        for bits in levels:
            c = np.cumsum(bits) - bits + at
            self.ranks.append(c.astype(np.int64))
            at += int(bits.sum())
        self.n = at

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = int(len(left) * GAMMA) + 1
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, any place (or -1) for keys that were never inserted."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_mix(keys[todo], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.ranks[k][at[hit]]
            todo = todo[~hit]
        return out


def _slot_key(key: np.ndarray, print_: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of the 128 by which a line is placed; another seed parts those that agree."""
    return _mix(key ^ _mix(print_, seed), seed + 1) if seed else key


def pack_shard(key: np.ndarray, print_: np.ndarray, count: np.ndarray) -> bytes:
    """The shard of distinct 128-bit hashes (key, print). Hashes that agree in ``key`` are placed by all their bits."""
    seed = 0
    while len(np.unique(slot := _slot_key(key, print_, seed))) < len(key):
        seed += 1
        if seed > 64:
            raise ValueError("hashes are not distinct")
    mph = PerfectHash.build(slot)
    at = mph.index(slot)
    prints, counts = np.empty((len(key), 2) if seed else len(key), np.uint64), np.empty(len(key), np.uint32)
    prints[at], counts[at] = np.stack([key, print_], axis=1) if seed else print_, np.minimum(count, 2**32 - 1)
    out = io.BytesIO()
    np.savez(out, seed=seed, prints=prints, counts=counts, sizes=np.array([len(b) for b in mph.levels], np.int64), bits=np.packbits(np.concatenate([*mph.levels, np.zeros(0, bool)])))
    return out.getvalue()


class Shard:
    def __init__(self, data: bytes):
        z = np.load(io.BytesIO(data))
        sizes = z["sizes"]
        bits = np.unpackbits(z["bits"], count=int(sizes.sum())).astype(bool)
        self.mph = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        self.seed, self.prints, self.counts = int(z["seed"]), z["prints"], z["counts"]

    def count(self, key: np.ndarray, print_: np.ndarray) -> np.ndarray:
        """Documents of each hash; 0 for those that the index doesn't hold."""
        at = self.mph.index(_slot_key(key, print_, self.seed))
        ok = at >= 0
        found = self.prints[at[ok]]
        ok[ok] = (found == np.stack([key[ok], print_[ok]], axis=1)).all(axis=1) if self.seed else found == print_[ok]
        out = np.zeros(len(key), np.int64)
        out[ok] = self.counts[at[ok]]
        return out


def _open(base: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(base)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)
    return a[:, 0].astype(np.uint64), a[:, 1].astype(np.uint64)


def build_index(docs: DataFrame, *, least: int = LEAST, shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """Count, shard and write the index. Returns its folder and the number of shards (0 where no line is common)."""
    spark = docs.sparkSession

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for t in batch.column(0):
                text = t.as_py()
                if text:
                    own = {line_hash(x) for x in text.split(b"\n")}
                    own.discard(None)
                    found += own
            k, p = _halves(found)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(p.view(np.int64))], names=["key", "print"])

    bounded_batches(docs.sparkSession)
    lines = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(lean(hashes), "key long, print long")
    common = lines.groupBy("key", "print").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= least)
    common = cut(common, "lines")
    n = common.count()
    if not n:
        return "", 0
    shards = 1 << max(0, (n // shard_keys).bit_length())
    base = f"{shared_dir(spark)}/line-index-{uuid.uuid4().hex}"

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, root = _open(base)
        fs.create_dir(root, recursive=True)
        pdf = pdf.sort_values(["key", "print"])
        data = pack_shard(pdf["key"].to_numpy().view(np.uint64), pdf["print"].to_numpy().view(np.uint64), pdf["docs"].to_numpy())
        name = f"{root}/{int(pdf['shard'].iloc[0])}"
        own = f"{name}.{hashlib.sha1(uuid.uuid4().bytes).hexdigest()}"
        with fs.open_output_stream(own) as f:
            f.write(data)
        fs.move(own, name)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "keys": [len(pdf)], "bytes": [len(data)]})

    shard = F.shiftrightunsigned("key", 64 - (shards.bit_length() - 1)) if shards > 1 else F.lit(0).cast("long")
    written = common.withColumn("shard", shard).groupBy("shard").applyInPandas(write, "shard long, keys long, bytes long")
    done = written.agg(F.collect_list("shard")).first()[0]
    fs, root = _open(base)
    with fs.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps({"shards": shards, "present": sorted(done), "least": least}).encode())
    return base, shards


def probe(base: str, shards: int, least: int, lines: list[list[bytes]]) -> list[np.ndarray]:
    """For each document which of its lines are common; shards are loaded one at a time."""
    lengths = [len(x) for x in lines]
    hashes = [line_hash(x) for own in lines for x in own]
    gone = np.zeros(len(hashes), bool)
    full = np.array([i for i, h in enumerate(hashes) if h is not None], np.int64)
    if shards and len(full):
        fs, root = _open(base)
        with fs.open_input_stream(f"{root}/index.json") as f:
            present = json.loads(f.read())["present"]
        key, print_ = _halves([hashes[i] for i in full])
        of = (key >> np.uint64(64 - (shards.bit_length() - 1))).astype(np.int64) if shards > 1 else np.zeros(len(key), np.int64)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], present, "left")
        ends = np.searchsorted(of[order], present, "right")
        for s, a, b in zip(present, starts, ends, strict=True):
            if a < b:
                with fs.open_input_stream(f"{root}/{s}") as f:
                    own = order[a:b]
                    gone[full[own]] = Shard(f.read()).count(key[own], print_[own]) >= least
    return np.split(gone, np.cumsum(lengths)[:-1]) if lengths else []


#: Bytes of text that a task gathers before it goes over the shards once.
GATHER = 4 << 20


def _gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= GATHER:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def line_report(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, a row for each input row."""
    base, shards = build_index(docs, least=least)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, "text"):
            lines = [(x.as_py() or b"").split(b"\n") for x in t["text"]]
            gone = probe(base, shards, least, lines)
            kept = [hashlib.sha256(b"\n".join(x for x, g in zip(own, gs.tolist(), strict=True) if not g)).hexdigest() for own, gs in zip(lines, gone, strict=True)]
            yield from pa.table({"doc_id": t["doc_id"], "n_lines": pa.array([len(x) for x in lines], pa.int64()), "n_dropped": pa.array([int(g.sum()) for g in gone], pa.int64()), "kept_sha256": pa.array(kept, pa.string())}).to_batches()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(judge), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_common_lines(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """docs with the common lines taken out of text; n_chars, where there is such a column, is counted anew."""
    base, shards = build_index(docs, least=least)
    names, schema = docs.columns, docs.schema
    count = "n_chars" in names

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, "text"):
            texts = [x.as_py() for x in t["text"]]
            lines = [(x or "").encode().split(b"\n") for x in texts]
            gone = probe(base, shards, least, lines)
            kept = [None if x is None else b"\n".join(y for y, g in zip(own, gs.tolist(), strict=True) if not g).decode() for x, own, gs in zip(texts, lines, gone, strict=True)]
            t = t.set_column(names.index("text"), "text", pa.array(kept, t["text"].type))
            if count:
                old = t["n_chars"].to_pylist()
                t = t.set_column(names.index("n_chars"), "n_chars", pa.array([o if k is None or not g.any() else len(k) for o, k, g in zip(old, kept, gone, strict=True)], t["n_chars"].type))
            yield from t.to_batches()

    return docs.mapInArrow(lean(take), schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM d),
k AS (
  SELECT r, doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.r, k.doc_id, k.i, k.line, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
