import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from morsefield.llm import packing


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "a", "\n\n  x\t\ty", "it's we'll 'S", "x\x1cy\x1d z", "½ ² ³ ¹ x²", "日本 语 text", "é́ ÀÉ", "<|endoftext|> a", "____ _a_ 1_2", "🎉🎉 ok", " a b", "١٢٣ 123", "a" * 5000, "ªº µ", "ǅ ʰ"]


@pytest.fixture(scope="module")
def encode():
    return packing.Encoder(packing.tokenizer_path())


def test_ids_equal_the_tokenizers_library(encode, spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text, ids in zip(texts, reference_ids(texts), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == ids, text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_of_any_text(encode, text):
    assert np.frombuffer(encode(text), "<u4").tolist() == reference_ids([text])[0]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_plan_is_gapless_and_no_worse_than_best_fit_by_document(histogram):
    runs = packing.plan(histogram, 64)
    seqs, seen = defaultdict(list), defaultdict(int)
    for length, rank, n, first, offset in sorted(runs):
        assert rank == seen[length]
        seen[length] += n
        for k in range(n):
            seqs[first + k].append((offset, length))
    assert dict(seen) == histogram
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    free = []  # plain best-fit decreasing
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = [f for f in free if f >= length]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - length)
            else:
                free.append(64 - length)
    assert len(seqs) <= len(free) + max(1, len(free) // 20)


def check(rows, docs, room):
    seqs, by = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= room
    ids = dict(zip(docs, reference_ids([t or "" for t in docs.values()]), strict=True))
    for d, own in by.items():
        full = ids[d] + [0]
        for r in sorted(own, key=lambda r: r.piece):
            assert r.ids_crc32 == zlib.crc32(np.array(full[r.start : r.start + r.length], "<u4").tobytes())
        assert sorted((r.start, r.length) for r in own) == packing.cut_pieces(len(full), room)
        assert len(own) == -(-len(full) // room)
    assert set(by) == set(docs)
    return len(seqs), sum(r.length for r in rows)


def test_query_on_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    n, total = check(packing.op3_best_fit_packing(spark, "/root/testdata/sf0.001").collect(), docs, 2048)
    assert n <= 1.03 * -(-total // 2048) + 1


def test_edges(spark):
    schema = "doc_id long, text string, length int, bucket string, before int, piece string"
    rows = [(1, None), (2, ""), (3, "word " * 3000), (4, "a b"), (5, "a b"), (6, "tie tie")]
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], schema)
    check(packing.pack(df).collect(), dict(rows), 2048)
    twice = packing.pack(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(packing.pack(df).collect())
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert packing.pack(df.limit(0)).collect() == []
    assert len(packing.pack(spark.createDataFrame([(None, "x")], "doc_id long, text string")).collect()) == 1


def test_ids_are_carried(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    r = packing.pack(df, ids=True).first()
    assert zlib.crc32(bytes(r.ids)) == r.ids_crc32


def default_ids(texts):
    """Ids by the library as it is, added tokens included."""
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(packing.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


MARK = "<|endoftext|>"
PARTS = st.sampled_from([MARK, MARK[:-1], "|>", " ", "\n", "  ", "Next doc", "end here", "it's", "é", "日", "<", "12"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=12))
def test_added_tokens_as_in_the_library(parts):
    text = "".join(parts)
    assert np.frombuffer(packing.encoder(packing.tokenizer_path())(text), "<u4").tolist() == default_ids([text])[0]


def test_query_rows_of_texts_with_added_tokens(spark):
    rows = [(1, f"end here{MARK}Next doc"), (2, MARK), (3, f"word {MARK} " * 1500), *((10 + k, t) for k, t in enumerate(ODD))]
    ids = dict(zip([d for d, _ in rows], default_ids([t for _, t in rows]), strict=True))
    assert ids[1] == [437, 994, 50256, 10019, 2205]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in out:
        full = ids[r.doc_id] + [0]
        assert (r.start, r.length) in packing.cut_pieces(len(full))
        assert r.ids_crc32 == zlib.crc32(np.array(full[r.start : r.start + r.length], "<u4").tobytes())
    assert len(out) == sum(len(packing.cut_pieces(len(x) + 1)) for x in ids.values())


def test_long_texts_are_encoded_in_parts(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    reference = Tokenizer.from_file(path)
    rng = random.Random(12)
    parts = ["a", " b", "  c", " it's", "'re", "\n", " \n", "\t", " 12", "3", " ,", ".", "\x1c", "\x1c x", "\x85", "\xa0y", " \xa0", "é", " ＡＢ", "☃ ☃", "<|endoftext|>", " ", "z" * 60]
    monkeypatch.setattr(packing, "PART", 20)
    encode = packing.MarkedEncoder(path)
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(150)))
        assert np.frombuffer(encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, text
