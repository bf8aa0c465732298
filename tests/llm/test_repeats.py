"""op5 against brute force: the whole small table, passages by words, long texts and repeated rows."""

import hashlib
import random

import brute

from morsefield.llm import passages, repeats

SF = "/root/testdata/sf0.01"


def said(rows):
    return [(d, len((t or "").encode()), sum(b - a for a, b in runs), len(runs), hashlib.sha256(rest).hexdigest()) for (d, t), (runs, rest) in zip(rows, brute.op5([t for _, t in rows]), strict=True)]


def test_query_on_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = repeats.op5_suffix_array_dedup(spark, SF).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(said(rows))
    assert {r.doc_id: r.shares_passage for r in got} == {d: x for (d, _), x in zip(rows, brute.shares_passage([t for _, t in rows]), strict=True)}
    assert all((r.n_shared > 0) == r.shares_passage for r in got) and any(r.shares_passage and not r.n_removed for r in got)


def test_passages(spark):
    rng = random.Random(9)
    text = lambda n, k=10**6: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    passage, short = text(51), text(50)
    rows = [(1, text(300) + " " + passage + " " + text(20)), (2, passage.replace(" ", "\n")), (3, text(5) + " " + passage), (4, short + " " + text(9)), (5, text(9) + " " + short), (6, "a " * 200), (7, None), (8, "a " * 60)]
    rows += [(9, (q := text(70)) + " x " + q), (10, text(200, 3)), (11, text(200, 3)), (12, ""), (13, text(400)), (13, None)]
    rows += [(20 + k, text(k) + " " + rows[0][1][: 900 + 40 * k]) for k in range(12)]
    got = {(r.doc_id, r.n_bytes): r.shares_passage for r in repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string"), words=51).collect()}
    want = brute.shares_passage([t for _, t in rows])
    assert got == {(d, len((t or "").encode())): x for (d, t), x in zip(rows, want, strict=True)}
    twice = spark.createDataFrame([(1, passage), (1, passage), (2, text(80))], "doc_id long, text string")
    assert passages.shared_stretches(twice).collect() == []


def test_text_over_a_chunk_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1 << 12)
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long = text(20_000)
    rows = [(1, long), (2, text(900) + long[3500:5000] + text(900)), (3, long[4090:4500]), (4, "z" * 5000)] + [(5, text(60) + long[9000:9700])] * 40
    got = repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(said(rows))
