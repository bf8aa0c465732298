import hashlib
import math
import random

import brute
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morsefield.llm import privacy


def expected(text):
    base = brute.op9_base(text)
    n = tuple(sum(k == kind for k, _, _ in base) for kind in brute.KINDS)
    said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
    return (*n, hashlib.sha256(said.encode()).hexdigest()), said


def got(rows):
    return [((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256), r.spans) for r in rows]


def test_base_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = privacy.op9_personal_data(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r, (base, spans) in zip(rows, got(rows), strict=True):
        want, said = expected(docs[r.doc_id])
        assert base == want, r.doc_id
        extra = spans.removeprefix(said).strip(",").split(",")
        assert spans.startswith(said) and all(x == "" or x.startswith(("term:", "removed:")) for x in extra)
    assert sum(sum(base[:4]) for base, _ in got(rows)) > 20


PART = st.sampled_from(["a", "b.c", "@", "x@y.z", "+1", " ", "-", "(", ")", ".", "1", "22", "255", "256", "4111 1111 1111 1111", "1.2.3.4", "%", "\n", "é", "0", "+49 30 1234-5678", "_", "😀"])


def test_base_on_odd_texts(spark):
    texts = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(PART, max_size=25))
    def gather(parts):
        texts.append("".join(parts))

    gather()
    texts += ["1 " * 20_000, "a" * 60_000, "a@" * 5_000, "9" * 30_000, "1." * 9_000, "a@b" + ".c" * 9_000, "+1" + "(" * 30_000, "x@y.z+w@q.r"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(privacy.privacy_report(df).collect())
    for r, (base, _) in zip(rows, got(rows), strict=True):
        assert base == expected(texts[r.doc_id])[0], texts[r.doc_id][:200]


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"word{i} the number of Zanzibart is +1 (555) 123-4567 today thing{i}") for i in range(6)]
    rows += [(i, f"other text {i} the number of something is today") for i in range(10, 200)]
    rows += [(300, "we met Zanzibart once"), (301, "we met Zanzibart once")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in privacy.privacy_report(df).collect()}
    assert out[300] == out[301] == "term:7:16"
    assert out[20] == ""
    assert out[0].startswith("phone:33:50,term:")
    clean = {r.doc_id: r.text for r in privacy.sanitise(df).collect()}
    assert clean[300] == "we met <TERM> once"
    assert "555" not in clean[0] and "<PHONE>" in clean[0] and clean[20] == dict(rows)[20]


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cc"), (4, "a@b.cc"), (4, "a@b.cc")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, kind int, spans string")
    out = sorted((r.doc_id or 0, r.n_email, r.spans) for r in privacy.privacy_report(df).collect())
    assert out == [(0, 1, "email:0:6"), (1, 0, ""), (2, 0, ""), (4, 1, "email:0:6"), (4, 1, "email:0:6")]
    assert privacy.privacy_report(df.limit(0)).collect() == []


def test_terms_stand_anywhere_in_the_text(spark):
    far = " ".join(f"filler{k}" for k in range(300))
    rows = [(i, f"Zanzibart {far} the number is +1 (555) 123-4567 {'y' * 300} {far} Quux") for i in range(6)]
    rows = [(i, f"{t} thing{i}") for i, t in rows] + [(i, f"{far} text {i} the number is") for i in range(10, 200)]
    rows += [(300, "we met Zanzibart once"), (301, f"see {'y' * 150} and Quux")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in privacy.privacy_report(df).collect()}
    assert out[300] == "term:7:16"
    assert out[301] == "term:159:163"
    assert out[20] == ""


def brute_terms(docs, prior=0.5):
    """{term: (disclosure, bits)} pair by pair; equal texts once."""
    texts = set(docs)
    terms, entities = {}, {}
    for t in texts:
        spans = brute.op9_base(t)
        for m in brute.WORD.finditer(t):
            if not any(s < m.end() and m.start() < e for _, s, e in spans):
                terms.setdefault(m[0], set()).add(t)
        for k, s, e in spans:
            entities.setdefault((k, t[s:e]), set()).add(t)
    out = {}
    for term, own in terms.items():
        for held in entities.values():
            if both := len(own & held):
                p = (both + prior * len(held) / len(texts)) / (len(own) + prior)
                b = math.log2(p * len(texts) / len(held))
                if p >= 0.5 and b >= 4:
                    was = out.get(term, (0, 0))
                    out[term] = (max(p, was[0]), max(b, was[1]))
    return out


def test_terms_of_rare_entities_against_brute_force(spark):
    rng, texts = random.Random(3), []
    for i in range(150):
        words = [f"w{rng.randrange(rng.choice([20, 400, 2000]))}" for _ in range(rng.randrange(3, 30))]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            words.insert(rng.randrange(len(words)), rng.choice([f"u{i}@x.org", f"({rng.randrange(9)}@y.org),", "10.0.0.1", f"w{i}:z@q.io"]))
        texts.append(" ".join(words))
    texts += [t for t in texts[:40] for _ in range(rng.randrange(3))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_terms(texts)
    rows = privacy.with_base_spans(df.select("doc_id", F.col("text").alias("_text")).withColumn("_t", privacy.text_id(F.col("_text"))))
    got = {r.term: (r.disclosure, r.bits) for r in privacy.disclosing_terms(rows, privacy.contexts(rows)).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[t][k] - want[t][k]) < 1e-9 for t in want for k in (0, 1))
    assert sum(got[t][0] < 0.7 for t in got) > 5
    for r in privacy.privacy_report(df).collect():
        t, base = texts[r.doc_id], brute.op9_base(texts[r.doc_id])
        spans = [f"{k}:{s}:{e}" for k, s, e in base]
        spans += [f"{'removed' if want[m[0]][0] >= 0.9 else 'term'}:{m.start()}:{m.end()}" for m in brute.WORD.finditer(t) if m[0] in want and not any(s < m.end() and m.start() < e for _, s, e in base)]
        assert r.spans == ",".join(spans)


def test_an_entity_of_one_or_two_texts(spark):
    rows = [(i, f"some text {i} the number of ab is today") for i in range(200)]
    rows += [(300, "the number of Zanzibart is +1 (555) 123-4567 today"), (301, "Qx some text a@b.cc"), (302, "Qx the number a@b.cc"), (303, "text of Qx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in privacy.privacy_report(df).collect()}
    assert out[300] == "phone:27:44,term:14:23"
    assert out[301] == "email:13:19,term:0:2"
    assert out[303] == "term:8:10"
    assert out[20] == ""
