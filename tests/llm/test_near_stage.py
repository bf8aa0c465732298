"""The near-duplicate stage of the pipeline against a brute force at 0.8, and the join of what pivots miss."""

import random

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from morsefield.llm import near_dedup


def kept_at(docs, percent):
    sets = {k: brute.shingles(t) for k, t in docs.items()}
    ids = sorted(docs)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {k for k, c in brute.components(docs, links).items() if c == k}


def test_stage_removes_copies_of_similarity_080_to_085(spark):
    rng, docs = random.Random(11), {}
    for g in range(60):
        words = [f"w{rng.randrange(10_000)}" for _ in range(150)]
        docs[10 * g] = " ".join(words)
        for k in range(1, 3):
            own = list(words)
            for at in rng.sample(range(150), rng.randrange(2, 5)):
                own[at] = f"x{g}y{k}z{at}"
            docs[10 * g + k] = " ".join(own)
    want = kept_at(docs, 80)
    assert len(kept_at(docs, 85)) > len(want) + 10
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()} == want


def test_bounds_follow_the_threshold():
    assert near_dedup.banding(85) == (25, 5) and near_dedup.least_agreeing(85) == 85
    bands, rows = near_dedup.banding(80)
    assert (1 - 0.8**rows) ** bands <= 1e-6 and bands * rows <= near_dedup.HASHES
    assert near_dedup.least_agreeing(80) <= 125 * 0.8 - 5 * (125 * 0.8 * 0.2) ** 0.5


def template_corpus(n, rng, shared=120, own=40):
    template = " ".join(f"t{k}" for k in range(shared))
    return {i: template + " " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(own)) for i in range(n)}


def test_documents_of_one_template_meet_nobody(spark):
    """Similarity 0.6 of all pairs, no link: nothing is paired, and two near copies among them are found."""
    docs = template_corpus(1500, random.Random(5))
    docs[5000] = docs[77].rsplit(" ", 2)[0] + " other end"
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    prof = near_dedup.profiles(df)
    left = prof.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("comp"), "signature").cache()
    sets = near_dedup._full_sets(df, left.select("rep"))
    assert {r.rep for r in near_dedup._meeting(near_dedup._postings(sets, left, 85)).collect()} == {77, 5000}
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df).collect()}
    assert got == {k: 77 if k == 5000 else k for k in docs}


def test_prefix_join_loses_no_link(spark, monkeypatch):
    """Crowds of texts around the threshold, all in components of their own at first, in blocks of any size."""
    rng, docs = random.Random(8), {}
    base = [f"w{k}" for k in range(120)]
    for i in range(130):
        own = list(base[: rng.randrange(100, 121)])
        for at in rng.sample(range(len(own)), rng.randrange(0, 6)):
            own[at] = f"x{rng.randrange(12)}"
        docs[i] = " ".join(own)
    sets = {k: brute.shingles(t) for k, t in docs.items()}
    want = {(a, b) for a in docs for b in docs if a > b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    left = near_dedup.profiles(df).select(F.col("doc_id").alias("rep"), F.when(F.col("doc_id") < 40, 0).otherwise(F.col("doc_id")).cast("long").alias("comp"), "signature").cache()
    full = near_dedup._full_sets(df, left.select("rep")).cache()
    state = left.withColumn("size", F.lit(1)).withColumn("n_shingles", F.lit(110))
    comp = {i: 0 if i < 40 else i for i in docs}
    joined = brute.components(comp.values(), [(comp[a], comp[b]) for a, b in want])
    for block, tile, wide, span in ((512, 256, 4096, 1 << 21), (7, 3, 5, 1 << 21), (512, 64, 4096, 2000), (20, 50, 50, 400)):
        monkeypatch.setattr(near_dedup, "SPAN", span)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "TILE", tile)
        monkeypatch.setattr(near_dedup, "WIDE", wide)
        meeting = near_dedup._meeting(near_dedup._postings(full, left, 80))
        some = state.join(meeting, "rep", "left_semi")
        links = [(max(r), min(r)) for r in near_dedup._links_left(near_dedup._in_blocks(some, 80), full, 80).collect()]
        assert set(links) <= want and all(a >= 40 for a, _ in links)
        assert brute.components(comp.values(), [(comp[a], comp[b]) for a, b in links]) == joined
