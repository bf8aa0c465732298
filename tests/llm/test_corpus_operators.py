"""The other corpus operators: edge cases, and whole small tables against plain Python."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from morsefield.llm import components, exact_dedup, line_dedup, mixing, near_dedup, quality_rules, repeats

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, key string, bucket int, kept int"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def frame(spark, rows):
    """Documents with columns that clash with the operators' own names."""
    return spark.createDataFrame([(d, t, None, s, None if t is None else len(t), 1, "k", 2, 3) for d, t, s in rows], SCHEMA)


ODD = [(1, None, None), (2, "", "a"), (3, "  \n\t ", "a"), (4, "One two", "b"), (4, "One two", "b"), (5, "one TWO", "a"), (None, "one two", None), (6, "É one two " * 3000, "b"), (7, "x y z w v u", "a")]


def test_exact_groups(spark):
    got = sorted(exact_dedup.exact_groups(frame(spark, ODD)).collect(), key=str)
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    pair = by[hashlib.sha256(b"one two").hexdigest()]
    assert {(r.keep_id, r.group_size) for r in pair} == {(5, 4)} and [r.doc_id for r in pair if r.kept] == [5]
    assert {(r.doc_id, r.keep_id) for r in by[hashlib.sha256(b"").hexdigest()]} == {(1, 2), (2, 2)}
    assert sum(r.kept for r in got) == len(by)
    heavy = exact_dedup.exact_groups(frame(spark, ODD * 4), heavy=2).collect()
    assert sum(r.kept for r in heavy) == len(by) and {r.group_size for r in heavy} == {4 * n for n in (1, 2, 4)}
    assert exact_dedup.exact_groups(frame(spark, ODD).limit(0)).collect() == []


def test_quality_statistics_and_edges(spark, docs):
    for r in quality_rules.quality_report(frame(spark, ODD), []).collect():
        text = next(t for d, t, _ in ODD if d == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.op2_base(text)
        assert r.kept == (not r.base_failed) and r.rule is None
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) + "\n" * rng.randrange(3) + rng.choice(["", "a b\na b\n a b", "#$ x"]) for _ in range(80)]
    for r in quality_rules.quality_report(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), []).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.op2_base(texts[r.doc_id])
    assert quality_rules.quality_report(frame(spark, ODD).limit(0), []).collect() == []
    clash = frame(spark, ODD).withColumn("_quality_statistics_words", F.lit(1)).withColumn("_s", F.lit(2))
    assert quality_rules.keep_by_quality(clash, []).columns == clash.columns
    kept = quality_rules.keep_by_quality(frame(spark, [*ODD, (9, "a b c d e f g h i j", "z")]), [])
    assert [(r.doc_id, r["kept"], r["h"]) for r in kept.collect()] == [(9, 3, 1)]


def test_rules_hold_out(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rules = quality_rules.learn(d, train)
    assert rules and all(r.precision >= 0.9 for r in rules)
    got = quality_rules.quality_report(d, rules).join(test, "doc_id").select("quality", "base_failed", "kept").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    bad = [r for r in got if r.quality == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)
    assert quality_rules.learn(d, labels.limit(0)) == []
    assert quality_rules.learn(d, labels.filter("quality = 1")) == []


def test_list_of_conjunctions_on_given_documents(spark):
    """Labels made from two conjunctions over the statistics of the given documents, a few of them wrong."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = quality_rules.quality_report(d, []).filter("not base_failed").withColumn("wl", F.col("word_chars") / F.col("n_words"))
    wl, n = stats.approxQuantile(["wl", "n_words"], [0.5], 0.0)
    one, two = (F.col("wl") > wl[0]) & (F.col("n_words") > n[0]), (F.col("n_symbols") > 0.02 * F.col("word_chars")) & (F.col("n_words") <= n[0])
    noise = F.pmod(F.xxhash64("doc_id"), F.lit(50)) == 0
    labels = stats.select("doc_id", F.when((one | two) != noise, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    rules = quality_rules.learn(d, labels, min_precision=0.8)
    assert len(rules) >= 2 and any(len(r.conditions) >= 2 for r in rules) and all(len(r.conditions) <= 4 for r in rules)
    judged = quality_rules.quality_report(d, rules).join(labels, "doc_id").filter("not base_failed")
    right = judged.filter((F.col("kept") & (F.col("quality") == 1)) | (~F.col("kept") & (F.col("quality") == 0))).count()
    assert right >= 0.88 * judged.count()
    # conditions that only fit the noise of the growing part are pruned: without pruning lists are longer
    assert sum(len(r.conditions) for r in rules) < 4 * len(rules)
    used = {r.rule for r in judged.select("rule").distinct().collect()}
    assert used >= {None, 0, 1}


def test_covering_finds_a_conjunction():
    grid = np.array([[a, b, 0, 0, 0] for a in range(4) for b in range(4)])
    bad = (grid[:, 0] > 1) & (grid[:, 1] <= 0)
    w = np.where(bad[:, None], [[20, 0, 10, 0]], [[0, 20, 0, 10]]).astype(float)
    rules = quality_rules.cover(grid, w, [[0.5, 1.5, 2.5], [0.5, 1.5, 2.5], [], [], []], min_precision=0.9, min_rows=5, max_rules=5, max_conditions=4)
    assert len(rules) == 1 and {(c.feature, c.above, c.threshold) for c in rules[0].conditions} == {("word_length", True, 1.5), ("symbol_share", False, 0.5)}


def test_line_dedup(spark, docs):
    common = [(i, f"own {i}\n  Shared LINE \n\nshared line", "a") for i in range(12)]
    rows = [*ODD, *common, (50, "shared line", "a"), (51, "nine\n" * 30, "b")]
    got = line_dedup.line_report(frame(spark, rows)).collect()
    want = brute.op10([t for _, t, _ in rows])
    said = sorted((str(d), n, k, hashlib.sha256(t.encode()).hexdigest()) for (d, _, _), (n, k, t) in zip(rows, want, strict=True))
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == said
    clean = line_dedup.drop_common_lines(frame(spark, rows))
    assert clean.columns == frame(spark, rows).columns and {r.text for r in clean.filter("doc_id = 50").collect()} == {""}
    assert clean.filter("doc_id = 1 and text is null").count() == 1
    assert line_dedup.line_report(frame(spark, rows).limit(0)).collect() == []
    assert line_dedup.line_report(frame(spark, ODD)).agg({"n_dropped": "sum"}).first()[0] == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    shard = line_dedup.Shard(line_dedup.pack_shard(keys, keys * np.uint64(3), np.arange(len(keys))))
    assert sorted(shard.mph.index(keys).tolist()) == list(range(len(keys)))
    assert (shard.count(keys, keys * np.uint64(3)) == np.arange(len(keys))).all()
    other = rng.integers(2**63, 2**64, 5000, dtype=np.uint64)
    assert not shard.count(other, other).any()


def test_hashes_that_agree_in_half_of_their_bits():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    keys[500:600] = keys[:100]
    prints = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    shard = line_dedup.Shard(line_dedup.pack_shard(keys, prints, np.arange(1, 1001)))
    assert (shard.count(keys, prints) == np.arange(1, 1001)).all()
    assert not shard.count(keys, prints + np.uint64(1)).any() and not shard.count(prints, keys).any()
    with pytest.raises(ValueError):
        line_dedup.pack_shard(keys[[1, 1]], prints[[1, 1]], np.ones(2))


def test_line_sql_counts_rows(spark):
    """Ten rows of one doc_id are ten documents, for the operator and for its SQL."""
    import duckdb

    rows = [(1, f"shared\nown {i}") for i in range(10)] + [(2, None), (3, " \n"), (4, "shared")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted(con.execute(line_dedup.OP10_SQL).fetchall())
    assert sum(r.n_dropped for r in got) == 11


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute.components({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert got == want


def near(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(df).collect()}


def test_near_dedup(spark, docs, monkeypatch):
    assert near(spark.read.parquet(f"{SF}/documents.parquet")) == brute.op6(docs)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = {}
    for i in range(90):  # one crowd of near copies, some only linked through others
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(150)] = f"x{rng.randrange(9)}"
        rows[i] = " ".join(w)
    for i in range(90, 130):
        rows[i] = " ".join(f"w{rng.randrange(500)}" for _ in range(40))
    rows |= {200: "a b c", 201: "A  B\nc", 202: "a b d", 203: None, 204: " ", 205: "one two three four five"}
    for block in (512, 8):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        assert near(frame(spark, [(d, t, "a") for d, t in rows.items()])) == brute.op6(rows)
    odd = near_dedup.near_groups(frame(spark, [(None, "a b", "a"), (3, "a b", "a"), (3, "a b", "a")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in odd) == [("3", "3", True), ("3", "3", True), ("None", "None", True)]
    assert near(frame(spark, ODD).limit(0)) == {}
    kept = near_dedup.drop_near_copies(frame(spark, [(d, t, "a") for d, t in rows.items()]))
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute.op6(rows).items() if c == d}


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 11 else None) for i in range(400)]
    got = mixing.mix_report(frame(spark, [*rows, (900, None, "s0"), (901, "", "empty")])).collect()
    total, taken = {}, {}
    source = {d: s for d, _, s in rows} | {900: "s0", 901: "empty"}
    for r in got:
        total[source[r.doc_id]] = r.source_size
        taken.setdefault(source[r.doc_id], [r.target, 0])[1] += r.taken
        assert r.taken <= 2 * r.size
    weigh = {s: (5, 2, 1)[k % 3] for k, s in enumerate(["empty", "s0", "s1", "s2", None])}
    level, capped = 1.5 * sum(total.values()), set()
    while True:  # water filling
        free = [s for s in total if s not in capped]
        price = (level - sum(2 * total[s] for s in capped)) / sum(weigh[s] for s in free)
        over = {s for s in free if price * weigh[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    for s, (target, n) in taken.items():
        assert target == pytest.approx(2 * total[s] if s in capped else price * weigh[s])
        assert abs(n - target) <= 7
    again = {(r.doc_id, r.taken) for r in mixing.mix_report(frame(spark, rows[::-1])).collect()}
    assert again == {(r.doc_id, r.taken) for r in mixing.mix_report(frame(spark, rows)).collect()}
    assert mixing.mix_report(frame(spark, rows).limit(0)).collect() == []
    clash = frame(spark, rows).withColumn("_mix_passes", F.lit(9)).withColumn("_MIX_copy", F.lit(9))
    assert mixing.mix(clash).columns == clash.columns and mixing.mix(clash).count() == mixing.mix(frame(spark, rows)).count()
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns
    assert mixed.count() == sum(r.taken // r.size for r in mixing.mix_report(frame(spark, rows)).collect())


def test_repeats(spark, docs, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, other = text(120), text(90)
    rows = [(i, text(rng.randrange(60)) + shared + text(rng.randrange(60)), "a") for i in range(14)]
    rows += [(20, other + text(30) + other, "a"), (21, "a" * 900, "a"), (22, shared[:250] + other[40:], "a"), (23, shared, "a"), (None, text(100), "a")]
    rows += [(24, rows[0][1], "a"), (25, text(200), "a"), (25, rows[-1][1], "a"), *ODD]
    want = brute.op5([t for _, t, _ in rows])
    said = sorted((str(d), len((t or "").encode()), sum(b - a for a, b in runs), len(runs), hashlib.sha256(rest).hexdigest()) for (d, t, _), (runs, rest) in zip(rows, want, strict=True))
    for crowd in (500, 2):
        monkeypatch.setattr(repeats, "CROWD", crowd)
        got = repeats.repeat_report(frame(spark, rows)).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == said
    assert repeats.repeat_report(frame(spark, rows).limit(0)).collect() == []


def test_maximal_repeats():
    members = [(b"xabcdefgh", 3), (b"yabcdefgz", 3), (b"yabcdqqq", 3), (b"zzzqqq", 3)]
    found = {(members[own[0]][0][members[own[0]][1] - left : members[own[0]][1] + right], tuple(sorted(own))) for left, right, own in repeats.maximal_repeats(members, 4)}
    assert (b"abcdefg", (0, 1)) in found and (b"abcd", (0, 1, 2)) in found and (b"yabcd", (1, 2)) in found
    assert all(2 not in own or 0 not in own or text == b"abcd" for text, own in found)
    assert list(repeats.intervals([2, 0, 3, 3, 1], 1)) == [(2, 0, 1), (3, 2, 4), (1, 2, 5)]
