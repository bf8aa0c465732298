"""The pipeline against plain Python, stage by stage on each stage's own input."""

from collections import Counter, defaultdict

import brute
import test_packing

import corpus_pipeline
from morsefield.llm import quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    states = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, states[-1], SF).write.parquet(str(tmp_path / str(k)))
        states.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert states[-1].columns == names
    rows = [[r.asDict() for r in s.collect()] for s in states[:5]]
    texts = [{r["doc_id"]: r["text"] for r in x} for x in rows]

    rules = quality_rules.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality_rules.quality_report(docs, rules).collect() if r.kept}
    assert set(texts[1]) == kept and 0 < len(kept) < len(texts[0])
    assert all(not brute.op2_base(t)[5] for t in texts[1].values())

    want = brute.op10(list(texts[1].values()))
    assert texts[2] == {k: w[2] for k, w in zip(texts[1], want, strict=True)}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2] if r["text"] != texts[1][r["doc_id"]])

    comp = brute.op6(texts[2], 80)  # the stage's threshold
    assert set(texts[3]) == {k for k, (_, c) in comp.items() if c == k}

    size = {k: len(brute.WORD.findall(t)) for k, t in texts[3].items()}
    source = {r["doc_id"]: r["source"] for r in rows[3]}
    taken, total = Counter(), Counter()
    for r in rows[4]:
        taken[r["source"]] += size[r["doc_id"]]
        assert r["text"] == texts[3][r["doc_id"]]
    for k, n in size.items():
        total[source[k]] += n
    assert max(Counter(r["doc_id"] for r in rows[4]).values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 0.15 * sum(size.values())
    assert all(taken[s] <= 2 * total[s] for s in total)

    packed = states[5].collect()
    by = defaultdict(int)
    for r in packed:
        by[r.doc_id] += r.length
    ids = dict(zip(texts[4], test_packing.reference_ids(list(texts[4].values())), strict=True))
    times = Counter(r["doc_id"] for r in rows[4])
    assert by == {k: (len(ids[k]) + 1) * times[k] for k in ids}

    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, packed))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_edges(spark):
    """Nulls in every column, repeated rows and ids, ties, a very long text, and columns whose names clash with the operators' own."""
    good = [" ".join(f"w{(17 * i + 31 * k) % 997}" for k in range(60)) for i in range(30)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(good)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (None, "no id " + " ".join(f"n{k}" for k in range(40)), None, None, None)]
    rows += [(5, good[5], "en", "s1", 1), (102, good[7], "en", "s1", 2), (103, good[7].upper(), None, "s0", 3)]
    rows += [(104, "long " + " ".join(f"x{k}" for k in range(60_000)), "en", "s0", 4)] + [(200 + k, f"tie{k} " * 1 + " ".join(f"t{k}_{j}" for j in range(30)) + "\nshared line", "en", "s1", 5) for k in range(12)]
    extra = "kept boolean, size long, bucket int, _mix_copy int, _quality_statistics int, component_id long, _lost long, piece int, ids string"
    df = spark.createDataFrame([(*r, False, 1, 2, 3, 4, 5, 6, 7, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    states = [df]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, states[-1], SF)
        states.append(spark.createDataFrame(out.collect(), out.schema))
    ids = [Counter(r.doc_id for r in s.collect()) for s in states]
    assert all(s.columns == df.columns for s in states[:5])
    assert 100 not in ids[1] and 101 not in ids[1] and ids[1][5] == 2 and ids[1][None] == 1
    assert all("shared line" not in (r.text or "") for r in states[2].collect())
    assert ids[3][7] == 1 and 102 not in ids[3] and 103 not in ids[3] and ids[3][5] == 2 and ids[3][None] == 1 and ids[3][104] == 1
    assert set(ids[4]) <= set(ids[3])
    by = defaultdict(int)
    for r in states[5].collect():
        assert 0 < r.length <= 2048 and r.offset + r.length <= 2048
        by[r.sequence_id] += r.length
    assert all(n <= 2048 for n in by.values()) and set(ids[5]) == set(ids[4])
