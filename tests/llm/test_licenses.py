import random
import re

import brute
import pytest

from morsefield.llm import licenses


def test_base_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = licenses.op4_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.op4_base(docs[r.doc_id]), r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert any(r.n_base for r in rows)


def scan(source, text):
    return [(a, b) for _, a, b in licenses.Scanner({"t": source}).scan(text)[7]]


def test_regions():
    t = "grant [[of rights]] to {{2}} and {{sell|lease out}} it"
    assert scan(t, "Grant to you and sell it") == [(0, 6)]
    assert scan(t, "x grant of rights to all of and lease out it") == [(1, 11)]
    assert scan(t, "grant of to you and sell it") == []
    assert scan(t, "grant to a b c and sell it") == []
    assert scan(t, "grant to and sell it grant to and sell it") == [(0, 5), (5, 10)]
    assert scan("a [[b [[c]] d]] e", "a e a b d e a b c d e a c e") == [(0, 2), (2, 6), (6, 11)]


def test_bad_templates():
    for t in ("[[a]] {{3}}", "a [[b", "a ]]", "{{2}} a"):
        with pytest.raises(ValueError):
            licenses.compile_template("t", t).first_words()


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "Licensed under the MIT License.\n" * 2), (3, "licensed under the mit license"), (None, "cc-by/nc"), (5, "x" * 100_000 + " under the MIT license")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_words int")
    out = {(r.doc_id, r.n_words): r for r in licenses.license_report(df, matches=True).collect()}
    assert out[1, 0].labels == "" and out[2, 0].score == 0 and out[1, 0].first_word is None
    assert (out[3, 10].n_base, out[3, 10].first_word, out[3, 10].last_word, out[3, 10].labels) == (2, 1, 6, "mit,mit-notice")
    assert out[None, 3].base_labels == "cc-by-nc" and out[None, 3].score == 0.8
    assert out[5, 5].n_base == 1
    assert licenses.license_report(df.limit(0)).collect() == []


def as_regex(template):
    """The template as a pattern over words that each end in a space."""
    out = re.sub(r"\{\{(\d+)\}\}", lambda m: f"\x01{m[1]}\x02", template)
    parts = re.findall(r"\x01\d+\x02|\[\[|\]\]|\{\{|\}\}|\||[^\s\[\]{}|\x01\x02]+", out)
    say = {"[[": "(?:", "]]": ")?", "{{": "(?:", "}}": ")", "|": "|"}
    return re.compile("".join(f"(?:[^ ]+ ){{0,{p[1:-1]}}}" if p[0] == "\x01" else say.get(p, re.escape(p) + " ") for p in parts))


def spelled(template, rng):
    """Some wording that the template allows."""
    t = re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join(f"n{rng.randrange(99)}" for _ in range(rng.randrange(int(m[1]) + 1))), template)
    while True:
        inner = re.search(r"\[\[((?:(?!\[\[|\{\{|\]\]|\}\}).)*)\]\]|\{\{((?:(?!\[\[|\{\{|\]\]|\}\}).)*)\}\}", t)
        if not inner:
            return t.split()
        own = rng.choice((inner[1] if inner[1] is not None else inner[2]).split("|"))
        t = t[: inner.start()] + " " + (own if inner[1] is None or rng.random() < 0.5 else "") + " " + t[inner.end() :]


@pytest.mark.parametrize("label", licenses.TEMPLATES)
def test_templates_against_a_regex(label):
    """Wordings the template allows, and the same with a word changed, dropped or added, against a backtracking matcher."""
    rng, source = random.Random(label), licenses.TEMPLATES[label]
    automaton, pattern = licenses.compile_template(label, source), as_regex(source)
    automaton.first_words()
    accepted = refused = 0
    for k in range(60):
        words = spelled(source, rng)
        if k % 2:
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice(([], ["changed"], [words[at], "added"]))
        want = bool(pattern.fullmatch("".join(w + " " for w in words)))
        assert (bool(words) and automaton.longest(words, 0) == len(words)) == want, words
        assert want or k % 2
        accepted += want
        refused += not want
        if want:
            assert label in licenses.Scanner().scan("Preface: " + " ".join(words).upper() + ". End")[5].split(",")
    assert accepted >= 30 and (refused or label in ("all-rights-reserved",))


def test_variants_are_told_apart():
    three = licenses.TEMPLATES["bsd-3-text"]
    words = " ".join(spelled(three, random.Random(1)))
    assert "bsd-3-text" in licenses.Scanner().scan(words)[5] and "bsd-2-text" not in licenses.Scanner().scan(words)[5]
    cut = " ".join(words.split()[:-3])
    assert "bsd" not in licenses.Scanner().scan(cut)[5]
