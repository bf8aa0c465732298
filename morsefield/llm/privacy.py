"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. For the rest the corpus is the
adversary's background knowledge. For a term t that stands in c(t, e) texts together with an entity e, and in n(t) of
all N texts at all, seeing t reveals e with P(e | t) = (c(t, e) + ``prior`` * P(e)) / (n(t) + ``prior``), P(e) = n(e) / N, and
the information it gives is log2(P(e | t) / P(e)) bits. The prior takes the place of a least number of texts: one text
with its only entity gives 2/3, and removal takes five. All are counts of whole texts, of any length, and of words that
touch no entity of the text. Terms with P(e | t) of at least ``disclosure`` and at least ``min_bits`` bits are generalised
(spans of kind ``term``, replaced by it) wherever they stand, and removed (spans of kind ``removed``) if P(e | t) reaches ``removal``. Equal texts count once, since
a copy is no new evidence.

All is built-in expressions: texts are split by a pattern, so that the lengths of the pieces give the places of the
matches. Patterns are written with possessive loops, which match the same and cannot overflow the stack on long
runs. Pairs of terms and entities are not made one by one: all terms that stand in the same texts with entities have the
same counts, all entities of the same texts too, so only one name of each such set is paired within a text.

Defined results. Null text counts as empty and has no spans. Places count code points, ends are exclusive. Base spans
of different kinds may overlap and all stay; a term that overlaps a base span of the text is not a span of its own.
Rows are judged one by one, repeated or not; a null doc_id is allowed. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WS_RE, Scratch, cut, let, small, table, words_of

LOCAL = "A-Za-z0-9._%+-"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: \G: a match may begin right after another one, else only where a run begins; that keeps searching linear.
PATTERNS = {
    "email": f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9]++(?:[\\x20-][0-9]++)*+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
WORD_RE = "[^\\x20\\x09-\\x0D]++"
#: Rows of 16 bytes up to which a table is broadcast.
MANY_ROWS = 1_000_000
PRIOR = 0.5
DISCLOSURE = 0.5
REMOVAL = 0.9
MIN_BITS = 4.0
#: Kinds of the spans of terms.
GENERALISED, REMOVED = "term", "removed"
NO_SPANS = "array<struct<kind:string,start:int,end:int,text:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    back = F.reverse(_digits(s))

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(back)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(s, F.lit(f"^{OCTET}(?:\\.{OCTET}){{3}}$"))
    if kind == "card":
        n = F.length(_digits(s))
        return F.when((n >= 13) & (n <= 19), _luhn(s)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _possible(kind: str, text: Column) -> Column:
    """A cheap necessary condition, so that most texts are never split."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return F.regexp_like(text, F.lit({"ip": "[0-9]\\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){12}"}[kind]))


def kind_spans(text: Column, kind: str) -> Column:
    """Spans (kind, start, end, text) of the valid matches of a kind, in order."""
    pattern = PATTERNS[kind]

    def placed(found: Column) -> Column:
        pieces = F.split(text, pattern)
        pairs = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(F.length(p).alias("gap"), m.alias("m")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(NO_SPANS).alias("out"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["gap"]
            end = start + F.length(x["m"])
            own = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("text"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.when(_valid(kind, x["m"]), F.array(own)).otherwise(F.array().cast(NO_SPANS))).alias("out"))

        return F.aggregate(pairs, zero, step, lambda a: a["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(_possible(kind, text), let(found, placed)).otherwise(F.array().cast(NO_SPANS))


def text_id(text: Column) -> Column:
    """128 bits by which equal texts are known."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def with_base_spans(rows: DataFrame) -> DataFrame:
    """rows with _text: adds one column for each kind; a one-element explode keeps them from being worked out again."""
    kinds = F.struct(*(kind_spans(F.col("_text"), k).alias(k) for k in PATTERNS))
    return rows.withColumn("_spans", F.explode(F.array(kinds)))


def _outside(text: Column, own: Column) -> Column:
    """The text without the words that spans touch."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def piece(at: Column, n: Column) -> Column:
        p = F.substring(text, at + 1, n)
        return F.when(at > 0, F.regexp_replace(p, f"^{WORD_RE}", "")).otherwise(p)

    def step(a: Column, x: Column) -> Column:
        before = F.regexp_replace(piece(a["at"], F.greatest(x["start"] - a["at"], F.lit(0))), f"(?<!{WORD_RE[:-2]}){WORD_RE}\\z", "")
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], F.array(before)).alias("out"))

    places = F.array_sort(F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return F.aggregate(places, zero, step, lambda a: F.array_join(F.concat(a["out"], F.array(piece(a["at"], F.length(text)))), " "))


def contexts(rows: DataFrame) -> DataFrame:
    """(_t, _text, own, entities, terms) of the texts that hold an entity, equal ones once, a written table."""
    own = F.concat(*(F.col(f"_spans.{k}") for k in PATTERNS))
    near = rows.select("_t", "_text", own.alias("own")).filter(F.size("own") > 0).dropDuplicates(["_t"])
    near = near.withColumn("_outside", F.explode(F.array(_outside(F.col("_text"), F.col("own")))))
    entities = F.array_distinct(F.transform("own", lambda x: F.concat(x["kind"], F.lit(":"), x["text"])))
    return cut(near.select("_t", "_text", "own", entities.alias("entities"), F.array_distinct(words_of(F.col("_outside"))).alias("terms")), "contexts")


def _plain(rows: DataFrame) -> DataFrame:
    """The rows without any entity."""
    return rows.filter(F.size(F.concat(*(F.col(f"_spans.{k}") for k in PATTERNS))) == 0)


def _texts_of(near: DataFrame, what: str, kinds: DataFrame) -> DataFrame:
    """(_t, n, f) for kinds (one, n, f): the texts of near that hold ``one``. f of a single text is its _t."""
    often = cut(kinds.filter("n > 1"), "often")
    held = near.select("_t", F.explode(what).alias("one")).join(small(often), "one").select("_t", "n", "f")
    return kinds.filter("n = 1").select(F.col("f").alias("_t"), "n", "f").unionByName(held)


def _kinds(counted: DataFrame) -> DataFrame:
    """(one, n, f): one name for all that stand in the same n texts, of fingerprint f."""
    return counted.groupBy("n", "f").agg(F.min("name").alias("one"))


def disclosing_terms(rows: DataFrame, near: DataFrame, *, prior: float = PRIOR, disclosure: float = DISCLOSURE, min_bits: float = MIN_BITS) -> DataFrame:
    """(term, n, f, far, disclosure, bits) of the terms that reveal some entity; far is the number of texts without one. near: contexts(rows)."""
    copies = cut(rows.groupBy("_t").agg(F.count(F.lit(1)).alias("_m")), "copies")
    total = float(copies.count())
    print_ = F.struct(F.bit_xor("_t.a").alias("a"), F.bit_xor("_t.b").alias("b"))
    counted = lambda what: near.select("_t", F.explode(what).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), print_.alias("f"))
    # m equal texts count 1/m each, so the sums are whole but for rounding
    often = small(copies.filter("_m > 1").withColumnRenamed("_t", "_c"), MANY_ROWS)
    plain = _plain(rows).select("_t", "_text").join(often, F.col("_t") == F.col("_c"), "left")
    plain = plain.select((F.lit(1.0) / F.coalesce("_m", F.lit(1))).alias("_w"), F.explode(F.array_distinct(words_of(F.col("_text")))).alias("term"))
    far = plain.groupBy("term").agg(F.round(F.sum("_w")).cast("long").alias("far"))
    terms = counted("terms").withColumnRenamed("name", "term").join(far, "term", "left").withColumn("far", F.coalesce("far", F.lit(0)))
    # no entity can be in more texts of a term than those that hold any
    terms = cut(terms.filter((F.col("n") + prior) >= disclosure * (F.col("n") + F.col("far") + prior)), "candidates")
    entities = cut(counted("entities"), "entities")
    mine = _texts_of(near, "terms", _kinds(terms.withColumnRenamed("term", "name")))
    theirs = _texts_of(near, "entities", _kinds(entities)).toDF("_t", "n_e", "g")
    pairs = mine.join(theirs, "_t").groupBy("n", "f", "n_e", "g").agg(F.count(F.lit(1)).alias("both")).filter((F.col("both") + prior) >= disclosure * (F.col("n") + prior))
    scored = terms.join(pairs, ["n", "f"]).withColumn("p", (F.col("both") + prior * F.col("n_e") / total) / (F.col("n") + F.col("far") + prior))
    scored = scored.withColumn("b", F.log2(F.col("p") * F.lit(total) / F.col("n_e")))
    scored = scored.filter((F.col("p") >= disclosure) & (F.col("b") >= min_bits))
    return scored.groupBy("term", "n", "f", "far").agg(F.max("p").alias("disclosure"), F.max("b").alias("bits"))


def _placed(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """(_t, found): spans of the terms in hits (_t, term, gone) that overlap no base span. texts: _t, _text, own."""
    hits = cut(hits.groupBy("_t").agg(F.map_from_entries(F.collect_list(F.struct("term", "gone"))).alias("_hits")), "hits")
    both = texts.join(hits, "_t")
    gaps = F.split("_text", "[^\\x20\\x09-\\x0D]+")
    pairs = F.zip_with(words_of(F.col("_text")), gaps, lambda w, g: F.struct(w.alias("w"), F.length(g).alias("gap")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(NO_SPANS).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["w"])
        kind = F.when(F.element_at(F.col("_hits"), x["w"]), REMOVED).otherwise(GENERALISED)
        mine = F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), x["w"].alias("text"))
        return F.struct(end.alias("at"), F.when(F.map_contains_key(F.col("_hits"), x["w"]), F.concat(a["out"], F.array(mine))).otherwise(a["out"]).alias("out"))

    full = F.filter(pairs, lambda x: x["w"].isNotNull())
    both = both.withColumn("_found", F.explode(F.array(F.aggregate(full, zero, step, lambda a: a["out"]))))
    clear = F.filter("_found", lambda s: ~F.exists("own", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return both.select("_t", clear.alias("found"))


def term_spans(rows: DataFrame, near: DataFrame, terms: DataFrame, removal: float = REMOVAL) -> DataFrame:
    """(_t, found): spans of disclosing terms that overlap no base span, for the texts that have any."""
    gone = terms.withColumn("gone", F.col("disclosure") >= removal)
    own = cut(gone.filter("n > 1").select("term", "gone"), "often")
    held = near.select("_t", F.explode("terms").alias("term")).join(small(own), "term").select("_t", "term", "gone")
    found = _placed(near, gone.filter("n = 1").select(F.col("f").alias("_t"), "term", "gone").unionByName(held))
    own = cut(gone.filter("far > 0").select("term", "gone"), "far")
    if not own.head(1):
        return found
    plain = _plain(rows).select("_t", "_text", F.array().cast(NO_SPANS).alias("own"))
    hits = plain.select("_t", F.explode(F.array_distinct(words_of(F.col("_text")))).alias("term")).join(small(own), "term").distinct()
    return found.unionByName(_placed(plain, hits).dropDuplicates(["_t"]))


def _said(spans: Column, kind: str | None = None) -> Column:
    name = F.lit(kind) if kind else None
    return F.transform(spans, lambda s: F.concat_ws(":", name if kind else s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def with_spans(docs: DataFrame, **how) -> DataFrame:
    """doc_id, _text, _spans (base, by kind) and _terms (spans of terms), a row for each input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("_text"))
    rows = with_base_spans(rows.withColumn("_t", text_id(F.col("_text"))))
    with Scratch(docs.sparkSession) as own:
        near = contexts(rows)
        none = F.array().cast(NO_SPANS)
        if not near.head(1):
            return rows.withColumn("_terms", none)
        terms = cut(disclosing_terms(rows, near, **how), "terms")
        if not terms.head(1):
            return rows.withColumn("_terms", none)
        found = own.keep(cut(term_spans(rows, near, terms), "found")).toDF("_f_t", "_f")
        return rows.join(found, rows["_t"] == found["_f_t"], "left").withColumn("_terms", F.coalesce("_f", none)).drop("_f_t", "_f")


def privacy_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans; a row for each input row."""
    s = with_spans(docs, **how)
    base = F.concat(*(_said(F.col(f"_spans.{k}"), k) for k in PATTERNS))
    return s.select(
        "doc_id",
        *(F.size(f"_spans.{k}").cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _said(F.col("_terms"))), ",").alias("spans"),
    )


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """doc_id and text with base spans and revealing terms replaced by their kind, and the most revealing terms removed.

    Of overlapping spans the one that begins first is replaced, and what later ones add is replaced too.
    """
    s = with_spans(docs, **how)
    spans = F.array_sort(F.transform(F.concat(*(F.col(f"_spans.{k}") for k in PATTERNS), F.col("_terms")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(F.col("_text"), a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        tag = F.when((x["kind"] == REMOVED) | (x["end"] <= a["at"]) | (x["start"] < a["at"]), F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], F.array(gap, tag)).alias("out"))

    rest = lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(F.col("_text"), a["at"] + 1, F.length("_text")))), "")
    return s.select("doc_id", F.when(F.size(spans) == 0, F.col("_text")).otherwise(F.aggregate(spans, zero, step, rest)).alias("text"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy_report(table(spark, sf_dir, "documents"))


assert WS_RE == "[\\x20\\x09-\\x0D]+"  # the gaps above are its complement
