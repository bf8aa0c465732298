import random

import xxhash

from morsefield.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def clean(line):
    return " ".join("".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in line).split())


def split_text(text):
    """(own lines, quoted (level, line)) character by character."""
    own, quoted, any_quote = [], [], False
    for line in text.split("\n"):
        k = 1 if line[:1] in (" ", "\t") and line[1:2] == ">" else 0
        level = 0
        while line[k : k + 1] == ">":
            level += 1
            k += 1
            if line[k : k + 1] in (" ", "\t") and line[k : k + 1]:
                k += 1
        if level:
            any_quote = True
            if own and own[-1].rstrip(" \t\r").endswith("wrote:") and not own[-1].rstrip(" \t\r")[:-6][-1:].isalnum():
                own.pop()
            quoted.append((level, line[k:]))
        else:
            own.append(line)
            quoted.append((0, None))
    return (own, quoted) if any_quote else (text.split("\n"), [])


def strings(lines):
    """What a run of lines is known by, as strings."""
    out = list(lines)
    whole = " ".join(lines)
    if len(lines) > 1:
        out.append(whole)
    w = whole.split(" ")
    grams = [(xxhash.xxh3_64_intdigest(" ".join(w[i : i + 5]).encode()), i, " ".join(w[i : i + 5])) for i in range(len(w) - 4)]
    chosen = set()
    for i in range(len(grams) - 7):
        chosen.add(min(grams[i : i + 8]))
    return out + [g for _, _, g in chosen]


def groups(lines):
    """Runs of (level, line): cleaned lines, parted by blank lines and changes of level."""
    out = []
    last = None
    for level, line in lines:
        line = clean(line or "")
        if not line:
            last = None
        elif last == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
            last = level
    return out


def brute(rows):
    """{(conv, turn): (own text, parent, root, depth)} by walking each conversation."""
    out, own, quoted = {}, {}, {}
    for c, t, _, text in rows:
        mine, found = split_text(text or "")
        own.setdefault((c, t), set()).update(s for _, g in groups((0, x) for x in mine) for s in strings(g))
        quoted.setdefault((c, t), []).extend((level, s) for level, g in groups(found) if level for s in strings(g))
        out[c, t] = "\n".join(mine).strip("\n") if found else (text or "")
    parent = {}
    for (c, t), qs in quoted.items():
        votes = {}
        for level, q in qs:
            first = min((u for (d, u), said in own.items() if d == c and q in said), default=None)
            if first is not None and first < t:
                votes[level, first] = votes.get((level, first), 0) + len(q)
        if votes:
            parent[c, t] = max(votes, key=lambda p: (-p[0], votes[p], p[1]))[1]
    res = {}
    for c, t in out:
        up, n = t, 0
        while (c, up) in parent:
            up, n = parent[c, up], n + 1
        res[c, t] = (out[c, t], parent.get((c, t)), up, n)
    return res


def reply_order(found):
    """[(conv, turn)] depth first, answers by turn."""
    out = []

    def walk(c, t):
        out.append((c, t))
        for d, u in sorted(found):
            if d == c and found[d, u][1] == t:
                walk(d, u)

    for c, t in sorted(found):
        if found[c, t][1] is None:
            walk(c, t)
    return out


def wrapped(words, width):
    lines = [""]
    for w in words:
        if len(lines[-1]) + len(w) > width:
            lines.append("")
        lines[-1] = f"{lines[-1]} {w}".strip()
    return lines


def mail(rng, talks, turns):
    """Conversations as mail programs write them: answers below quotes of whole or cut texts, wrapped anew, nested."""
    rows = []
    for c in range(talks):
        texts = []
        for t in range(turns):
            own = [" ".join(f"{rng.choice(['the', 'Of', 'and', 'x'])}{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 9, 30]))) for _ in range(rng.randrange(1, 4))]
            body = "\n\n".join("\n".join(wrapped(p.split(), 60)) for p in own)
            if texts and rng.random() < 0.75:
                of = rng.choice(texts[-4:])
                lines = of.split("\n")
                if rng.random() < 0.4:  # wrapped anew
                    lines = wrapped([w for x in lines if not x.startswith(">") for w in x.split()], rng.choice([25, 40, 72]))
                if rng.random() < 0.3:
                    lines = lines[rng.randrange(len(lines)) :]
                quoted = [(">" if x.startswith(">") else "> ") + x for x in lines]
                body = "\n".join([*(["On Monday someone wrote:"] if rng.random() < 0.5 else []), *quoted, body])
            texts.append(body)
            rows.append((c, t, "user", body))
    return rows


def test_parse():
    text = "Hello\n\nOn Monday A wrote:\n> one\n>> two\n> > three\nmine\n>four"
    own, quoted = quotes.parse(text)
    assert own == "Hello\n\nmine" and [x for x in quoted if x[0]] == [(1, "one"), (2, "two"), (2, "three"), (1, "four")]
    assert quotes.parse("a > b\n") == ("a > b\n", [])
    assert quotes.parse("x" * 500 + " wrote:\n> q\nyes")[0] == "yes"


def check(spark, rows):
    want = brute(rows)
    got = quotes.thread(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.conv_id, r.turn): (r.text, r.parent_turn, r.root_turn, r.depth) for r in got} == want
    assert [(r.conv_id, r.turn) for r in sorted(got, key=lambda r: (r.conv_id, r.root_turn, r.place))] == reply_order(want)
    return want


def test_mail_against_brute_force(spark):
    want = check(spark, mail(random.Random(5), 12, 16))
    assert max(x[3] for x in want.values()) > 4
    assert sum(x[1] is not None for x in want.values()) > 100
    ordered = [(r.conv_id, r.turn) for r in quotes.reply_ordered(spark.createDataFrame(mail(random.Random(5), 3, 9), SCHEMA)).collect()]
    assert ordered == reply_order(brute(mail(random.Random(5), 3, 9)))


def test_random_lines_against_brute_force(spark):
    rng, rows = random.Random(6), []
    for c in range(8):
        said = []
        for t in range(12):
            own = [f"line {rng.randrange(40)}  of Talk" for _ in range(rng.randrange(1, 3))]
            lines = list(own)
            if said and rng.random() < 0.7:
                lines = [f"{rng.choice(['> ', '>', '>> ', ' > > '])}{x.upper() if rng.random() < 0.3 else x}" for x in rng.choice(said)] + [">> deeper"] + lines
            said.append(own)
            rows.append((c, t, "user", "\n".join(lines)))
    check(spark, rows)


def test_chains_and_fans(spark):
    """A chain as deep as the conversation is long, and a message with many answers."""
    rows = [(1, 0, "u", "start of it")] + [(1, t, "u", f"> {'start of it' if t == 1 else f'answer {t - 1}'}\nanswer {t}") for t in range(1, 120)]
    rows += [(2, 0, "u", "question")] + [(2, t, "u", f"> question\nreply {t}") for t in range(1, 90)] + [(2, 100, "u", "> reply 7\nlate")]
    want = check(spark, rows)
    assert want[1, 119][3] == 119 and want[2, 100][1] == 7


def test_quotes_that_were_wrapped_anew(spark):
    rows = [(1, 0, "u", "alpha beta"), (1, 1, "u", " ".join(f"w{k}" for k in range(40))), (1, 2, "u", "> alpha\n> beta\nyes"), (1, 3, "u", "> " + "\n> ".join(" ".join(f"w{k}" for k in range(s, s + 7)) for s in (9, 16))), (1, 4, "u", "> alpha\n>\n> beta")]
    got = {r.turn: r.parent_turn for r in quotes.thread(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: None, 1: None, 2: 0, 3: 1, 4: None}


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = quotes.op1_quotation_links(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): (r.text, r.parent_turn, r.root_turn, r.depth) for r in got} == brute(rows)


def test_edges(spark):
    rows = [(1, 0, "u", None), (1, 1, "u", ""), (None, 2, "u", "> x"), (1, None, "u", "> x"), (1, 3, "u", "x"), (1, 3, "u", "x"), (1, 4, "u", "> x\n> x\nyes"), (1, 5, "u", "> not there"), (1, 6, "u", "y" * 50_000), (-2, -10**13, "u", "far"), (-2, 10**14, "u", "> far")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", level int, key string")
    got = quotes.thread(df).collect()
    assert len(got) == len(rows)
    assert {(r.turn, r.parent_turn) for r in got if r.parent_turn is not None} == {(4, 3), (10**14, -10**13)}
    assert quotes.thread(df.limit(0)).collect() == []


def test_ties_go_to_the_latest_message(spark):
    rows = [(1, 0, "u", "first said"), (1, 1, "u", "other said"), (1, 2, "u", "> first said\n\n> other said\nboth")]
    got = {r.turn: r.parent_turn for r in quotes.thread(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2] == 1


def test_deep_quotes_link_where_shallow_ones_do_not(spark):
    rows = [
        (1, 0, "u", "the first word"),
        (1, 1, "u", "> the first word\nan answer"),
        (1, 3, "u", "> a message that is missing\n>> the first word\nyes"),
        (1, 4, "u", ">> the first word\n>> and more\ndeep only"),
        (1, 5, "u", "> an answer\n>> the first word\n>> the first word\nshallow wins"),
        (1, 6, "u", "> gone\n>> gone too\n>>> deep only\nthree down"),
        (1, 7, "u", ">> not there"),
    ]
    got = {r.turn: r for r in quotes.thread(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: r.parent_turn for t, r in got.items()} == {0: None, 1: 0, 3: 0, 4: 0, 5: 1, 6: 4, 7: None}
    assert {t: r.root_turn for t, r in got.items()} == {0: 0, 1: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 7}
