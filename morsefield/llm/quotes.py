"""Quotation linking: which earlier message a message answers, from what it quotes.

Each text is parsed into its own lines and quoted lines with their nesting level (the number of leading ``>`` signs). A run of
quoted lines of one level without a blank line is a passage; a run of own lines without a blank line is a paragraph. Both are
normalised (A-Z lower-cased, white space and line ends collapsed) and hashed in the same ways: each line, the whole run, and
grams of ``GRAM`` words, of which in every ``WINDOW`` in a row the one of least hash counts. So a quote is known whole, by its
lines, and, where it was wrapped anew or cut, by any run of GRAM + WINDOW - 1 words that it shares with a paragraph.

The earliest message of a conversation that has a hash among its own is its original; one row a hash is kept of it, so the
join of quotes with originals has at most one partner each, however common a line is. Passages of all levels are joined; a
message answers the original of most characters (ties: the latest) at the shallowest level that finds one: deeper
levels are quotes of quotes, and count where the message between is missing or not quoted itself. Conversations
without any quote are parsed and not looked at again.

Threads are trees of answers. Roots and depths come from pointer doubling, places from the tour around each thread that goes
down into a message's answers in turn order and up again: its list of steps is ranked by doubling too. So the rounds grow with
the logarithm of a thread's size, and all tables have a row or two a message, however deep the quoting. Sorting by
conv_id, root_turn and place gives every conversation in reply order: each message is followed by its answers.

Defined results. Null text counts as empty. A message never answers itself or a later turn. Rows that repeat a
(conv_id, turn) share one parent, and their quotes count together. Rows without conv_id or turn are kept, unlinked. A line that
announces a quote ("... wrote:" right before it) belongs to the quote. What is quoted twice counts twice. Blank lines are no
evidence. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, Scratch, bounded_batches, cut, lean, small, table

_MARK = re.compile(r"[ \t]?((?:>[ \t]?)+)(.*)", re.S)
_SAYS = re.compile(r".*\bwrote:[ \t\r]*", re.S)
_AZ = str.maketrans(UPPER, LOWER)
GRAM = 5
WINDOW = 8


def normal(line: str) -> str:
    return " ".join(line.translate(_AZ).split())


def key_of(words: str) -> int:
    return xxhash.xxh3_64_intdigest(words.encode()) - 2**63


def runs(lines: Iterable[tuple[int, str]]) -> Iterator[tuple[int, list[str]]]:
    """(level, normalised lines) of the runs of one level; a blank line ends a run."""
    held: list[str] = []
    at = 0
    for level, line in lines:
        line = normal(line)
        if held and (level != at or not line):
            yield at, held
            held = []
        if line:
            held.append(line)
        at = level
    if held:
        yield at, held


def keys_of(lines: list[str]) -> list[tuple[int, int]]:
    """(key, characters) of a run's lines, of the run if it has several, and of its chosen grams."""
    out = [(key_of(x), len(x)) for x in lines]
    whole = " ".join(lines)
    if len(lines) > 1:
        out.append((key_of(whole), len(whole)))
    words = whole.split(" ")
    if len(words) >= GRAM + WINDOW - 1:
        grams = [" ".join(words[i : i + GRAM]) for i in range(len(words) - GRAM + 1)]
        hashes = [(key_of(g), i) for i, g in enumerate(grams)]
        chosen = {min(hashes[i : i + WINDOW]) for i in range(len(grams) - WINDOW + 1)}
        out += [(h, len(grams[i])) for h, i in sorted(chosen)]
    return out


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(text without quotes, quoted lines with their levels)."""
    if ">" not in text:
        return text, []
    own: list[str] = []
    quoted: list[tuple[int, str]] = []
    for line in text.split("\n"):
        if m := _MARK.fullmatch(line):
            if own and _SAYS.fullmatch(own[-1]):
                own.pop()
            quoted.append((m[1].count(">"), m[2]))
        else:
            own.append(line)
            quoted.append((0, ""))  # own lines part passages
    if not any(level for level, _ in quoted):
        return text, []
    return "\n".join(own).strip("\n"), quoted


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, max_level, n_quoted (lines), quoted: structs (level, key, n) of the passages."""
    quoted_type = pa.list_(pa.struct([("level", pa.int32()), ("key", pa.int64()), ("n", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, level, number, quotes = [], [], [], []
            for t in b.column(3):
                own, found = parse(t.as_py() or "")
                text.append(own)
                level.append(max((x for x, _ in found), default=0))
                number.append(sum(1 for x, line in found if x and normal(line)))
                quotes.append([{"level": x, "key": k, "n": n} for x, lines in runs(found) if x for k, n in keys_of(lines)])
            arrays = [pa.array(text, pa.string()), pa.array(level, pa.int32()), pa.array(number, pa.int64()), pa.array(quotes, quoted_type)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *arrays], names=["conv_id", "turn", "role", "text", "max_level", "n_quoted", "quoted"])

    bounded_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    return rows.mapInArrow(lean(work), "conv_id long, turn long, role string, text string, max_level int, n_quoted long, quoted array<struct<level:int,key:long,n:long>>")


def own_keys(named: DataFrame) -> DataFrame:
    """(conv_id, turn, key): the keys of the paragraphs of each message's own text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, turn, keys = [], [], []
            for c, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = {k for _, lines in runs((0, x) for x in text.as_py().split("\n")) for k, _ in keys_of(lines)}
                conv += [c] * len(own)
                turn += [t] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (conv, turn, keys)], names=["conv_id", "turn", "key"])

    return named.select("conv_id", "turn", "text").mapInArrow(lean(work), "conv_id long, turn long, key long")


#: Conversations (8 bytes each) up to which their ids are broadcast.
MANY = 1_000_000


def parents(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, matched) of the messages that quote an earlier one."""
    named = parsed.filter("conv_id is not null and turn is not null")
    quoted = named.select("conv_id", "turn", F.explode("quoted").alias("q"))
    quoted = cut(quoted.groupBy("conv_id", "turn", F.col("q.level").alias("level"), F.col("q.key").alias("key")).agg(F.sum("q.n").alias("n")), "quoted")
    talks = cut(quoted.select("conv_id").distinct(), "quoting")
    if not talks.head(1):
        return quoted.select("conv_id", "turn", F.col("turn").alias("parent"), F.col("n").alias("matched"))
    lines = own_keys(named.join(small(talks, MANY), "conv_id", "left_semi"))
    wanted = quoted.select("conv_id", "key").distinct()
    first = lines.groupBy("conv_id", "key").agg(F.min("turn").alias("parent")).join(wanted, ["conv_id", "key"], "left_semi")
    linked = quoted.join(first, ["conv_id", "key"]).filter("parent < turn")
    votes = linked.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("n").alias("matched"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("shallow"), "matched", "parent")).alias("best"))
    return cut(best.select("conv_id", "turn", F.col("best.parent").alias("parent"), F.col("best.matched").alias("matched")), "parents")


def _roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, top, depth): the root of each linked message and the links up to it, by pointer doubling."""
    state = links.select("conv_id", "turn", "parent", F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = state.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("_top"), F.col("depth").alias("_depth"))
        both = state.join(up, ["conv_id", "top"], "left")
        both = both.select("conv_id", "turn", "parent", F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_top").isNotNull().alias("moved"))
        both = cut(both, "roots")
        state = both.drop("moved")
        if not both.filter("moved").head(1):
            return state


def _places(rooted: DataFrame) -> DataFrame:
    """(conv_id, turn, place): places from 1 on of the linked messages in the tour around their thread; the root is 0.

    Steps are (turn, down): into a message, and out of it. A step into a message is followed by that into its first answer,
    or by the one out of it; a step out by that into the next answer of the same parent, or by the one out of the parent.
    What is summed from a step to the end of the tour is the number of messages that come from it on.
    """
    brothers = Window.partitionBy("conv_id", "parent").orderBy("turn")
    nodes = rooted.select("conv_id", "turn", "parent", "top", F.lead("turn").over(brothers).alias("_next"))
    first = rooted.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("_first"))
    nodes = nodes.join(first, ["conv_id", "turn"], "left")
    into = nodes.select("conv_id", "top", "turn", F.lit(True).alias("down"), F.coalesce("_first", "turn").alias("to"), F.col("_first").isNotNull().alias("to_down"), F.lit(1).cast("long").alias("n"))
    # the step out of the root is the end: it isn't in the table
    out = nodes.select("conv_id", "top", "turn", F.lit(False).alias("down"), F.coalesce("_next", "parent").alias("to"), F.col("_next").isNotNull().alias("to_down"), F.lit(0).cast("long").alias("n"))
    steps = cut(into.unionByName(out), "steps")
    while True:
        far = steps.select("conv_id", F.col("turn").alias("to"), F.col("down").alias("to_down"), F.col("to").alias("_to"), F.col("to_down").alias("_to_down"), F.col("n").alias("_n"))
        both = steps.join(far, ["conv_id", "to", "to_down"], "left")
        moved = F.col("_to").isNotNull()
        both = both.select("conv_id", "top", "turn", "down", F.coalesce("_to", "to").alias("to"), F.when(moved, F.col("_to_down")).otherwise(F.col("to_down")).alias("to_down"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), moved.alias("moved"))
        both = cut(both, "steps")
        steps = both.drop("moved")
        if not both.filter("moved").head(1):
            break
    size = steps.groupBy("conv_id", "top").agg(F.max("n").alias("_size"))
    return steps.filter("down").join(size, ["conv_id", "top"]).select("conv_id", "turn", (F.col("_size") - F.col("n") + 1).alias("place"))


def thread(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_quoted, max_level, parent_turn, root_turn, depth, place, a row for each input row."""
    with Scratch(conversations.sparkSession) as own:
        parsed = own.keep(cut(messages(conversations), "messages"))
        links = parents(parsed)
        zero = F.lit(0).cast("long")
        if not links.head(1):
            none = F.lit(None).cast("long")
            return parsed.select("conv_id", "turn", "role", "text", "n_quoted", "max_level", none.alias("parent_turn"), F.col("turn").alias("root_turn"), zero.alias("depth"), zero.alias("place"))
        rooted = _roots(links)
        found = own.keep(cut(rooted.join(_places(rooted), ["conv_id", "turn"]), "threads"))
        found = found.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "parent", "top", "depth", "place")
        both = parsed.join(found, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
        return both.select("conv_id", "turn", "role", "text", "n_quoted", "max_level", F.col("parent").alias("parent_turn"), F.coalesce("top", "turn").alias("root_turn"), F.coalesce("depth", zero).alias("depth"), F.coalesce("place", zero).alias("place"))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """The conversations without quotes, in reply order, by a distributed sort."""
    return thread(conversations).orderBy("conv_id", "root_turn", "place", "turn")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thread(table(spark, sf_dir, "conversations"))
