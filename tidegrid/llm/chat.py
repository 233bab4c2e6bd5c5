"""Chat formatting by quotation linking: quoted passages are parsed by level, hashed after normalisation, joined to the message that first said them, and the replies put in reading order.

A message is linked to the message that said the passage it quotes: of the least quoted level the one said last in its own conversation, else the first occurrence in another conversation. A passage counts
whole, and each line and sentence of it, so that a quotation with a change in it links through the rest; towards other conversations only units of FAR_WORDS words or more count, as short ones are said everywhere.

Links form trees that may span conversations. Their reading order (each reply below what it answers, replies to one message by conversation and turn) is the Euler tour of the tree: each message is entered and left once, each such event
points to the one before it, and pointers double until all reach the start, which gives root, depth and position together. Rounds are the logarithm of the longest tour; no conversation, tree or list of siblings is ever gathered in a task.

Defined cases: null or empty text is an empty body without quotes; a passage that nobody said earlier links to nothing; links in a circle (conversations that quote each other) leave out the one of the circle's smallest message in the order,
whose parent columns stay. Rows that share (conv_id, turn) are messages of their own, told apart by role and text; wholly equal rows get equal results. Rows with a null conv_id or turn have no parent and are nobody's. No rows: no rows. Only conv_id, turn, role
and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import chunks, remove, staged, texts

QUOTE = re.compile(r"^((?:[ \t]*>)+)[ \t]?(.*)$")
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
WORD = re.compile(r"\w+")
#: Least words of a unit that links to another conversation, and of a sentence that links at all.
FAR_WORDS, SENTENCE_WORDS = 4, 4
KEY = "struct<c:bigint,t:bigint,x:bigint>"


def units(passage: str) -> dict[int, int]:
    """Hash of each normalised unit of a passage (whole, paragraphs, lines, longer sentences) -> its words."""
    out = {}
    lines = passage.split("\n")
    sentences = [s for x in lines for s in SENTENCE.split(x)]
    for kind, found in enumerate(((passage, *passage.split("\n\n")), lines, sentences)):
        for x in found:
            words = WORD.findall(x.lower())
            if len(words) >= (SENTENCE_WORDS if kind == 2 else 1):
                out[xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)] = len(words)
    return out


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages as (level, passage): lines in a row of one level are a passage."""
    body, quoted, lines = [], [], []
    before = 0
    for line in text.split("\n"):
        m = QUOTE.match(line) if ">" in line else None
        level = m[1].count(">") if m else 0
        if not level:
            body.append(line)
        elif level == before:
            lines.append(m[2])
        else:
            lines = [m[2]]
            quoted.append((level, lines))
        before = level
    return "\n".join(body).strip(), [(k, "\n".join(x)) for k, x in quoted]


def _said(messages: DataFrame) -> DataFrame:
    """m (key; null without conv_id or turn), conv_id, turn, role, body, n_quotes (passages), quotes (level, hash, words of their units), own (hashes of what the body says)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64()), ("words", pa.int32())]))
        for whole in batches:
            for b in chunks(whole):
                bodies, many, quotes, own = [], [], [], []
                for t in texts(b.column("text")):
                    body, quoted = parse(t)
                    bodies.append(body)
                    many.append(len(quoted))
                    quotes.append([{"level": k, "h": h, "words": n} for k, p in quoted for h, n in units(p).items()])
                    own.append(sorted(units(body)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "turn", "role", "x")), pa.array(bodies, pa.string()), pa.array(many, pa.int64()), pa.array(quotes, kind), pa.array(own, pa.list_(pa.int64()))], ["conv_id", "turn", "role", "x", "body", "n_quotes", "quotes", "own"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("x", F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    out = rows.mapInArrow(run, "conv_id long, turn long, role string, x long, body string, n_quotes long, quotes array<struct<level:int,h:long,words:int>>, own array<bigint>")
    key = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("x")))
    return out.select(key.alias("m"), "conv_id", "turn", "role", "body", "n_quotes", "quotes", "own")


def _parents(said: DataFrame) -> DataFrame:
    """(m, p): each linked message and the one it answers."""
    asked = said.where("m is not null").select("m", F.explode("quotes").alias("q")).select("m", "q.level", "q.h", "q.words").distinct()
    sought = asked.select("h").distinct()  # only passages that are quoted somewhere go on: a common line that nobody quotes costs nothing
    lines = said.where("m is not null").select("m", F.explode("own").alias("h")).join(sought, "h", "left_semi")
    here = lines.groupBy(F.col("m.c").alias("c"), "h").agg(F.min("m").alias("at"))
    anywhere = here.groupBy("h").agg(F.min("at").alias("f"))
    # the first occurrence outside the conversation of the first one, for quotations in that conversation itself
    elsewhere = here.join(anywhere, "h").where(F.col("c") != F.col("f.c")).groupBy("h").agg(F.min("at").alias("g"))
    linked = asked.withColumn("c", F.col("m.c")).join(here, ["c", "h"], "left").join(anywhere.join(elsewhere, "h", "left"), "h", "left")
    inside = F.when(F.col("at.t") < F.col("m.t"), F.col("at"))
    outside = F.when(F.col("words") >= FAR_WORDS, F.when(F.col("f.c") != F.col("c"), F.col("f")).otherwise(F.col("g")))
    near = F.min(F.when(inside.isNotNull(), F.struct(F.col("level"), (-F.col("at.t")).alias("k"), inside.alias("p"))))
    far = F.min(F.when(outside.isNotNull(), F.struct(F.col("level"), (-F.col("words")).alias("k"), outside.alias("p"))))
    return linked.groupBy("m").agg(near.alias("near"), far.alias("far")).select("m", F.coalesce("near.p", "far.p").alias("p")).where("p is not null")


def _without_circles(links: DataFrame) -> DataFrame:
    """links without that of the smallest message of each circle. A link to an earlier (conversation, turn) alone closes none, so without others nothing is done."""
    if not links.where("p >= m").take(1):
        return links
    now = staged(links.select("m", F.col("p").alias("to"), F.col("p").alias("least")), "circles")
    while True:  # least: the smallest of the next 2 ** k messages on the way up; stable when all ways that go on are circles seen whole
        a, b = now.alias("a"), now.alias("b")
        moved = a.join(b, F.col("a.to") == F.col("b.m")).select("a.m", F.col("b.to").alias("to"), F.least("a.least", "b.least").alias("least"), (F.col("b.least") < F.col("a.least")).alias("news"))
        after = staged(moved, "circles")
        settled = after.agg(F.count(F.lit(1)), F.max("news")).first()
        done = not settled[0] or (not settled[1] and settled[0] == now.count())
        remove(now)
        now = after.drop("news")
        if done:
            break
    cut = now.where("m = least").select("m")
    return links.join(cut, "m", "left_anti")


def _next_siblings(links: DataFrame) -> DataFrame:
    """(m, beside): of messages that answer the same one, the next in order. Rows are dealt out by ranges of (p, m), so a message with any number of answers is spread over tasks; the first row of each range goes to the one before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            rows = list(zip(b.column("p").to_pylist(), b.column("m").to_pylist(), strict=True))
            out = []
            for p, m in rows:
                if last is not None:
                    out.append((*last, m if last[0] == p else None, None, None))
                else:
                    out.append((p, m, None, part, True))
                last, first = (p, m), False
            if out:
                yield _batch(out)
        if not first:
            yield _batch([(*last, None, part, False)])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        key = pa.struct([("c", pa.int64()), ("t", pa.int64()), ("x", pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), (key, key, key, pa.int32(), pa.bool_()), strict=True)], ["p", "m", "beside", "part", "head"])

    ranged = links.select("p", "m").repartitionByRange("p", "m").sortWithinPartitions("p", "m")
    found = staged(ranged.mapInArrow(run, f"p {KEY}, m {KEY}, beside {KEY}, part int, head boolean"), "beside")
    edges = found.where("part is not null").select("part", "head", "p", "m").collect()  # two rows for each partition
    heads = sorted(((r.part, r.p, r.m) for r in edges if r.head), key=lambda r: r[0])
    after = {r[0]: heads[i + 1][1:] for i, r in enumerate(heads[:-1])}
    fixed = [(r.m, after[r.part][1]) for r in edges if not r.head and r.part in after and after[r.part][0] == r.p]
    across = links.sparkSession.createDataFrame(fixed, f"m {KEY}, beside {KEY}")
    return found.where("beside is not null").select("m", "beside").unionByName(across)


def _order(links: DataFrame) -> DataFrame:
    """(m, root, depth, position) of all messages that answer or are answered."""
    beside = _next_siblings(links)
    first = links.groupBy(F.col("p").alias("m")).agg(F.min("m").alias("child"))
    nodes = links.select("m").unionByName(links.select(F.col("p").alias("m"))).distinct()
    every = staged(nodes.join(first, "m", "left").join(links, "m", "left").join(beside, "m", "left"), "nodes")
    event = lambda m, leaves: F.struct(m.alias("m"), F.lit(leaves).alias("leaves"))
    enter, leave = event(F.col("m"), False), event(F.col("m"), True)
    into = F.when(F.col("child").isNotNull(), event(F.col("child"), False)).otherwise(leave)
    out = F.when(F.col("beside").isNotNull(), event(F.col("beside"), False)).when(F.col("p").isNotNull(), event(F.col("p"), True))
    steps = every.select(F.explode(F.array(F.struct(enter.alias("before"), into.alias("e")), F.struct(leave.alias("before"), out.alias("e")))).alias("s")).select("s.*").where("e is not null")
    starts = every.where("p is null").select(F.lit(None).cast(f"struct<m:{KEY},leaves:boolean>").alias("before"), enter.alias("e"))
    seen, deep = F.when(~F.col("before.leaves"), 1).otherwise(0), F.when(F.col("before.leaves"), -1).when(~F.col("before.leaves"), 1).otherwise(0)
    now = staged(steps.unionByName(starts).select("e", "before", F.coalesce("before", "e").alias("first"), seen.cast("long").alias("position"), deep.cast("long").alias("depth")), "tour")
    while now.where("before is not null").take(1):
        a, b = now.alias("a"), now.alias("b")
        sums = [(F.col(f"a.{c}") + F.coalesce(f"b.{c}", F.lit(0))).alias(c) for c in ("position", "depth")]
        after = staged(a.join(b, F.col("a.before") == F.col("b.e"), "left").select("a.e", "b.before", F.coalesce("b.first", "a.first").alias("first"), *sums), "tour")
        remove(now)
        now = after
    return now.where("not e.leaves").select("e.m", F.col("first.m").alias("root"), "depth", "position")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, parent_conv, parent_turn, root_conv, root_turn, depth, position: order by root_conv, root_turn, position to read each conversation without quotes, replies below what they answer."""
    said = staged(_said(messages), "messages")
    links = staged(_parents(said), "parents")
    out = said.join(links, "m", "left")
    if links.take(1):
        order = staged(_order(staged(_without_circles(links), "links")), "order")
        out = out.join(order, "m", "left")
    else:
        out = out.withColumns({"root": F.lit(None).cast(KEY), "depth": F.lit(0), "position": F.lit(0)})
    return out.select(
        "conv_id", "turn", "role", "body", "n_quotes", F.col("p.c").alias("parent_conv"), F.col("p.t").alias("parent_turn"),
        F.coalesce("root.c", "conv_id").alias("root_conv"), F.coalesce("root.t", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("position", F.lit(0)).cast("long").alias("position"),
    )
