"""Benchmark decontamination by pigeonhole edit matching.

Items and texts are normalised (lower case, white space as single blanks). An item of n characters may differ from some passage of a text in k = floor(rate * n) edits; it is cut into
k + 1 pieces, one of which any such passage holds unchanged. Aho-Corasick finds all pieces in a whole text in one pass; around the hits Myers' bit-parallel algorithm computes the
least distance of the whole item to any passage. Items come in blocks of bounded number and size, one pass over the documents for each block, so neither what tasks get nor what the driver holds grows with either table; the passes grow with the items.

Defined cases: null and empty texts match nothing; items that are null, empty or blank match nothing; equal items are found each under its own id (a null id too); repeated rows of
documents give a row each. No rows on either side: no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import chunks, remove, staged, texts

#: Edits as a share of an item, items and characters of them that one pass over the documents looks for.
RATE, BLOCK, BLOCK_BYTES = 0.08, 5_000, 8 << 20


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of item to any passage of text, and where that passage first ends; None if over `most`."""
    m = len(item)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    ones, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = ones, 0, m, None
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (ones & ~(diagonal | up)), up & diagonal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & ones, (minus << 1) & ones  # a passage may start anywhere: no carry into row 0
        up, down = minus | (ones & ~((eq | down) | plus)), plus & (eq | down)
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


class Matcher:
    """Finds a block of (item_id, normalised text) in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, t, k) in enumerate(self.items):
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places[t[a:b]].append((at, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def find(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end in the normalised text) of each item within its budget."""
        if not self.any or not text:
            return []
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(text):
            for at, offset in where:
                _, t, k = self.items[at]
                a = end + 1 - size - offset - k
                b = a + len(t) + 2 * k
                spans = windows[at]
                if spans and a <= spans[-1][1] and b >= spans[-1][0]:
                    spans[-1] = [min(a, spans[-1][0]), max(b, spans[-1][1])]
                else:
                    spans.append([a, b])
        out = []
        for at, spans in windows.items():
            i, t, k = self.items[at]
            best = None
            for a, b in spans:
                part = text[max(a, 0) : max(b, 0)]
                exact = part.find(t)
                got = (0, exact + len(t)) if exact >= 0 else myers(t, part, k) if len(part) >= len(t) - k else None
                if got and (best is None or got[0] < best[0]):
                    best = got[0], max(a, 0) + got[1]
                if best and best[0] == 0:
                    break
            if best:
                out.append((i, *best))
        return out


def _blocks(benchmark: DataFrame, block: int, size: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of at most `block` rows and about `size` characters (a longer item is a block of its own); the driver holds one block and one partition of the items at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator()
    held: list[tuple[int | None, str]] = []
    many = 0
    for i, x in rows:
        if not (t := normalised(x)):
            continue
        if held and (len(held) == block or many + len(t) > size):
            yield held
            held, many = [], 0
        held.append((i, t))
        many += len(t)
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, distance, end. With several blocks each one's rows are written before the next is fetched."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, end int"

    def of(items: list[tuple[int | None, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for whole in batches:
                for b in chunks(whole):
                    found = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True) for hit in matcher.find(normalised(t))]
                    columns = zip(*found, strict=True) if found else [[], [], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "distance", "end"])

        return rows.mapInArrow(run, schema)

    out, last = [], None
    for items in _blocks(benchmark, block):
        if last is not None:
            out.append(staged(of(last), "found"))
        last = items
    out.append(of(last) if last is not None else docs.sparkSession.createDataFrame([], schema))
    return reduce(DataFrame.unionByName, out)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no item, with the same columns; no join and no shuffle. With several blocks what one has left is written before the next is fetched."""

    def without(df: DataFrame, items: list[tuple[int | None, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for whole in batches:
                for b in chunks(whole):
                    yield b.filter(pa.array([not matcher.find(normalised(t)) for t in texts(b.column("text"))], pa.bool_()))

        return df.mapInArrow(run, docs.schema)

    left, last = docs, None
    for items in _blocks(benchmark, block):
        if last is not None:
            after = staged(without(left, last), "left", "snappy")
            if left is not docs:
                remove(left)
            left = after
        last = items
    return without(left, last) if last is not None else docs
