"""Edit-aware token counts: a tree of sums over the pre-tokens of each document, kept as a table; an edit encodes the touched leaves and their surroundings only.

`trees` encodes each text once and keeps, beside it, its leaves: about LEAF pre-tokens each, with their characters, pre-tokens and tokens. `edited` takes such a table and edits, builds the balanced
tree over the kept leaves without encoding anything, replaces the leaves that an edit touches, and returns the same kind of table, so edits can go on from there.

Pre-tokens are encoded one by one, so a count is the sum over them. The pattern reads from left to right: what follows a cut depends on the text behind it only. Behind an edit the old cuts hold again from the
first old leaf that starts at a new cut; before it, a cut stands if MARGIN characters and two whole pre-tokens lie between it and the edit. The literal end-of-text marker is one token and bounds the pre-tokens around it, as
in the tokenizer file (and in packing).

Defined cases: null text is empty (0 tokens); edits are clipped to the text, an end before the start counts as the start, a null start or end as the text's end, null replacement as empty, an empty replacement deletes. Edits
of a document apply by `seq`, then start, end and text, each to the text that the ones before left. Repeated rows and ids get a row each, and all edits of their id; a null doc_id has no edits; edits of unknown ids do nothing. No rows: no rows.
Only doc_id and text are read, and doc_id, seq, start, end, text of edits.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import chunks, texts
from tidegrid.llm.packing import MARKER, encoder

LEAF, MARGIN = 64, 2 * len(MARKER)
_CACHE = 200_000
LEAVES = "array<struct<chars:int,pieces:int,tokens:int>>"
EDITS = "array<struct<seq:bigint,start:bigint,end:bigint,text:string>>"


@functools.cache
def _pattern():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def pieces(text: str, at: int = 0) -> Iterator[tuple[int, str]]:
    """(end, pre-token) from a cut on; a marker is a pre-token."""
    while at < len(text):
        mark = text.find(MARKER, at)
        for m in _pattern().finditer(text, at, mark if mark >= 0 else len(text)):
            yield m.end(), m[0]
        if mark < 0:
            return
        at = mark + len(MARKER)
        yield at, MARKER


class Counter(dict):
    """Pre-token -> its number of tokens; remembered up to a fixed number of them."""

    def __init__(self, path: str):
        super().__init__({MARKER: 1})
        self.encode = encoder(path)._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece.encode()))
        if len(self) < _CACHE and len(piece) < 40:
            self[piece] = n
        return n


Sizes = tuple[int, int, int]  # characters, pre-tokens, tokens


def leaves(text: str, count: Counter) -> list[Sizes]:
    """Every LEAF pre-tokens of a whole text are a leaf."""
    found = [p for _, p in pieces(text)] if MARKER in text else _pattern().findall(text)
    if not found:
        return []
    at = np.arange(0, len(found), LEAF)
    chars, tokens = (np.add.reduceat(np.fromiter(map(f, found), np.int64, len(found)), at).tolist() for f in (len, count.__getitem__))
    return list(zip(chars, np.diff(np.append(at, len(found))).tolist(), tokens, strict=True))


class Node:
    """A leaf (with its text as a string and a range of it) or the sum of two nodes whose heights differ by at most one."""

    __slots__ = ("left", "right", "text", "start", "chars", "pieces", "tokens", "height")

    def __init__(self, left, right, text="", start=0, sizes: Sizes | None = None):
        self.left, self.right, self.text, self.start = left, right, text, start
        self.chars, self.pieces, self.tokens = sizes or (left.chars + right.chars, left.pieces + right.pieces, left.tokens + right.tokens)
        self.height = 0 if left is None else 1 + max(left.height, right.height)

    def leaves(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            x = stack.pop()
            if x.left is None:
                yield x
            else:
                stack += [x.right, x.left]


def _balanced(parts: list[Node]) -> Node | None:
    while len(parts) > 1:
        parts = [Node(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        if len(parts) > 1 and parts[-1].height < parts[-2].height - 1:  # an odd one out joins its neighbour
            parts[-2:] = [_joined(*parts[-2:])]
    return parts[0] if parts else None


def _pair(a: Node, b: Node) -> Node:
    """Nodes whose heights differ by two at most, side by side."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Node(a.left, Node(a.right, b))
        return Node(Node(a.left, a.right.left), Node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Node(Node(a, b.left), b.right)
        return Node(Node(a, b.left.left), Node(b.left.right, b.right))
    return Node(a, b)


def _joined(a: Node | None, b: Node | None) -> Node | None:
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return _pair(a.left, _joined(a.right, b))
    if b.height > a.height + 1:
        return _pair(_joined(a, b.left), b.right)
    return Node(a, b)


def _split(x: Node | None, place: int) -> tuple[Node | None, Node | None]:
    """Leaves that end at or before a place, and the others."""
    if x is None or place >= x.chars:
        return x, None
    if x.left is None:
        return None, x
    if place < x.left.chars:
        a, b = _split(x.left, place)
        return a, _joined(b, x.right)
    a, b = _split(x.right, place - x.left.chars)
    return _joined(x.left, a), b


def _edge(x: Node, last: bool) -> Node:
    while x.left is not None:
        x = x.right if last else x.left
    return x


class Tree:
    """The sums over a document's leaves; `encoded` counts the pre-tokens that edits have encoded."""

    def __init__(self, text: str, count: Counter, kept: Iterable[Sizes] | None = None):
        self.count, self.encoded, at, parts = count, 0, 0, []
        for sizes in leaves(text, count) if kept is None else kept:
            parts.append(Node(None, None, text, at, sizes))
            at += sizes[0]
        self.root = _balanced(parts)

    @property
    def total(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def n_pieces(self) -> int:
        return self.root.pieces if self.root else 0

    @property
    def text(self) -> str:
        return "".join(x.text[x.start : x.start + x.chars] for x in self.root.leaves()) if self.root else ""

    def sizes(self) -> list[Sizes]:
        return [(x.chars, x.pieces, x.tokens) for x in self.root.leaves()] if self.root else []

    def edit(self, a: int | None, b: int | None, new: str | None) -> None:
        """Replaces text[a:b] by new: work in proportion to the leaves around it and the logarithm of the number of leaves, as far as cuts move."""
        n, new = self.root.chars if self.root else 0, new or ""
        a, b = (n if x is None else max(0, min(x, n)) for x in (a, b))
        b = max(a, b)
        before, rest = _split(self.root, max(a - MARGIN, 0))
        whole = 0
        while before is not None and whole < 2:  # boundary context: two whole pre-tokens
            edge = _edge(before, True)
            before, _ = _split(before, before.chars - edge.chars)
            rest, whole = _joined(edge, rest), whole + edge.pieces
        start = before.chars if before else 0
        taken, rest = self._until(rest, b - start)
        old = "".join(x.text[x.start : x.start + x.chars] for x in taken)
        buffer = old[: a - start] + new + old[b - start :]
        done, at, more = [], 0, 1
        while True:
            held = len(buffer)
            for end, piece in pieces(buffer, at):
                if rest is not None and end + MARGIN > held:
                    break  # what follows may change this one
                done.append(piece)
                at = end
                # the next kept leaf starts at this cut
                if rest is not None and at == self._mark(buffer, taken, old, a - start, b - start, new, at):
                    break
            mark = self._mark(buffer, taken, old, a - start, b - start, new, at)
            if rest is None and at == held or mark == at:
                break
            fresh, rest = self._take(rest, more)
            taken += fresh
            add = "".join(x.text[x.start : x.start + x.chars] for x in fresh)
            old, buffer, more = old + add, buffer + add, 2 * more
        # leaves that were taken but lie behind the last cut stay as they are
        shift, place, kept = len(new) - (b - a), 0, []
        for x in taken:
            if place >= b - start and place + shift >= at:
                kept.append(x)
            place += x.chars
        fresh = []
        text, place = buffer[:at], 0
        for i in range(0, len(done), LEAF):
            part = done[i : i + LEAF]
            size = sum(map(len, part))
            fresh.append(Node(None, None, text, place, (size, len(part), sum(map(self.count.__getitem__, part)))))
            place += size
        self.encoded += len(done)
        self.root = _joined(_joined(before, _balanced(fresh + kept)), rest)

    @staticmethod
    def _until(x: Node | None, place: int) -> tuple[list[Node], Node | None]:
        """The leaves that start before a place (one at least), and the others."""
        taken: list[Node] = []
        held = 0
        while x is not None and (held < place or not taken):
            edge = _edge(x, False)
            _, x = _split(x, edge.chars)
            taken.append(edge)
            held += edge.chars
        return taken, x

    @staticmethod
    def _take(x: Node | None, n: int) -> tuple[list[Node], Node | None]:
        taken: list[Node] = []
        while x is not None and len(taken) < n:
            edge = _edge(x, False)
            _, x = _split(x, edge.chars)
            taken.append(edge)
        return taken, x

    @staticmethod
    def _mark(buffer: str, taken: list[Node], old: str, a: int, b: int, new: str, at: int) -> int:
        """at, if an old leaf behind the edit starts there (or the buffer ends), else -1."""
        place, shift = at - len(new) + (b - a), 0
        if place < b or at < a + len(new):
            return -1
        for x in taken:
            if shift == place:
                return at
            shift += x.chars
        return at if shift == place else -1


def _column(found: list[list[Sizes]]) -> pa.Array:
    """Each document's leaves as an Arrow list, from three flat columns."""
    flat = np.array([x for f in found for x in f], np.int32).reshape(-1, 3)
    offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], ["chars", "pieces", "tokens"]))


def trees(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, leaves, n_tokens: every document encoded once. Write it as a table to edit from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path)
        for whole in batches:
            for b in chunks(whole):
                found = [leaves(t, count) for t in texts(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), _column(found), pa.array([sum(x[2] for x in f) for f in found], pa.int64())], ["doc_id", "text", "leaves", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, text string, leaves {LEAVES}, n_tokens long")


def applied(kept: DataFrame, edits: Column, path: str) -> DataFrame:
    """A table of trees with each row's own edits (an array like EDITS): doc_id, text, leaves, n_tokens after them, n_before, n_pieces (before), n_encoded (pre-tokens encoded for the edits). Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path)
        order = lambda e: tuple((v is None, v) for v in (e["seq"], e["start"], e["end"], e["text"]))
        for whole in batches:
            for b in chunks(whole):
                after, sums, numbers = [], [], []
                for t, sizes, todo in zip(texts(b.column("text")), b.column("leaves").to_pylist(), b.column("edits").to_pylist(), strict=True):
                    tree = Tree(t, count, [(x["chars"], x["pieces"], x["tokens"]) for x in sizes or []])
                    start = tree.total, tree.n_pieces
                    for e in sorted(todo or [], key=order):
                        tree.edit(e["start"], e["end"], e["text"])
                    after.append(tree.text if todo else t)
                    sums.append(tree.sizes())
                    numbers.append((tree.total, *start, tree.encoded))
                columns = [pa.array(c, pa.int64()) for c in (zip(*numbers, strict=True) if numbers else [[]] * 4)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(after, pa.string()), _column(sums), *columns], ["doc_id", "text", "leaves", "n_tokens", "n_before", "n_pieces", "n_encoded"])

    return kept.select("doc_id", "text", "leaves", edits.cast(EDITS).alias("edits")).mapInArrow(run, f"doc_id long, text string, leaves {LEAVES}, n_tokens long, n_before long, n_pieces long, n_encoded long")


def edited(kept: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """A table of trees and a table of edits (doc_id, seq, start, end, text) -> as `applied`. Documents without edits pass through, and nothing of them is encoded."""
    one = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct("seq", "start", "end", "text").cast(EDITS[6:-1])).alias("edits"))  # bounded by one document's edits
    return applied(kept.join(one, "doc_id", "left"), F.col("edits"), path)


def stated_edits() -> Column:
    """The edits of the query: a word in the middle replaced, a line added in front, the last ten characters deleted."""
    n = F.length(F.coalesce(F.col("text"), F.lit("")))
    row = lambda *v: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(k) for k, x in zip(("seq", "start", "end", "text"), v, strict=True)])
    return F.array(row(1, F.floor(n / 2), F.floor(n / 2) + 7, " revised"), row(2, F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), "Note:\n"), row(3, n.cast("bigint") - 9, n.cast("bigint") + 1, ""))


def counted(docs: DataFrame, path: str, edits: Callable[[], Column] = stated_edits, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """doc_id, n_tokens, n_after, n_pieces, n_encoded: the trees of all documents are made and stored, the edits then made from the stored trees."""
    out = applied(store(trees(docs, path)), edits(), path)
    return out.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_after"), "n_pieces", "n_encoded")
