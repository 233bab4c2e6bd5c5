"""Repeated passages: every byte covered by a string of LENGTH bytes that starts earlier too, by merged Burrows-Wheeler transforms.

A transform of all suffixes of a corpus has no place in one task, so only text that can repeat is sorted, in pieces that are independent of each other:

1. Each window of LENGTH bytes is named by its least GRAM-byte gram (leftmost of equals). Windows in a row with the same gram form a phrase. Equal windows have equal grams at equal offsets, so
   a gram that occurs once rules its windows out, and only phrases of one gram need comparison (as in prefix-free parsing). Nothing is lost.
2. Of equal phrases of a gram the first stays; all windows of the others start earlier too. The distinct phrases of grams with several are the dictionary. Phrases count as equal if the 64-bit hashes of
   both their grams and of themselves are, parts (4.) by 128 bits.
3. The dictionary is split by gram. In a task it is cut into shards; each shard's suffixes are sorted once and give its transform. The shards are merged by iterative interleave refinement: after round
   k the interleaving is that of all suffixes ordered by their first 2k bytes, and a bit says where these differ from the ones before. After LENGTH / 2 rounds the runs without a bit are the
   intervals of common prefixes of LENGTH or more: the repeated windows. Suffixes are never sorted across shards.
   A window that two phrases share holds their gram and LENGTH - GRAM more bytes, at least half of these on one side; a phrase that agrees with no other on either half is left out before sorting.
4. No task gets more than CROWD distinct phrases of one gram. The windows of a gram that has more (a passage in a great share of all documents, each with its own surroundings) are dealt out by how many
   bytes they have before the gram: the windows of either half of that range hold a longer gram, by which they are grouped anew. Equal parts collapse to their first, longer grams that occur once fall away,
   and what is left is sorted like any other gram's phrases, or halved again; a range of one is a whole window, so at most log2(LENGTH - GRAM) + 1 rounds follow.

Order is by doc_id, then by a hash of the text for rows that share a doc_id, then by position. Defined cases: null text is empty; texts under LENGTH bytes lose nothing; rows equal in doc_id and
text count as one row and get equal results; a null doc_id is ordered last. No rows: no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import remove, staged, utf8

LENGTH, GRAM, CROWD = 100, 32, 1_000
SEGMENT, SHARD, MERGE = 1 << 19, 1 << 16, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def phrases(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: row, start in the text, number of windows + (length + 1) * the gram's offset, hash of the gram, hash of the phrase. At most SEGMENT + length bytes at once, or one text's segment."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    up, down = _powers(1 << (n + 1).bit_length())
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])))
        g = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        bits = np.uint64(21)
        m = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
        step, wide = 1, length - gram + 1
        while 2 * step <= wide:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < wide:
            m = np.minimum(m[: len(m) - (wide - step)], m[wide - step :])
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: n - length + 1]
        ok = np.flatnonzero(np.arange(n - length + 1) + length <= off[1:][row])
        if not len(ok):
            return phrases(data[:0], off[:1])
        at = (m[ok] & np.uint64((1 << 21) - 1)).astype(np.int64)
        new = np.concatenate(([True], (np.diff(at) != 0) | (np.diff(ok) != 1) | (np.diff(row[ok]) != 0)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(ok)])) - 1
        s, e, p = ok[first], ok[last], at[first]
        whole = _mix((sums[e + length] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (p - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return row[s], s - off[row[s]], e - s + 1 + (length + 1) * (p - s), g[p].view(np.int64), whole.view(np.int64)


def _segments(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, starts) of bounded size: many whole short texts, or overlapping parts of a long one."""
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > SEGMENT:
            for a in range(0, int(off[i + 1] - off[i]), SEGMENT):
                part = data[off[i] + a : min(off[i] + a + SEGMENT + length - 1, off[i + 1])]
                yield part, np.array([0, len(part)]), np.array([i]), np.array([a])
            i += 1
            continue
        j = i + 1
        while j < n and off[j + 1] - off[i] <= SEGMENT:
            j += 1
        yield data[off[i] : off[j]], off[i : j + 1] - off[i], np.arange(i, j), np.zeros(j - i, np.int64)
        i = j


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of a shard (places in the strings laid end to end, each closed by an end mark below all bytes and ordered by string) and its transform: the two bytes before each suffix."""
    text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int64) + 1, 0) for s in strings])
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + len(strings))
    step = 1
    while True:
        far = np.zeros(n, np.int64)
        far[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + len(strings) + 300) + np.where(rank < len(strings), 0, far)  # an end mark decides
        order = np.argsort(key)  # equal keys get one rank, so their order is free
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order, np.stack((np.roll(text, 2)[order], np.roll(text, 1)[order])).astype(np.uint16)


def merged(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement of transforms to prefixes of `depth`: for each place the suffix (counted over the shards laid end to end), and the number of its interval of equal prefixes.

    A transform holds the two bytes before each suffix, so a round refines by two; an odd depth begins with a round of one.
    """
    far, near = np.concatenate([b for _, b in shards], axis=1)
    base = 256 if max(far.max(initial=0), near.max(initial=0)) < 256 else 257  # UTF-8 has no byte 255
    narrow = np.uint16 if base == 256 else np.uint32
    n = len(near)
    small = np.uint8 if len(shards) <= 256 else np.uint16
    start = np.repeat(np.arange(len(shards), dtype=small), [b.shape[1] for _, b in shards])
    z, block, new = start, np.zeros(n, np.int32), np.ones(n, bool)
    rounds = [(near, 0)] * (depth % 2) + [(far.astype(narrow) * narrow(base) + near, base)] * (depth // 2)
    known = None
    for chars, wide in rounds:
        if known is None or known[0] is not chars:
            # suffixes whose first bytes hold an end mark are all different, ordered by shard from the start
            own = np.where(chars < wide, chars.dtype.type(0), chars) if wide else chars
            by = np.argsort(own, kind="stable")
            c = own[by]
            done = np.flatnonzero((c % wide == 0) if wide else (c == 0))
            known = chars, c[1:] != c[:-1], done, start[by][done]
            here = np.empty(n, chars.dtype)
        _, edge, done, settled = known
        here[np.argsort(z, kind="stable")] = chars
        order = np.argsort(here, kind="stable")
        b = block[order]
        np.not_equal(b[1:], b[:-1], out=new[1:])
        new[1:] |= edge
        new[done] = True
        z = z[order]
        z[done] = settled
        block = np.cumsum(new, dtype=np.int32)
        if block[-1] == n:
            break
    which = np.empty(n, np.int64)
    which[np.argsort(z, kind="stable")] = np.arange(n)
    return which, block


def repeats(strings: list[bytes], where: list[tuple[int, int, int]], length: int = LENGTH, shard: int = SHARD) -> list[tuple[int, int, int]]:
    """(string, first, last) runs of windows of `length` that start earlier in another string; where: (doc, hash, start) of each string."""
    groups, held = [[]], 0
    for k, s in enumerate(strings):
        if held > shard:
            groups.append([])
            held = 0
        groups[-1].append(k)
        held += len(s) + 1
    shards, owner, place = [], [], []
    for g in groups:
        order, bwt = transform([strings[k] for k in g])
        sizes = [len(strings[k]) + 1 for k in g]
        own = np.repeat(np.array(g), sizes)
        at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        shards.append((order, bwt))
        owner.append(own[order])
        place.append(at[order])
    which, block = merged(shards, length)
    own, at = np.concatenate(owner)[which], np.concatenate(place)[which]
    sizes = np.array([len(s) for s in strings])
    ok = at + length <= sizes[own]
    many = np.bincount(block, weights=ok) > 1
    own, at, block = (x[ok & many[block]] for x in (own, at, block))
    if not len(own):
        return []
    doc, tie, start = np.array(where, np.int64).reshape(-1, 3).T
    order = np.lexsort((start[own] + at, tie[own], doc[own], block))
    own, at, block = own[order], at[order], block[order]
    lead = np.maximum.accumulate(np.where(np.concatenate(([True], block[1:] != block[:-1])), np.arange(len(block)), 0))
    differs = lambda v: v != v[lead]
    late = differs(doc[own]) | differs(tie[own]) | differs(start[own] + at)  # equal rows bring the same place twice
    own, at = own[late], at[late]
    order = np.lexsort((at, own))
    own, at = own[order], at[order]
    cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))))
    end = np.concatenate((cut[1:], [len(own)])) - 1
    return list(zip(own[cut].tolist(), at[cut].tolist(), at[end].tolist(), strict=True)) if len(own) else []


def comparable(strings: list[bytes], at: list[int], length: int = LENGTH, gram: int = GRAM) -> list[int]:
    """Of phrases of one gram, at these offsets, those that share half of the bytes around it, on one side, with another: no other pair can share a window."""
    half = (length - gram + 1) // 2
    left = [s[q - half : q + gram] if q >= half else None for s, q in zip(strings, at, strict=True)]
    right = [s[q : q + gram + half] if q + gram + half <= len(s) else None for s, q in zip(strings, at, strict=True)]
    lefts, rights = Counter(left), Counter(right)
    return [k for k in range(len(strings)) if (left[k] is not None and lefts[left[k]] > 1) or (right[k] is not None and rights[right[k]] > 1)]


def _docs(docs: DataFrame) -> DataFrame:
    """d, x, text, doc_id. x, the tie break, is a hash of the text where rows share a doc_id and else 0, which costs next to nothing in the tables and shuffles of phrases."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    shared = staged(rows.groupBy("d").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")  # as a table its size is known, so the planner broadcasts it only where it is small
    return rows.join(shared, "d", "left").select("d", F.when(F.col("c").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("x"), "text", "doc_id")


def _halves(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Phrases whose windows have lo .. hi bytes before the gram -> the parts of both halves of that range, each under the longer gram that all its windows hold."""
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        got = []
        for d, x, s, q, lo, hi, raw in zip(*(batch.column(c).to_pylist() for c in ("d", "x", "s", "q", "lo", "hi", "bytes")), strict=True):
            n, mid = len(raw) - length + 1, (lo + hi) // 2
            for a, b in ((lo, mid), (mid + 1, hi)):
                least, most = max(a, q - n + 1), min(b, q)
                if a <= b and least <= most:
                    part = raw[q - most : q - least + length]
                    g = xxhash.xxh3_64_intdigest(raw[q - a : q + length - b], a * 256 + b) - (1 << 63)
                    got.append((g, xxhash.xxh3_128_digest(part), d, x, s + q - most, most, a, b, part))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*got, strict=True) if got else [[]] * 9, kinds, strict=True)], ["g", "p", "d", "x", "s", "q", "lo", "hi", "bytes"])


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(d, x, a, b): byte ranges to remove, of the row with order keys d and x; they overlap."""
    keyed = _docs(docs)
    bits = ((length + 1) ** 2).bit_length()  # sn: a phrase's start, then its windows and its gram's offset in so many bits; one number is shuffled for both
    start, size = F.shiftright("sn", bits), F.col("sn").bitwiseAND((1 << bits) - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            d, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "x"))
            for part, o, rows, starts in _segments(data, off, length):
                row, s, n, g, p = phrases(part, o, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (g, p, d[rows[row]], x[rows[row]], (s + starts[row]) << bits | n)], ["g", "p", "d", "x", "sn"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for part, o, _, _ in _segments(data, off, length):
                g, n = np.unique(phrases(part, o, length, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], ["g", "n"])

    # grams first, by themselves: the wide rows of phrases are made in the task that deals them out and are never a table
    grams = keyed.select("text").mapInArrow(named, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    twice = staged(grams.where("n > 1").select("g"), "twice")  # as a table, so that the join's skewed partitions can be split
    every = keyed.select("d", "x", "text").mapInArrow(cut, "g long, p long, d long, x long, sn long")
    found = staged(every.join(twice, "g"), "repeated")
    remove(twice)
    firsts = staged(found.groupBy("g", "p").agg(F.min(F.struct("d", "x", "sn")).alias("f")), "firsts")
    later = found.join(firsts.select("g", "p", F.col("f.d").alias("fd"), F.col("f.x").alias("fx"), F.col("f.sn").alias("fsn")), ["g", "p"])
    later = [later.where("d <> fd or x <> fx or sn <> fsn").select("d", "x", start.alias("a"), (start + size % (length + 1) + length - 1).alias("b"))]
    several = staged(firsts.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "several")
    wanted = firsts.join(several, "g").select("g", "c", "f.*").groupBy("d", "x").agg(F.collect_list(F.struct("g", "c", start.alias("s"), size.alias("n"))).alias("w"))  # a text's phrases: bounded by the text

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            data, off = utf8(batch.column("text"))
            d, x = (batch.column(c).to_pylist() for c in ("d", "x"))
            got, held = [], 0
            for i, w in enumerate(batch.column("w").to_pylist()):
                for q in w:
                    raw = data[off[i] + q["s"] : off[i] + q["s"] + q["n"] % (length + 1) + length - 1].tobytes()
                    got.append((q["g"], q["c"], d[i], x[i], q["s"], q["n"] // (length + 1), raw))
                    held += len(raw)
                    if held > SEGMENT:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*got, strict=True), kinds, strict=True)], ["g", "c", "d", "x", "s", "q", "bytes"])
                        got, held = [], 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*got, strict=True), kinds, strict=True)], ["g", "c", "d", "x", "s", "q", "bytes"])

    dictionary = staged(keyed.select("d", "x", "text").join(wanted, ["d", "x"]).mapInArrow(fetch, "g long, c long, d long, x long, s long, q long, bytes binary"), "dictionary")
    columns = ["g", "d", "x", "s", "bytes", "q"]
    few = [dictionary.where(F.col("c") <= crowd).select(*columns)]
    many = dictionary.where(F.col("c") > crowd).withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)})
    crowds = several.where(F.col("c") > crowd)
    while crowds.take(1):  # as many rounds as the logarithm of length - gram at most
        parts = staged(many.select(*columns, "lo", "hi").mapInArrow(functools.partial(_halves, length=length, gram=gram), "g long, p binary, d long, x long, s long, q long, lo int, hi int, bytes binary"), "parts")
        leads = staged(parts.groupBy("g", "p").agg(F.min(F.struct("d", "x", "s", "q", "lo", "hi", "bytes")).alias("f")), "leads")
        own = parts.join(leads.select("g", "p", F.struct("f.d", "f.x", "f.s").alias("f")), ["g", "p"])
        later.append(own.where("struct(d, x, s) <> f").select("d", "x", F.col("s").alias("a"), (F.col("s") + F.octet_length("bytes")).alias("b")))
        several = staged(leads.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "several")
        dictionary = leads.join(several, "g").select("g", "c", "f.*")
        few.append(dictionary.where(F.col("c") <= crowd).select(*columns))
        many, crowds = dictionary.where(F.col("c") > crowd), several.where(F.col("c") > crowd)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        same: list[tuple] = []
        size, g = 0, None

        def out() -> pa.RecordBatch:
            got = [(held[k][0], held[k][1], held[k][2] + a, held[k][2] + b + length) for k, a, b in repeats([h[3] for h in held], [h[:3] for h in held], length)] if held else []
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*got, strict=True) if got else [[]] * 4)], ["d", "x", "a", "b"])

        def close() -> int:
            kept = [same[k] for k in comparable([h[3] for h in same], [h[4] for h in same], length, gram)]
            held.extend(kept)
            same.clear()
            return sum(len(h[3]) for h in kept)

        for batch in batches:
            for gram_, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "d", "x", "s", "bytes", "q")), strict=True):
                if gram_ != g:
                    size += close()
                    if size > MERGE:
                        yield out()
                        held.clear()
                        size = 0
                g = gram_
                same.append(tuple(row))
        close()
        yield out()

    sorted_out = reduce(DataFrame.unionByName, few).repartition("g").sortWithinPartitions("g").mapInArrow(sort, "d long, x long, a long, b long")
    return reduce(DataFrame.unionByName, [*later, sorted_out])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), spans (array of removed [a, b))."""
    ranges = spans(docs, length).groupBy("d", "x").agg(F.collect_list(F.struct("a", "b")).alias("r"))  # a text's ranges: bounded by the text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            out = []
            for i, r in enumerate(batch.column("r").to_pylist()):
                own = data[off[i] : off[i + 1]]
                step = np.zeros(len(own) + 1, np.int32)
                if r:
                    np.add.at(step, [q["a"] for q in r], 1)
                    np.add.at(step, [q["b"] for q in r], -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = own[~gone].tobytes()
                out.append((len(own), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), kept, edge.reshape(-1, 2).tolist()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    joined = _docs(docs).join(ranges, ["d", "x"], "left").select("doc_id", "text", "r")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<bigint>>")
