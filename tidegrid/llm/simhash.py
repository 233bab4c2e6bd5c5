"""SimHash near-duplicates: fingerprints of word shingles, linked within a few bits by the pigeonring principle.

`fingerprints` gives one 64-bit fingerprint a document, `links` all pairs of classes of equal fingerprints within `bits` bits, `near_duplicates` a component for each document.

Defined cases: null and empty texts and texts without words have the fingerprint zero, linked like any other. Rows with the same doc_id are rows of their
own. A null doc_id keeps its row and takes part; component_id is the smallest doc_id that isn't null (null if there is none). No rows: no rows.
Columns other than doc_id and text are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import overlap
from tidegrid.llm.common import new_name, staged, utf8
from tidegrid.llm.components import components

#: Fingerprints in a bucket that are compared pair by pair; a larger bucket is dealt out to finer ones.
BUCKET = 64
#: Bits within which fingerprints of sets are compared on their sets.
NEAR = 4


def simhash(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of UTF-8 bytes: A-Z lower-cased, words between ASCII white space, shingles with repeats, bit set if in over half of the XXH64."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = list(zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, 8192):
        got = b"".join([digest(joined[a:b], seed) for a, b in spans[at : at + 8192]])
        counts += np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            found = np.array([simhash(data[x:y].tobytes(), shingle, seed) for x, y in zip(off[:-1], off[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ring(places: list[int], bits: int) -> list[list[int]]:
    """A ring of bit places in 2 * bits + 1 segments of neighbours. With so many, every chain of two neighbouring segments has a budget below 1."""
    m = 2 * bits + 1
    cuts = [len(places) * i // m for i in range(m + 1)]
    return [places[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(places: Iterable[int]) -> int:
    x = sum(1 << j for j in places)
    return x - (1 << 64) if x >> 63 else x


def _paths(bits: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """For each level the paths (parent, path, first start, mask of the places that agree): a path adds to its parent a chain of two segments of the ring of the other places."""
    level = [(0, 0, [])]
    while True:
        out = []
        for parent, first, agreed in level:
            rest = [j for j in range(64) if j not in agreed]
            ring = _ring(rest, bits)
            for i in range(len(ring)):
                chain = ring[i] + ring[(i + 1) % len(ring)] * (len(ring) > 1)
                out.append((parent, len(out), i if not agreed else first, agreed + chain))
        yield [(parent, path, first, _mask(agreed)) for parent, path, first, agreed in out]
        level = [(path, first, agreed) for _, path, first, agreed in out]


def links(distinct: DataFrame, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> all links (u, v), u > v, of pairs within `bits` bits.

    Pigeonring: around the ring of m = 2 * bits + 1 segments, a pair within `bits` has a start from which every chain of l consecutive segments differs in at
    most l * bits / m bits. Chains of one and two segments then differ nowhere, so start and value of two neighbouring segments (2 * 64 / m places) are the bucket; the
    longer chains are tested on the pair before the whole distance is. A bucket of over `bucket` fingerprints is dealt out anew by the same principle: its pairs are within
    `bits` on the places that the bucket leaves open, which are a ring too. Each level leaves (m - 2) / m of the places open, so rows of a crowded bucket grow by m a level, and
    with log2(bucket) open places no bucket can be crowded. `bucket` counts as 2 ** (2 * bits) at least, so that each level has a place for each segment.
    """
    ring, bucket = _ring(list(range(64)), bits), max(bucket, 1 << 2 * bits)
    m = len(ring)
    segments = [(s[0], _mask(range(len(s)))) for s in ring]
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    diff = [F.bit_count(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(width))) for shift, width in segments]
    tests = []
    for i in range(m):
        chain, test = F.lit(0), F.lit(True)
        for step in range(m):
            chain = chain + diff[(i + step) % m]
            if step >= 1:
                test = test & (chain <= (step + 1) * bits // m)
        tests.append((F.col("a.first") == i) & test)
    viable = reduce(Column.__or__, tests)
    rows, pairs = distinct.select(F.lit(0).alias("path"), "fp"), []
    for level in _paths(bits):
        table = distinct.sparkSession.createDataFrame(level, "path int, next int, first int, mask long")  # m to the power of the level rows, whatever the input
        rows = rows.join(F.broadcast(table), "path").select(F.col("next").alias("path"), "first", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        sizes = rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        keyed = staged(rows.join(sizes, ["path", "key"]), "buckets")
        few = keyed.where(F.col("n") <= bucket)
        same = (F.col("a.path") == F.col("b.path")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp"))
        pairs.append(few.alias("a").join(few.alias("b"), same & viable & (F.bit_count(x) <= bits)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")))
        rows = keyed.where(F.col("n") > bucket).select("path", "fp")
        if not rows.take(1):
            return reduce(DataFrame.unionByName, pairs).distinct()


def near_duplicates(docs: DataFrame, bits: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    prints = staged(fingerprints(docs, shingle, seed), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    stars = components(links(classes.select("fp"), bits))
    linked = classes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    linked = staged(linked.select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    roots = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_sets(sets: DataFrame, bits: int = NEAR) -> DataFrame:
    """Different sets (key, fp) -> pairs (a > b) of keys: each with the first of its fingerprint, and the first ones of all fingerprints within `bits` bits. Rows of a fingerprint are no more than its sets."""
    classes = staged(sets.groupBy("fp").agg(F.min("key").alias("first")), "prints")
    equal = sets.join(classes, "fp").where("key <> first").select(F.col("key").alias("x"), F.col("first").alias("y"))
    x, y = (classes.select(F.col("fp").alias(c), F.col("first").alias(f)) for c, f in (("u", "x"), ("v", "y")))
    pairs = equal.unionByName(links(classes.select("fp"), bits).join(x, "u").join(y, "v").select("x", "y"))
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; of rows that share doc_id and text one stays. Rows without a doc_id stay if some component holds nothing else.

    Components are those of 5-word shingles with a Jaccard similarity of 0.8 or more. Fingerprints of these shingles within NEAR bits are linked first, by the ring, if their sets have the similarity. Fingerprints of
    such pairs differ in up to about a quarter of their bits, too many for buckets of them, so what is still in different components goes through the buckets of tidegrid/llm/overlap.py.
    """
    name, times = new_name(docs, "kept_id"), new_name(docs, "times")
    kept = docs.join(overlap.kept_ids(docs, near_sets).withColumnRenamed("kept_id", name), F.expr(f"doc_id <=> {name}"), "left_semi")
    shared = docs.groupBy(F.col("doc_id").alias(name)).agg(F.count(F.lit(1)).alias(times)).where(F.col(times) > 1).select(name)
    if not shared.take(1):
        return kept
    shared, same = staged(shared, "shared-ids"), F.expr(f"doc_id <=> {name}")
    return kept.join(shared, same, "left_anti").unionByName(kept.join(shared, same, "left_semi").dropDuplicates(["doc_id", "text"]))
