import re

import numpy as np
import pytest

from tidegrid.llm import overlap, simhash

SCHEMA = "doc_id long, text string"


def plain_kept(rows):
    """Brute force over all pairs."""

    def members(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    found = [members(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(found):
        for j in range(i):
            if x == found[j] or 5 * len(x & found[j]) >= 4 * len(x | found[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def edited(rng, words, k):
    words = list(words)
    for i in rng.integers(0, len(words), k):
        words[i] = f"new{rng.integers(0, 10**9)}"
    return " ".join(words)


def test_near_copies_of_short_texts_go(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, n)] for n in rng.integers(60, 90, 40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, edited(rng, w, 1)) for i, w in enumerate(base)]
    kept = sorted(r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == plain_kept(rows) == list(range(40))


@pytest.mark.parametrize("pairwise", [2, 64])
def test_equal_to_brute_force(spark, pairwise, monkeypatch):
    monkeypatch.setattr(overlap, "PAIRWISE", pairwise)
    monkeypatch.setattr(overlap, "HOT_LEAST", 2)
    monkeypatch.setattr(overlap, "SAMPLE", 0.5)
    rng = np.random.default_rng(8)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, 70)] for _ in range(4)]
    texts = [edited(rng, base[rng.integers(0, 4)], rng.integers(0, 4)) for _ in range(150)] + [None, "", " \t", "one", "ONE", "a b c d", "a b c d e", "a b c d e f"]
    texts += [" ".join(base[0][: int(k)]) for k in rng.integers(50, 70, 20)]
    rows = list(enumerate(texts))
    kept = sorted(r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == plain_kept(rows)


def test_equal_to_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    kept = sorted(r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == plain_kept(rows)


def plain_print(text):
    hashes = [int(x) for x in overlap.shingles(text.encode())]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in hashes) > len(hashes))


def test_near_copies_are_linked_by_fingerprints(spark, monkeypatch):
    """What the fingerprints link without the buckets, then that the buckets add the rest."""
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, 300)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + 30 * k + i, edited(rng, w, 1 + 4 * k)) for k in range(2) for i, w in enumerate(base)] + [(900, ""), (901, None), (902, "one"), (903, "two")]
    frame = spark.createDataFrame(rows, SCHEMA)
    prints = {d: plain_print(t or "") for d, t in rows}
    found = overlap.sets(frame).where("fp is not null").collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in found} == {d: p for d, p in prints.items() if d in {r.doc_id for r in found}}
    near = {(x, y) for x in prints for y in prints if x < y and (prints[x] ^ prints[y]).bit_count() <= simhash.NEAR}
    copies = {(x, y) for x, y in near if x < 100 and (y - 100) % 30 == x}
    assert 20 < len(copies) < 60
    whole = sorted(r.doc_id for r in simhash.deduplicated(frame).collect())
    monkeypatch.setattr(overlap, "_parted", lambda pairs, stars: pairs.limit(0))
    kept = {r.doc_id for r in simhash.deduplicated(frame).collect()}
    root = {d: d for d in prints} | {901: 900}
    for x, y in sorted(near):
        if y < 900 and (x if x < 100 else (x - 100) % 30) == (y - 100) % 30:
            least = min(root[x], root[y])
            root = {d: least if r in (root[x], root[y]) else r for d, r in root.items()}
    assert kept == set(root.values()) and whole == plain_kept(rows) and set(whole) < kept


def test_sets_of_one_fingerprint_meet(spark):
    rng = np.random.default_rng(6)
    prints = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    prints += [p ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for k in (0, 1, 3, 4, 5) for p in prints[:8]]
    rows = [(int(k), p) for k, p in zip(rng.permutation(1000), prints, strict=False)]
    got = {(r.a, r.b) for r in simhash.near_sets(spark.createDataFrame(rows, "key long, fp long")).collect()}
    first = {p: min(k for k, q in rows if q == p) for p in prints}
    want = {(max(k, first[p]), min(k, first[p])) for k, p in rows if k != first[p]}
    want |= {(max(first[p], first[q]), min(first[p], first[q])) for p in first for q in first if p != q and (p ^ q).bit_count() <= simhash.NEAR}
    assert got == want and len(got) > 30
