import hashlib

import numpy as np
import pytest

from tidegrid.llm import suffix


def plain(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, d int, x string")


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def made():
    rng = np.random.default_rng(3)
    word = lambda: "".join("abcdeé"[k] for k in rng.integers(0, 6, rng.integers(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    rows = []
    for i in range(60):
        t = text(int(rng.integers(1, 120)))
        for _ in range(int(rng.integers(0, 3))):
            s = shared[rng.integers(0, 4)]
            a = int(rng.integers(0, len(s) - 60))
            t = t[: len(t) // 2] + s[a : a + int(rng.integers(60, 260))] + t[len(t) // 2 :]
        rows.append((i, t))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "ab" * 400), (103, "z" * 333), (104, "ab" * 300), (105, None), (106, ""), (107, "q" * 99), (108, "z" * 101)]
    return rows


def test_small_against_brute_force(spark):
    rows = made()
    assert result(suffix.without_repeats(frame(spark, rows))) == plain(rows)


def test_crowded_grams_are_exact(spark, monkeypatch):
    rows = made()
    monkeypatch.setattr(suffix.spans, "__defaults__", (100, 32, 1))
    assert result(suffix.without_repeats(frame(spark, rows))) == plain(rows)


def test_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert result(suffix.without_repeats(frame(spark, rows))) == plain(rows)


def test_long_texts_are_cut_into_segments(spark):
    rng = np.random.default_rng(4)
    long = "".join(map(chr, rng.integers(97, 123, 1_200_000)))
    rows = [(1, long), (2, long[500_000:700_000] + "!" + long[10:150])]
    assert result(suffix.without_repeats(frame(spark, rows))) == plain(rows)


def test_odd_rows(spark):
    a = "0123456789" * 11
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix.without_repeats(frame(spark, [(5, a), (5, a), (None, a)])).collect())
    assert got == sorted([("5", plain([(5, a)])[5][1])] * 2 + [("None", 110)])
    assert suffix.without_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("shard", [40, 200, 10**6])
def test_merged_intervals(shard):
    rng = np.random.default_rng(shard)
    strings = [bytes(rng.integers(97, 99, rng.integers(8, 40)).tolist()) for _ in range(20)]
    where = [(i, 0, 0) for i in range(20)]
    got = {(k, j) for k, a, b in suffix.repeats(strings, where, 8, shard) for j in range(a, b + 1)}
    seen, want = set(), set()
    for k, s in enumerate(strings):
        for j in range(len(s) - 7):
            if s[j : j + 8] in seen:
                want.add((k, j))
            seen.add(s[j : j + 8])
    assert got == want


@pytest.mark.parametrize("length", [5, 8, 11])
@pytest.mark.parametrize("alphabet", [(97, 98), (97, 254, 255)])
@pytest.mark.parametrize("shard", [30, 10**6])
def test_merged_depths_and_bytes(length, alphabet, shard):
    rng = np.random.default_rng(length + shard % 7)
    strings = [bytes(rng.choice(alphabet, rng.integers(length, 40)).tolist()) for _ in range(25)]
    got = {(k, j) for k, a, b in suffix.repeats(strings, [(i, 0, 0) for i in range(25)], length, shard) for j in range(a, b + 1)}
    seen, want = set(), set()
    for k, s in enumerate(strings):
        for j in range(len(s) - length + 1):
            if s[j : j + length] in seen:
                want.add((k, j))
            seen.add(s[j : j + length])
    assert got == want


def test_shared_ids_with_different_texts(spark):
    a, b = "0123456789" * 12, "abcdefghij" * 12
    rows = [(5, a), (5, a + b), (6, b), (None, b), (None, a + "!")]
    got = suffix.without_repeats(frame(spark, rows)).collect()
    assert len(got) == 5 and {(r.doc_id, r.n_bytes) for r in got} == {(i, len(t)) for i, t in rows}
    by = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
    assert by[(6, 120)] == 120 and by[(None, 120)] == 120 and by[(None, 121)] == 120
    assert len({by[(5, 120)], by[(5, 240)]} & {120, 240}) == 1
