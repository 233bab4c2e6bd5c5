import re
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidegrid.llm import decontaminate, learning, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "x\nx\ny z\n\nx"), (5, "a b c d a b c\n" * 3000), (6, "#$ <b> é ü | x")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1.0, "c", 0) for i, t in rows], "doc_id long, text string, score double, n_words string, y int")


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        dup += x in seen and bool(re.search(r"[^\x20\x09-\x0D]", x))
        seen.add(x)
    count = {}
    for i in range(len(words) - 2):
        count[tuple(words[i : i + 3])] = count.get(tuple(words[i : i + 3]), 0) + 1
    hit = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)]


def test_base_rules(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    for _, t in [*docs, *ODD]:
        assert quality.base(np.frombuffer((t or "").encode(), np.uint8))[0] == plain_base(t)


def plain_hashed(text):
    """Cell counts one n-gram at a time, in whole numbers."""
    a, b, c = (int(m) for m in quality.MIX)
    half, wrap = quality.DIM // 2, 1 << 32
    shift = 32 - (half.bit_length() - 1)
    count = [0] * quality.DIM
    words = [zlib.crc32(w) for w in text.encode().split()]
    for w in words:
        count[(w * a % wrap) >> shift] += 1
    for v, w in zip(words, words[1:], strict=False):
        count[((v * b + w * c) % wrap) >> shift] += 1
    for i in range(len(text) - 2):
        three = ((ord(text[i]) * a + ord(text[i + 1])) * b + ord(text[i + 2])) * c % wrap
        count[half + (three >> shift)] += 1
        if i + 3 < len(text):
            count[half + ((three + ord(text[i + 3])) * a % wrap >> shift)] += 1
    x = np.log1p(count)
    return x / max(np.linalg.norm(x), 1e-9)


def test_probability_against_plain_version(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    weights = quality.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6 + i, t) for i, (_, t) in enumerate(ODD)]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows), labels).collect()}
    for i, t in rows:
        want = 1 / (1 + np.exp(-(plain_hashed(t or "") @ weights[:-1] + weights[-1])))
        assert got[i].probability == pytest.approx(want, abs=1e-4)
        n = plain_base(t)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert got[i].kept == (not failed and got[i].probability >= quality.KEEP) and got[i].verdict == ("reject" if not got[i].kept else "good" if got[i].probability >= quality.GOOD else "doubtful")
    monkeypatch.setattr(quality, "PIECE", 7)
    for _, t in rows[:20]:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        assert quality.hashed(raw, *quality.base(raw)[1:]) == pytest.approx(plain_hashed(t or ""), abs=1e-6)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()
    y = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert np.mean([(r.probability >= 0.5) == y[r.doc_id] for r in held]) > 0.9
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_quality_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(frame(spark, ODD), none).collect()
    assert sorted(str([r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words]) for r in got) == sorted(str(plain_base(t)) for _, t in ODD)
    assert quality.quality(frame(spark, []), none).collect() == []


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([g.predicted == y for g, y in held]) > 0.93
    assert np.mean([y for g, y in held if g.predicted]) > 0.9
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got.values())


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 0), (None, 1, 1), (4, 0, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(toxicity.toxicity(frame(spark, ODD), labels).collect()) == len(ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(frame(spark, ODD), none).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, []), labels).collect() == []


def plain_features(text, lexicon):
    """The features by direct definition, character by character and word by word."""
    low = text.lower()
    words = re.findall(r"[^\W\d_]+", low)
    n, size, letters = max(len(words), 1), max(len(text), 1), max(sum(map(len, words)), 1)

    def score(w):
        return max(lexicon[w[:k]] for k in range(4, 8) if w[:k] in lexicon) if w[:4] in lexicon else None

    told = [score(w) for w in words]
    got = [x for x in told if x is not None] or [0.0]
    marked = [i for i, (w, x) in enumerate(zip(words, told, strict=True)) if w in toxicity.INSULTS or (x is not None and x > 2)]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND]
    mixed = []
    for t in low.split():
        at = next((i for i, c in enumerate(t) if c in "0123456789@$!*+|"), None)
        if at is not None and any(re.match(r"[^\W\d_]", c) for c in t[at + 1 :]):
            mixed.append(t)
    plain = [[w for w in re.findall(r"[^\W\d_]+", t.translate(toxicity.LEET))] for t in mixed]
    hidden = sum(any(w in toxicity.INSULTS or (score(w) or 0) > 2 for w in ws) for ws in plain)
    base, counts = sum(w in toxicity.INSULTS for w in words), [sum(x > c for x in got) for c in (1, 2, 3)]
    return [
        np.log1p(len(words)), base / n, min(base, 20), sum(got) / n, max(got), *[c / n for c in counts], *[np.log1p(c) for c in counts], len({w[:6] for w, x in zip(words, told, strict=True) if x is not None and x > 2}),
        max([sum(m <= j <= m + 29 for j in marked) for m in marked], default=0), len(you) / n, np.mean([min(abs(y - m) for y in you) <= 5 for m in marked]) if you and marked else 0, sum(c.isupper() for c in text) / letters,
        len(re.findall(r"\b[A-Z]{3,}\b", text)) / n, text.count("!") / size, text.count("?") / size, sum(c in ".,;:'\"()-" for c in text) / size, sum(c in "#*$%&|<>@" for c in text) / size, len(mixed) / n, hidden / n,
        len(re.findall(r"\b(?:[^\W\d_][.\-_* ]){3,}[^\W\d_]\b", low)) / n, len(re.findall(r"([^\W\d_])\1\1", low)) / n, sum(c.isdigit() for c in text) / size, letters / n, len(set(words)) / n,
    ]


def test_features_against_plain_version(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    lexicon = {"fool": 2.5, "foolis": 3.1, "wort": 0.8, "wertl": 1.2, "wert": 0.0, "trash": 2.2, "tras": 0.0, "stup": 2.4}
    odd = ["", " ", "You f00lish 1d10t, y0u tr@sh!! STOP", "s.t.u.p.i.d İstanbul ẞ ²³ \ud7ff 𝔘pper", "aaa" * 50, "du wertlos\u00adig $$$ b*stard?"]
    words = toxicity.Words(lexicon)
    for t in [*docs, *odd]:
        assert toxicity.features(t, words) == pytest.approx([float(x) for x in plain_features(t, lexicon)], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("unit", ["7", "a", "1a", "$", " ", "a.", "a_", "!?", "A", "é", "\n", "7 ", "@7"])
def test_long_tokens_take_linear_time(unit):
    words = toxicity.Words({"aaaa": 2.0})
    toxicity.features("x", words)
    began = time.perf_counter()
    toxicity.features(unit * (100_000 // len(unit)), words)
    assert time.perf_counter() - began < 1


def test_toxicity_keeps_clashing_columns(spark):
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 0), (4, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, ODD).withColumnRenamed("score", "Toxic_Score").withColumnRenamed("n_words", "toxic_score_")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.Toxic_Score for r in kept.collect()} <= {1.0}


def test_learners():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert (((fit := learning.fit_trees(x[:400], y[:400], rounds=60)).raw(x[400:]) > 0) == y[400:]).mean() > 0.9
    at, share = learning.isotonic(fit.raw(x[400:]), y[400:])
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all()
    w = learning.fit_logistic(x.astype(np.float32), (x[:, 0] > 0).astype(np.float32))
    assert ((x @ w[:-1] + w[-1] > 0) == (x[:, 0] > 0)).mean() > 0.95


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(300):
        item, text = ("".join("abc"[k] for k in rng.integers(0, 3, n)) for n in (rng.integers(1, 90), rng.integers(0, 120)))
        want, got = distance(item, text), decontaminate.myers(item, text, 1000)
        assert got is None and not text or got[0] == want


def test_matches_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join("abcdefgh"[k] for k in rng.integers(0, 8, rng.integers(2, 8)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(12)]
    docs = []
    for i in range(80):
        body = [word() for _ in range(60)]
        if i % 2:
            t = list(items[i % 12][1])
            for _ in range(i % 14):
                t[rng.integers(0, len(t))] = "xyz "[rng.integers(0, 4)]
            body[20:20] = ["".join(t).upper() if i % 3 else "".join(t)]
        docs.append((i, "  \n".join(body)))
    bench = [*items, (100, None), (101, " "), (None, items[1][1])]
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(frame(spark, [*docs, *ODD]), spark.createDataFrame(bench, "item_id long, text string"), block=5).collect()}
    want = set()
    for d, x in docs:
        for i, t in bench:
            n = decontaminate.normalised(t)
            if n and (e := distance(n, decontaminate.normalised(x))) <= int(decontaminate.RATE * len(n)):
                want.add((d, i, e))
    assert got == want and len(want) > 20
    left = decontaminate.clean(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"), block=5)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _, _ in want} and left.columns == frame(spark, docs).columns
    assert decontaminate.matches(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_pipeline_against_plain(spark):
    """Every stage after the fitted one against plain Python, on the rows that it was given."""
    from tests.llm import test_simhash_packing_secrets as plain
    from tidegrid.llm import packing, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    calm = stages["toxicity"](spark, docs, SF).cache()
    assert calm.columns == columns and 880 < calm.count() < 1000
    one = stages["near_duplicates"](spark, calm, SF).cache()
    fps = {r.doc_id: plain.plain_simhash(r.text) for r in calm.collect()}
    assert {r.doc_id for r in one.collect()} == {i for i, c in plain.plain_components(fps).items() if i == c}
    pure = stages["decontamination"](spark, one, SF).cache()
    items = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {r.doc_id for r in one.collect() if any(t in decontaminate.normalised(r.text) for t in items)}
    assert {r.doc_id for r in one.collect()} - {r.doc_id for r in pure.collect()} == exact
    safe = stages["secrets"](spark, pure, SF).cache()
    before = {r.doc_id: r.text for r in pure.collect()}
    for r in safe.collect():
        spans = plain.plain_base(before[r.doc_id])
        assert (r.text == before[r.doc_id]) or spans or "[secret]" in r.text
        assert not plain.plain_base(r.text)
    cut = stages["packing"](spark, safe, SF).collect()
    assert {p.doc_id for p in cut} == {r.doc_id for r in safe.collect()}
    assert sum(p.length for p in cut) == sum(len(packing.encode(r.text, plain.PATH)) + 1 for r in safe.collect())
    assert secrets.KINDS[3] == "random"


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_nothing(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).collect() == []
