"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities and counts of lexicon words (a fixed list, and word beginnings learned from labelled rows as log-odds), their closeness to
second-person words, capitals, punctuation and obfuscation rates. The lexicon for a training row is learned from the other half of the sample; it holds every word
beginning whose log-odds lie SURE standard errors above 0, however many those are (they grow with the sample, which is bounded). Trees and
calibration are fitted on at most MOST_ROWS labelled rows (a documented bound); everything is scored with whole texts, in time linear in them.

Defined cases: null text counts as empty and has a score like any other; repeated rows and ids get a row each; a null doc_id is held out; extra columns are not
inputs, whatever their names. Without labelled rows of both classes the score is the share of label 1 (0 without any label). No rows: no rows.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import chunks, new_name, staged, texts
from tidegrid.llm.learning import Trees, fit_trees, held_out, isotonic, sample, sigmoid

MOST_ROWS, REJECT = 12_000, 0.7
#: Least log-odds of a word beginning in the lexicon, in themselves and in standard errors.
ODDS, SURE = 0.7, 2.5
#: A fixed list to start from; the learned beginnings extend it to whatever the labels mark.
INSULTS = frozenset(
    "idiot moron stupid dumb fool loser clown trash garbage scum worthless pathetic disgusting filth vermin pig jerk bastard bitch retard imbecile cretin shit fuck asshole "
    "dummkopf arschloch trottel abschaum scheisse hurensohn wertlos erbärmlich widerlich connard imbécile salaud ordure minable dégoûtant abruti merde "
    "idiota estúpido imbécil basura escoria inútil patético asqueroso payaso mierda".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros vuestra vuestro".split())
WORD = re.compile(r"[^\W\d_]+")
MASK, LETTER = re.compile(r"[0-9@$!*+|]"), re.compile(r"[^\W\d_]")
SPELLED = re.compile(r"\b(?:[^\W\d_][.\-_* ]){3,}[^\W\d_]\b")
LONG_RUN = re.compile(r"([^\W\d_])\1\1")
CAPITALS = re.compile(r"\b[A-Z]{3,}\b")
LEET = str.maketrans("013457@$!+|", "oieastasitl")
NAMES = (
    "log_words base_density base_count sum_density highest dense1 dense2 dense3 count1 count2 count3 distinct nearby second close capitals all_caps exclaim question punctuation symbols "
    "mixed hidden spelled stretched digits word_length variety"
).split()


#: Kinds of characters that are counted: a bit each in a table over code points.
_SIGNS = {4: "!", 8: "?", 16: ".,;:'\"()-", 32: "#*$%&|<>@"}
_CACHE = 300_000


@functools.cache
def _table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for bit, test in ((1, str.isupper), (2, str.isdigit)):
        out[[c for c in range(0x110000) if test(chr(c))]] |= bit
    for bit, signs in _SIGNS.items():
        out[list(map(ord, signs))] |= bit
    return out


def _characters(text: str) -> list[int]:
    """How many are upper case, digits, and of each kind of sign."""
    kinds = np.bincount(_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=64)
    return [int(kinds[np.arange(64) & bit > 0].sum()) for bit in (1, 2, *_SIGNS)]


def _units(word: str) -> list[str]:
    return [word[:k] for k in range(4, min(len(word), 7) + 1)]


class Words(dict):
    """What a lexicon says of a word: (score or None, flags: 1 second person, 2 insult, 4 high score); remembered, and forgotten when too many are."""

    PLAIN = (None, 0)

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, w: str) -> tuple[float | None, int]:
        score = self.lexicon.get(w[:4])
        if score is not None:
            for k in range(5, min(len(w), 7) + 1):
                score = max(score, self.lexicon.get(w[:k], score))
        flags = (w in SECOND) + 2 * (w in INSULTS) + 4 * (score is not None and score > 2)
        out = (score, flags) if flags or score is not None else self.PLAIN
        if len(self) >= _CACHE:
            self.clear()
        self[w] = out
        return out


def disguised(low: str) -> list[str]:
    """Tokens between white space in which a letter follows a digit or sign that often stands for one; one look at each character."""
    return [t for t in low.split() if (m := MASK.search(t)) and LETTER.search(t, m.end())] if MASK.search(low) else []


def features(text: str, known: Words) -> list[float]:
    """The dense features named in NAMES."""
    low = text.lower()
    words = WORD.findall(low)
    n, size = max(len(words), 1), max(len(text), 1)
    told = list(map(known.__getitem__, words))
    special = [(i, x) for i, x in enumerate(told) if x is not Words.PLAIN]
    you = [i for i, x in special if x[1] & 1]
    base = sum(1 for _, x in special if x[1] & 2)
    marked = [i for i, x in special if x[1] & 6]
    hits = {words[i][:6] for i, x in special if x[1] & 4}
    scores = [x[0] for _, x in special if x[0] is not None]
    got = np.array(scores) if scores else np.zeros(1)
    at = np.array(marked) if marked else np.zeros(0, np.int64)
    nearby = int((np.searchsorted(at, at + 30) - np.arange(len(at))).max()) if len(at) else 0
    close = 0.0
    if you and marked:
        y = np.array(you)
        k = np.searchsorted(y, at)
        gap = np.minimum(np.abs(y[np.minimum(k, len(y) - 1)] - at), np.abs(y[np.maximum(k - 1, 0)] - at))
        close = float((gap <= 5).mean())
    letters = max(sum(map(len, words)), 1)
    upper, digits, *signs = _characters(text)
    mixed = disguised(low)
    hidden = sum(any(known[w][1] & 6 for w in WORD.findall(x.translate(LEET))) for x in mixed)
    count = [int((got > c).sum()) for c in (1, 2, 3)]
    return [
        float(np.log1p(len(words))), base / n, min(base, 20), float(got.sum()) / n, float(got.max()), *[c / n for c in count], *[float(np.log1p(c)) for c in count],
        len(hits), nearby, len(you) / n, close, upper / letters, len(CAPITALS.findall(text)) / n if upper else 0.0,
        *[c / size for c in signs],
        len(mixed) / n, hidden / n, len(SPELLED.findall(low)) / n, len(LONG_RUN.findall(low)) / n, digits / size, letters / n, len(set(words)) / n,
    ]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: Trees | None = None
    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    share: np.ndarray = field(default_factory=lambda: np.zeros(1))
    _known: Words | None = None  # each task's own

    def score(self, found: list[str]) -> np.ndarray:
        if self.trees is None or not found:
            return np.full(len(found), float(self.share[0]))
        known = Words(self.lexicon) if self._known is None else self._known
        self._known = known
        raw = self.trees.raw(np.array([features(x, known) for x in found]))
        return 0.999 * np.interp(raw, self.at, self.share) + 0.001 * sigmoid(raw)  # the second part keeps the order within a block


def _lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Word beginnings and their log-odds: from half 0, from half 1, from both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()
        for b in batches:
            for x, y, half in zip(texts(b.column("text")), b.column("y").to_pylist(), b.column("half").to_pylist(), strict=True):
                seen.update((u, 2 * half + y) for u in {u for w in set(WORD.findall(x.lower())) for u in _units(w)})
                if len(seen) > 200_000:
                    yield flush(seen)
                    seen.clear()
        yield flush(seen)

    def flush(seen: Counter) -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["unit", "cell", "n"])

    total = {(h, y): n for h, y, n in rows.groupBy("half", "y").count().collect()}
    each = rows.mapInArrow(run, "unit string, cell int, n long").groupBy("unit").agg(*[F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(4)])

    def odds(halves: tuple[int, ...]):
        hit, miss = (sum(F.col(f"c{2 * h + y}") for h in halves) for y in (1, 0))
        pos, neg = (sum(total.get((h, y), 0) for h in halves) for y in (1, 0))
        size = F.log((hit + 0.5) / (pos + 1.0)) - F.log((miss + 0.5) / (neg + 1.0))
        return F.when((hit >= 3) & (size > ODDS) & (size > SURE * F.sqrt(1 / (hit + 0.5) + 1 / (miss + 0.5))), size)

    each = each.select("unit", odds((0,)).alias("o0"), odds((1,)).alias("o1"), odds((0, 1)).alias("o2"))
    best = each.where(F.coalesce("o0", "o1", "o2").isNotNull()).collect()  # word beginnings of a sample of bounded rows
    out = []
    for k in (1, 2, 3):
        lexicon = {r[0]: r[k] for r in best if r[k] is not None}
        for u in list(lexicon):  # features() looks up the first four letters before the longer beginnings
            lexicon.setdefault(u[:4], 0.0)
        out.append(lexicon)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_ROWS) -> Model:
    rows = staged(sample(docs, labels, label, most), "toxic-sample")
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Model(share=np.array([float(next(iter(counts), 0))]))
    of0, of1, both = _lexicons(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(of1), Words(of0)
        for b in batches:
            found = [features(x, known[h]) for x, h in zip(texts(b.column("text")), b.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    known = sorted(rows.mapInArrow(run, "doc_id long, y int, x array<double>").collect())  # at most `most` rows of some thirty numbers
    x, y = np.array([r.x for r in known]), np.array([r.y for r in known], float)
    fold = np.arange(len(y)) % 3
    out_of_fold = np.zeros(len(y))
    for k in range(3):
        if len(set(y[fold != k])) == 2:
            out_of_fold[fold == k] = fit_trees(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(both, fit_trees(x, y), *isotonic(out_of_fold, y))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with one more column; name must be new."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(texts(b.column("text"))), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels, most=most))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, with the same columns."""
    name = new_name(docs, "toxic_score")
    return scored(docs, fit(docs, labels), name).where(F.col(name) < REJECT).drop(name)
