"""Quality rules: fixed base rules, then a logistic regression over hashed word and character n-grams, calibrated, against fixed thresholds.

Word unigrams and bigrams and runs of three and four characters of the whole text are counted in DIM cells by hash, damped (log1p) and scaled to length 1. The weights come from at most MOST_ROWS
labelled rows outside the held-out ones (a documented bound); Platt scaling on scores out of fold calibrates the probability. Scoring runs in Arrow batches.

Defined cases: a null text has no words and fails the base rules; repeated rows and ids get a row each; extra columns are not read. Without labels of both
classes the probability is 1, so that the base rules decide. No rows: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import staged, utf8
from tidegrid.llm.learning import fit_logistic, held_out, platt, sample, sigmoid

DIM, MOST_ROWS = 4096, 4_000
#: Fixed thresholds of the probability: below KEEP a text goes, from GOOD on it is good, between them doubtful (and kept).
KEEP, GOOD = 0.5, 0.8
#: Odd multipliers of the hashes.
MIX = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917))
PIECE = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64), list(seen)


def base(data: np.ndarray) -> tuple[list[int], np.ndarray, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; the words as numbers; the distinct words."""
    raw = data.tobytes()
    ids, distinct = _word_ids(raw.split())
    lines: set[bytes] = set()
    repeated = 0
    for line in raw.split(b"\n"):
        if line in lines:
            repeated += bool(line.strip())
        else:
            lines.add(line)
    again = 0
    if len(ids) >= 3:
        pair = np.unique(ids[:-1] * len(distinct) + ids[1:], return_inverse=True)[1]
        _, back, count = np.unique(pair[:-1] * len(distinct) + ids[2:], return_inverse=True, return_counts=True)
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : len(ids) - 2 + k] |= count[back] >= 2
        again = int(covered.sum())
    chars = int((~_SPACE[data] & ((data & 0xC0) != 0x80)).sum())
    return [len(ids), chars, int(_SYMBOL[data].sum()), repeated, again], ids, distinct


def hashed(data: np.ndarray, ids: np.ndarray, distinct: list[bytes]) -> np.ndarray:
    """Damped counts of n-grams in DIM cells, of length 1 (zeros for an empty text); half of the cells for words and pairs of words, half for three and four characters in a row."""
    half = DIM // 2
    shift = np.uint32(32 - (half.bit_length() - 1))
    count = np.zeros(DIM)
    if len(ids):
        word = np.array([zlib.crc32(w) for w in distinct], np.uint32)[ids]
        count[:half] += np.bincount((word * MIX[0]) >> shift, minlength=half)
        count[:half] += np.bincount((word[:-1] * MIX[1] + word[1:] * MIX[2]) >> shift, minlength=half)
    char = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    for at in range(0, len(char), PIECE):
        c = char[at : at + PIECE + 3]
        if len(c) >= 3:
            three = ((c[:-2] * MIX[0] + c[1:-1]) * MIX[1] + c[2:]) * MIX[2]
            count[half:] += np.bincount(three[:PIECE] >> shift, minlength=half)
            count[half:] += np.bincount(((three[:-1] + c[3:]) * MIX[0])[:PIECE] >> shift, minlength=half)
    x = np.log1p(count)
    return (x / max(np.linalg.norm(x), 1e-9)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> np.ndarray | None:
    """DIM weights and an intercept on the scale of calibrated log-odds; None without both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            found = []
            for x, y in zip(off[:-1], off[1:], strict=True):
                _, ids, distinct = base(data[x:y])
                found.append(hashed(data[x:y], ids, distinct).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "x"])

    rows = staged(sample(docs, labels, "quality", most), "quality-sample").mapInArrow(run, "doc_id long, y int, x binary")
    known = sorted((r.doc_id, r.y, bytes(r.x)) for r in rows.toLocalIterator())  # at most `most` rows of 2 * DIM bytes
    y = np.array([r[1] for r in known], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(r[2], np.float16) for r in known]).astype(np.float32)
    fold, raw = np.arange(len(y)) % 2, np.zeros(len(y))
    for k in range(2):
        w = fit_logistic(x[fold != k], y[fold != k])
        raw[fold == k] = x[fold == k] @ w[:-1] + w[-1]
    slope, shift = platt(raw, y)
    w = fit_logistic(x, y) * slope
    w[-1] += shift
    return w


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, held_out, probability, verdict (reject, doubtful or good)."""
    weights = fit(docs, labels, most)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            rows, p = [], []
            for x, y in zip(off[:-1], off[1:], strict=True):
                numbers, ids, distinct = base(data[x:y])
                rows.append(numbers)
                p.append(1.0 if weights is None else float(sigmoid(np.float64(hashed(data[x:y], ids, distinct) @ weights[:-1] + weights[-1]))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, np.array(rows, np.int64).reshape(-1, 5).T), pa.array(p, pa.float64())], ["doc_id", *names, "probability"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in names)}, probability double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.when(failed | (F.col("probability") < KEEP), "reject").when(F.col("probability") < GOOD, "doubtful").otherwise("good")
    return out.select("doc_id", *names, failed.alias("base_failed"), (~failed & (F.col("probability") >= KEEP)).alias("kept"), held_out(F.col("doc_id")).alias("held_out"), "probability", verdict.alias("verdict"))
