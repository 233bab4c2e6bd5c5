"""Small learners on numpy for bounded samples: boosted trees, isotonic and Platt calibration, logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y, half): at most `most` labelled rows outside the held-out ones, those with the least hash of doc_id. Labels that disagree count as their largest."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y", F.xxhash64(F.col("doc_id"), F.lit(7)).bitwiseAND(F.lit(1)).cast("int").alias("half"))


@dataclass
class Trees:
    """Boosted trees of a fixed depth on binned features."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for d in range(depth):
                at = node + (1 << d) - 1
                node = 2 * node + (x[rows, f[at]] > c[at])
            out += v[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 1.0, bins: int = 32, least: float = 2.0) -> Trees:
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(prior / (1 - prior)))
    score, rows, lanes = np.full(n, start), np.arange(n), np.arange(width) * bins
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = sigmoid(score)
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for d in range(depth):
            k = 1 << d
            flat = (node[:, None] * (width * bins) + lanes + binned).ravel()
            gs, hs = (np.bincount(flat, np.repeat(v, width), k * width * bins).reshape(k, width, bins).cumsum(axis=2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            won = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
            chosen, place = best // bins, best % bins
            at = np.arange(k) + k - 1
            feature[at] = chosen
            cut[at] = [edges[f][min(b, len(edges[f]) - 1)] if w else np.inf for f, b, w in zip(chosen, place, won, strict=True)]
            node = 2 * node + (won[node] & (binned[rows, chosen[node]] > place[node]))
        gl, hl = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
        leaf = -rate * gl / (hl + l2)
        score += leaf[node]
        features.append(feature), cuts.append(cut), leaves.append(leaf)
    return Trees(start, np.array(features), np.array(cuts), np.array(leaves))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the blocks' mean raw scores and their shares of ones, both rising."""
    blocks: list[list[float]] = []
    for r, v in sorted(zip(raw.tolist(), y.tolist(), strict=True)):
        blocks.append([1, v, r])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, s, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + s, blocks[-1][2] + t]
    return np.array([t / n for n, _, t in blocks]), np.array([s / n for n, s, _ in blocks])


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights with the intercept last: full-batch Adam, deterministic."""
    w, m, v = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for t in range(1, steps + 1):
        e = (sigmoid(x @ w[:-1] + w[-1]) - y).astype(np.float32) / len(y)
        g = np.append(x.T @ e + l2 * w[:-1], e.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float32)


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept that calibrate raw scores, by Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, ab = np.stack([raw, np.ones(len(raw))], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ ab)
        ab = ab - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (ab - [1, 0]))
    return float(max(ab[0], 1e-3)), float(ab[1])
