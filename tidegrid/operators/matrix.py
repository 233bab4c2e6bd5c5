"""Imputers that need a whole matrix at once: low rank, neighbours, chained regressions, splines and covariance filters.

A matrix (the series of one entity) is one Arrow group; scale comes from entities. Each method takes steps by series with NaN for missing and returns it full. Those in CAUSAL
use rows up to each step only. A series without observations is 0; observed cells keep their value.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.impute import register

Matrix = np.ndarray
METHODS: dict[str, Callable[[Matrix], Matrix]] = {}
CAUSAL = {"ewcov", "online_factor"}


def _method(f: Callable[[Matrix], Matrix]) -> Callable[[Matrix], Matrix]:
    METHODS[f.__name__] = f
    return f


def _scaled(x: Matrix) -> tuple[Matrix, Matrix, Matrix, Matrix]:
    """z-scores with 0 for missing, what was seen, means and deviations."""
    seen = np.isfinite(x)
    n = np.maximum(seen.sum(axis=0), 1)
    mean = np.where(seen, x, 0).sum(axis=0) / n
    dev = np.sqrt(np.where(seen, (x - mean) ** 2, 0).sum(axis=0) / n)
    dev = np.where(dev > 0, dev, 1.0)
    return np.where(seen, (x - mean) / dev, 0.0), seen, mean, dev


def _shrunk(z: Matrix, seen: Matrix, threshold: float, rounds: int, rank: int | None = None) -> Matrix:
    """Singular values cut by `threshold` (and to `rank`), observed cells put back, repeated."""
    out = z.copy()
    for _ in range(rounds):
        u, s, v = np.linalg.svd(np.where(seen, z, out), full_matrices=False)
        s = np.maximum(s - threshold, 0)
        if rank is not None:
            s[rank:] = 0
        new = (u * s) @ v
        moved = np.linalg.norm(new - out) / (np.linalg.norm(out) + 1e-12)
        out = new
        if moved < 1e-5:
            break
    return out


@_method
def svd_impute(x: Matrix, rank: int = 10, rounds: int = 25) -> Matrix:
    """Hard rank; at most half of the series."""
    z, seen, mean, dev = _scaled(x)
    return _shrunk(z, seen, 0.0, rounds, min(rank, max(1, x.shape[1] // 2))) * dev + mean


@_method
def soft_impute_fixed(x: Matrix, share: float = 0.05, rounds: int = 50) -> Matrix:
    """Singular values cut by a share of the largest."""
    z, seen, mean, dev = _scaled(x)
    return _shrunk(z, seen, share * np.linalg.svd(z, compute_uv=False)[0], rounds) * dev + mean


@_method
def softimpute(x: Matrix) -> Matrix:
    """The cut is chosen among six on held-out cells, where at least 60 are observed."""
    z, seen, mean, dev = _scaled(x)
    top = np.linalg.svd(z, compute_uv=False)[0]
    shares = [0.5, 0.25, 0.12, 0.06, 0.03, 0.015]
    best = 0.06
    if seen.sum() >= 60:
        held = seen & (np.random.default_rng(0).random(z.shape) < 0.1)
        part = np.where(held, 0.0, z)
        best = min(shares, key=lambda c: float(np.abs(_shrunk(part, seen & ~held, c * top, 30) - z)[held].mean()) if held.any() else 0.0)
    return _shrunk(z, seen, best * top, 60) * dev + mean


@_method
def mcnnm(x: Matrix, rounds: int = 8) -> Matrix:
    """Step and series effects in turn with a low-rank remainder."""
    z, seen, mean, dev = _scaled(x)
    low = np.zeros_like(z)
    rows, cols = np.zeros((len(z), 1)), np.zeros((1, z.shape[1]))
    for _ in range(rounds):
        rows = np.where(seen, z - low - cols, 0).sum(axis=1, keepdims=True) / np.maximum(seen.sum(axis=1, keepdims=True), 1)
        cols = np.where(seen, z - low - rows, 0).sum(axis=0, keepdims=True) / np.maximum(seen.sum(axis=0, keepdims=True), 1)
        rest = np.where(seen, z - rows - cols, low)
        low = _shrunk(rest, seen, 0.1 * np.linalg.svd(rest, compute_uv=False)[0], 10)
    return (low + rows + cols) * dev + mean


@_method
def trmf(x: Matrix, rank: int = 6, lags: tuple[int, ...] = (1, 2, 3), rounds: int = 20, ridge: float = 0.1) -> Matrix:
    """Low rank whose factors follow an autoregression: loadings, coefficients and factors in turn."""
    z, seen, mean, dev = _scaled(x)
    k, t = min(rank, *z.shape), len(z)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    f, w = u[:, :k] * np.sqrt(s[:k]), v[:k].T * np.sqrt(s[:k])
    theta = np.zeros((len(lags), k))
    eye = np.eye(k)
    for _ in range(rounds):
        w = np.linalg.solve(np.einsum("tn,tr,ts->nrs", seen.astype(float), f, f) + ridge * eye, (z.T @ f)[:, :, None])[:, :, 0]
        start = max(lags)
        if t > start + len(lags):
            for r in range(k):
                a = np.stack([f[start - lag : t - lag, r] for lag in lags], axis=1)
                theta[:, r] = np.clip(np.linalg.solve(a.T @ a + ridge * np.eye(len(lags)), a.T @ f[start:, r]), -1, 1)
        gram, cross = np.einsum("tn,nr,ns->trs", seen.astype(float), w, w), z @ w
        for i in range(t):
            lead = sum((theta[j] * f[i - lag] for j, lag in enumerate(lags) if i >= lag), np.zeros(k)) if i >= start else np.zeros(k)
            f[i] = np.linalg.solve(gram[i] + ridge * eye, cross[i] + ridge * lead)
    return (f @ w.T) * dev + mean


@_method
def knn(x: Matrix, k: int = 5, block: int = 256) -> Matrix:
    """The mean of the k nearest steps that have the series, by distance over what both have, scaled up to all series; steps are compared in blocks."""
    seen = np.isfinite(x)
    z = np.where(seen, x, 0.0)
    out = x.copy()
    s = seen.astype(float)
    mean = z.sum(axis=0) / np.maximum(seen.sum(axis=0), 1)
    todo = np.flatnonzero(~seen.all(axis=1))
    for a in range(0, len(todo), block):
        rows = todo[a : a + block]
        both = s[rows] @ s.T
        d = (z[rows] ** 2) @ s.T + s[rows] @ (z**2).T - 2 * z[rows] @ z.T
        d = np.where(both > 0, np.maximum(d, 0) * x.shape[1] / np.maximum(both, 1), np.inf)
        for j in np.flatnonzero(~seen[rows].all(axis=0)):
            donors = np.flatnonzero(seen[:, j])
            want = np.flatnonzero(~seen[rows, j])
            if not len(donors):
                continue
            part = d[np.ix_(want, donors)]
            near = np.argsort(part, axis=1, kind="stable")[:, :k]
            ok = np.isfinite(np.take_along_axis(part, near, axis=1))
            got = np.where(ok, z[donors[near], j], 0).sum(axis=1) / np.maximum(ok.sum(axis=1), 1)
            out[rows[want], j] = np.where(ok.any(axis=1), got, mean[j])
    return out


@_method
def mice(x: Matrix, rounds: int = 10, ridge: float = 1e-2) -> Matrix:
    """Each series in turn by ridge regression on the others."""
    z, seen, mean, dev = _scaled(x)
    out = z.copy()
    for _ in range(rounds):
        for j in np.argsort((~seen).sum(axis=0), kind="stable"):
            on, off = seen[:, j], ~seen[:, j]
            if not off.any() or not on.any() or x.shape[1] == 1:
                continue
            a = np.column_stack([np.delete(out, j, axis=1), np.ones(len(out))])
            b = np.linalg.solve(a[on].T @ a[on] + ridge * on.sum() * np.eye(a.shape[1]), a[on].T @ z[on, j])
            out[off, j] = a[off] @ b
    return out * dev + mean


@_method
def spline(x: Matrix) -> Matrix:
    """Natural cubic through four observations or more, a parabola through three, else straight lines; ends held."""
    out = x.copy()
    for j in range(x.shape[1]):
        at = np.flatnonzero(np.isfinite(x[:, j]))
        gone = np.flatnonzero(~np.isfinite(x[:, j]))
        if not len(at) or not len(gone):
            continue
        y, t = x[at, j], np.clip(gone, at[0], at[-1]).astype(float)
        if len(at) == 3:
            out[gone, j] = np.polyval(np.polyfit(at - at[0], y, 2), t - at[0])
        elif len(at) > 3:
            out[gone, j] = _natural(at.astype(float), y, t)
        else:
            out[gone, j] = np.interp(t, at, y)
    return out


def _natural(at: Matrix, y: Matrix, t: Matrix) -> Matrix:
    h, n = np.diff(at), len(at)
    slope = np.diff(y) / h
    diag, rhs, bend = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope), np.zeros(n)
    for i in range(1, n - 2):  # elimination of a tridiagonal system
        f = h[i] / diag[i - 1]
        diag[i] -= f * h[i]
        rhs[i] -= f * rhs[i - 1]
    for i in range(n - 3, -1, -1):
        bend[i + 1] = (rhs[i] - h[i + 1] * bend[i + 2]) / diag[i]
    k = np.clip(np.searchsorted(at, t, side="right") - 1, 0, n - 2)
    left, right = at[k + 1] - t, t - at[k]
    return (bend[k] * left**3 + bend[k + 1] * right**3) / (6 * h[k]) + (y[k] / h[k] - bend[k] * h[k] / 6) * left + (y[k + 1] / h[k] - bend[k + 1] * h[k] / 6) * right


@_method
def ewcov(x: Matrix, halflife: float = 200, ridge: float = 1e-2, warm: int = 5) -> Matrix:
    """Conditional mean under decayed moments of the filled rows before; while cold, the mean of what the series has had. The rows before a series starts hold its first observation in the moments, not in the fill."""
    n, lam = x.shape[1], 0.5 ** (1 / halflife)
    weight, m, c = 0.0, np.zeros(n), np.zeros((n, n))
    total, count = np.zeros(n), np.zeros(n)
    out = np.empty_like(x)
    for t, row in enumerate(x):
        on, off = np.isfinite(row), ~np.isfinite(row)
        fill = np.where(count > 0, total / np.maximum(count, 1), 0.0)
        if t >= warm:
            mean = m / weight
            cov = c / weight - np.outer(mean, mean)
            cov = cov + np.eye(n) * ridge * (np.trace(cov) / n + 1e-9)
            fill = mean + (cov[:, on] @ np.linalg.solve(cov[np.ix_(on, on)], row[on] - mean[on]) if on.any() else 0.0)
        out[t] = np.where(off, fill, row)
        for j in np.flatnonzero(on & (count == 0)):  # the rows before count as if they had held the first observation
            m[j] = weight * row[j]
            c[j] = c[:, j] = row[j] * m
        total, count = total + np.where(on, row, 0), count + on
        weight, m, c = lam * weight + 1, lam * m + out[t], lam * c + np.outer(out[t], out[t])
    return out


@_method
def online_factor(x: Matrix, rank: int = 6, warm: int = 8, refresh: int = 10, window: int = 200, ridge: float = 0.1) -> Matrix:
    """Factors with a first-order autoregression, loadings fitted anew every few steps on the rows of a trailing window; while cold, the last observation."""
    out, n = np.empty_like(x), x.shape[1]
    last, k = np.zeros(n), min(rank, n)
    w = theta = f = mean = dev = None
    for t, row in enumerate(x):
        on = np.isfinite(row)
        fill = last
        if t >= warm:
            if w is None or t % refresh == 0:
                z, seen, mean, dev = _scaled(x[max(0, t - window) : t])
                u, s, v = np.linalg.svd(_shrunk(z, seen, 0.0, 5, k), full_matrices=False)
                w, past = v[:k].T, u[:, :k] * s[:k]
                theta = np.clip(np.sum(past[1:] * past[:-1], axis=0) / (np.sum(past[:-1] ** 2, axis=0) + ridge), -0.999, 0.999)
                f = past[-1]
            f = theta * f
            if on.any():
                f = np.linalg.solve(w[on].T @ w[on] + ridge * np.eye(w.shape[1]), w[on].T @ ((row - mean) / dev)[on] + ridge * f)
            fill = w @ f * dev + mean
        out[t] = np.where(on, row, fill)
        last = np.where(on, row, last)
    return out


NAMES = tuple(METHODS)


def filled(cells: DataFrame, method: str, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Cells with `fill` by a matrix method; a step that lacks rows of a series counts as missing there."""
    schema = T.StructType([*cells.schema.fields, T.StructField("fill", T.DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["x"].to_numpy(float)
        own = np.where(np.isfinite(own), own, np.nan)
        m = pdf.assign(x=own).pivot_table(index="ord", columns="feature", values="x", aggfunc="mean", dropna=False).sort_index()
        x = m.to_numpy(float)
        got = METHODS[method](x)
        got = np.where(np.isfinite(got) & np.isfinite(x).any(axis=0) if method not in CAUSAL else np.isfinite(got), got, 0.0)
        at = got[m.index.get_indexer(pdf["ord"]), m.columns.get_indexer(pdf["feature"])]
        return pdf.assign(fill=np.where(np.isfinite(own), own, at))[[f.name for f in schema]]

    out = cells.groupBy(*[k for k in keys if k != "feature"]).applyInPandas(one, schema)
    return out.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


for _name in NAMES:
    register(_name, functools.partial(filled, method=_name), _name in CAUSAL)
