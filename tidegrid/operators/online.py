"""Online rivals of the estimator: each fills a step from rows up to it, keeps a small state, and never looks back further than that.

As in matrix.py a matrix (steps by series) is one Arrow group and scale comes from entities; observed cells keep their value, and what a method can't say yet is the series' past mean, then the past mean of all, then 0.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.operators import impute as im
from tidegrid.operators import matrix as mx
from tidegrid.operators import panel as pn
from tidegrid.operators.evaluate import missingness

Matrix = np.ndarray
METHODS: dict[str, Callable[[Matrix], Matrix]] = {}


def _online(f: Callable[[Matrix], Matrix]) -> Callable[[Matrix], Matrix]:
    METHODS[f.__name__] = f
    return f


def _solve(a: Matrix, b: Matrix) -> Matrix:
    """Least squares where a system of huge or constant values has no own solution."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0] if a.ndim == 2 else np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(a, b, strict=True)])


class _Past:
    """Means of what each series, and all, have had."""

    def __init__(self, n: int):
        self.total, self.count = np.zeros(n), np.zeros(n)

    def mean(self) -> Matrix:
        whole = self.total.sum() / self.count.sum() if self.count.sum() else 0.0
        return np.where(self.count > 0, self.total / np.maximum(self.count, 1), whole)

    def add(self, row: Matrix) -> None:
        on = np.isfinite(row)
        self.total += np.where(on, row, 0)
        self.count += on


def _steps(x: Matrix, state) -> Matrix:
    """Runs state(row, on, t, mean so far) -> fill for each step; what isn't finite becomes the past mean."""
    past, out = _Past(x.shape[1]), np.empty_like(x)
    for t, row in enumerate(x):
        on = np.isfinite(row)
        mean = past.mean()
        fill = state(row, on, t, mean)
        out[t] = np.where(on, row, np.where(np.isfinite(fill), fill, mean))
        past.add(row)
    return out


@_online
def ew_covariance(x: Matrix, halflife: float = 40, ridge: float = 1e-2, warm: int = 5) -> Matrix:
    """Gaussian conditional mean under moments that decay pair by pair: each pair of series counts the steps at which both were seen."""
    n, keep = x.shape[1], 0.5 ** (1 / halflife)
    w, s, p = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n))  # weight, sum of the first, sum of products of each pair

    def step(row, on, t, mean):
        nonlocal w, s, p
        fill = mean
        if t >= warm and on.any():
            m = np.divide(np.diag(s), np.diag(w), out=mean.copy(), where=np.diag(w) > 0)
            both = np.maximum(w, 1e-9)
            c = np.where(w > 1, p / both - (s / both) * (s / both).T, 0.0)
            e, v = np.linalg.eigh((c + c.T) / 2)  # moments of pairs need not fit together
            c = (v * np.maximum(e, ridge * (max(np.trace(c), 0) / n + 1e-9))) @ v.T
            fill = m + c[:, on] @ _solve(c[np.ix_(on, on)], row[on] - m[on])
        seen, v = np.outer(on, on), np.where(on, row, 0.0)
        w, s, p = keep * w + seen, keep * s + seen * v[:, None], keep * p + np.outer(v, v)
        return fill

    return _steps(x, step)


def _projected(basis: Matrix, on: Matrix, z: Matrix, ridge: float = 1e-3, weight: Matrix | None = None) -> Matrix:
    u = basis[on]
    wu = u if weight is None else u * weight[:, None]
    return _solve(wu.T @ u + ridge * np.eye(u.shape[1]), wu.T @ z)


def _subspace(x: Matrix, rank: int, eta: float, nu: float | None, warm: int = 5) -> Matrix:
    """Tracks a subspace of scaled rows by gradient steps kept orthonormal; nu: residuals weigh as in a t distribution."""
    n = x.shape[1]
    k = min(rank, n)
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((n, k)))[0]
    spread = _Spread(n)

    def step(row, on, t, mean):
        nonlocal basis
        dev = spread.dev()
        fill = mean
        if on.any():
            z = (row[on] - mean[on]) / dev[on]
            w = _projected(basis, on, z, 1e-1)
            weight = np.ones(len(z))
            for _ in range(2 if nu else 0):
                r = z - basis[on] @ w
                scale = max(float(np.median(np.abs(r))) * 1.4826, 1e-3)
                weight = (nu + 1) / (nu + (r / scale) ** 2)
                w = _projected(basis, on, z, 1e-1, weight)
            if t >= warm:
                fill = mean + dev * (basis @ w)
            r = np.zeros(n)
            r[on] = weight * (z - basis[on] @ w)
            basis = np.linalg.qr(basis + eta * np.outer(r, w) / (1 + w @ w))[0]
            spread.add(row, mean)
        return fill

    return _steps(x, step)


class _Spread:
    """Deviations of what each series has had."""

    def __init__(self, n: int):
        self.square, self.count = np.zeros(n), np.zeros(n)

    def dev(self) -> Matrix:
        return np.where(self.count > 1, np.sqrt(self.square / np.maximum(self.count, 1)) + 1e-9, 1.0)

    def add(self, row: Matrix, mean: Matrix) -> None:
        on = np.isfinite(row)
        self.square += np.where(on, (row - mean) ** 2, 0)
        self.count += on


@_online
def grouse(x: Matrix) -> Matrix:
    """Subspace tracking of rank 5."""
    return _subspace(x, 5, 0.1, None)


@_online
def robust_grouse(x: Matrix) -> Matrix:
    """Subspace tracking with t weights (4 degrees of freedom) on the residuals."""
    return _subspace(x, 5, 0.15, 4.0)


@_online
def hetero_pca(x: Matrix, rank: int = 5, keep: float = 0.97, warm: int = 12) -> Matrix:
    """Streaming probabilistic principal components with a noise variance for each series, sums of the regression of each series on the factors decaying by `keep`."""
    n = x.shape[1]
    k = min(rank, n)
    basis, noise = 0.1 * np.random.default_rng(0).standard_normal((n, k)), np.ones(n)
    gram, cross, square, held, spread = np.tile(np.eye(k), (n, 1, 1)), np.zeros((n, k)), np.ones(n), np.ones(n), _Spread(n)

    def step(row, on, t, mean):
        nonlocal basis, noise, gram, cross, square, held
        fill, dev = mean, spread.dev()
        if on.any():
            z = np.clip((row[on] - mean[on]) / dev[on], -1e3, 1e3)
            u = basis[on] / noise[on][:, None]
            c = np.linalg.inv(basis[on].T @ u + np.eye(k))
            w = c @ (u.T @ z)
            if t >= warm:
                fill = mean + dev * np.clip(basis @ w, -4, 4)
            second = np.outer(w, w) + c
            gram[on] = keep * gram[on] + second
            cross[on] = keep * cross[on] + z[:, None] * w
            basis[on] = _solve(gram[on] + 1e-3 * np.eye(k), cross[on][:, :, None])[:, :, 0]
            square[on], held[on] = keep * square[on] + (z - basis[on] @ w) ** 2, keep * held[on] + 1
            noise = np.maximum(square / held, 1e-4)
            spread.add(row, mean)
        return fill

    return _steps(x, step)


@_online
def ar_factors(x: Matrix, rank: int = 4, window: int = 80, refit: int = 8, warm: int = 16) -> Matrix:
    """Factors of the differences of a window of filled rows, each with an autoregression; a step is the last row plus the predicted difference, corrected by what is seen of the step."""
    n, held = x.shape[1], []
    k = min(rank, n)
    basis = theta = last = None

    def step(row, on, t, mean):
        nonlocal basis, theta, last
        if not held:
            fill = mean
        else:
            before = held[-1]
            fill = before
            if t >= warm:
                if basis is None or t % refit == 0:
                    d = np.diff(np.array(held[-window:]), axis=0)
                    u, s, v = np.linalg.svd(d, full_matrices=False)
                    basis, f = v[:k].T, u[:, :k] * s[:k]
                    theta = np.clip((f[1:] * f[:-1]).sum(axis=0) / ((f[:-1] ** 2).sum(axis=0) + 0.1), -0.95, 0.95)
                    last = f[-1]
                ahead = theta * last
                if on.any():
                    u = basis[on]
                    ahead = _solve(u.T @ u + 0.5 * np.eye(k), u.T @ (row[on] - before[on]) + 0.5 * ahead)
                fill = before + basis @ ahead
                last = ahead
        held.append(np.where(on, row, np.where(np.isfinite(fill), fill, mean)))
        del held[:-window]
        return fill

    return _steps(x, step)


@_online
def regimes(x: Matrix, window: int = 60, warm: int = 20) -> Matrix:
    """A bank of three autoregressions of each series (random walk, persistent, back to the mean), weighted by their recent errors, mixed with a ridge regression on the series seen at the step."""
    n = x.shape[1]
    rho = np.array([1.0, 0.9, 0.5])
    errors, last, held = np.ones((3, n)), np.zeros(n), []

    def step(row, on, t, mean):
        nonlocal errors, last
        if not held:
            last = mean
        ahead = mean + rho[:, None] * (last - mean)
        w = np.exp(-0.5 * errors / np.maximum(errors.min(axis=0), 1e-9))
        own = (w * ahead).sum(axis=0) / w.sum(axis=0)
        fill = own
        if t >= warm and on.any() and not on.all():
            past = np.array(held[-window:])
            a, b = past[:, on] - past[:, on].mean(axis=0), past[:, ~on] - past[:, ~on].mean(axis=0)
            beta = _solve(a.T @ a + (0.1 * np.trace(a.T @ a) / on.sum() + 1e-6) * np.eye(int(on.sum())), a.T @ b)
            context = past[:, ~on].mean(axis=0) + (row[on] - past[:, on].mean(axis=0)) @ beta
            left = ((b - a @ beta) ** 2).mean(axis=0)
            alone = errors.min(axis=0)[~on]
            fill = own.copy()
            fill[~on] = (context * alone + own[~on] * left) / np.maximum(alone + left, 1e-12)
        errors = np.where(on, 0.95 * errors + 0.05 * (np.where(on, row, 0) - ahead) ** 2, errors)
        last = np.where(on, row, fill)
        held.append(last)
        del held[:-window]
        return fill

    return _steps(x, step)


@_online
def fixed_effect_factors(x: Matrix, rank: int = 3, window: int = 200, refit: int = 10, warm: int = 10) -> Matrix:
    """Past mean of the series, mean residual of the step (shrunk by its uncertainty), and factors of a window of residuals fitted to what is seen of the step."""
    n, held = x.shape[1], []
    k = min(rank, n)
    basis = None

    def step(row, on, t, mean):
        nonlocal basis
        r = row[on] - mean[on]
        time = float(r.mean()) if on.any() else 0.0
        time *= time**2 / (time**2 + r.var() / max(len(r) / 4, 1) + 1e-12) if on.any() else 0.0
        fill = mean + time
        rest = np.where(on, row - fill, 0.0)
        if t >= warm and (basis is None or t % refit == 0):
            basis = np.linalg.svd(np.array(held[-window:]), full_matrices=False)[2][:k].T
        if basis is not None and on.any():
            fill = fill + basis @ _projected(basis, on, rest[on], 0.05)
            rest = np.where(on, rest, fill - mean - time)
        held.append(rest)
        del held[:-window]
        return fill

    return _steps(x, step)


@_online
def wide_covariance(x: Matrix) -> Matrix:
    """The covariance filter for 40 series or more, online factors below: what a wide cross-section pays."""
    return mx.ewcov(x) if x.shape[1] >= 40 else mx.online_factor(x)


def winsorised(x: Matrix, k: float = 2.0, warm: int = 8, gate: float = 10.0) -> Matrix:
    """Values drawn in to k deviations (1.4826 median absolute) around the median of what the series has had, clipped values included, for series whose kurtosis so far is over `gate`."""
    out = x.copy()
    for j in range(x.shape[1]):
        past: list[float] = []
        raw: list[float] = []
        for t in np.flatnonzero(np.isfinite(x[:, j])):
            v = x[t, j]
            raw.append(v)
            if len(past) >= warm:
                p, q = np.array(past), np.array(raw)
                middle = np.median(p)
                band = k * 1.4826 * np.median(np.abs(p - middle))
                spread = q.var()
                heavy = spread > 0 and ((q - q.mean()) ** 4).mean() / spread**2 > gate
                if heavy and band > 0:
                    v = float(np.clip(v, middle - band, middle + band))
            past.append(v)
            out[t, j] = v
    return out


@_online
def winsorised_covariance(x: Matrix) -> Matrix:
    """The covariance filter on winsorised values."""
    return np.where(np.isfinite(x), x, mx.ewcov(winsorised(x)))


def periods(x: Matrix, most: int = 3, least: float = 0.3) -> list[int]:
    """Periods of one series: local maxima of its autocorrelation over `least`, the strongest first, multiples of one already taken left out."""
    on = np.isfinite(x)
    z = np.where(on, x - x[on].mean(), 0.0) if on.any() else x
    n = len(x)
    found = []
    for lag in range(2, n // 3):
        both = on[lag:] & on[:-lag]
        if both.sum() > 10:
            a, b = z[lag:][both], z[:-lag][both]
            found.append((lag, float(a @ b / np.sqrt((a @ a) * (b @ b) + 1e-12))))
    r = dict(found)
    peaks = sorted(((v, k) for k, v in found if v > least and v >= r.get(k - 1, 2) and v > r.get(k + 1, -1)), reverse=True)
    out: list[int] = []
    for v, k in peaks:
        k = min([q for w, q in peaks if w >= 0.85 * v and q > 3 and k % q in (0, 1, q - 1)], default=k)  # the base of which the strongest is a multiple
        if len(out) < most and not any(k % p in (0, 1, p - 1) for p in out):
            out.append(k)
    return out


@_online
def seasonal(x: Matrix, refit: int = 24, warm: int = 48) -> Matrix:
    """Each series by itself: sines and cosines of its own periods and a trend, by ridge regression on its past, if two halves of the past confirm the periods; else its last observation."""
    out = np.empty_like(x)
    for j in range(x.shape[1]):
        col, last, total, count = x[:, j], np.nan, 0.0, 0
        basis, beta = None, None
        for t, v in enumerate(col):
            fill = last if np.isfinite(last) else total / count if count else 0.0
            if t >= warm and t % refit == 0:
                past = col[:t]
                found = periods(past)
                halves = [periods(past[: t // 2]), periods(past[t // 2 :])]
                good = [p for p in found if any(abs(p - q) <= 1 for q in halves[1]) and (t < 6 * p or any(abs(p - q) <= 1 for q in halves[0]))]
                basis = None
                if good:
                    basis = lambda s, good=good: np.concatenate([[np.ones_like(s, float), s / max(t, 1)], *([np.sin(2 * np.pi * s / p), np.cos(2 * np.pi * s / p)] for p in good)])
                    at = np.flatnonzero(np.isfinite(past))
                    a = basis(at.astype(float)).T
                    beta = _solve(a.T @ a + 0.1 * np.eye(a.shape[1]), a.T @ past[at])
                    if ((past[at] - a @ beta) ** 2).mean() > 0.8 * (np.diff(past[at]) ** 2).mean():  # the last observation does as well
                        basis = None
            if basis is not None:
                fill = float(basis(np.array([float(t)]))[:, 0] @ beta)
            out[t, j] = v if np.isfinite(v) else fill
            if np.isfinite(v):
                last, total, count = v, total + v, count + 1
    return out


def effective_rank(c: Matrix) -> float:
    """exp of the entropy of the shares of the eigenvalues."""
    e = np.maximum(np.linalg.eigvalsh(c), 0)
    p = e[e > 0] / e.sum() if e.sum() > 0 else np.ones(1)
    return float(np.exp(-(p * np.log(p)).sum()))


@_online
def ranked_ridge(x: Matrix, window: int = 120, warm: int = 30, refit: int = 10) -> Matrix:
    """Factors where the effective rank of a window is under half of the series, a ridge regression on the series seen at the step where it is higher."""
    n, low, held = x.shape[1], mx.online_factor(x), []
    wide = False

    def step(row, on, t, mean):
        nonlocal wide
        fill = low[t]
        if t >= warm:
            past = np.array(held[-window:])
            c = past - past.mean(axis=0)
            if t % refit == 0 or t == warm:
                z = c / np.where((d := c.std(axis=0)) > 0, d, 1.0)
                wide = effective_rank(z.T @ z / len(z)) > 0.5 * n
            if wide and on.any() and not on.all():
                a, b = c[:, on], c[:, ~on]
                beta = _solve(a.T @ a + (0.05 * np.trace(a.T @ a) / on.sum() + 1e-6) * np.eye(int(on.sum())), a.T @ b)
                fill = fill.copy()
                fill[~on] = past[:, ~on].mean(axis=0) + (row[on] - past[:, on].mean(axis=0)) @ beta
        held.append(np.where(on, row, fill))
        del held[:-window]
        return fill

    return _steps(x, step)


@_online
def shrunk_covariance(x: Matrix, halflife: float = 200, energy: float = 0.95, warm: int = 10) -> Matrix:
    """The covariance filter with its covariance cut to the eigenvalues that hold `energy` of the variance, the rest spread evenly."""
    n, keep = x.shape[1], 0.5 ** (1 / halflife)
    weight, m, c = 0.0, np.zeros(n), np.zeros((n, n))

    def step(row, on, t, mean):
        nonlocal weight, m, c
        fill = mean
        if t >= warm and on.any():
            centre = m / weight
            e, v = np.linalg.eigh(c / weight - np.outer(centre, centre))
            e, v = np.maximum(e[::-1], 0), v[:, ::-1]
            k = int(np.searchsorted(np.cumsum(e), energy * e.sum())) + 1
            floor = e[k:].mean() if k < n else 0.0
            s = (v[:, :k] * e[:k]) @ v[:, :k].T + np.eye(n) * (floor + 1e-2 * e.sum() / n + 1e-9)
            fill = centre + s[:, on] @ _solve(s[np.ix_(on, on)], row[on] - centre[on])
        full = np.where(on, row, fill)
        weight, m, c = keep * weight + 1, keep * m + full, keep * c + np.outer(full, full)
        return fill

    return _steps(x, step)


@_online
def reset_covariance(x: Matrix, drift: float = 0.5, alarm: float = 5.0, burn: int = 30, rest: int = 8, kept: float = 0.15, halflife: float = 200) -> Matrix:
    """The covariance filter with a two-sided cumulative sum on the step's standardised error: an alarm keeps only a small share of the moments."""
    n, keep = x.shape[1], 0.5 ** (1 / halflife)
    weight, m, c = 0.0, np.zeros(n), np.zeros((n, n))
    up = down = 0.0
    quiet, level, spread, seen = 0, 0.0, 1.0, 0

    def step(row, on, t, mean):
        nonlocal weight, m, c, up, down, quiet, level, spread, seen
        fill = mean
        if t >= 5 and on.any():
            centre = m / weight
            s = c / weight - np.outer(centre, centre)
            s = s + np.eye(n) * 1e-2 * (np.trace(s) / n + 1e-9)
            fill = centre + s[:, on] @ _solve(s[np.ix_(on, on)], row[on] - centre[on])
            error = float(((row[on] - centre[on]) / np.sqrt(np.maximum(np.diag(s)[on], 1e-12))).mean())
            seen += 1
            if seen > 5:
                z = (error - level) / max(np.sqrt(spread), 1e-6)
                up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
            level, spread = level + (error - level) / min(seen, 50), spread + ((error - level) ** 2 - spread) / min(seen, 50)
            quiet = max(0, quiet - 1)
            if t >= burn and not quiet and max(up, down) > alarm:
                weight, m, c = kept * weight, kept * m, kept * c
                up = down = 0.0
                quiet = rest
        full = np.where(on, row, fill)
        weight, m, c = keep * weight + 1, keep * m + full, keep * c + np.outer(full, full)
        return fill

    return _steps(x, step)


def windowed(method: Callable[[Matrix], Matrix], x: Matrix, length: int = 24) -> Matrix:
    """A method that sees the whole of a table, run on each trailing window and read at its right edge; a window it fails on or can't fill gives the last observation, else 0."""
    out, last = np.empty_like(x), np.zeros(x.shape[1])
    for t, row in enumerate(x):
        on = np.isfinite(row)
        try:
            fill = method(x[max(0, t - length + 1) : t + 1].copy())[-1]
        except (np.linalg.LinAlgError, ValueError, IndexError):
            fill = last
        out[t] = np.where(on, row, np.where(np.isfinite(fill), fill, last))
        last = np.where(on, row, last)
    return out


@_online
def windowed_softimpute(x: Matrix) -> Matrix:
    return windowed(mx.METHODS["softimpute"], x)


@_online
def routed(x: Matrix) -> Matrix:
    """One series: its seasons; many: covariance; between: by effective rank."""
    n = x.shape[1]
    return seasonal(x) if n == 1 else mx.ewcov(x) if n >= 40 else ranked_ridge(x)


NAMES = tuple(METHODS)
for _name, _fn in METHODS.items():
    mx.METHODS[_name] = _fn
    mx.CAUSAL.add(_name)
    im.register(_name, functools.partial(mx.filled, method=_name), True)


# What windows and aggregates express.


def safety_mean(cells: DataFrame, keys=im.KEYS) -> DataFrame:
    """The series' past mean, then the past mean of all series, then 0. The second comes from one row for each step."""
    steps = cells.groupBy("ord").agg(F.sum("x").alias("_s"), F.count("x").alias("_n"))
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("ord", (F.sum("_s").over(w) / F.nullif(F.sum("_n").over(w), F.lit(0))).alias("_m"))
    got = cells.join(steps, "ord")
    return got.withColumn("fill", F.coalesce("x", F.avg("x").over(im.past(keys)), "_m", F.lit(0.0))).drop("_m")


def panel_ewma(cells: DataFrame, halflife: float = 5.0, keys=pn.KEYS) -> DataFrame:
    """The decayed mean of an entity's own past."""
    return im.ewma(cells, keys, halflife)


def step_ewma(cells: DataFrame, halflife: float = 20.0) -> DataFrame:
    """The mean of a feature over entities at each step, decayed over steps strictly before: one short series for each feature."""
    steps = cells.groupBy("feature", "ord").agg(F.avg("x").alias("x"))
    lam = 0.5 ** (1 / halflife)

    def run(ords, xs):
        num = den = 0.0
        out = []
        for x in xs:
            out.append(num / den if den else 0.0)
            num, den = lam * num + (x or 0.0), lam * den + (x is not None)
        return out

    got = im._scanned(steps.withColumn("_seen", F.col("x")), ("feature",), run, always=True).select("feature", "ord", F.col("fill").alias("_m"))
    return cells.join(got, ["feature", "ord"]).withColumn("fill", F.coalesce("x", "_m")).drop("_m")


def gap_aware(cells: DataFrame, keys=pn.KEYS, low: float = 0.60, high: float = 0.72, tau: float = 6.0) -> DataFrame:
    """Joint panel engine and the entity's own filter, the joint one the more the longer the gap: its share goes from `low` to `high` over about tau steps."""
    ids = [*keys, "ord"]
    gap = missingness(cells, keys).select(*ids, F.col("time_since_obs").alias("_g"))
    one = lambda df, name: df.groupBy(*ids).agg(F.first("fill").alias(name))
    share: Column = low + (high - low) * (1 - F.exp(-F.col("_g") / tau))
    both = cells.join(gap, ids).join(one(pn.joint(cells, keys), "_j"), ids).join(one(mx.filled(cells, "fixed_effect_factors", keys), "_p"), ids)
    return both.withColumn("fill", F.coalesce("x", share * F.col("_j") + (1 - share) * F.col("_p"))).drop("_g", "_j", "_p")


def by_shape(cells: DataFrame, keys=im.KEYS) -> DataFrame:
    """A panel: factors with fixed effects; a matrix: online factors."""
    return mx.filled(cells, "fixed_effect_factors" if len(keys) > 1 else "online_factor", keys)


def panel_factors(cells: DataFrame, keys=pn.KEYS, rounds: int = 6) -> DataFrame:
    """Batch: entity and step means of each feature taken out in turn, the residuals of all entities side by side as one matrix, its factors, and all put back together."""
    entity, step = Window.partitionBy(*keys), Window.partitionBy("feature", "ord")
    got = cells.withColumns({"_a": F.lit(0.0), "_b": F.lit(0.0)})
    for _ in range(rounds):
        got = got.withColumn("_a", F.coalesce(F.avg(F.col("x") - F.col("_b")).over(entity), F.lit(0.0)))
        got = got.withColumn("_b", F.coalesce(F.avg(F.col("x") - F.col("_a")).over(step), F.lit(0.0)))
    rest = got.withColumn("_c", F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys])).select("_c", "ord", (F.col("x") - F.col("_a") - F.col("_b")).alias("x"))
    low = mx.filled(rest.withColumnRenamed("_c", "feature"), "trmf", ("feature",)).select(F.col("feature").alias("_c"), "ord", F.col("fill").alias("_low"))
    joined = got.withColumn("_c", F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys])).join(low, ["_c", "ord"])
    return joined.withColumn("fill", F.coalesce("x", F.col("_a") + F.col("_b") + F.col("_low"))).drop("_a", "_b", "_c", "_low")


im.register("safety_mean", safety_mean, True)
