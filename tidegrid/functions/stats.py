"""Statistics of comparisons, volatility losses and gap theory. Rows of experiments are aggregated by Spark; what is left for numpy are small samples and matrices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.scores import erfc


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_tail(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for whole degrees of freedom, by the recurrence from one or two."""
    if x <= 0:
        return 1.0
    out, term = (float(erfc(np.array([math.sqrt(x / 2)]))[0]), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)) if df % 2 else (math.exp(-x / 2), math.exp(-x / 2) * x / 2)
    for k in range(1 + (df % 2 == 0), df - 1, 2) if df > 2 else ():
        out += term
        term *= x / (k + 2)
    return out


def t_interval(x: np.ndarray, confidence: float = 0.95) -> tuple[float, float]:
    """Mean and half-width."""
    n = len(x)
    return (float(np.mean(x)), t_quantile(0.5 + confidence / 2, n - 1) * float(np.std(x, ddof=1)) / math.sqrt(n)) if n > 1 else (float(np.mean(x)), 0.0)


def bootstrap_interval(x: np.ndarray, confidence: float = 0.95, draws: int = 5000, seed: int = 0) -> tuple[float, float]:
    x = np.asarray(x, float)
    if len(x) < 2:
        return float(x.mean()), float(x.mean())
    means = x[np.random.default_rng(12345 + seed).integers(0, len(x), (draws, len(x)))].mean(axis=1)
    lo, hi = np.percentile(means, [50 * (1 - confidence), 50 * (1 + confidence)])
    return float(lo), float(hi)


def wilcoxon(d: np.ndarray) -> float:
    """Two-sided p of the signed-rank test: exact for up to 25 differences without ties, else the normal approximation."""
    d = np.asarray(d, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return float("nan")
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    up = ranks[d > 0].sum()
    low = min(up, ranks.sum() - up)
    if n <= 25 and len(np.unique(np.abs(d))) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    ties = pd.Series(np.abs(d)).value_counts().to_numpy()
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
    return float(erfc(np.array([abs(low - n * (n + 1) / 4) / sd / math.sqrt(2)]))[0])


def friedman(blocks: np.ndarray) -> tuple[float, float]:
    """Statistic and p of blocks by methods."""
    n, k = blocks.shape
    ranks = pd.DataFrame(blocks).rank(axis=1).to_numpy()
    ties = sum(((c := pd.Series(r).value_counts().to_numpy()) ** 3 - c).sum() for r in blocks)
    q = (12 / (n * k * (k + 1)) * (ranks.sum(axis=0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))
    return float(q), chi2_tail(float(q), k - 1)


def compared(results: DataFrame, method: str, against: str, score: str = "mae", block: tuple[str, ...] = ("dataset", "seed")) -> DataFrame:
    """One row of a paired comparison over blocks: n, mean_diff (positive: `method` is better), the t interval, p of the paired t test, wilcoxon_p."""
    of = lambda m: F.max(F.when(F.col("method") == m, F.col(score)))
    pairs = results.groupBy(*block).agg(of(method).alias("a"), of(against).alias("b")).where("a is not null and b is not null")
    d = np.array([r.d for r in pairs.select((F.col("b") - F.col("a")).alias("d")).collect()], float)  # one number for each experiment
    n = len(d)
    mean, half = t_interval(d) if n else (float("nan"), float("nan"))
    sd = float(np.std(d, ddof=1)) if n > 1 else 0.0
    p = t_tail(mean / (sd / math.sqrt(n)), n - 1) if sd > 0 else float("nan")
    row = (method, against, n, mean, mean - half, mean + half, p, wilcoxon(d) if n else float("nan"))
    return results.sparkSession.createDataFrame([row], "method string, against string, n int, mean_diff double, low double, high double, t_p double, wilcoxon_p double")


def averaged(results: DataFrame, score: str = "mae") -> DataFrame:
    """(dataset, method, n, score, place): the mean over seeds of each method on each data set and its place there; failures (null) are counted as n_failed."""
    each = results.groupBy("dataset", "method").agg(F.count(score).alias("n"), F.sum(F.col(score).isNull().cast("long")).alias("n_failed"), F.avg(score).alias(score))
    return each.withColumn("place", F.rank().over(Window.partitionBy("dataset").orderBy(F.asc_nulls_last(score))))


def leaderboard(results: DataFrame, score: str = "mae") -> DataFrame:
    """(method, mean_place, wins, n_datasets), the best first."""
    return averaged(results, score).groupBy("method").agg(F.avg("place").alias("mean_place"), F.sum((F.col("place") == 1).cast("long")).alias("wins"), F.count(F.lit(1)).alias("n_datasets")).orderBy("mean_place", "method")


def accepted(results: DataFrame, champion: str, challenger: str, worst: float = 0.02, budget: float = 0.10) -> DataFrame:
    """One row: whether a challenger replaces the champion. No data set may get worse by over `worst`; then either it is faster without loss, or better at most `budget` slower and gaining at least as much as it costs, in proportion."""
    of = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    each = results.groupBy("dataset").agg(of(champion, "mae").alias("a"), of(challenger, "mae").alias("b"), of(champion, "seconds").alias("s"), of(challenger, "seconds").alias("u"))
    row = each.agg(F.avg("a").alias("mae_champion"), F.avg("b").alias("mae_challenger"), F.max(F.col("b") - F.col("a")).alias("largest_loss"), ((F.sum("u") - F.sum("s")) / F.greatest(F.sum("s"), F.lit(1e-9))).alias("cost"))
    gain = F.col("mae_champion") - F.col("mae_challenger")
    share = gain / F.greatest(F.abs("mae_champion"), F.lit(1e-9))
    good = ((gain >= -1e-9) & (F.col("cost") < -1e-6)) | ((gain > 1e-6) & (F.col("cost") <= budget) & (share >= F.col("cost")))
    return row.withColumns({"gain": gain, "accepted": (F.col("largest_loss") <= worst) & good})


def qlike(variance: Column, proxy: Column) -> Column:
    """The loss of one forecast of a variance: ln h + proxy / h. Average it."""
    h = F.greatest(variance, F.lit(1e-12))
    return F.log(h) + proxy / h


def variance_scores(df: DataFrame, forecast: str, proxy: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean QLIKE and squared error of variance forecasts."""
    h, p = F.col(forecast), F.col(proxy)
    return df.where(h.isNotNull() & p.isNotNull()).groupBy(*by).agg(F.avg(qlike(h, p)).alias("qlike"), F.avg((h - p) * (h - p)).alias("mse"), F.count(F.lit(1)).alias("n"))


def value_at_risk(df: DataFrame, returned: str, variance: str, by: tuple[str, ...], p: float = 0.01) -> DataFrame:
    """Rate of returns below the normal quantile at p, and Kupiec's likelihood ratio with its p-value (null without or with only violations)."""
    from tidegrid.operators.evaluate import normal_quantile

    under = F.col(returned) < normal_quantile(p) * F.sqrt(F.greatest(F.col(variance), F.lit(1e-12)))
    got = df.where(F.col(returned).isNotNull() & F.col(variance).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(under.cast("long")).alias("n_under"))
    n, x, rate = F.col("n"), F.col("n_under"), F.col("n_under") / F.col("n")
    ll = lambda q: (n - x) * F.log(1 - q) + x * F.log(q)
    got = got.withColumns({"rate": rate, "ratio": F.when((x > 0) & (x < n), -2 * (ll(F.lit(p)) - ll(rate)))})

    @F.pandas_udf("double")
    def tail(lr: pd.Series) -> pd.Series:
        v = np.sqrt(np.maximum(lr.to_numpy(float), 0) / 2)
        return pd.Series(np.where(np.isnan(v), np.nan, erfc(v)), index=lr.index)

    return got.withColumn("p_value", F.when(F.col("ratio").isNotNull(), tail("ratio")))


def portfolio_variance(covariances: np.ndarray, returns: np.ndarray) -> float:
    """Mean squared return of the portfolios of least variance, one for each step's covariance; steps with missing returns are left out."""
    t, n = returns.shape
    ok = np.isfinite(returns).all(axis=1)
    w = np.linalg.solve(covariances[ok] + 1e-8 * np.eye(n), np.ones((int(ok.sum()), n, 1)))[:, :, 0]
    w /= w.sum(axis=1, keepdims=True)
    return float(np.mean((w * returns[ok]).sum(axis=1) ** 2)) if ok.any() else float("nan")


def covariance_qlike(forecast: np.ndarray, true: np.ndarray) -> float:
    """Mean of trace(F^-1 S) - ln det(F^-1 S) - n over steps."""
    n = forecast.shape[1]
    m = np.linalg.solve(forecast + 1e-8 * np.eye(n), true)
    sign, log = np.linalg.slogdet(m)
    ok = (sign > 0) & np.isfinite(log)
    return float(np.mean(np.trace(m, axis1=1, axis2=2)[ok] - log[ok] - n)) if ok.any() else float("nan")


def canonical_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Mean canonical correlation of two sets of columns: 1 if they span the same space."""
    q = [np.linalg.qr(x - x.mean(axis=0))[0] for x in (a, b)]
    s = np.linalg.svd(q[0].T @ q[1], compute_uv=False)
    return float(np.clip(s[: min(a.shape[1], b.shape[1])], 0, 1).mean())


def explained(cells: DataFrame, k: int = 5) -> DataFrame:
    """(component, share, cumulative): variance of the standardised series explained by principal components. The matrix of products is a Spark aggregate over steps that series share; only that matrix reaches the driver, features squared."""
    mean = cells.groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = cells.join(mean, "feature").select("ord", "feature", F.coalesce((F.col("x") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), F.lit(0.0)).alias("z"))
    a, b = z.alias("a"), z.alias("b")
    cross = a.join(b, F.col("a.ord") == F.col("b.ord")).groupBy(F.col("a.feature").alias("i"), F.col("b.feature").alias("j")).agg(F.sum(F.col("a.z") * F.col("b.z")).alias("c")).collect()
    names = sorted({r.i for r in cross})
    at = {f: n for n, f in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    for r in cross:
        c[at[r.i], at[r.j]] = r.c
    share = np.sort(np.linalg.eigvalsh(c))[::-1] if len(names) else np.zeros(0)
    share = np.maximum(share, 0) / max(share.sum(), 1e-300)
    rows = [(i + 1, float(v), float(share[: i + 1].sum())) for i, v in enumerate(share[:k])]
    return cells.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def gap_theory(df: DataFrame, memory: str = "a", gap: str = "g", scale2: float = 1.0) -> DataFrame:
    """Adds for an AR(1) with coefficient a and an inner gap of g steps the mean absolute error of a filter, of a smoother, and their difference: closed forms, averaged over the gap's steps."""
    a, g = F.col(memory), F.col(gap)
    each = F.sequence(F.lit(1), g.cast("int"))
    filtered = lambda k: scale2 * (1 - F.pow(a, 2 * k))
    smoothed = lambda k: filtered(k) * (1 - F.pow(a, 2 * (g + 1 - k))) / (1 - F.pow(a, 2 * (g + 1)))
    mean = lambda f: math.sqrt(2 / math.pi) * F.aggregate(F.transform(each, lambda k: F.sqrt(f(k))), F.lit(0.0), lambda acc, v: acc + v) / g
    out = df.withColumns({"mae_filter": mean(filtered), "mae_smoother": mean(smoothed)})
    return out.withColumn("difference", F.col("mae_filter") - F.col("mae_smoother"))


def simulated_gap(a: float, g: int, trials: int = 20_000, seed: int = 0) -> tuple[float, float]:
    """Mean absolute errors of the filter and the smoother measured on made AR(1) stretches."""
    rng = np.random.default_rng(seed)
    x = np.empty((trials, g + 2))
    x[:, 0] = rng.standard_normal(trials)
    for t in range(1, g + 2):
        x[:, t] = a * x[:, t - 1] + math.sqrt(1 - a * a) * rng.standard_normal(trials)
    k = np.arange(1, g + 1)
    ends = 1 - a ** (2 * (g + 1))
    left, right = a**k * (1 - a ** (2 * (g + 1 - k))) / ends, a ** (g + 1 - k) * (1 - a ** (2 * k)) / ends
    inner = x[:, 1:-1]
    return float(np.abs(inner - x[:, :1] * a**k).mean()), float(np.abs(inner - x[:, :1] * left - x[:, -1:] * right).mean())


def r_squared(cells: DataFrame, target: str, ridge: float = 0.0, where: str = "true") -> DataFrame:
    """(target, r2, n): share of the target's variance that a linear regression on the other series explains, over steps where all are seen. Sums of products are a Spark aggregate over steps; features squared numbers reach the driver."""
    names = sorted(r.feature for r in cells.select("feature").distinct().collect())
    others = [f for f in names if f != target]
    wide = cells.where(where).groupBy("ord").pivot("feature", names).agg(F.avg("x")).na.drop()
    columns = [F.lit(1.0), *(F.col(f"`{f}`") for f in others), F.col(f"`{target}`")]
    sums = wide.agg(F.count(F.lit(1)), *[F.sum(columns[i] * columns[j]) for i in range(len(columns)) for j in range(i + 1)]).first()
    n, c = sums[0], np.zeros((len(columns), len(columns)))
    if n < 3:
        return cells.sparkSession.createDataFrame([(target, None, n)], "target string, r2 double, n long")
    c[np.tril_indices(len(columns))] = sums[1:]
    c = c + np.tril(c, -1).T
    penalty = ridge * np.eye(len(columns) - 1)
    penalty[0, 0] = 0
    beta = np.linalg.lstsq(c[:-1, :-1] + penalty, c[:-1, -1], rcond=None)[0]
    rest = c[-1, -1] - 2 * beta @ c[:-1, -1] + beta @ c[:-1, :-1] @ beta
    total = c[-1, -1] - c[0, -1] ** 2 / n
    return cells.sparkSession.createDataFrame([(target, float(1 - rest / total) if total > 0 else None, n)], "target string, r2 double, n long")
