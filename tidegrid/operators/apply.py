"""What is built on the imputers: races between methods, evaluation by horizon and sample, lag regressions, nowcasts at releases, variance and covariance forecasts.

Rows stay in Spark; numpy gets sums of products (features squared), one series, or one window of a matrix for each Arrow group.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegrid.operators import audit as au
from tidegrid.operators import evaluate as ev
from tidegrid.operators import impute as im
from tidegrid.operators.impute import KEYS

RESULT = "dataset string, method string, seed int, mae double, rmse double, n long, error string"


def _tried(run: Callable[[], DataFrame]) -> tuple[float | None, float | None, int, str | None]:
    """Figures of one run, or its error: one row, so it is run here."""
    try:
        r = run().first()
        return r.mae, r.rmse, r.n, None
    except Exception as e:  # noqa: BLE001 - whatever a caller's method raises is its result
        return None, None, 0, f"{type(e).__name__}: {e}"[:200]


def over_seeds(sets: dict[str, DataFrame], methods: list[str], seeds: tuple[int, ...] = (0, 1, 2), mechanism: str = "mcar", rate: float = 0.2, keys=KEYS) -> DataFrame:
    """(dataset, method, seed, mae, rmse, n, error): each method on each data set under the same masks; a method that fails has its error in place of figures."""
    rows = []
    for name, cells in sets.items():
        for seed in seeds:
            hidden = ev.masked(cells, mechanism, rate, seed)
            rows += [(name, m, seed, *_tried(lambda h=hidden, m=m: ev.scores(im.impute(h, m, keys=keys)))) for m in methods]
    return next(iter(sets.values())).sparkSession.createDataFrame(rows, RESULT)


def benchmark(cells: DataFrame, methods: list[str] | None = None, mechanism: str = "mcar", rate: float = 0.15, seed: int = 3, keys=KEYS, extra: dict[str, tuple[Callable[..., DataFrame], bool]] | None = None) -> DataFrame:
    """(method, causal, mae, rmse, n, error, place): the same mask for all, point-in-time methods first. extra: methods of the caller's, name -> (function of cells and keys, point in time)."""
    known = im.METHODS | (extra or {})
    hidden = ev.masked(cells, mechanism, rate, seed)
    names = methods if methods is not None else list(known)
    rows = [(m, known[m][1], *_tried(lambda f=known[m][0]: ev.scores(f(hidden, keys=keys)))) for m in names]
    out = cells.sparkSession.createDataFrame(rows, "method string, causal boolean, mae double, rmse double, n long, error string")
    return out.withColumn("place", F.rank().over(Window.partitionBy("causal").orderBy(F.asc_nulls_last("mae")))).orderBy(F.desc("causal"), "place", "method")


def race(cells: DataFrame, methods: list[str], cut: float = 0.6, mechanism: str = "mcar", rate: float = 0.2, seed: int = 0, length: int = 24, keys=KEYS) -> DataFrame:
    """(method, mae_full, mae_causal): history is whole, cells are hidden in the live part only, and each method is scored on all rows and as a filter."""
    top = F.max("ord").over(Window.partitionBy(*keys))
    live = cells.withColumn("_live", F.col("ord") >= F.floor((top + 1) * cut))
    hidden = ev.masked(live, mechanism, rate, seed)
    hidden = hidden.withColumn("hidden", F.col("hidden") & F.col("_live")).withColumn("x", F.when(F.col("hidden"), F.lit(None)).otherwise(F.col("truth"))).drop("_live")
    one = lambda m: au.masked_mae(im.impute(hidden, m, keys=keys)).withColumnRenamed("mae", "mae_full").crossJoin(au.masked_mae(au.causal_variant(hidden, m, length, keys)).withColumnRenamed("mae", "mae_causal")).withColumn("method", F.lit(m))  # noqa: E731 - single rows
    return reduce(DataFrame.unionByName, map(one, methods)).select("method", "mae_full", "mae_causal")


def by_horizon(predicted: DataFrame, left_out: Column, baseline: str = "persistence") -> DataFrame:
    """(sample, model, horizon, n, rmse, skill) of rows (model, horizon, truth, fill): all rows, and those outside `left_out`; skill is 1 - rmse / that of the baseline."""
    samples = F.when(left_out, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("without")))
    each = predicted.where("truth is not null and fill is not null").withColumn("sample", F.explode(samples))
    e = F.col("fill") - F.col("truth")
    got = each.groupBy("sample", "model", "horizon").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))
    base = F.max(F.when(F.col("model") == baseline, F.col("rmse"))).over(Window.partitionBy("sample", "horizon"))
    return got.withColumn("skill", 1 - F.col("rmse") / F.nullif(base, F.lit(0.0)))


def flat_band(scored: DataFrame, level: float = 0.9, train: float = 0.5, keys=KEYS) -> DataFrame:
    """(keys..., q, coverage, n): one conformal half-width from the first part of each series' absolute errors (column err), and how many of the rest it covers."""
    top = F.max("ord").over(Window.partitionBy(*keys))
    parts = scored.where("err is not null").withColumn("_early", F.col("ord") < top * train)
    q = ev.conformal_quantile(parts.where("_early").withColumn("score", F.col("err")), level, tuple(keys))
    late = parts.where("not _early").join(F.broadcast(q), list(keys))  # one row for each series
    return late.groupBy(*keys, "q").agg(F.avg((F.col("err") <= F.col("q")).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def static_multipliers(scored: DataFrame, levels: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95), least: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., level, n, multiplier): the conformal quantile of all scores; the normal one with fewer than `least`."""
    normal = scored.sparkSession.createDataFrame([(float(v), ev.normal_quantile((1 + v) / 2)) for v in levels], "level double, _z double")
    have = scored.where("score is not null and not isnan(score)")
    counts = have.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    found = [ev.conformal_quantile(have, v, by).withColumn("level", F.lit(float(v))) for v in levels]
    q = reduce(DataFrame.unionByName, found)
    out = counts.join(F.broadcast(normal), F.lit(True)).join(q, [*by, "level"], "left")
    return out.select(*by, "level", "n", F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("_z")).alias("multiplier"))


# Regressions on sums of products.


def lagged(cells: DataFrame, target: str, lags: int = 2, value: str = "fill", ahead: int = 1) -> tuple[DataFrame, list[str]]:
    """(ord, y, features...): the target `ahead` steps later, and all series now and at lags before."""
    names = sorted(r.feature for r in cells.select("feature").distinct().collect())
    wide = cells.groupBy("ord").pivot("feature", names).agg(F.first(value))
    w = Window.orderBy("ord")  # one row for each step
    columns = [f"f{i}_{k}" for i in range(len(names)) for k in range(lags)]
    out = wide.select("ord", F.lead(f"`{target}`", ahead).over(w).alias("y"), *[(F.lag(f"`{f}`", k).over(w) if k else F.col(f"`{f}`")).alias(f"f{i}_{k}") for i, f in enumerate(names) for k in range(lags)])
    return out.na.drop(), columns


def ridge(rows: DataFrame, columns: list[str], target: str = "y", penalty: float = 1.0) -> dict[str, float]:
    """Coefficients with an intercept ("") of a ridge regression on standardised features, from one aggregate of sums of products."""
    x = [F.lit(1.0), *(F.col(f"`{c}`") for c in columns), F.col(f"`{target}`")]
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i + 1)]).first()
    n, c = sums[0], np.zeros((len(x), len(x)))
    if not n:
        return {"": 0.0} | dict.fromkeys(columns, 0.0)
    c[np.tril_indices(len(x))] = sums[1:]
    c += np.tril(c, -1).T
    mean = c[0] / n
    centred = c / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(centred), 1e-18))
    k = len(columns)
    z = centred[1 : k + 1, 1 : k + 1] / np.outer(dev[1 : k + 1], dev[1 : k + 1])
    beta = np.linalg.solve(z + penalty / n * np.eye(k), centred[1 : k + 1, -1] / dev[1 : k + 1]) / dev[1 : k + 1] if k else np.zeros(0)
    return {"": float(mean[-1] - beta @ mean[1 : k + 1])} | dict(zip(columns, beta.tolist(), strict=True))


def predicted(rows: DataFrame, beta: dict[str, float], name: str = "fill") -> DataFrame:
    return rows.withColumn(name, sum((F.col(f"`{c}`") * b for c, b in beta.items() if c), F.lit(beta[""])))


def backtest(filled: DataFrame, target: str, cut: float = 0.6, lags: int = 2, penalty: float = 1.0, period: int = 24) -> DataFrame:
    """One row of a lag regression learned on the first part and read on the rest: r2, and the Sharpe ratio per `period` of going with the sign of the forecast change."""
    rows, columns = lagged(filled, target, lags)
    top = rows.agg(F.max("ord")).first()[0] or 0
    beta = ridge(rows.where(F.col("ord") < cut * top), columns, penalty=penalty)
    names = sorted(r.feature for r in filled.select("feature").distinct().collect())
    now = F.col(f"f{names.index(target)}_0")
    live = predicted(rows.where(F.col("ord") >= cut * top), beta)
    gain = F.signum(F.col("fill") - now) * (F.col("y") - now)
    e = F.col("y") - F.col("fill")
    got = live.agg(F.count(F.lit(1)).alias("n"), (1 - F.sum(e * e) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))).alias("r2"), (F.avg(gain) / F.nullif(F.stddev_pop(gain), F.lit(0.0)) * math.sqrt(period)).alias("sharpe"))
    return got.withColumn("target", F.lit(target))


def reported_and_live(cells: DataFrame, method: str, target: str, cut: float = 0.6, length: int = 24, **options) -> DataFrame:
    """Two rows: the backtest on a table filled as a whole, and on one filled as it would have been live. Their difference is what looking ahead reports."""
    whole = backtest(im.impute(cells, method), target, cut, **options).withColumn("kind", F.lit("reported"))
    live = backtest(au.causal_variant(cells, method, length), target, cut, **options).withColumn("kind", F.lit("live"))
    return whole.unionByName(live)


def picked_target(cells: DataFrame, cut: float = 0.6) -> str:
    """The series that the others explain best on the training part."""
    from tidegrid.functions.stats import r_squared

    top = cells.agg(F.max("ord")).first()[0] or 0
    names = sorted(r.feature for r in cells.select("feature").distinct().collect())
    scores = {f: r_squared(cells, f, 1.0, f"ord < {cut * top}").first().r2 or -1.0 for f in names}
    return max(names, key=lambda f: (scores[f], f))


def boosted(rows: DataFrame, columns: list[str], cut: float = 0.6, trees: int = 30) -> DataFrame:
    """Boosted stumps on bootstrap samples, learned on the first part of the steps: the rows with `fill`."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    top = rows.agg(F.max("ord")).first()[0] or 0
    table = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows)
    model = GBTRegressor(featuresCol="_x", labelCol="y", predictionCol="fill", maxIter=trees, maxDepth=1, stepSize=0.1, subsamplingRate=0.7, seed=0).fit(table.where(F.col("ord") < cut * top))
    return model.transform(table).drop("_x")


def contemporaneous(cells: DataFrame, target: str, method: str = "locf", cut: float = 0.6, penalty: float = 1.0) -> DataFrame:
    """(ord, y, fill) of the live part: the target from the other series of the same step, filled up to that step only; coefficients from the complete training part."""
    names = sorted(r.feature for r in cells.select("feature").distinct().collect())
    others = [f for f in names if f != target]
    top = cells.agg(F.max("ord")).first()[0] or 0
    wide = lambda df, v: df.groupBy("ord").pivot("feature", names).agg(F.first(v)).withColumnRenamed(target, "y")
    beta = ridge(wide(cells.where(F.col("ord") < cut * top), "x").na.drop(), others, penalty=penalty)
    features = wide(au.causal_variant(cells.where(F.col("feature") != target), method).unionByName(cells.where(F.col("feature") == target).withColumn("fill", F.col("x"))), "fill")
    return predicted(features.where(F.col("ord") >= cut * top), beta).select("ord", "y", "fill")


# Nowcasts.


def nowcast(cells: DataFrame, target: str, k: int = 3, first: float = 0.4, method: str = "locf") -> DataFrame:
    """(ord, model, truth, fill) at each release (the last of k steps) behind the first part: the last release (persistence), a regression on the period's mean of the other series (bridge) and on the first principal direction of these
    (factor), each learned on the releases before it only."""
    other = im.impute(cells.where(F.col("feature") != target), method)
    w = Window.partitionBy("feature").orderBy("ord").rowsBetween(-(k - 1), 0)
    means = other.withColumn("m", F.avg("fill").over(w)).where(F.col("ord") % k == k - 1)
    z = Window.partitionBy("feature").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # point in time
    scaled = (F.col("m") - F.avg("m").over(z)) / F.nullif(F.stddev_pop("m").over(z), F.lit(0.0))
    per = means.withColumn("s", scaled).groupBy("ord").agg(F.avg("m").alias("bridge"), F.avg("s").alias("factor"))
    y = cells.where((F.col("feature") == target) & (F.col("ord") % k == k - 1)).select("ord", F.col("x").alias("truth"))
    rows = y.join(per, "ord")
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # one row for each release
    out = rows.withColumn("persistence", F.last("truth", True).over(before))
    for c in ("bridge", "factor"):
        both = F.when(F.col("truth").isNotNull(), F.col(c))
        mx, my, n = F.avg(both).over(before), F.avg(F.when(F.col(c).isNotNull(), F.col("truth"))).over(before), F.count(both).over(before)
        slope = F.covar_pop("truth", c).over(before) / F.nullif(F.var_pop(both).over(before), F.lit(0.0))
        out = out.withColumn(f"_{c}", F.when(n >= 8, my + slope * (F.col(c) - mx)).otherwise(F.col("persistence")))
    top = rows.agg(F.max("ord")).first()[0] or 0
    out = out.where(F.col("ord") >= first * top).select("ord", "truth", "persistence", F.col("_bridge").alias("bridge"), F.col("_factor").alias("factor"))
    return out.unpivot(["ord", "truth"], ["persistence", "bridge", "factor"], "model", "fill")


def sharpening(cells: DataFrame, target: str, k: int = 3, method: str = "locf") -> DataFrame:
    """(age, mae, n): errors of the fill of a target that is seen at the last of k steps only, by steps since its last release."""
    hidden = cells.withColumn("truth", F.col("x")).withColumn("x", F.when((F.col("feature") != target) | (F.col("ord") % k == k - 1), F.col("x")))
    got = im.impute(hidden, method).where((F.col("feature") == target) & F.col("x").isNull() & F.col("truth").isNotNull())
    return got.groupBy((F.col("ord") % k + 1).alias("age")).agg(F.avg(F.abs(F.col("fill") - F.col("truth"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def growth(cells: DataFrame, steps: int = 1, keys=KEYS) -> DataFrame:
    """x becomes the change of its logarithm over `steps`, in percent; null where either value isn't positive."""
    w = Window.partitionBy(*keys).orderBy("ord")
    positive = lambda c: F.when(c > 0, F.log(c))
    return cells.withColumn("x", 100 * (positive(F.col("x")) - positive(F.lag("x", steps).over(w))))


def one_step(cells: DataFrame, keys=KEYS, least: int = 10) -> DataFrame:
    """(keys..., ord, model, horizon, truth, fill): forecasts of each observed value by its last one (persistence) and by a first-order autoregression on the pairs strictly before."""
    w = Window.partitionBy(*keys).orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.where("x is not null").withColumn("p", F.lag("x").over(w)).withColumn("_y", F.when(F.col("p").isNotNull(), F.col("x")))
    slope = F.covar_pop("_y", "p").over(before) / F.nullif(F.var_pop("p").over(before), F.lit(0.0))
    ar = F.when(F.count("p").over(before) >= least, F.avg("_y").over(before) + slope * (F.col("p") - F.avg("p").over(before))).otherwise(F.col("p"))
    got = rows.withColumn("ar1", ar).where("p is not null").select(*keys, "ord", F.lit(1).alias("horizon"), F.col("x").alias("truth"), F.col("p").alias("persistence"), "ar1")
    return got.unpivot([*keys, "ord", "horizon", "truth"], ["persistence", "ar1"], "model", "fill")


# Variances and covariances.


def ewma_variance(cells: DataFrame, lam: float = 0.94, keys=KEYS) -> DataFrame:
    """Adds variance: the decayed mean square of what the series has had strictly before, each observation once; null before the first."""

    def run(ords, xs):
        num = den = 0.0
        out = []
        for x in xs:
            out.append(num / den if den else float("nan"))
            if x is not None:
                num, den = lam * num + x * x, lam * den + 1
        return out

    got = im._scanned(cells.withColumnRenamed("fill", "_fill") if "fill" in cells.columns else cells, tuple(keys), run, always=True)
    return got.withColumn("variance", F.when(~F.isnan("fill"), F.col("fill"))).drop("fill")


def robust_variance(cells: DataFrame, width: int = 60, keys=KEYS) -> DataFrame:
    """Adds variance from the median absolute value of the last `width` observations strictly before."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(-width, -1)
    mad = F.expr("percentile(abs(x), 0.5)").over(w)
    return cells.withColumn("variance", F.pow(1.4826 * mad, 2))


def _t_garch(x: np.ndarray, omega: float, a: float, b: float, nu: float) -> tuple[np.ndarray, float]:
    """Variances and log-likelihood of a filter whose news is the score of a t distribution: an outlier moves it by a bounded amount. Missing values leave the level to return to its mean."""
    h = np.empty(len(x))
    level = omega
    ll = 0.0
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    for i, v in enumerate(x):
        h[i] = level
        u = 0.0
        if v == v:
            q = v * v / ((nu - 2) * level)
            u = level * ((nu + 1) * q / (1 + q) - 1)
            ll += const - 0.5 * math.log(level) - (nu + 1) / 2 * math.log1p(q)
        level = max(omega * (1 - b) + b * level + a * u, 1e-8 * omega)
    return h, ll


def _descended(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 120) -> np.ndarray:
    """A simplex that moves downhill."""
    n = len(start)
    points = np.vstack([start, start + 0.4 * np.eye(n)])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = points[order], values[order]
        middle = points[:-1].mean(axis=0)
        tried = [(f(p), p) for p in (middle + s * (middle - points[-1]) for s in (1.0, 2.0, -0.5))]
        best = min(tried, key=lambda v: v[0])
        if best[0] < values[-1]:
            points[-1], values[-1] = best[1], best[0]
        else:
            points[1:] = (points[1:] + points[0]) / 2
            values[1:] = [f(p) for p in points[1:]]
    return points[np.argmin(values)]


def fitted_garch(x: np.ndarray, score: bool = True) -> tuple[np.ndarray, dict[str, float]]:
    """One series' variances by the filter above (score) or by squared returns, parameters by likelihood."""
    seen = x[np.isfinite(x)]
    omega = max(float(np.mean(seen**2)), 1e-12) if len(seen) else 1.0

    def parts(p):
        a, b, nu = 1 / (1 + math.exp(-p[0])) * 0.3, 0.7 + 0.2999 / (1 + math.exp(-p[1])), 2.5 + math.exp(min(p[2], 4))
        return a, b, nu

    def plain(a, b):
        h, level, ll = np.empty(len(x)), omega, 0.0
        for i, v in enumerate(x):
            h[i] = level
            if v == v:
                ll -= 0.5 * (math.log(level) + v * v / level)
            level = omega * (1 - b) + (b - a) * level + a * (v * v if v == v else level)
            level = max(level, 1e-8 * omega)
        return h, ll

    loss = (lambda p: -_t_garch(x, omega, *parts(p))[1]) if score else (lambda p: -plain(*parts(p)[:2])[1])
    best = _descended(loss, np.array([-1.0, 1.5, 1.5]), 60)
    a, b, nu = parts(best)
    return (_t_garch(x, omega, a, b, nu)[0] if score else plain(a, b)[0]), {"omega": omega, "a": a, "b": b, "nu": nu}


def garch_variance(cells: DataFrame, keys=KEYS, score: bool = True) -> DataFrame:
    """Adds variance; a series is one Arrow group. Parameters are fitted to the whole series, the filter itself looks back only."""
    schema = T.StructType([*cells.schema.fields, T.StructField("variance", T.DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", ignore_index=True)
        return pdf.assign(variance=fitted_garch(pdf["x"].to_numpy(float), score)[0])[[f.name for f in schema]]

    return cells.groupBy(*keys).applyInPandas(one, schema).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def _shrunk(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Towards a multiple of the identity, by the variance of its elements."""
    n, t = len(c), len(x)
    target = np.trace(c) / n * np.eye(n)
    d = ((c - target) ** 2).sum()
    noise = sum(((np.outer(r, r) - c) ** 2).sum() for r in x) / t**2
    w = min(1.0, noise / d) if d > 0 else 1.0
    return w * target + (1 - w) * c


def _nonlinear(c: np.ndarray, t: int) -> np.ndarray:
    """Each eigenvalue shrunk by itself with the kernel estimate of the limiting spectral density."""
    e, v = np.linalg.eigh(c)
    n = len(e)
    e = np.maximum(e, 1e-12)
    width = t ** (-1 / 3) * e
    r = (e[:, None] - e[None, :]) / width[None, :]
    density = (3 / (4 * math.sqrt(5)) * np.maximum(1 - r**2 / 5, 0) / width).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        hilbert = -3 / (10 * math.pi) * r + 3 / (4 * math.sqrt(5) * math.pi) * (1 - r**2 / 5) * np.log(np.abs((math.sqrt(5) - r) / (math.sqrt(5) + r)))
    hilbert = np.where(np.isclose(np.abs(r), math.sqrt(5)), -3 / (10 * math.pi) * r, hilbert)
    transform = (hilbert / width).mean(axis=1)
    q = n / t
    new = e / ((math.pi * q * e * density) ** 2 + (1 - q - math.pi * q * e * transform) ** 2)
    return (v * new) @ v.T


def _with_variances(corr: np.ndarray, h: np.ndarray) -> np.ndarray:
    return corr * np.sqrt(np.outer(h, h))


def covariances(x: np.ndarray, model: str, window: int = 250, factors: int = 2) -> np.ndarray:
    """The covariance forecast for the step after a window of returns (steps by series, NaN for missing): static, sample, ewma, lw, nls, ccc, dcc or factor."""
    x = np.where(np.isfinite(x), x, 0.0)[-window if model != "static" else None :]
    t, n = x.shape
    sample = x.T @ x / t
    age = 0.94 ** np.arange(t - 1, -1, -1)
    ewma = (x * age[:, None]).T @ x / age.sum()
    if model in ("sample", "static"):
        return sample + 1e-9 * np.eye(n)
    if model == "ewma":
        return ewma + 1e-6 * np.trace(ewma) / n * np.eye(n)
    if model == "lw":
        return _shrunk(sample, x)
    if model == "nls":
        return _nonlinear(sample, t)
    h = np.array([((age @ x[:, j] ** 2) / age.sum()) for j in range(n)])
    running = np.empty_like(x)
    v = np.maximum(x.var(axis=0), 1e-12)
    for i in range(t):
        running[i] = v
        v = 0.94 * v + 0.06 * x[i] ** 2
    z = x / np.sqrt(np.maximum(running, 1e-12))
    base = z.T @ z / t
    d = np.sqrt(np.maximum(np.diag(base), 1e-12))
    constant = base / np.outer(d, d)
    if model == "ccc":
        return _with_variances(constant, h)
    if model == "dcc":
        q = constant.copy()
        for r in z:
            q = 0.02 * constant + 0.95 * q + 0.03 * np.outer(r, r)
        d = np.sqrt(np.diag(q))
        return _with_variances(q / np.outer(d, d), h)
    if model == "factor":
        u, s, w = np.linalg.svd(x, full_matrices=False)
        f, loads = u[:, :factors] * s[:factors], w[:factors].T
        own = ((x - f @ loads.T) ** 2 * age[:, None]).sum(axis=0) / age.sum()
        return (loads * ((f**2 * age[:, None]).sum(axis=0) / age.sum())) @ loads.T + np.diag(own + 1e-12)
    raise ValueError(f"model {model!r}")


COVARIANCES = ("static", "sample", "ewma", "lw", "nls", "ccc", "dcc", "factor")


def covariance_backtest(cells: DataFrame, models: tuple[str, ...] = COVARIANCES, window: int = 250, every: int = 20, per_year: int = 252) -> DataFrame:
    """(model, n, volatility, nll): rolling origins, one Arrow group for each origin with its window of returns; the yearly volatility of the portfolio of least variance over the steps that follow, and the mean negative log-likelihood."""
    top = cells.agg(F.max("ord")).first()[0] or 0
    origins = cells.sparkSession.createDataFrame([(o,) for o in range(window, top, every)] or [(0,)], "origin long").where(F.col("origin") >= window)
    rows = cells.join(F.broadcast(origins), (F.col("ord") >= F.col("origin") - window) & (F.col("ord") < F.col("origin") + every))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        o = int(pdf["origin"].iloc[0])
        m = pdf.pivot_table(index="ord", columns="feature", values="x", aggfunc="mean", dropna=False).sort_index()
        past, live = m[m.index < o].to_numpy(float), m[m.index >= o].to_numpy(float)
        live = live[np.isfinite(live).all(axis=1)]
        out = []
        for k in models:
            c = covariances(past, k, window)
            w = np.linalg.solve(c + 1e-8 * np.eye(len(c)), np.ones(len(c)))
            w /= w.sum()
            sign, log = np.linalg.slogdet(c)
            mahal = (live * np.linalg.solve(c + 1e-12 * np.eye(len(c)), live.T).T).sum(axis=1)
            out += [(k, float((r @ w) ** 2), float(0.5 * (log + q + len(c) * math.log(2 * math.pi)))) for r, q in zip(live, mahal, strict=True)]
        return pd.DataFrame(out, columns=["model", "square", "nll"])

    each = rows.groupBy("origin").applyInPandas(one, "model string, square double, nll double")
    return each.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("square") * per_year).alias("volatility"), F.avg("nll").alias("nll"))
