"""Scores and statistics over cells or scored rows, as aggregates and windows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Coefficients of the rational approximations of erfc by W. J. Cody, for |x| up to 0.46875, up to 4, and beyond.
_CODY = (
    ([3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1], [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03]),
    ([5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8], [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03]),
    ([3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2], [2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]),
)


def _ratio(x: np.ndarray, kind: int) -> np.ndarray:
    p, q = _CODY[kind]
    top, low = p[-1] * x, x.copy()
    for a, b in zip(p[:-2], q[:-1], strict=True):
        top, low = (top + a) * x, (low + b) * x
    return (top + p[-2]) / (low + q[-1])


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of an array, to double precision."""
    x = np.asarray(x, float)
    y = np.abs(np.where(np.isfinite(x), x, 0.0))
    near, far = np.minimum(y, 0.46875), np.maximum(y, 4.0)
    small = 1 - near * _ratio(near**2, 0)
    middle = np.exp(-np.clip(y, 0.46875, 4.0) ** 2) * _ratio(np.clip(y, 0.46875, 4.0), 1)
    tail = np.exp(-(np.minimum(far, 27.0) ** 2)) / far * (1 / math.sqrt(math.pi) - far**-2 * _ratio(far**-2, 2))
    out = np.where(y <= 0.46875, small, np.where(y <= 4, middle, tail))
    out = np.where(x < 0, 2 - out, out)
    return np.where(np.isnan(x), np.nan, np.where(np.isinf(x), np.where(x > 0, 0.0, 2.0), out))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(z, float) / math.sqrt(2))


def pit(truth: str, mean: str, sigma: str) -> Column:
    """Where the truth lies in its Gaussian forecast, 0 .. 1; null without a positive sigma."""

    @F.pandas_udf("double")
    def at(y: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        z = (y - m) / s.where(s > 0)
        return pd.Series(normal_cdf(z.to_numpy(float)), index=z.index).where(z.notna(), None)

    return at(truth, mean, sigma)


def gaussian_crps(truth: str, mean: str, sigma: str) -> Column:
    """Closed form; with sigma 0 or less the absolute error. Spark has no erf, so this is an Arrow function."""

    @F.pandas_udf("double")
    def crps(y: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        z = (y - m) / s.where(s > 0)
        cdf = pd.Series(normal_cdf(z.to_numpy(float)), index=z.index)
        pdf = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        out = s * (z * (2 * cdf - 1) + 2 * pdf - 1 / math.sqrt(math.pi))
        return out.where(s > 0, (y - m).abs())

    return crps(truth, mean, sigma)


def ensemble_crps(truth: Column, members: Column) -> Column:
    """Mean distance of members to the truth less half their mean distance to each other, from the sorted array; null without members."""
    m = F.sort_array(F.filter(members, lambda v: v.isNotNull() & ~F.isnan(v)))
    n = F.size(m).cast("double")
    near = F.aggregate(m, F.lit(0.0), lambda a, v: a + F.abs(v - truth)) / n
    spread = F.aggregate(F.transform(m, lambda v, i: (2.0 * i - n + 1) * v), F.lit(0.0), lambda a, v: a + v) / (n * n)
    return F.when(n > 0, near - spread)


def reliability(df: DataFrame, pit: str, bins: int = 10) -> DataFrame:
    """bin (0 ..), n, share of rows at or below the bin's upper edge: on the diagonal when calibrated. No global sort: one row for each bin is windowed."""
    counts = df.where(F.col(pit).between(0, 1)).groupBy(F.least(F.lit(bins - 1), F.floor(F.col(pit) * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("share", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()))


def spearman(df: DataFrame, a: str, b: str, by: tuple[str, ...]) -> DataFrame:
    """Correlation of mean ranks within each group."""
    ranked = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c in (a, b):
        whole = Window.partitionBy(*by, c)
        ranked = ranked.withColumn(f"_{c}", F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(whole) - 1) / 2)
    return ranked.groupBy(*by).agg(F.corr(f"_{a}", f"_{b}").alias("spearman"), F.count(F.lit(1)).alias("n"))


def by_tertile(df: DataFrame, value: str, score: str, by: tuple[str, ...]) -> DataFrame:
    """Mean score in thirds of `value`, cut at its percentiles in each group."""
    cuts = df.groupBy(*by).agg(F.expr(f"percentile({value}, 1/3D)").alias("_a"), F.expr(f"percentile({value}, 2/3D)").alias("_b"))
    third = F.when(F.col(value) <= F.col("_a"), "short").when(F.col(value) <= F.col("_b"), "medium").otherwise("long")
    return df.join(cuts, list(by)).groupBy(*by, third.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))


def _median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return F.when(n > 0, (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2 + 1).cast("int"))) / 2)


def hampel(cells: DataFrame, width: int = 20, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Adds score: distance to the median of the `width` rows strictly before, in units of 1.4826 median absolute deviations; null without past or spread."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(-width, -1)
    got = cells.withColumn("_w", F.collect_list("x").over(w)).withColumn("_m", _median(F.col("_w")))
    mad = _median(F.transform("_w", lambda v: F.abs(v - F.col("_m"))))
    return got.withColumn("score", F.abs(F.col("x") - F.col("_m")) / F.nullif(1.4826 * mad, F.lit(0.0))).drop("_w", "_m")


def robust_standardised(cells: DataFrame, keys: tuple[str, ...] = ("feature",), floor: float = 0.01) -> DataFrame:
    """Adds z: distance to the median over the largest of deviation, 1.4826 median absolute deviations and a floor. Two aggregates, no series is gathered as rows."""
    middle = cells.groupBy(*keys).agg(F.expr("percentile(x, 0.5D)").alias("_m"), F.stddev_pop("x").alias("_s"))
    near = cells.join(middle, list(keys))
    mad = near.groupBy(*keys).agg(F.expr("percentile(abs(x - _m), 0.5D)").alias("_d"))
    return near.join(mad, list(keys)).withColumn("z", (F.col("x") - F.col("_m")) / F.greatest("_s", 1.4826 * F.col("_d"), F.lit(floor))).drop("_m", "_s", "_d")


def lag_memory(cells: DataFrame, keys: tuple[str, ...] = ("feature",), lag: int = 1) -> DataFrame:
    """Correlation of each series with itself `lag` steps before, over pairs that were both observed."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return cells.withColumn("_p", F.lag("x", lag).over(w)).where("x is not null and _p is not null").groupBy(*keys).agg(F.corr("x", "_p").alias("memory"), F.count(F.lit(1)).alias("n"))


def tail_index(cells: DataFrame, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Degrees of freedom of a t distribution with the series' kurtosis: 4 + 6 / excess, 60 without excess."""
    k = F.kurtosis("x")
    return cells.groupBy(*keys).agg(F.when(k > 0.2, F.least(F.lit(60.0), 4 + 6 / k)).otherwise(60.0).alias("nu"))


def correlations(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., i, j, corr, n) for series i < j over steps that both have: cells of one step meet, so the join grows with steps times series squared."""
    a = cells.where("x is not null").select(*keys, "ord", F.col("feature").alias("i"), F.col("x").alias("xi"))
    b = a.withColumnsRenamed({"i": "j", "xi": "xj"})
    return a.join(b, [*keys, "ord"]).where("i < j").groupBy(*keys, "i", "j").agg(F.corr("xi", "xj").alias("corr"), F.count(F.lit(1)).alias("n"))


def selective_indicators(cells: DataFrame, threshold: float = 0.15, least: int = 8) -> DataFrame:
    """For each series: informative, the mean standardised difference of the other series between its missing and its observed steps, and whether that reaches the threshold."""
    spread = cells.groupBy("feature").agg(F.stddev_pop("x").alias("s"))
    flags = cells.select("ord", F.col("feature").alias("target"), F.col("x").isNull().alias("gone"))
    others = cells.where("x is not null").select("ord", "feature", "x")
    gone = lambda c: F.when(F.col("gone") == c, F.col("x"))
    pairs = flags.join(others, "ord").where("target <> feature").groupBy("target", "feature").agg(F.avg(gone(True)).alias("a"), F.avg(gone(False)).alias("b"), F.count(gone(True)).alias("na"), F.count(gone(False)).alias("nb"))
    d = F.abs(F.col("a") - F.col("b")) / F.nullif(F.col("s"), F.lit(0.0))
    means = pairs.where((F.col("na") >= least) & (F.col("nb") >= least)).join(spread, "feature").groupBy("target").agg(F.avg(d).alias("difference"))
    names = cells.select(F.col("feature").alias("target")).distinct()
    return names.join(means, "target", "left").select(F.col("target").alias("feature"), "difference", F.coalesce(F.col("difference") >= threshold, F.lit(False)).alias("informative"))


def disagreements(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Groups whose sources state two values or more."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high")).where("n_values >= 2")


def _by_score(df: DataFrame, score: str, error: str, best_first: bool) -> DataFrame:
    """(_s, _n, _e, _before, _all): rows of one score (in 0 .. 1, to six digits, so a million groups at most) with how many come before them."""
    have = df.where(F.col(score).isNotNull() & F.col(error).isNotNull() & ~F.isnan(score) & ~F.isnan(error))
    each = have.groupBy(F.round(score, 6).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum(error).alias("_e"))
    w = Window.orderBy(F.desc("_s") if best_first else "_s")
    return each.withColumns({"_before": F.sum("_n").over(w) - F.col("_n"), "_all": F.sum("_n").over(Window.partitionBy())})


def calibration_bins(df: DataFrame, score: str, error: str, bins: int = 8) -> DataFrame:
    """(bin, n, mean_score, mean_error) of bins of equal count by score in 0 .. 1; rows of one score share a bin."""
    at = F.floor(F.col("_before") * bins / F.col("_all")).cast("int")
    return _by_score(df, score, error, False).groupBy(at.alias("bin")).agg(F.sum("_n").alias("n"), (F.sum(F.col("_s") * F.col("_n")) / F.sum("_n")).alias("mean_score"), (F.sum("_e") / F.sum("_n")).alias("mean_error"))


def risk_coverage(df: DataFrame, score: str, error: str, coverages: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
    """(coverage, kept, risk): mean error of the rows of the highest scores in 0 .. 1, for each share kept; rows of one score stay together."""
    marks = df.sparkSession.createDataFrame([(float(c),) for c in coverages], "coverage double")
    met = _by_score(df, score, error, True).join(F.broadcast(marks), F.col("_before") < F.col("coverage") * F.col("_all"))
    return met.groupBy("coverage").agg(F.sum("_n").alias("kept"), (F.sum("_e") / F.sum("_n")).alias("risk"))


def random_coverage(df: DataFrame, error: str, coverages: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), seeds: tuple[int, ...] = (0, 1, 2, 3, 4), ids: tuple[str, ...] = ("feature", "ord")) -> DataFrame:
    """(coverage, risk): what a gate that knows nothing gets, rows kept by hash, averaged over seeds."""
    marks = df.sparkSession.createDataFrame([(float(c), s) for c in coverages for s in seeds], "coverage double, seed int")
    draw = F.pmod(F.xxhash64(*ids, F.col("seed")), F.lit(1_000_000)) < F.col("coverage") * 1_000_000
    each = df.where(F.col(error).isNotNull()).join(F.broadcast(marks), F.lit(True)).where(draw).groupBy("coverage", "seed").agg(F.avg(error).alias("r"))
    return each.groupBy("coverage").agg(F.avg("r").alias("risk"))


def by_dials(dials: DataFrame) -> DataFrame:
    """Adds reading: what the learned dials say of the data (persistent, heavy tails, low rank, or mixed)."""
    out = F.when((F.col("ar") >= 0.9) & (F.col("nu") >= 20), "persistent").when(F.col("nu") < 8, "heavy_tails").when(F.col("effective_rank") >= 1, "low_rank").otherwise("mixed")
    return dials.withColumn("reading", out)


def median_memory(cells: DataFrame, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(memory, n): the median over series of their correlation with themselves one step before."""
    return lag_memory(cells, keys).agg(F.expr("percentile(memory, 0.5D)").alias("memory"), F.count("memory").alias("n"))
