"""Missingness features, masks, metrics, conformal pieces and the look-ahead audit, on cells."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.operators.impute import KEYS, past


def missingness(cells: DataFrame, keys=KEYS) -> DataFrame:
    """was_imputed, time_since_obs, gap_length, missing_rate."""
    gone = F.col("x").isNull()
    since = F.col("ord") - F.coalesce(F.max(F.when(~gone, F.col("ord"))).over(past(keys)), F.min("ord").over(Window.partitionBy(*keys)) - 1)
    return cells.withColumns({"was_imputed": gone.cast("double"), "time_since_obs": since.cast("double"), "gap_length": since.cast("double"), "missing_rate": F.avg(gone.cast("double")).over(past(keys))})


def gap_lengths(cells: DataFrame, keys=KEYS) -> DataFrame:
    """For each missing cell the whole length of its gap (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy("ord")
    gone = cells.where("x is null").withColumn("_i", F.col("ord") - F.row_number().over(w))
    return gone.withColumn("gap", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_i"))).drop("_i")


def hash_draw(*parts: Column | str, seed: int) -> Column:
    """A draw in 0 .. 999 that SQL can repeat, from MD5."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % 1000


def _hide(cells: DataFrame, chosen: Column) -> DataFrame:
    """truth, hidden (of observed cells only), and x without the hidden cells."""
    hidden = F.coalesce(F.col("x").isNotNull() & chosen, F.lit(False))
    return cells.withColumn("truth", F.col("x")).withColumn("hidden", hidden).withColumn("x", F.when(~F.col("hidden"), F.col("x")))


def _z(value: str = "x") -> Column:
    w = Window.partitionBy("feature")
    return (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))


def masked(cells: DataFrame, mechanism: str, rate: float, seed: int, block: int = 10) -> DataFrame:
    """truth, hidden, and x without the hidden cells. mechanism: mcar, block (stretches of a series), blackout (of all series), mnar (large values likelier), mar (likelier where the series before is high),
    mixed (three fifths of the rate in stretches, the rest in points) or async (gaps of exponential length, each series by itself)."""
    stretch, cut, points = F.floor(F.col("ord") / block), F.lit(1000 * rate), hash_draw("feature", "ord", seed=seed)
    if mechanism == "mnar":
        return _hide(cells, points < F.least(F.lit(1000.0), 2000 * rate / (1 + F.exp(-_z()))))
    if mechanism == "mar":
        step = Window.partitionBy("ord").orderBy("feature")
        got = cells.withColumn("_z", _z())
        before = F.coalesce(F.lag("_z").over(step), F.last("_z").over(step.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
        return _hide(got.withColumn("_d", before), points < F.least(F.lit(950.0), 2000 * rate / (1 + F.exp(-F.col("_d"))))).drop("_z", "_d")
    if mechanism == "mixed":
        return _hide(cells, (hash_draw(F.col("feature"), stretch, seed=seed) < 600 * rate) | (hash_draw("feature", "ord", seed=seed + 1) < 400 * rate))
    if mechanism == "async":
        return _hide(cells, _gap_from_starts(rate, 2 * block, seed))
    draw = {"mcar": points, "block": hash_draw(F.col("feature"), stretch, seed=seed), "blackout": hash_draw(stretch, seed=seed)}[mechanism]
    return _hide(cells, draw < cut)


def _gap_from_starts(rate: float, mean: int, seed: int) -> Column:
    """Whether a gap that began at one of the last 8 * mean steps reaches the cell: each step starts one with a chance of rate / mean, of exponential length (cut there)."""
    reach = 8 * mean
    begins = lambda at: hash_draw(F.col("feature"), at, seed=seed)
    length = lambda at: F.greatest(F.lit(1.0), F.floor(-F.log((hash_draw(F.col("feature"), at, seed=seed + 1) + 1) / 1001.0) * mean))
    return F.exists(F.sequence(F.col("ord") - reach, F.col("ord")), lambda at: (at >= 0) & (begins(at) < 1000 * rate / mean) & (at + length(at) > F.col("ord")))


def long_gap(cells: DataFrame, share: float = 0.2, seed: int = 0) -> DataFrame:
    """One gap of a share of the steps in each series, begun by hash, not at the first or last step."""
    w = Window.partitionBy("feature")
    steps = F.max("ord").over(w) - F.min("ord").over(w) + 1
    size = F.greatest(F.lit(1), F.floor(steps * F.lit(share)))
    first = F.min("ord").over(w) + 1 + F.floor(hash_draw("feature", seed=seed) * F.greatest(F.lit(1), steps - size - 1) / 1000)
    got = cells.withColumns({"_a": first, "_n": size})
    return _hide(got, (F.col("ord") >= F.col("_a")) & (F.col("ord") < F.col("_a") + F.col("_n"))).drop("_a", "_n")


def subsequence(cells: DataFrame, rate: float, seed: int, gap: int, keys=KEYS) -> DataFrame:
    """Stretches of `gap` steps hidden by hash, and for each hidden cell the length of the hidden run that it is in (neighbouring stretches join)."""
    hidden = masked(cells, "block", rate, seed, gap)
    w = Window.partitionBy(*keys).orderBy("ord")
    runs = hidden.where("hidden").withColumn("_i", F.col("ord") - F.row_number().over(w))
    runs = runs.withColumn("gap", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_i"))).select(*keys, "ord", "gap")
    return hidden.join(runs, [*keys, "ord"], "left").withColumn("gap", F.coalesce("gap", F.lit(0)))


def scores(filled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """mae, rmse, mre, bias, corr (null for constant fills or truths) and n over hidden cells with finite values; how many fills were not finite."""
    e = F.col("fill") - F.col("truth")
    bad = F.col("fill").isNull() | F.isnan("fill")
    rows = filled.where("hidden").withColumns({"_bad": bad, "_e": F.when(~bad, e), "_f": F.when(~bad, F.col("fill")), "_t": F.when(~bad, F.col("truth"))})
    return rows.groupBy(*by).agg(
        F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), (F.sum(F.abs("_e")) / F.sum(F.when(~F.col("_bad"), F.abs("truth")))).alias("mre"),
        F.avg("_e").alias("bias"), (F.covar_pop("_f", "_t") / F.nullif(F.stddev_pop("_f") * F.stddev_pop("_t"), F.lit(0.0))).alias("corr"), F.count("_e").alias("n"), F.sum(F.col("_bad").cast("long")).alias("n_bad"),
    )


def train_standardised(cells: DataFrame, cut: float = 0.6, keys=KEYS) -> DataFrame:
    """z-scores by the mean and deviation of the first share of each series."""
    w = Window.partitionBy(*keys)
    early = F.col("ord") < F.max("ord").over(w) * F.lit(cut)
    got = cells.withColumn("_t", F.when(early, F.col("x")))
    return got.withColumn("z", (F.col("x") - F.avg("_t").over(w)) / F.nullif(F.stddev_pop("_t").over(w), F.lit(0.0))).drop("_t")


def conformal_quantile(scored: DataFrame, level: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The ceil(level (n + 1))-th smallest score, or the largest. Scores are counted in slices, 256 to a doubling of their size, the slice that holds the rank is found from these counts, and only its rows are ranked:
    no task sees a group whole, with or without `by`."""
    x = F.col("score")
    size = F.floor(F.log2(F.abs(x)) * 256).cast("int") + (1 << 20)  # rises with the size of any double
    rows = scored.where(x.isNotNull() & ~F.isnan(x)).withColumn("_s", F.when(x > 0, size).when(x < 0, -size).otherwise(0))
    counts = rows.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*by)  # one row for each slice
    n = F.sum("_c").over(whole)
    before = F.sum("_c").over(whole.orderBy("_s")) - F.col("_c")
    ranked = counts.withColumns({"_b": before, "_k": F.least(n, F.ceil(F.lit(level) * (n + 1)))})
    holds = ranked.where((F.col("_b") < F.col("_k")) & (F.col("_k") <= F.col("_b") + F.col("_c"))).select(*by, "_s", (F.col("_k") - F.col("_b")).alias("_r"))  # one row for each group
    place = F.row_number().over(Window.partitionBy(*by).orderBy("score"))
    return rows.join(holds, [*by, "_s"]).withColumn("_p", place).where("_p = _r").select(*by, F.col("score").alias("q"))


def interval_scores(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Coverage and sharpness of lo .. hi around truth."""
    return df.groupBy(*by).agg(F.avg(F.col("truth").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("sharpness"))


def trailing_windows(cells: DataFrame, length: int, keys=KEYS) -> DataFrame:
    """Each cell once for each window that it is in; win_id is the window's last step."""
    last = F.max("ord").over(Window.partitionBy(*keys))
    return cells.withColumn("_last", last).withColumn("win_id", F.explode(F.sequence(F.col("ord"), F.least(F.col("_last"), F.col("ord") + length - 1)))).drop("_last")


def causality_certificate(cells: DataFrame, method: Callable[[DataFrame], DataFrame], prefixes: int = 6, keys=KEYS) -> DataFrame:
    """Fills of growing prefixes against the full run, one job: prefix (its last step), cells, max_revision."""
    top = cells.agg(F.max("ord")).first()[0]
    ends = sorted({round(top // 3 + (top - 1 - top // 3) * i / max(prefixes - 1, 1)) for i in range(prefixes)}) if top else []
    full = method(cells).select(*keys, "ord", F.col("fill").alias("whole"))
    parts = [method(cells.where(F.col("ord") <= e)).select(*keys, "ord", "fill", F.lit(e).cast("long").alias("prefix")) for e in ends]
    runs = reduce(DataFrame.unionByName, parts)
    return runs.join(full, [*keys, "ord"]).groupBy("prefix").agg(F.count(F.lit(1)).alias("cells"), F.max(F.abs(F.col("fill") - F.col("whole"))).alias("max_revision"))


def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2
