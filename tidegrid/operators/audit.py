"""Look-ahead audit: what an imputer gains from rows after the step that it fills."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegrid.operators import evaluate as ev
from tidegrid.operators import impute as im
from tidegrid.operators.impute import KEYS

WORST = 1e3  # what a fill that is not finite costs


def right_edge(windows: DataFrame) -> DataFrame:
    """The last row of each trailing window."""
    return windows.where("ord = win_id")


def keep_observed(filled: DataFrame, keys=KEYS) -> DataFrame:
    """Observed cells exact; a fill that is not finite becomes the series mean, else 0."""
    bad = F.col("fill").isNull() | F.isnan("fill") | (F.abs("fill") == float("inf"))
    mean = F.avg("x").over(Window.partitionBy(*keys))
    return filled.withColumn("fill", F.coalesce("x", F.when(~bad, F.col("fill")), mean, F.lit(0.0)))


def causal_variant(cells: DataFrame, method: str, length: int = 24, keys=KEYS) -> DataFrame:
    """Any imputer as a filter: run on each trailing window by itself, its right edge kept. Each cell is in `length` windows at most, and each window is a matrix of its own."""
    windows = ev.trailing_windows(cells, length, keys)
    return right_edge(im.impute(windows, method, keys=("win_id", *keys))).drop("win_id")


def masked_mae(filled: DataFrame) -> DataFrame:
    """mae over hidden cells, WORST for a fill that is not finite."""
    e = F.abs(F.col("fill") - F.col("truth"))
    return filled.where("hidden").agg(F.avg(F.when(F.col("fill").isNull() | F.isnan(e) | (e == float("inf")), F.lit(WORST)).otherwise(e)).alias("mae"))


PATTERNS, RATES = ("mcar", "block"), (0.1, 0.2)


def report(cells: DataFrame, method: str, mechanisms: tuple[str, ...] = PATTERNS, rates: tuple[float, ...] = RATES, seed: int = 3, length: int = 24, keys=KEYS) -> DataFrame:
    """One row: errors of the method on all rows and as a filter, averaged over patterns and rates, their difference (positive: it gains from later rows), the largest revision over prefixes."""
    runs = []
    for m in mechanisms:
        for r in rates:
            hidden = ev.masked(cells, m, r, seed)
            runs += [masked_mae(f).select("mae", F.lit(kind).alias("kind")) for kind, f in (("full", im.impute(hidden, method, keys=keys)), ("causal", causal_variant(hidden, method, length, keys)))]
    of = lambda k: F.avg(F.when(F.col("kind") == k, F.col("mae")))
    both = reduce(DataFrame.unionByName, runs).agg(of("full").alias("mae_full"), of("causal").alias("mae_causal"))
    revised = ev.causality_certificate(cells, lambda c: im.impute(c, method, keys=keys), keys=keys).agg(F.max("max_revision").alias("max_revision"))
    row = both.crossJoin(revised)  # of one row each
    return row.select(F.lit(method).alias("method"), "mae_full", "mae_causal", (F.col("mae_causal") - F.col("mae_full")).alias("delta"), "max_revision", (F.col("max_revision") <= 1e-6).alias("holds"))


REPORT = "method string, mae_full double, mae_causal double, delta double, max_revision double, holds boolean, error string"


def panel(cells: DataFrame, methods: list[str], **options) -> DataFrame:
    """Reports of several methods, the largest gain first. A method that fails has its error in place of figures: each report is one row, so each is run here."""
    rows = []
    for m in methods:
        try:
            rows += [(*r, None) for r in report(cells, m, **options).collect()]
        except Exception as e:  # noqa: BLE001 - whatever a method of the caller's raises is its result
            rows.append((m, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
    return cells.sparkSession.createDataFrame(rows, REPORT).orderBy(F.desc_nulls_last("delta"), "method")


class _Window:
    """The last `size` scores, kept in order of arrival and in order of size: one in, one out."""

    def __init__(self, size: int):
        self.size, self.sorted, self.queue = size, [], deque()

    def add(self, score: float) -> None:
        insort(self.sorted, score)
        self.queue.append(score)
        if len(self.queue) > self.size:
            del self.sorted[bisect_left(self.sorted, self.queue.popleft())]

    def quantile(self, level: float, least: int, otherwise: float) -> float:
        n = len(self.sorted)
        return otherwise if n < max(least, 1) else self.sorted[max(0, min(n, math.ceil(level * (n + 1))) - 1)]


def trailing_multipliers(scored: DataFrame, level: float, window: int = 4000, least: int = 30, keys=KEYS) -> DataFrame:
    """For each row the conformal quantile of the `window` scores of its series strictly before; the normal quantile while there are fewer than `least`. A null score counts nothing. A series is one Arrow group."""
    normal = ev.normal_quantile((1 + level) / 2)
    schema = T.StructType([*scored.schema.fields, T.StructField("multiplier", T.DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable", ignore_index=True)
        held, out = _Window(window), []
        for s in pdf["score"].tolist():
            out.append(held.quantile(level, least, normal))
            if s is not None and s == s:
                held.add(s)
        return pdf.assign(multiplier=out)

    return scored.groupBy(*keys).applyInPandas(one, schema)


def trailing_grid(steps: DataFrame, scored: DataFrame, level: float, window: int = 4000, least: int = 30, entity: tuple[str, ...] = ()) -> DataFrame:
    """(entity..., ord, multiplier) for each step: the conformal quantile of the last `window` scores of strictly earlier steps, of all series together."""
    normal = ev.normal_quantile((1 + level) / 2)
    rows = steps.select(*entity, "ord", F.lit(None).cast("double").alias("score")).unionByName(scored.select(*entity, "ord", "score"))
    schema = T.StructType([*(steps.schema[e] for e in entity), T.StructField("ord", T.LongType()), T.StructField("multiplier", T.DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        held, ords, out = _Window(window), [], []
        for t, own in pdf.sort_values(["ord", "score"]).groupby("ord", sort=True)["score"]:
            ords.append(t)
            out.append(held.quantile(level, least, normal))
            for s in own.dropna().tolist():
                held.add(s)
        return pd.DataFrame({"ord": ords, "multiplier": out}).assign(**{e: pdf[e].iloc[0] for e in entity})[[f.name for f in schema]]

    return rows.groupBy(*entity).applyInPandas(one, schema)


def visible_standardised(cells: DataFrame, keys=KEYS) -> DataFrame:
    """z of truth by the mean and deviation of the visible cells alone; one visible cell: its value and 1; none: 0 and 1."""
    w = Window.partitionBy(*keys)
    n = F.count("x").over(w)
    mean = F.coalesce(F.avg("x").over(w), F.lit(0.0))
    dev = F.when(n >= 2, F.stddev_pop("x").over(w)).otherwise(1.0)
    return cells.withColumn("z", (F.col("truth") - mean) / (dev + 1e-9))


def probes(cells: DataFrame, method: Callable[[DataFrame], DataFrame], n: int = 4, seed: int = 0, keys=KEYS) -> DataFrame:
    """(tau, cells, drift, holds): the fills of missing cells at some steps tau, from the rows up to tau against the whole run. The steps are drawn by hash from those behind the first fifth."""
    steps = cells.agg(F.min("ord"), F.max("ord")).first()  # two values
    if steps[0] is None or steps[1] - steps[0] < 3:
        return cells.sparkSession.createDataFrame([], "tau long, cells long, drift double, holds boolean")
    low, high = steps
    early = low + (high - low + 1) // 5
    drawn = cells.select("ord").distinct().where((F.col("ord") >= early) & (F.col("ord") < high)).orderBy(F.md5(F.concat_ws("|", F.col("ord").cast("string"), F.lit(str(seed)))), "ord").limit(n)
    taus = sorted(r.ord for r in drawn.collect())  # n values
    gone = cells.where("x is null").select(*keys, "ord")
    full = method(cells).select(*keys, "ord", F.col("fill").alias("whole")).join(gone, [*keys, "ord"], "left_semi")
    parts = [method(cells.where(F.col("ord") <= t)).where(F.col("ord") == t).select(*keys, "ord", "fill") for t in taus]
    if not parts:
        return cells.sparkSession.createDataFrame([], "tau long, cells long, drift double, holds boolean")
    met = reduce(DataFrame.unionByName, parts).join(full, [*keys, "ord"])
    off = F.abs(F.col("fill") - F.col("whole"))
    return met.groupBy(F.col("ord").alias("tau")).agg(F.count(F.lit(1)).alias("cells"), F.max(off).alias("drift"), F.every(off <= 1e-6 + 1e-5 * F.abs("whole")).alias("holds"))


def both_ways(cells: DataFrame, method: str, length: int = 24, keys=KEYS) -> DataFrame:
    """Cells with fill_bidirectional, from separate stretches of `length` steps seen whole, and fill_causal, from the right edges of trailing windows."""
    stretches = cells.withColumn("_part", F.floor(F.col("ord") / length))
    both = keep_observed(im.impute(stretches, method, keys=("_part", *keys)), keys).select(*keys, "ord", F.col("fill").alias("fill_bidirectional"))
    past = keep_observed(causal_variant(cells, method, length, keys), keys).select(*keys, "ord", F.col("fill").alias("fill_causal"))
    return cells.join(both, [*keys, "ord"]).join(past, [*keys, "ord"])


def revisions(cells: DataFrame, method: Callable[[DataFrame], DataFrame], low: int, high: int, prefixes: int = 6, keys=KEYS) -> DataFrame:
    """(prefix, cells, mean_revision, max_revision): how far the fills of the missing cells at steps low .. high have moved from the shortest prefix as later rows come in."""
    top = cells.agg(F.max("ord")).first()[0]
    if top is None or high + 20 > top + 1:
        return cells.sparkSession.createDataFrame([], "prefix long, cells long, mean_revision double, max_revision double")
    ends = sorted({int(high + 20 + (top + 1 - high - 20) * i / max(prefixes - 1, 1)) for i in range(prefixes)})
    early = cells.where(f"x is null and ord between {low} and {high}").select(*keys, "ord")
    runs = [method(cells.where(F.col("ord") < e)).select(*keys, "ord", "fill").join(early, [*keys, "ord"], "left_semi").withColumn("prefix", F.lit(e).cast("long")) for e in ends]
    first = runs[0].select(*keys, "ord", F.col("fill").alias("_first"))
    moved = reduce(DataFrame.unionByName, runs).join(first, [*keys, "ord"]).withColumn("_r", F.abs(F.col("fill") - F.col("_first")))
    return moved.groupBy("prefix").agg(F.count(F.lit(1)).alias("cells"), F.avg("_r").alias("mean_revision"), F.max("_r").alias("max_revision"))
