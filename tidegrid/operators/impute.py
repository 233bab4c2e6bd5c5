"""Imputers that windows and aggregates express: each takes cells and returns them with `fill`; observed cells keep their value.

`keys` name a series. fallback: 'zero' (point in time) or 'column_mean' (looks ahead where no past exists). Windows are partitioned by series, so they
scale with the number of series; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

KEYS = ("feature",)
X = F.col


def _order(keys: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ord")


def past(keys=KEYS) -> WindowSpec:
    return _order(keys).rowsBetween(Window.unboundedPreceding, 0)


def ahead(keys=KEYS) -> WindowSpec:
    return _order(keys).rowsBetween(0, Window.unboundedFollowing)


def trailing(n: int, keys=KEYS) -> WindowSpec:
    return _order(keys).rowsBetween(-(n - 1), 0)


def _left(keys: tuple[str, ...], fallback: str) -> Column:
    if fallback == "zero":
        return F.lit(0.0)
    if fallback == "column_mean":
        return F.coalesce(F.avg("x").over(Window.partitionBy(*keys)), F.lit(0.0))
    raise ValueError(f"fallback {fallback!r}")


def _filled(cells: DataFrame, *choices: Column) -> DataFrame:
    return cells.withColumn("fill", F.coalesce(F.col("x"), *choices))


def zero(cells, keys=KEYS):
    return _filled(cells, F.lit(0.0))


def locf(cells, keys=KEYS, lead="zero"):
    """Last observation; a leading gap is 0 or the column mean."""
    return _filled(cells, F.last("x", True).over(past(keys)), _left(keys, lead))


def nocb(cells, keys=KEYS, tail="zero"):
    """Next observation; a trailing gap is 0 or the last observation ('last'). Looks ahead."""
    rest = [F.last("x", True).over(past(keys))] if tail == "last" else []
    return _filled(cells, F.first("x", True).over(ahead(keys)), *rest, F.lit(0.0))


def forward_backward(cells, keys=KEYS):
    return _filled(cells, F.last("x", True).over(past(keys)), F.first("x", True).over(ahead(keys)), F.lit(0.0))


def global_mean(cells, keys=KEYS):
    return _filled(cells, F.avg("x").over(Window.partitionBy(*keys)), F.lit(0.0))


def expanding_mean(cells, keys=KEYS, fallback="zero"):
    return _filled(cells, F.avg("x").over(past(keys)), _left(keys, fallback))


def rolling_mean(cells, keys=KEYS, width=24, fallback="zero"):
    return _filled(cells, F.avg("x").over(trailing(width, keys)), _left(keys, fallback))


def rolling_median(cells, keys=KEYS, width=24, fallback="zero"):
    return _filled(cells, F.expr("percentile(x, 0.5)").over(trailing(width, keys)), _left(keys, fallback))


def _seen(keys):
    """The last observed (ord, x) up to here and the next from here, as structs."""
    s = F.when(F.col("x").isNotNull(), F.struct(F.col("ord").alias("t"), F.col("x").alias("v")))
    return F.last(s, True).over(past(keys)), F.first(s, True).over(ahead(keys))


def linear(cells, keys=KEYS):
    """Straight lines between observations, ends held. Looks ahead."""
    a, b = _seen(keys)
    got = cells.withColumns({"_a": a, "_b": b})
    line = X("_a.v") + (X("_b.v") - X("_a.v")) * (X("ord") - X("_a.t")) / F.nullif(X("_b.t") - X("_a.t"), F.lit(0))
    return _filled(got, line, X("_a.v"), X("_b.v"), F.lit(0.0)).drop("_a", "_b")


def drift(cells, keys=KEYS, fallback="zero"):
    """The line through the last two observations, continued; one observation: held."""
    obs = cells.where("x is not null").withColumns({"_px": F.lag("x").over(_order(keys)), "_pt": F.lag("ord").over(_order(keys))})
    got = cells.join(obs.select(*keys, "ord", "_px", "_pt"), [*keys, "ord"], "left")
    s = F.when(X("x").isNotNull(), F.struct(X("ord").alias("t"), X("x").alias("v"), ((X("x") - X("_px")) / (X("ord") - X("_pt"))).alias("m")))
    got = got.withColumn("_s", F.last(s, True).over(past(keys)))
    return _filled(got, X("_s.v") + F.coalesce(X("_s.m"), F.lit(0.0)) * (X("ord") - X("_s.t")), _left(keys, fallback)).drop("_s", "_px", "_pt")


def seasonal_naive(cells, keys=KEYS, period=24):
    """The last observation at the same phase; else the last one; else the column mean."""
    phase = Window.partitionBy(*keys, X("ord") % period).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return _filled(cells, F.last("x", True).over(phase), F.last("x", True).over(past(keys)), _left(keys, "column_mean"))


def xsec_feature_mean(cells, keys=KEYS, entity=(), fallback="zero"):
    """The mean over the other series of the same step; else the last observation; else the past mean."""
    return _filled(cells, F.avg("x").over(Window.partitionBy(*entity, "ord")), F.last("x", True).over(past(keys)), _left(keys, fallback))


def xsec_entity_mean(cells, keys=("entity", "feature")):
    """The mean of the feature over the entities of the same step; else the last observation; else 0."""
    return _filled(cells, F.avg("x").over(Window.partitionBy("feature", "ord")), F.last("x", True).over(past(keys)), F.lit(0.0))


def panel_locf(cells):
    """Last observation of the entity's series; a leading gap takes the feature's mean over all entities and strictly earlier steps; else 0. The means come from one row for each step."""
    steps = cells.groupBy("feature", "ord").agg(F.sum("x").alias("_s"), F.count("x").alias("_n"))
    w = Window.partitionBy("feature").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("feature", "ord", (F.sum("_s").over(w) / F.nullif(F.sum("_n").over(w), F.lit(0))).alias("_m"))
    return _filled(cells.join(steps, ["feature", "ord"]), F.last("x", True).over(past(("entity", "feature"))), X("_m"), F.lit(0.0)).drop("_m")


def two_way_mean(cells, keys=KEYS):
    """Series mean plus step mean minus the mean of all; the series mean at a step without observations."""
    total = cells.agg(F.avg("x").alias("_t"))
    got = cells.join(F.broadcast(total))
    return _filled(got, F.avg("x").over(Window.partitionBy(*keys)) + F.avg("x").over(Window.partitionBy("ord")) - X("_t"), F.avg("x").over(Window.partitionBy(*keys)), F.lit(0.0)).drop("_t")


def _scanned(cells: DataFrame, keys: tuple[str, ...], run: Callable[[list, list], list], always: bool = False) -> DataFrame:
    """A recurrence within each series: run(ords, xs) -> fills, with None for missing; linear in the series, one Arrow group for each. always: what it says, for observed cells too."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", ignore_index=True)
        xs = [None if v != v else v for v in pdf["x"].tolist()]
        return pdf.assign(fill=[x if x is not None and not always else f for x, f in zip(xs, run(pdf["ord"].tolist(), xs), strict=True)])

    schema = T.StructType([*cells.schema.fields, T.StructField("fill", T.DoubleType())])
    return cells.groupBy(*keys).applyInPandas(one, schema)


def holt(cells, keys=KEYS, a=0.4, b=0.1, cap=10):
    """Level and trend, continued up to `cap` steps into a gap; 0 before the first observation."""

    def run(ords, xs):
        level, trend, age, out = None, 0.0, 0, []
        for x in xs:
            age += 1
            out.append(0.0 if level is None else level + min(age, cap) * trend)
            if x is not None:
                new = x if level is None else a * x + (1 - a) * (level + trend)
                trend = 0.0 if level is None else b * (new - level) + (1 - b) * trend
                level, age = new, 0
        return out

    return _scanned(cells, keys, run)


def kalman_level(cells, keys=KEYS, q=0.05, r=1.0):
    """Local level from N(0, 1); the variance grows in gaps; the level is the fill once anything was seen, else 0."""

    def run(ords, xs):
        m, p, seen, out = 0.0, 1.0, False, []
        for x in xs:
            p += q
            out.append(m if seen else 0.0)
            if x is not None:
                k = p / (p + r)
                m, p, seen = m + k * (x - m), (1 - k) * p, True
        return out

    return _scanned(cells, keys, run)


def kalman_filter(cells, keys=KEYS, q=0.01, r=1.0):
    """The first observation sets the level; the variance stays in gaps."""

    def run(ords, xs):
        m, p, out = None, r, []
        for x in xs:
            out.append(0.0 if m is None else m)
            if x is not None and m is None:
                m = x
            elif x is not None:
                k = (p + q) / (p + q + r)
                m, p = m + k * (x - m), (1 - k) * (p + q)
        return out

    return _scanned(cells, keys, run)


def ewma(cells, keys=KEYS, halflife=5.0):
    """Mean of past observations, each worth half as much after `halflife` later observations."""
    lam = 0.5 ** (1 / halflife)

    def run(ords, xs):
        num = den = 0.0
        out = []
        for x in xs:
            out.append(num / den if den else 0.0)
            if x is not None:
                num, den = lam * num + x, lam * den + 1
        return out

    return _scanned(cells, keys, run)


#: name -> (function, point in time)
METHODS: dict[str, tuple[Callable[..., DataFrame], bool]] = {
    "zero": (zero, True), "locf": (locf, True), "mean_past": (expanding_mean, True), "rolling_mean": (rolling_mean, True), "rolling_median": (rolling_median, True), "drift": (drift, True),
    "ewma": (ewma, True), "holt": (holt, True), "kalman_local_level": (kalman_level, True), "kalman_filter": (kalman_filter, True), "xsec_mean": (xsec_feature_mean, True),
    "seasonal_naive": (seasonal_naive, False), "global_mean": (global_mean, False), "nocb": (nocb, False), "linear_interp": (linear, False), "forward_backward": (forward_backward, False), "two_way_mean": (two_way_mean, False),
}


def list_methods() -> list[str]:
    return list(METHODS)


def is_causal(method: str) -> bool:
    return METHODS[method][1]


def register(name: str, fn: Callable[..., DataFrame], causal: bool) -> None:
    METHODS[name] = (fn, causal)


def impute(cells: DataFrame, method: str = "locf", **options) -> DataFrame:
    return METHODS[method][0](cells, **options)
