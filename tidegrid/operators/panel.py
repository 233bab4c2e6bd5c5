"""Panels (entity, feature, ord): the joint engine, which shares factors between entities, the engine of single entities, and their blend.

The joint engine's state couples all entities at each step, so a panel is one Arrow group: `panel` columns name independent panels, which run side by side. Memory is one panel's steps by entities by features.
Every fill at a step comes from rows up to that step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegrid.operators import estimator as es
from tidegrid.operators.impute import METHODS

KEYS = ("entity", "feature")
SOLVE_EVERY = 4


def _squares(m: np.ndarray) -> np.ndarray:
    return (m[:, :, None] * m[:, None, :]).reshape(len(m), -1)


class _Joint:
    """Entity level, trimmed time effect of each feature, factors (entity loadings times time factor times feature loadings) and a carry of what is left."""

    def __init__(self, e: int, f: int):
        r = es.RANK
        rng = np.random.default_rng(0)
        self.e, self.f, self.r = e, f, r
        self.own, self.all = np.zeros((2, e, f)), np.zeros((2, f))
        self.slow, self.keep = 0.5 ** (1 / es.LEVEL_HALFLIFE), 0.5 ** (1 / es.HALFLIFE)
        self.entity, self.feature, self.alpha = 0.01 * rng.standard_normal((e, r)), 0.01 * rng.standard_normal((f, r)), np.ones(r)
        self.a, self.time, self.steps = 0.5, np.zeros(r), 0
        self.nu, self.scale2, self.spread, self.moments = es.NU_START, 1.0, np.array([0.0, es.FAINT]), np.array([0.0, 0.0, es.FAINT])
        self.rest, self.have, self.row = np.zeros((e, f)), np.zeros((e, f), bool), np.zeros((e, r))
        self.last, self.age, self.rho, self.lag = np.zeros((e, f)), np.full((e, f), 1e9), 0.0, np.array([0.0, es.FAINT])

    def weight(self, square):
        return (self.nu + 1) / (self.nu + square / max(self.scale2, es.EPS))

    def level(self) -> np.ndarray:
        whole = np.divide(*self.all, out=np.zeros(self.f), where=self.all[1] > 0)
        return np.where(self.own[1] > 0, self.own[0] / np.maximum(self.own[1], 1), whole)

    def common(self, r: np.ndarray, on: np.ndarray) -> np.ndarray:
        """For each feature the mean over entities: of three or more that of the middle, shrunk by its uncertainty; of fewer the plain one."""
        n = on.sum(axis=0)
        held = np.where(on, r, np.nan)
        out = np.where(on, r, 0.0).sum(axis=0) / np.maximum(n, 1)
        many = n >= 3
        if many.any():
            x = held[:, many]
            low, high = np.nanpercentile(x, (10, 90), axis=0)
            raw = np.nanmean(np.where((x >= low) & (x <= high), x, np.nan), axis=0)
            signal = np.maximum(raw * raw, es.EPS)
            out[many] = raw * signal / (signal + np.maximum(np.nanvar(x, axis=0), es.EPS) / n[many])
        return out

    def step(self, x: np.ndarray) -> np.ndarray:
        """x: entities by features at one step, NaN for missing."""
        on = np.isfinite(x)
        some = on.any(axis=1)
        level = self.level()
        r = np.where(on, x - level, 0.0)
        time = self.common(r, on)
        r = np.where(on, r - time, 0.0)
        # the time factor, drawn to its prediction
        ahead = self.a * self.time
        inside = (on @ _squares(self.feature)).reshape(-1, self.r, self.r)
        toward = r @ self.feature
        off_by = np.where(on, r - (self.entity * ahead) @ self.feature.T, 0.0)
        w = np.where(some, self.weight((off_by**2).sum(axis=1) / np.maximum(on.sum(axis=1), 1)), 0.0)
        pull = self.a**2 / (1 - self.a**2 + 1e-2)
        g = np.einsum("e,er,es,ers->rs", w, self.entity, self.entity, inside) + np.diag(self.alpha + pull)
        factor = np.linalg.solve(g, (w[:, None] * self.entity * toward).sum(axis=0) + pull * ahead)
        if some.any():
            g = np.multiply.outer(factor, factor) * inside[some] + np.diag(self.alpha)
            self.entity[some] = np.linalg.solve(g, (factor * toward[some])[:, :, None])[:, :, 0]
        low = (self.entity * factor) @ self.feature.T
        self.age += 1
        carry = self.rho ** np.minimum(self.age, 60) * self.last
        fill = np.where(on, x, level + time + low + carry)
        self.rest, self.have = np.where(on, r, low), np.ones_like(self.have)
        self.row[some] = self.entity[some] * factor
        self.learn(x, on, some, r - low)
        self.steps += 1
        if self.steps % SOLVE_EVERY == 0:
            self.refit()
        self.a = float(np.clip(0.8 * self.a + 0.2 * (factor @ self.time) / (self.time @ self.time + 1), 0, 0.999))
        self.time = factor
        return fill

    def learn(self, x: np.ndarray, on: np.ndarray, some: np.ndarray, idio: np.ndarray) -> None:
        fresh = on & (self.age <= 1.5)
        which = np.flatnonzero(fresh.any(axis=1))
        if len(which):
            pairs = np.stack([np.where(fresh, idio * self.last, 0).sum(axis=1), np.where(fresh, self.last**2, 0).sum(axis=1)])[:, which]
            k = len(which)
            self.lag = self.keep**k * self.lag + pairs @ self.keep ** np.arange(k - 1, -1, -1)
            self.rho = float(np.clip(self.lag[0] / max(self.lag[1], 1e-6), 0, 0.995))
        self.last, self.age = np.where(on, idio, self.last), np.where(on, 0, self.age)
        if some.any():
            square = idio[on] ** 2
            mean, w, scale = square.mean(), self.weight(square.mean()), max(self.scale2, es.EPS)
            self.spread = self.keep * self.spread + [w * mean, w]
            self.moments = self.keep * self.moments + [mean / scale, (square**2).mean() / scale**2, 1]
            self.scale2 = max(self.spread[0] / self.spread[1], es.EPS)
            if self.moments[2] > 30:
                m2, m4 = self.moments[:2] / self.moments[2]
                excess = m4 / max(m2 * m2, es.EPS) - 3
                self.nu = float(np.clip(0.7 * self.nu + 0.3 * (4 + 6 / excess if excess > 0.2 else es.NU_HIGH), es.NU_LOW, es.NU_HIGH))
        seen = np.stack([np.where(on, x, 0.0), on.astype(float)])
        self.own = np.where(on, self.slow * self.own, self.own) + seen
        for k in range(self.e):  # forgets with each observation of any entity
            self.all = np.where(on[k], self.slow * self.all, self.all) + seen[:, k]

    def refit(self) -> None:
        known = self.have.any(axis=1)
        if known.sum() < 2:
            return
        row, have = self.row[known], self.have[known]
        g = (have.T.astype(float) @ _squares(row)).reshape(-1, self.r, self.r) + np.diag(self.alpha)
        new = np.linalg.solve(g, (np.where(have, self.rest[known], 0.0).T @ row)[:, :, None])[:, :, 0]
        self.feature[have.any(axis=0)] = new[have.any(axis=0)]
        energy = (self.feature**2).sum(axis=0) * ((row**2).sum(axis=0) + 1)
        self.alpha = (self.f + known.sum()) / (energy + 1)


def run_panel(x: np.ndarray) -> np.ndarray:
    """x: entities by steps by features, NaN for missing -> the same, full."""
    state, out = _Joint(x.shape[0], x.shape[2]), np.empty_like(x)
    for t in range(x.shape[1]):
        out[:, t] = state.step(x[:, t])
    return np.where(np.isfinite(out), out, 0.0)


def joint(cells: DataFrame, keys=KEYS, panel: tuple[str, ...] = ()) -> DataFrame:
    """The joint engine: cells with `fill`. Several rows of a cell: the mean of those observed counts."""
    schema = T.StructType([*cells.schema.fields, T.StructField("fill", T.DoubleType())])
    of = [k for k in keys if k != "feature"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["x"].astype(float).to_numpy()
        own = np.where(np.isfinite(own), own, np.nan)
        names = pdf[of].astype(str).agg("\x1f".join, axis=1) if len(of) > 1 else pdf[of[0]]
        (e, entities), (t, times), (f, features) = (pd.factorize(c, sort=True, use_na_sentinel=False) for c in (names, pdf["ord"], pdf["feature"]))
        total, count = np.zeros((2, len(entities), len(times), len(features)))
        np.add.at(total, (e, t, f), np.nan_to_num(own))
        np.add.at(count, (e, t, f), np.isfinite(own))
        got = run_panel(np.divide(total, count, out=np.full(total.shape, np.nan), where=count > 0))
        return pdf.assign(fill=np.where(np.isfinite(own), own, got[e, t, f]))[[c.name for c in schema]]

    out = cells.groupBy(*panel).applyInPandas(one, schema)
    return out.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def per_entity(cells: DataFrame, keys=KEYS) -> DataFrame:
    return es.estimate(cells, keys)


ENGINES: dict[str, Callable[..., DataFrame]] = {"joint": joint, "per_entity": per_entity}


def impute_panel(cells: DataFrame, engine: str = "joint", keys=KEYS) -> DataFrame:
    """engine: 'joint' or 'per_entity'."""
    if engine not in ENGINES:
        raise ValueError(f"engine {engine!r}: one of {sorted(ENGINES)}")
    return ENGINES[engine](cells, keys)


def availability(cells: DataFrame, tau: float = 5.0, keys=KEYS) -> DataFrame:
    """Adds own_weight in 0 .. 1: how many observations of the series lie strictly before, over the steps since the last of them, against tau."""
    before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("x").isNotNull(), F.col("ord"))
    have = F.count(seen).over(before) / (1 + F.coalesce(F.col("ord") - F.max(seen).over(before), F.lit(1e6)))
    return cells.withColumn("_have", have).withColumn("own_weight", F.col("_have") / (F.col("_have") + tau)).drop("_have")


def blended(cells: DataFrame, tau: float = 5.0, keys=KEYS) -> DataFrame:
    """The entity's own engine where it has much to go on, the joint one elsewhere."""
    ids = [*keys, "ord"]
    one = lambda df, name: df.groupBy(*ids).agg(F.first("fill").alias(name))
    both = availability(cells, tau, keys).join(one(joint(cells, keys), "_j"), ids).join(one(per_entity(cells, keys), "_p"), ids)
    w = F.col("own_weight")
    return both.withColumn("fill", F.coalesce("x", w * F.col("_p") + (1 - w) * F.col("_j"))).drop("_j", "_p", "own_weight")


def by_stay(cells: DataFrame, method: str, length: int = 48, keys=("feature",), **options) -> DataFrame:
    """A method that starts anew with each stretch of `length` steps."""
    stays = cells.withColumn("_stay", F.floor(F.col("ord") / length))
    return METHODS[method][0](stays, keys=("_stay", *keys), **options).drop("_stay")


