"""The front door: a table in, the same table with its gaps filled out; rows, columns, order of columns, labels and types as they came."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scores import selective_indicators
from tidegrid.operators import estimator as es
from tidegrid.operators import impute as im
from tidegrid.operators import panel as pn
from tidegrid.operators.evaluate import missingness
from tidegrid.sources.files import numbered
from tidegrid.sources.grid import observed

NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")
FEATURES = ("was_imputed", "time_since_obs", "gap_length", "missing_rate")


class Adapter:
    """Table <-> cells. time: the column that orders steps; entity: the columns that name a panel's entities. Neither is filled, numeric or not; nor are columns that are no numbers. Steps are the distinct times, numbered in their order, so
    several rows of one (time, entity) are several observations of one cell. Rows with a null time have no step: they come back as they are."""

    def __init__(self, df: DataFrame, time: str, entity: str | tuple[str, ...] | None = None):
        self.df, self.time, self.entity = df, time, (entity,) if isinstance(entity, str) else tuple(entity or ())
        for c in (time, *self.entity):
            if c not in df.columns:
                raise KeyError(f"column {c!r} not found in {df.columns}")
        self.values = [f.name for f in df.schema if f.dataType.typeName() in NUMERIC and f.name not in (time, *self.entity)]
        if not self.values:
            raise ValueError("no numeric column to fill")
        self.steps = codes(df, time).withColumnsRenamed({"label": "_label", "code": "_ord"})
        self.ids = [f"_e{i}" for i in range(len(self.entity))]

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.ids, "feature")

    def _rows(self) -> DataFrame:
        return self.df.join(self.steps, self.df[self.time].eqNullSafe(self.steps["_label"]), "left").drop("_label")

    def cells(self) -> DataFrame:
        """(entity..., feature, ord, x), one row for each cell: the mean of its observations."""
        rows = self._rows().where("_ord is not null")
        ids = [F.col(f"`{c}`").alias(i) for c, i in zip(self.entity, self.ids, strict=True)]
        long = rows.select(*ids, F.col("_ord").alias("ord"), *[observed(F.col(f"`{v}`")).alias(v) for v in self.values]).unpivot([*self.ids, "ord"], self.values, "feature", "x")
        return long.groupBy(*self.keys, "ord").agg(F.avg("x").alias("x"))

    def back(self, filled: DataFrame, value: str = "fill") -> DataFrame:
        """The table with its gaps filled from cells: observed values keep their value and type, a filled column of whole numbers becomes double."""
        wide = filled.groupBy(*self.ids, "ord").pivot("feature", self.values).agg(F.first(value))
        wide = wide.select(F.col("ord").alias("_ord"), *[F.col(i) for i in self.ids], *[F.col(f"`{v}`").alias(f"_f_{v}") for v in self.values])
        rows = self._rows()
        same = rows["_ord"] == wide["_ord"]
        for c, i in zip(self.entity, self.ids, strict=True):
            same = same & rows[c].eqNullSafe(wide[i])
        out = rows.join(wide, same, "left")

        def one(c: str):
            if c not in self.values:
                return rows[c]
            own, kind = observed(rows[c]), self.df.schema[c].dataType
            whole = not isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))
            kept = F.coalesce(own, F.col(f"`_f_{c}`"))
            return (kept if whole else kept.cast(kind)).alias(c)

        return out.select(*[one(c) for c in self.df.columns])

    def features(self, cells: DataFrame, kinds: tuple[str, ...] = FEATURES, selective: bool = True) -> DataFrame:
        """(time, entity..., <column>__<kind>...): the pattern of gaps as columns; selective: also <column>__selective_mim for columns whose gaps go with other values of the others."""
        if unknown := set(kinds) - set(FEATURES):
            raise ValueError(f"unknown kinds {sorted(unknown)}")
        each = missingness(cells, self.keys)
        aggregates = [F.first(k).alias(k) for k in kinds]
        if selective:
            informative = selective_indicators(cells.withColumn("ord", F.struct(*self.ids, "ord")) if self.ids else cells)
            each = each.join(F.broadcast(informative.select("feature", "informative")), "feature", "left")  # one row for each column
            aggregates.append(F.first(F.when(F.col("informative"), F.col("was_imputed"))).alias("selective_mim"))
        names = [f"{v}__{k}" for v in self.values for k in (*kinds, *(["selective_mim"] if selective else []))]
        wide = each.groupBy(*self.ids, "ord").pivot("feature", self.values).agg(*aggregates)
        if len(aggregates) == 1:
            wide = wide.withColumnsRenamed({v: f"{v}__{(*kinds, 'selective_mim')[0]}" for v in self.values})
        else:
            wide = wide.withColumnsRenamed({f"{v}_{k}": f"{v}__{k}" for v in self.values for k in (*kinds, "selective_mim")})
        labels = self.steps.withColumnRenamed("_label", self.time)
        out = wide.join(labels, wide["ord"] == labels["_ord"])
        return out.select(self.time, *[F.col(i).alias(c) for c, i in zip(self.entity, self.ids, strict=True)], *[F.col(f"`{n}`") for n in names])


def codes(df: DataFrame, column: str) -> DataFrame:
    """(label, code): the distinct values in order, numbered from 0; null has none."""
    return numbered(df.select(F.col(f"`{column}`").alias("label")).where("label is not null").distinct(), ["label"]).select("label", F.col("ord").alias("code"))


class Imputer:
    """Point-in-time filling; there is no other kind."""

    def __init__(self, causal: bool = True):
        if not causal:
            raise NotImplementedError("only point-in-time estimation")

    def impute(self, df: DataFrame, time: str, entity=None, engine: str = "joint", method: str | Callable | None = None, return_mask: bool = False, kinds: tuple[str, ...] = FEATURES, selective: bool = True):
        """The table filled; with return_mask also the features of its gaps. entity: a panel, filled by the `engine` ('joint' or 'per_entity'). method: another imputer, by name or as a function of cells and keys."""
        adapter = Adapter(df, time, entity)
        cells = adapter.cells()
        if method is not None:
            filled = method(cells, adapter.keys) if callable(method) else im.impute(cells, method, keys=adapter.keys)
        elif adapter.entity:
            filled = pn.impute_panel(cells, engine, adapter.keys)
        else:
            filled = es.estimate(cells, adapter.keys)
        out = adapter.back(filled)
        return (out, adapter.features(cells, tuple(kinds), selective)) if return_mask else out

    def run(self, df: DataFrame, time: str, entity=None, settings: es.Settings = es.Settings()) -> DataFrame:
        """The traced cells (fill, sigma, parts) of a table, one run for each entity."""
        adapter = Adapter(df, time, entity)
        return es.traced(adapter.cells(), tuple(adapter.ids), settings)

    def forecast(self, df: DataFrame, time: str, horizon: int, entity=None) -> DataFrame:
        adapter = Adapter(df, time, entity)
        return es.forecast(adapter.cells(), horizon, tuple(adapter.ids))


def impute(df: DataFrame, time: str, entity=None, engine: str = "joint", return_mask: bool = False, **options):
    return Imputer().impute(df, time, entity, engine, return_mask=return_mask, **options)


def standard(df: DataFrame, time: str, entity=None) -> DataFrame:
    """The cells of a table, for operators that work on cells."""
    return Adapter(df, time, entity).cells()


__all__ = ["Adapter", "Imputer", "codes", "impute", "standard"]
