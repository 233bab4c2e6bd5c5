"""Fills of a stream of cells: the last observation and the past mean of each series, kept as state for each series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last double, total double, n long, top long"


def filled(cells: DataFrame, keys: tuple[str, ...] = ("feature",), method: str = "locf") -> DataFrame:
    """A streaming DataFrame of cells with `fill` and `late`. method: 'locf' or 'mean_past'; 0 before the first observation.

    Rows of a batch are taken in order of ord. A row at or before the last ord that its series has had is late: it is filled from the state of that moment and leaves no trace in it,
    so a fill that was given is never revised. State is four numbers for each series.
    """
    if method not in ("locf", "mean_past"):
        raise ValueError(method)
    schema = T.StructType([*cells.schema.fields, T.StructField("fill", T.DoubleType()), T.StructField("late", T.BooleanType())])

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, n, top = state.get if state.exists else (0.0, 0.0, 0, -(1 << 62))
        rows = pd.concat(list(frames)).sort_values("ord", kind="stable", ignore_index=True)
        fills, lates = [], []
        for t, x in zip(rows["ord"].tolist(), rows["x"].tolist(), strict=True):
            seen, late = x is not None and x == x and abs(x) != float("inf"), t <= top
            if seen and not late:
                last, total, n = float(x), total + x, n + 1
            top = max(top, t)
            lates.append(late)
            fills.append(float(x) if seen else last if method == "locf" else total / n if n else 0.0)
        state.update((last, total, n, top))
        yield rows.assign(fill=fills, late=lates)[[f.name for f in schema]]

    return cells.groupBy(*keys).applyInPandasWithState(one, schema, STATE, "append", GroupStateTimeout.NoTimeout)
