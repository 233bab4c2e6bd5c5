import numpy as np
import pytest

from tests.test_estimator import factors, frame, hide
from tidegrid.operators import impute, matrix


@pytest.mark.parametrize("name", matrix.NAMES)
def test_fills_are_finite_and_beat_the_mean(name):
    truth = factors(300, 10, 2)
    x, m = hide(truth, 0.15)
    got = matrix.METHODS[name](x)
    assert np.isfinite(got).all()
    late = m & (np.arange(len(x)) > 50)[:, None]
    mean = np.nanmean(x, axis=0)
    assert np.abs(got - truth)[late].mean() < 0.8 * np.abs(mean - truth)[late].mean()


@pytest.mark.parametrize("name", sorted(matrix.CAUSAL))
def test_prefixes_agree(name):
    x, _ = hide(factors(120, 6), 0.2)
    f = matrix.METHODS[name]
    assert np.allclose(f(x[:70]), f(x)[:70], atol=1e-10)


def test_spline_is_exact_on_lines_and_parabolas():
    t = np.arange(9.0)
    x = np.stack([2 * t + 1, t**2], axis=1)
    y = x.copy()
    y[[3, 5], 0] = np.nan
    y[[1, 2, 3, 5, 6, 7], 1] = np.nan
    assert np.allclose(matrix.spline(y), x)


@pytest.mark.parametrize("name", matrix.NAMES)
def test_edges(name):
    for x in (np.full((3, 2), np.nan), np.array([[1.0]]), np.array([[np.nan]]), np.full((20, 3), 2.0)):
        x = x.copy()
        x[len(x) // 2, 0] = np.nan
        got = matrix.METHODS[name](x)
        assert got.shape == x.shape and np.isfinite(np.where(np.isfinite(x).any(axis=0), got, 0.0)).all()


def test_on_cells(spark):
    x, _ = hide(factors(60, 4), 0.2)
    for name in ("softimpute", "ewcov"):
        rows = impute.impute(frame(spark, x), name, keys=("entity", "feature")).collect()
        assert len(rows) == 240 and all(r.fill is not None and (r.x is None or r.x == r.fill) for r in rows)
