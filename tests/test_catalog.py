import math

import duckdb
import pytest

import __spark_entry__
from tidegrid.operators import evaluate, impute
from tidegrid.plans import catalog, extended  # noqa: F401 - extended adds to the catalog
from tidegrid.sources import grid

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in ("events", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found):
    fix = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x
    return sorted(([fix(x) for x in r] for r in found), key=lambda r: [(x is None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got, want = rows(df.select(*columns).collect()), rows(oracle.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) < 2e-6 for x, y in zip(g, w, strict=True)), (g, w)


def cells(spark, xs):
    return spark.createDataFrame([("s", t, x) for t, x in enumerate(xs)], "feature string, ord long, x double")


def fills(df):
    return [r.fill for r in df.orderBy("ord").collect()]


def test_golden_vectors(spark):
    c = cells(spark, [1.0, None, 9.0])
    assert [fills(impute.impute(c, m))[1] for m in ("locf", "nocb", "linear_interp")] == [1, 9, 5]
    m = evaluate.missingness(cells(spark, [1.0, None, None, None, 2.0])).orderBy("ord").collect()
    assert [r.time_since_obs for r in m] == [0, 1, 2, 3, 0]
    m = evaluate.missingness(cells(spark, [None, 1.0, None, 2.0])).orderBy("ord").collect()
    assert [r.missing_rate for r in m] == pytest.approx([1, 0.5, 2 / 3, 0.5])
    assert abs(evaluate.normal_quantile(0.95) - 1.644854) < 1e-5


@pytest.mark.parametrize("method", impute.list_methods())
def test_contract(spark, method):
    xs = [None, 2.0, None, None, 2.0, None]
    got = fills(impute.impute(cells(spark, xs), method))
    assert all(x is None or x == f for x, f in zip(xs, got, strict=True)) and all(f is not None and math.isfinite(f) for f in got)
    assert set(got[2:]) == {2.0} or method in ("zero", "kalman_local_level", "nocb")  # a level that starts from 0; a trailing gap that is 0 by definition
    assert fills(impute.impute(cells(spark, [None, None]), method)) == [0, 0]
    assert fills(impute.impute(cells(spark, []), method)) == []


@pytest.mark.parametrize("method", impute.list_methods())
def test_causal_tag(spark, method):
    xs = [None if (t * 7) % 5 < 2 else float((t * 13) % 11) for t in range(40)]
    worst = max(r.max_revision for r in evaluate.causality_certificate(cells(spark, xs), impute.METHODS[method][0]).collect())
    assert not impute.is_causal(method) or worst <= 1e-9


def test_wide_round_trip_and_nan(spark):
    w = spark.createDataFrame([(0, 1.0, float("nan"), "a"), (1, None, float("inf"), "b")], "ord long, p double, q double, label string")
    c = grid.cells_of(w, "ord")
    assert sorted((r.feature, r.ord, r.x) for r in c.where("x is not null").collect()) == [("p", 0, 1.0)]
    back = grid.wide_of(impute.locf(c), ["p", "q"]).orderBy("ord").collect()
    assert [(r.p, r.q) for r in back] == [(1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        grid.cells_of(w.select("ord", "label"), "ord")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
