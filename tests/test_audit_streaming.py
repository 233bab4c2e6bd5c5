import math

import pytest
from pyspark.sql import functions as F

from tests.test_estimator import factors, frame, hide
from tidegrid.functions import scores
from tidegrid.operators import audit, impute
from tidegrid.plans import catalog  # noqa: F401  (registers all methods)
from tidegrid.streaming import carry


def test_causal_variant_and_report(spark):
    x, _ = hide(factors(60, 3), 0.3)
    cells = frame(spark, x).drop("entity")
    a = {(r.feature, r.ord): r.fill for r in audit.causal_variant(cells, "locf", 60).collect()}
    b = {(r.feature, r.ord): r.fill for r in impute.locf(cells).collect()}
    assert a == b
    got = {r.method: r for r in audit.panel(cells, ["locf", "linear_interp"], length=24).collect()}
    assert got["locf"].holds and not got["linear_interp"].holds
    assert got["linear_interp"].delta > got["locf"].delta - 1e-9


def test_keep_observed(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 5.0), ("a", 1, None, float("nan")), ("b", 0, None, None)], "feature string, ord long, x double, fill double")
    assert sorted((r.feature, r.ord, r.fill) for r in audit.keep_observed(df).collect()) == [("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 0.0)]


def test_gaussian_crps_and_reliability(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (2.0, 0.0, 0.0)], "y double, m double, s double")
    got = [r.c for r in df.select(scores.gaussian_crps("y", "m", "s").alias("c")).collect()]
    assert got[0] == pytest.approx(2 / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi)) and got[1] == 2
    rel = scores.reliability(spark.range(100).select((F.col("id") / 100).alias("p")), "p").orderBy("bin").collect()
    assert [r.share for r in rel] == pytest.approx([(k + 1) / 10 for k in range(10)])


@pytest.mark.parametrize(("method", "want"), [("locf", [0, 1, 1, 3, 3]), ("mean_past", [0, 1, 1, 3, 2])])
def test_stream(spark, tmp_path, method, want):
    schema = "feature string, ord long, x double"
    for k, rows in enumerate([[("a", 1, 1.0), ("a", 0, None), ("a", 2, None)], [("a", 4, None), ("a", 3, 3.0), ("a", 1, 9.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = carry.filled(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), method=method).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r.fill for r in out.where("not late").orderBy("ord").collect()] == want
    assert [(r.ord, r.fill) for r in out.where("late").collect()] == [(1, 9.0)]
