"""Tables as cells: (keys..., feature, ord, x), one row for each series and step of time, x null where nothing was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def observed(x: Column) -> Column:
    """NaN and infinities count as missing, like null."""
    x = x.cast("double")
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def cells_of(df: DataFrame, ord_col: str, values: list[str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """A wide table to cells. values: all numeric columns but ord and keys unless named; others stay out (join them back on keys and ord)."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    values = values or [c for c in numeric if c != ord_col and c not in keys]
    if not values:
        raise ValueError("no numeric column")
    ids = [*keys, ord_col]
    long = df.select(*ids, *[observed(F.col(c)).alias(c) for c in values]).unpivot(ids, values, "feature", "x")
    return long.withColumnRenamed(ord_col, "ord")


def wide_of(cells: DataFrame, features: list[str], keys: tuple[str, ...] = (), value: str = "fill") -> DataFrame:
    return cells.groupBy(*keys, "ord").pivot("feature", features).agg(F.first(value))


def densified(points: DataFrame, step: str, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(keys, at timestamp, x) to a full grid between the first and last `at` of all series: ord counts steps of 'HOUR' or 'DAY' from 0."""
    lo, hi = points.agg(F.min("at"), F.max("at")).first()  # two values
    if lo is None:
        return points.select(*keys, F.lit(0).cast("long").alias("ord"), "x")
    grid = points.select(*keys).distinct().withColumn("at", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.expr(f"INTERVAL 1 {step}"))))
    n = F.expr(f"timestampdiff({step}, timestamp'{lo}', at)").cast("long")
    return grid.join(points, [*keys, "at"], "left").select(*keys, n.alias("ord"), "x")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    points = e.groupBy(F.col("event_type").alias("feature"), F.date_trunc("hour", "ts").alias("at")).agg(F.avg("value").alias("x"))
    return densified(points, "HOUR")


def daily_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel: (entity, feature, ord, x) by user, event type and day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    points = e.groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("feature"), F.date_trunc("day", "ts").alias("at")).agg(F.avg("value").alias("x"))
    return densified(points, "DAY", ("entity", "feature"))


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id as ord, each element a series: a complete matrix, for masks that are put on it."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    name = next(f.name for f in v.schema if f.dataType.typeName() == "array")
    return v.select(F.col("vec_id").alias("ord"), F.posexplode(name).alias("feature", "x")).select(F.col("feature").cast("long").alias("feature"), "ord", F.col("x").cast("double").alias("x"))
