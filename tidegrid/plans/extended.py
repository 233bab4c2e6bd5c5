"""More named queries, added to those of the catalog: adapters, masks, calibration, audits, statistics, applications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid import api
from tidegrid.functions import scores as sc
from tidegrid.functions import stats as st
from tidegrid.operators import apply as ap
from tidegrid.operators import audit as au
from tidegrid.operators import estimator as es
from tidegrid.operators import evaluate as ev
from tidegrid.operators import impute as im
from tidegrid.operators import matrix as mx
from tidegrid.operators import online as on
from tidegrid.operators import panel as pn
from tidegrid.plans.catalog import ALL, DAILY, DRAW, HIDE, HOURLY, LAST24, LOCF, PUP, SEEN, UP, _add, _cells_sql, _errors, _rounded
from tidegrid.sources import files as fl
from tidegrid.sources import grid

KINDS = ("click", "error", "purchase", "signup", "view")


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """(day, user_id, label, n, <kind>...): a panel as a table with gaps, a column that is no number and one of whole numbers."""
    e = spark.read.parquet(f"{d}/events.parquet")
    value = [F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in KINDS[:3]]
    return e.groupBy(F.date_trunc("day", "ts").alias("day"), "user_id").agg(F.max("event_type").alias("label"), F.count(F.lit(1)).alias("n"), *value)


WIDE = f"w AS (SELECT date_trunc('day', ts) AS day, user_id, max(event_type) AS label, count(*) AS n, {', '.join(f'''avg(value) FILTER (event_type = '{k}') AS {k}''' for k in KINDS[:3])} FROM events GROUP BY 1, 2)"
ROUND = lambda c: f"round({c}, 6) AS {c}"

_add(
    "table_round_trip",
    lambda spark, d: _rounded(api.impute(_wide(spark, d), "day", "user_id", method="locf"), "day", "user_id", "label", "n", *KINDS[:3]),
    f"WITH {WIDE} SELECT day, user_id, label, n::DOUBLE AS n, {', '.join(f'round(coalesce({k}, last_value({k} IGNORE NULLS) OVER u, 0), 6) AS {k}' for k in KINDS[:3])} FROM w WINDOW u AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
_add("label_codes", lambda spark, d: api.codes(spark.read.parquet(f"{d}/events.parquet"), "event_type"), "SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT event_type AS label FROM events)")
_add("step_codes", lambda spark, d: api.codes(_wide(spark, d), "day"), f"WITH {WIDE} SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT day AS label FROM w)")


def _features(spark: SparkSession, d: str) -> DataFrame:
    _, got = api.impute(_wide(spark, d).drop("n"), "day", "user_id", method="locf", return_mask=True, selective=False)
    return _rounded(got, *got.columns)


_add(
    "table_features", _features,
    f"""WITH {WIDE}, r AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS ord FROM w) SELECT day, user_id, {', '.join(f'''({k} IS NULL)::INT::DOUBLE AS {k}__was_imputed, (ord - coalesce(max(CASE WHEN {k} IS NOT NULL THEN ord END) OVER u, min(ord) OVER (PARTITION BY user_id) - 1))::DOUBLE AS {k}__time_since_obs,
(ord - coalesce(max(CASE WHEN {k} IS NOT NULL THEN ord END) OVER u, min(ord) OVER (PARTITION BY user_id) - 1))::DOUBLE AS {k}__gap_length, round(avg(({k} IS NULL)::INT) OVER u, 6) AS {k}__missing_rate''' for k in KINDS[:3])}
FROM r WINDOW u AS (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)


def _hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours by kind, as a wide table (ord, kinds...)."""
    e = spark.read.parquet(f"{d}/events.parquet")
    wide = fl.pivoted(e.withColumnRenamed("value", "v"), F.date_trunc("hour", "ts"), "event_type", ["v"])
    return wide.select("ord", *[F.col(f"{k}_v") for k in KINDS])


def _melted(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c != "ord"]
    return _rounded(df.unpivot("ord", names, "series", "x"), "ord", "series", "x")


PIVOT = f"""p AS (SELECT date_trunc('hour', ts) AS h, event_type || '_v' AS series, first(value ORDER BY event_id) AS x FROM events GROUP BY ALL)"""
FIRST = f"""q AS (SELECT date_trunc('hour', ts) AS h, event_type, max(value) AS v FROM events GROUP BY ALL), k AS (SELECT DISTINCT event_type FROM q), t AS (SELECT h, dense_rank() OVER (ORDER BY h) - 1 AS ord FROM (SELECT DISTINCT h FROM q)),
c AS (SELECT t.ord, k.event_type || '_v' AS series, q.v AS x FROM t CROSS JOIN k LEFT JOIN q ON q.h = t.h AND q.event_type = k.event_type)"""


def _hours_max(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").agg(F.max("value").alias("v"))
    return fl.pivoted(e, F.col("h"), "event_type", ["v"]).select("ord", *[F.col(f"{k}_v") for k in KINDS])


_add("station_pivot", lambda spark, d: _melted(_hours_max(spark, d)), f"WITH {FIRST} SELECT ord, series, round(x, 6) AS x FROM c")
_add(
    "covered_complete_standardised", lambda spark, d: _melted(fl.standardised(fl.complete(fl.covered(_hours_max(spark, d), 0.1)))),
    f"""WITH {FIRST}, s AS (SELECT series FROM c GROUP BY series HAVING avg((x IS NOT NULL)::INT) >= 0.1), g AS (SELECT ord FROM c JOIN s USING (series) GROUP BY ord HAVING count(x) = count(*)), o AS (SELECT ord AS old, row_number() OVER (ORDER BY ord) - 1 AS ord FROM g),
z AS (SELECT o.ord, series, x FROM c JOIN s USING (series) JOIN o ON o.old = c.ord) SELECT ord, series, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-9), 6) AS x FROM z WINDOW w AS (PARTITION BY series)""",
)
_add("thinned", lambda spark, d: _melted(fl.thinned(_hours_max(spark, d), 5, 3)), f"WITH {FIRST} SELECT ord // 5 AS ord, series, round(x, 6) AS x FROM c WHERE ord % 5 = 0 AND series IN ('click_v', 'error_v', 'purchase_v')")
_add(
    "mixed_frequency",
    lambda spark, d: _rounded(fl.mixed_frequency(_hours_max(spark, d).select("ord", "click_v", "error_v"), ["click_v"], 3), "ord", "click_v", "error_v", "truth_click_v", "released"),
    f"""WITH {FIRST}, p AS (SELECT ord, max(x) FILTER (series = 'click_v') AS a, max(x) FILTER (series = 'error_v') AS b FROM c GROUP BY ord)
SELECT ord, round(CASE WHEN ord % 3 = 2 THEN a END, 6) AS click_v, round(b, 6) AS error_v, round(a, 6) AS truth_click_v, ord % 3 = 2 AS released FROM p""",
)


def _vintages(spark: SparkSession, d: str) -> DataFrame:
    """Order totals as published: each ship month of an order's lines is a vintage of the order's day."""
    o, l = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.date_trunc("month", "l_shipdate").alias("vintage"), F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("date")).agg(F.sum("l_quantity").cast("double").alias("value"))


_add(
    "vintage", lambda spark, d: _rounded(fl.vintage(_vintages(spark, d), F.lit("1996-01-01").cast("timestamp")).withColumn("vintage", F.col("vintage").cast("date")).withColumn("date", F.col("date").cast("date")), "series", "date", "value", "vintage"),
    """WITH p AS (SELECT date_trunc('month', l_shipdate)::DATE AS vintage, o_orderpriority AS series, o_orderdate::DATE AS date, sum(l_quantity)::DOUBLE AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT series, date, round(arg_max(value, vintage), 6) AS value, max(vintage) AS vintage FROM p WHERE vintage <= DATE '1996-01-01' GROUP BY ALL""",
)

# Imputers.
G = HOURLY
_add(
    "safety_mean", lambda spark, d: _rounded(on.safety_mean(grid.hourly_events(spark, d)), "feature", "ord", "fill"),
    f"""WITH {G}, t AS (SELECT ord, sum(x) AS s, count(x) AS n FROM g GROUP BY ord), m AS (SELECT ord, sum(s) OVER (ORDER BY ord) / nullif(sum(n) OVER (ORDER BY ord), 0) AS mu FROM t)
SELECT feature, ord, round(coalesce(x, avg(x) OVER {UP}, mu, 0), 6) AS fill FROM g JOIN m USING (ord)""",
)
LAM5, LAM20 = (f"{0.5 ** (1 / h)!r}::DOUBLE" for h in (5.0, 20.0))
_add(
    "panel_ewma", lambda spark, d: _rounded(on.panel_ewma(grid.daily_users(spark, d)), "entity", "feature", "ord", "fill"),
    f"""WITH {DAILY}, c AS (SELECT *, count(x) OVER {PUP} AS i FROM g), s AS (SELECT *, sum(x * pow({LAM5}, -i)) OVER {PUP} / nullif(sum(CASE WHEN x IS NOT NULL THEN pow({LAM5}, -i) END) OVER {PUP}, 0) AS m FROM c)
SELECT entity, feature, ord, round(coalesce(x, m, 0), 6) AS fill FROM s""",
)
_add(
    "step_ewma", lambda spark, d: _rounded(on.step_ewma(grid.daily_users(spark, d)), "entity", "feature", "ord", "fill"),
    f"""WITH {DAILY}, t AS (SELECT feature, ord, avg(x) AS a FROM g GROUP BY ALL), m AS (SELECT feature, ord, sum(a * pow({LAM20}, -ord)) OVER v / nullif(sum(CASE WHEN a IS NOT NULL THEN pow({LAM20}, -ord) END) OVER v, 0) AS m FROM t
WINDOW v AS (PARTITION BY feature ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT entity, feature, ord, round(coalesce(x, m, 0), 6) AS fill FROM g JOIN m USING (feature, ord)""",
)
_add(
    "availability", lambda spark, d: _rounded(pn.availability(grid.daily_users(spark, d)), "entity", "feature", "ord", "own_weight"),
    f"""WITH {DAILY}, hv AS (SELECT *, count(x) OVER w / (1 + coalesce(ord - max(CASE WHEN x IS NOT NULL THEN ord END) OVER w, 1e6)) AS have FROM g WINDOW w AS (PARTITION BY entity, feature ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT entity, feature, ord, round(have / (have + 5), 6) AS own_weight FROM hv""",
)
_add(
    "by_stay", lambda spark, d: _rounded(pn.by_stay(grid.hourly_events(spark, d), "mean_past"), "feature", "ord", "fill"),
    f"WITH {G} SELECT feature, ord, round(coalesce(x, avg(x) OVER (PARTITION BY feature, ord // 48 ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS fill FROM g",
)
for _engine in ("joint", "per_entity"):
    _add(f"panel_{_engine}", lambda spark, d, e=_engine: _rounded(pn.impute_panel(grid.daily_users(spark, d), e), "entity", "feature", "ord", "fill"))
_add("panel_blended", lambda spark, d: _rounded(pn.blended(grid.daily_users(spark, d)), "entity", "feature", "ord", "fill"))
_add("panel_gap_aware", lambda spark, d: _rounded(on.gap_aware(grid.daily_users(spark, d)), "entity", "feature", "ord", "fill"))
_add("panel_factors", lambda spark, d: _rounded(on.panel_factors(grid.daily_users(spark, d)), "entity", "feature", "ord", "fill"))
for _m in on.NAMES:
    _add(f"online_{_m}", lambda spark, d, m=_m: _rounded(mx.filled(grid.hourly_events(spark, d), m), "feature", "ord", "fill"))

# By-products of the estimator.
_add("estimator_compact", lambda spark, d: _rounded(es.compact(es.traced(grid.hourly_events(spark, d))), "feature", "ord", "level", "season", "factor", "residual"))
_add("estimator_dials", lambda spark, d: _rounded(sc.by_dials(es.dials(grid.hourly_events(spark, d))), "nu", "ar", "effective_rank", "reading"))
_add("estimator_pooled_network", lambda spark, d: _rounded(es.pooled_network(grid.daily_users(spark, d), ("entity",)), "i", "j", "corr", "n"))
_add("estimator_calibrated", lambda spark, d: _rounded(es.calibrated(grid.hourly_events(spark, d)), "feature", "ord", "fill", "half", "lo", "hi"))
_add("estimator_components", lambda spark, d: _rounded(es.components(es.traced(grid.hourly_events(spark, d))).where("x is null"), "feature", "ord", *es.TRUST))
_add("estimator_trusted", lambda spark, d: _rounded(es.trusted(grid.hourly_events(spark, d)).where("x is null"), "feature", "ord", "fill", "trust"))

# Masks.
Z = "(x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0)"
RAW = G.replace("g AS (", "g0 AS (")
MASK_SQL = {
    "mar": f"""z AS (SELECT *, {Z} AS z FROM g0 WINDOW w AS (PARTITION BY feature)), v AS (SELECT *, coalesce(lag(z) OVER s, last_value(z) OVER (PARTITION BY ord ORDER BY feature ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS lead FROM z WINDOW s AS (PARTITION BY ord ORDER BY feature)),
m AS (SELECT feature, ord, x AS truth, x IS NOT NULL AND {DRAW.format('feature, ord, 5')} < least(950, 400 / (1 + exp(-lead))) AS hidden FROM v)""",
    "mixed": f"m AS (SELECT feature, ord, x AS truth, x IS NOT NULL AND ({DRAW.format('feature, ord // 10, 5')} < 120 OR {DRAW.format('feature, ord, 6')} < 80) AS hidden FROM g0)",
    "async": f"""a AS (SELECT feature, ord AS s, greatest(1, floor(-ln(({DRAW.format('feature, ord, 6')} + 1) / 1001.0::DOUBLE) * 20)) AS n FROM g0 WHERE {DRAW.format('feature, ord, 5')} < 10),
m AS (SELECT g0.feature, ord, x AS truth, x IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.feature = g0.feature AND s <= ord AND s >= ord - 160 AND s + n > ord) AS hidden FROM g0)""",
}
for _m, _sql in MASK_SQL.items():
    _add(f"mask_{_m}", lambda spark, d, m=_m: _rounded(im.locf(ev.masked(grid.hourly_events(spark, d), m, 0.2, 5)), "feature", "ord", "hidden", "fill"),
         f"WITH {RAW}, {_sql}, g AS (SELECT *, CASE WHEN NOT hidden THEN truth END AS x FROM m) SELECT feature, ord, hidden, round(coalesce(x, {LOCF}, 0), 6) AS fill FROM g")
_add(
    "mask_subsequence", lambda spark, d: ev.subsequence(grid.hourly_events(spark, d), 0.2, 5, 6).select("feature", "ord", "hidden", "gap"),
    f"""WITH {RAW}, m AS (SELECT feature, ord, x IS NOT NULL AND {DRAW.format('feature, ord // 6, 5')} < 200 AS hidden FROM g0), i AS (SELECT feature, ord, ord - row_number() OVER (PARTITION BY feature ORDER BY ord) AS i FROM m WHERE hidden),
n AS (SELECT feature, ord, count(*) OVER (PARTITION BY feature, i) AS gap FROM i) SELECT m.feature, m.ord, hidden, coalesce(gap, 0) AS gap FROM m LEFT JOIN n USING (feature, ord)""",
)
_add(
    "mask_long_gap", lambda spark, d: ev.long_gap(grid.hourly_events(spark, d), 0.2, 5).groupBy("feature").agg(F.sum(F.col("hidden").cast("long")).alias("n"), F.min(F.when(F.col("hidden"), F.col("ord"))).alias("first")),
    f"""WITH {RAW}, bb AS (SELECT *, min(ord) OVER w AS lo, max(ord) OVER w - min(ord) OVER w + 1 AS steps FROM g0 WINDOW w AS (PARTITION BY feature)), s AS (SELECT *, greatest(1, floor(steps * 0.2::DOUBLE)) AS size FROM bb),
m AS (SELECT *, lo + 1 + floor({DRAW.format('feature, 5')} * greatest(1, steps - size - 1) / 1000) AS a FROM s) SELECT feature, CAST(sum((x IS NOT NULL AND ord >= a AND ord < a + size)::INT) AS BIGINT) AS n, min(CASE WHEN x IS NOT NULL AND ord >= a AND ord < a + size THEN ord END) AS first FROM m GROUP BY ALL""",
)

# Calibration and scores.
ERF = "(CASE WHEN abs({0}) > 6 THEN sign({0}) WHEN {0} = 0 THEN 0.0 ELSE sign({0}) * exp(-({0}) * ({0})) * list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(abs({0})) - lgamma(k + 1.5)))) END)"


def _forecast(spark: SparkSession, d: str) -> DataFrame:
    """The last observation with the deviation of all as its sigma, on hidden cells."""
    filled = im.locf(ev.masked(grid.hourly_events(spark, d), "mcar", 0.15, 3))
    return filled.withColumn("sigma", F.stddev_pop("x").over(Window.partitionBy("feature"))).where("hidden")


FORECAST = HIDE.split(", e AS (")[0] + f", s AS (SELECT *, coalesce(held, 0) AS fill, stddev_pop(x) OVER {ALL} AS sigma FROM f), hh AS (SELECT feature, ord, truth, fill, sigma, (truth - fill) / sigma / sqrt(2) AS q, (truth - fill) / sigma AS z FROM s WHERE hidden)"
_add(
    "interval_scores", lambda spark, d: _rounded(ev.interval_scores(es.interval(_forecast(spark, d)), ("feature",)), "feature", "coverage", "sharpness"),
    FORECAST + " SELECT feature, round(avg((truth BETWEEN fill - 1.96 * sigma AND fill + 1.96 * sigma)::INT), 6) AS coverage, round(avg(2 * 1.96::DOUBLE * sigma), 6) AS sharpness FROM hh GROUP BY ALL",
)
_add(
    "gaussian_crps", lambda spark, d: _rounded(_forecast(spark, d).groupBy("feature").agg(F.avg(sc.gaussian_crps("truth", "fill", "sigma")).alias("crps")), "feature", "crps"),
    FORECAST + f" SELECT feature, round(avg(sigma * (z * {ERF.format('q')} + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 6) AS crps FROM hh GROUP BY ALL",
)
_add(
    "pit", lambda spark, d: _rounded(_forecast(spark, d).withColumn("pit", sc.pit("truth", "fill", "sigma")), "feature", "ord", "pit"),
    FORECAST + f" SELECT feature, ord, round((1 + {ERF.format('q')}) / 2, 6) AS pit FROM hh",
)
_add(
    "reliability", lambda spark, d: _rounded(sc.reliability(_forecast(spark, d).withColumn("pit", sc.pit("truth", "fill", "sigma")), "pit"), "bin", "n", "share"),
    FORECAST + f", pp AS (SELECT least(9, greatest(0, floor((1 + {ERF.format('q')}) / 2 * 10)))::INT AS bin, count(*) AS n FROM hh GROUP BY 1) SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS share FROM pp",
)
_add(
    "normal_quantiles", lambda spark, d: spark.createDataFrame([(p, round(ev.normal_quantile(p), 4)) for p in (0.75, 0.9, 0.95, 0.975, 0.99, 0.995)], "p double, z double"),
    "SELECT * FROM (VALUES (0.75::DOUBLE, 0.6745::DOUBLE), (0.9, 1.2816), (0.95, 1.6449), (0.975, 1.96), (0.99, 2.3263), (0.995, 2.5758)) AS t(p, z)",
)
SCORED = HIDE + ", a AS (SELECT feature, ord, err AS score, count(*) OVER (PARTITION BY feature) AS n, row_number() OVER (PARTITION BY feature ORDER BY err) AS r FROM e)"
_add(
    "static_multipliers", lambda spark, d: _rounded(ap.static_multipliers(_errors(spark, d).withColumnRenamed("err", "score"), by=("feature",)), "feature", "level", "n", "multiplier"),
    SCORED + """, l AS (SELECT unnest([0.5::DOUBLE, 0.8, 0.9, 0.95]) AS level, unnest([0.674489750196082::DOUBLE, 1.28155156554460, 1.64485362695147, 1.95996398454005]) AS z),
kk AS (SELECT DISTINCT feature, n FROM a) SELECT kk.feature, level, kk.n, round(CASE WHEN kk.n < 30 THEN z ELSE a.score END, 6) AS multiplier FROM kk CROSS JOIN l LEFT JOIN a ON a.feature = kk.feature AND a.r = least(kk.n, ceil(level * (kk.n + 1))::BIGINT)""",
)
_add(
    "trailing_grid", lambda spark, d: _rounded(au.trailing_grid(grid.hourly_events(spark, d).select("ord").distinct(), _errors(spark, d).withColumnRenamed("err", "score"), 0.9), "ord", "multiplier"),
    HIDE + """, t AS (SELECT DISTINCT ord FROM g), w AS (SELECT t.ord, list(err ORDER BY err) FILTER (err IS NOT NULL) AS l FROM t LEFT JOIN e ON e.ord < t.ord GROUP BY t.ord)
SELECT ord, round(CASE WHEN coalesce(len(l), 0) < 30 THEN 1.64485362695147::DOUBLE ELSE l[least(len(l), ceil(0.9::DOUBLE * (len(l) + 1))::BIGINT)] END, 6) AS multiplier FROM w""",
)
_add(
    "flat_band", lambda spark, d: _rounded(ap.flat_band(_errors(spark, d)), "feature", "q", "coverage", "n"),
    HIDE + """, bb AS (SELECT *, ord < 0.5::DOUBLE * max(ord) OVER (PARTITION BY feature) AS early FROM e), r AS (SELECT feature, err, row_number() OVER (PARTITION BY feature ORDER BY err) AS r, count(*) OVER (PARTITION BY feature) AS n FROM bb WHERE early),
q AS (SELECT feature, err AS q FROM r WHERE r = least(n, ceil(0.9::DOUBLE * (n + 1))::BIGINT)) SELECT feature, round(q, 6) AS q, round(avg((err <= q)::INT), 6) AS coverage, count(*) AS n FROM bb JOIN q USING (feature) WHERE NOT early GROUP BY feature, q""",
)


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d).withColumn("score", F.round(F.exp(-F.col("gap") / 8.0), 6))


GRADED = HIDE + ", s AS (SELECT err, round(exp(-gap / 8.0::DOUBLE), 6) AS score FROM e), a AS (SELECT score, count(*) AS n, sum(err) AS t FROM s GROUP BY score)"
_add(
    "calibration_bins", lambda spark, d: _rounded(sc.calibration_bins(_graded(spark, d), "score", "err", 4), "bin", "n", "mean_score", "mean_error"),
    GRADED + ", bb AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS before, sum(n) OVER () AS total FROM a) SELECT floor(before * 4 / total)::INT AS bin, CAST(sum(n) AS BIGINT) AS n, round(sum(score * n) / sum(n), 6) AS mean_score, round(sum(t) / sum(n), 6) AS mean_error FROM bb GROUP BY 1",
)
_add(
    "risk_coverage", lambda spark, d: _rounded(sc.risk_coverage(_graded(spark, d), "score", "err"), "coverage", "kept", "risk"),
    GRADED + ", bb AS (SELECT *, sum(n) OVER (ORDER BY score DESC) - n AS before, sum(n) OVER () AS total FROM a), c AS (SELECT unnest([0.2::DOUBLE, 0.4, 0.6, 0.8, 1.0]) AS coverage) SELECT coverage, CAST(sum(n) AS BIGINT) AS kept, round(sum(t) / sum(n), 6) AS risk FROM bb JOIN c ON before < coverage * total GROUP BY coverage",
)
_add("random_coverage", lambda spark, d: _rounded(sc.random_coverage(_errors(spark, d), "err"), "coverage", "risk"))
_add(
    "median_memory", lambda spark, d: _rounded(sc.median_memory(grid.hourly_events(spark, d)), "memory", "n"),
    f"WITH {G}, q AS (SELECT feature, x, lag(x) OVER (PARTITION BY feature ORDER BY ord) AS p FROM g), m AS (SELECT feature, corr(x, p) AS m FROM q WHERE x IS NOT NULL AND p IS NOT NULL GROUP BY ALL) SELECT round(median(m), 6) AS memory, count(m) AS n FROM m",
)

# Audit.
ENDS = "WITH"
_add(
    "keep_observed", lambda spark, d: _rounded(au.keep_observed(grid.hourly_events(spark, d).withColumn("fill", F.when(F.col("ord") % 3 == 0, F.lit(float("nan"))).when(F.col("ord") % 3 == 1, F.lit(7.0)))), "feature", "ord", "fill"),
    f"WITH {G} SELECT feature, ord, round(coalesce(x, CASE WHEN ord % 3 = 1 THEN 7.0 END, avg(x) OVER {ALL}, 0), 6) AS fill FROM g",
)
_add(
    "visible_standardised", lambda spark, d: _rounded(au.visible_standardised(ev.masked(grid.hourly_events(spark, d), "mcar", 0.15, 3)), "feature", "ord", "z"),
    HIDE + f" SELECT feature, ord, round((truth - coalesce(avg(x) OVER {ALL}, 0)) / (CASE WHEN count(x) OVER {ALL} >= 2 THEN stddev_pop(x) OVER {ALL} ELSE 1 END + 1e-9), 6) AS z FROM f",
)
_add(
    "causal_variant", lambda spark, d: _rounded(au.causal_variant(grid.hourly_events(spark, d), "global_mean"), "feature", "ord", "fill"),
    f"WITH {G} SELECT feature, ord, round(coalesce(x, avg(x) OVER {LAST24}, 0), 6) AS fill FROM g",
)
_add(
    "both_ways", lambda spark, d: _rounded(au.both_ways(grid.hourly_events(spark, d), "global_mean"), "feature", "ord", "fill_bidirectional", "fill_causal"),
    f"WITH {G} SELECT feature, ord, round(coalesce(x, avg(x) OVER (PARTITION BY feature, ord // 24), 0), 6) AS fill_bidirectional, round(coalesce(x, avg(x) OVER {LAST24}, 0), 6) AS fill_causal FROM g",
)
_add(
    "probes", lambda spark, d: _rounded(au.probes(grid.hourly_events(spark, d), lambda c: im.global_mean(c)), "tau", "cells", "drift", "holds"),
    f"""WITH {G}, bb AS (SELECT min(ord) AS lo, max(ord) AS hi FROM g), t AS (SELECT DISTINCT ord FROM g, bb WHERE ord >= lo + (hi - lo + 1) // 5 AND ord < hi), pp AS (SELECT ord AS tau FROM t ORDER BY md5(concat_ws('|', ord, 0)), ord LIMIT 4),
v AS (SELECT feature, ord, x, avg(x) OVER {ALL} AS whole, avg(x) OVER {UP} AS part FROM g), d AS (SELECT ord, abs(coalesce(part, 0) - coalesce(whole, 0)) AS d, coalesce(whole, 0) AS whole FROM v JOIN pp ON tau = ord WHERE x IS NULL)
SELECT ord AS tau, count(*) AS cells, round(max(d), 6) AS drift, bool_and(d <= 1e-6 + 1e-5 * abs(whole)) AS holds FROM d GROUP BY ord""",
)
_add(
    "revisions", lambda spark, d: _rounded(au.revisions(grid.hourly_events(spark, d), lambda c: im.global_mean(c), 20, 200), "prefix", "cells", "mean_revision", "max_revision"),
    f"""WITH {G}, n AS (SELECT max(ord) + 1 AS n FROM g), pp AS (SELECT DISTINCT floor(220 + (n - 220) * i / 5.0)::BIGINT AS prefix FROM n, range(0, 6) AS r(i)), a AS (SELECT prefix, feature, avg(x) AS m FROM pp JOIN g ON ord < prefix GROUP BY ALL),
c AS (SELECT feature, ord FROM g WHERE x IS NULL AND ord BETWEEN 20 AND 200), v AS (SELECT prefix, feature, ord, coalesce(m, 0) - first_value(coalesce(m, 0)) OVER (PARTITION BY feature, ord ORDER BY prefix) AS r FROM c JOIN a USING (feature))
SELECT prefix, count(*) AS cells, round(avg(abs(r)), 6) AS mean_revision, round(max(abs(r)), 6) AS max_revision FROM v GROUP BY prefix""",
)

# Statistics and applications.
METHODS = ("zero", "locf", "mean_past", "rolling_mean", "rolling_median", "xsec_mean")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """(dataset, method, seed, mae, seconds): each feature a data set, three masks."""
    rows = []
    for seed in (1, 2, 3):
        cells = ev.masked(grid.hourly_events(spark, d), "mcar", 0.15, seed)
        rows += [ev.scores(im.impute(cells, m), ("feature",)).select(F.col("feature").alias("dataset"), F.lit(m).alias("method"), F.lit(seed).alias("seed"), "mae", F.lit(float(1 + k)).alias("seconds")) for k, m in enumerate(("locf", "mean_past"))]
    return reduce(DataFrame.unionByName, rows)


def _results_sql() -> str:
    each = []
    for seed in (1, 2, 3):
        base = f"SELECT feature, ord, x AS truth, x IS NOT NULL AND {DRAW.format(f'feature, ord, {seed}')} < 150 AS hidden FROM g0"
        fills = f"SELECT *, coalesce({LOCF}, 0) AS locf, coalesce(avg(x) OVER {UP}, 0) AS mean_past FROM (SELECT *, CASE WHEN NOT hidden THEN truth END AS x FROM ({base}))"
        each += [f"SELECT feature AS dataset, '{m}' AS method, {seed} AS seed, avg(abs({m} - truth)) AS mae, {k + 1}::DOUBLE AS seconds FROM ({fills}) WHERE hidden GROUP BY ALL" for k, m in enumerate(("locf", "mean_past"))]
    return f"WITH {RAW}, r AS ({' UNION ALL '.join(each)})"


RESULTS = _results_sql()
AVERAGED = ", a AS (SELECT dataset, method, count(mae) AS n, CAST(sum((mae IS NULL)::INT) AS BIGINT) AS n_failed, avg(mae) AS mae FROM r GROUP BY ALL), pp AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY mae)::INT AS place FROM a)"
_add("seeds", lambda spark, d: _rounded(_results(spark, d), "dataset", "method", "seed", "mae"), RESULTS + " SELECT dataset, method, seed, round(mae, 6) AS mae FROM r")
_add("averaged", lambda spark, d: _rounded(st.averaged(_results(spark, d)), "dataset", "method", "n", "n_failed", "mae", "place"), RESULTS + AVERAGED + " SELECT dataset, method, n, n_failed, round(mae, 6) AS mae, place FROM pp")
_add("leaderboard", lambda spark, d: _rounded(st.leaderboard(_results(spark, d)), "method", "mean_place", "wins", "n_datasets"), RESULTS + AVERAGED + " SELECT method, round(avg(place), 6) AS mean_place, CAST(sum((place = 1)::INT) AS BIGINT) AS wins, count(*) AS n_datasets FROM pp GROUP BY method")
_add(
    "accepted", lambda spark, d: _rounded(st.accepted(_results(spark, d).groupBy("dataset", "method").agg(F.avg("mae").alias("mae"), F.max("seconds").alias("seconds")), "mean_past", "locf"), "mae_champion", "mae_challenger", "largest_loss", "cost", "gain", "accepted"),
    RESULTS + """, a AS (SELECT dataset, avg(mae) FILTER (method = 'mean_past') AS a, avg(mae) FILTER (method = 'locf') AS b, max(seconds) FILTER (method = 'mean_past') AS s, max(seconds) FILTER (method = 'locf') AS u FROM r GROUP BY dataset),
t AS (SELECT avg(a) AS mae_champion, avg(b) AS mae_challenger, max(b - a) AS largest_loss, (sum(u) - sum(s)) / greatest(sum(s), 1e-9) AS cost, avg(a) - avg(b) AS gain FROM a)
SELECT round(mae_champion, 6) AS mae_champion, round(mae_challenger, 6) AS mae_challenger, round(largest_loss, 6) AS largest_loss, round(cost, 6) AS cost, round(gain, 6) AS gain,
largest_loss <= 0.02 AND ((gain >= -1e-9 AND cost < -1e-6) OR (gain > 1e-6 AND cost <= 0.1 AND gain / greatest(abs(mae_champion), 1e-9) >= cost)) AS accepted FROM t""",
)
_add("compared", lambda spark, d: _rounded(st.compared(_results(spark, d), "mean_past", "locf"), "method", "against", "n", "mean_diff", "low", "high", "t_p", "wilcoxon_p"))
_add(
    "variance_scores", lambda spark, d: _rounded(st.variance_scores(ap.ewma_variance(grid.hourly_events(spark, d)).withColumn("p", F.col("x") * F.col("x")), "variance", "p", ("feature",)), "feature", "qlike", "mse", "n"),
    f"""WITH {G}, c AS (SELECT *, count(x) OVER {UP} AS i FROM g), w AS (SELECT *, sum(x * x * pow(0.94::DOUBLE, -i)) OVER b / nullif(sum(CASE WHEN x IS NOT NULL THEN pow(0.94::DOUBLE, -i) END) OVER b, 0) AS h FROM c WINDOW b AS (PARTITION BY feature ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT feature, round(avg(ln(greatest(h, 1e-12)) + x * x / greatest(h, 1e-12)), 6) AS qlike, round(avg((h - x * x) ** 2), 6) AS mse, count(*) AS n FROM w WHERE h IS NOT NULL AND x IS NOT NULL GROUP BY feature""",
)
_add(
    "value_at_risk", lambda spark, d: _rounded(st.value_at_risk(ap.robust_variance(grid.hourly_events(spark, d)).withColumn("r", F.col("x") - F.avg("x").over(Window.partitionBy("feature"))), "r", "variance", ("feature",), 0.05), "feature", "n", "n_under", "rate", "ratio", "p_value"),
    f"""WITH {G}, l AS (SELECT feature, ord, x, list(abs(x)) FILTER (x IS NOT NULL) OVER (PARTITION BY feature ORDER BY ord ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS l, x - avg(x) OVER {ALL} AS r FROM g),
v AS (SELECT feature, r, pow(1.4826::DOUBLE * list_median(l), 2) AS h FROM l), u AS (SELECT feature, count(*) AS n, CAST(sum((r < -1.64485362695147::DOUBLE * sqrt(greatest(h, 1e-12)))::INT) AS BIGINT) AS k FROM v WHERE r IS NOT NULL AND h IS NOT NULL GROUP BY feature),
q AS (SELECT *, k / n AS rate, CASE WHEN k > 0 AND k < n THEN -2 * ((n - k) * ln(1 - 0.05::DOUBLE) + k * ln(0.05::DOUBLE) - (n - k) * ln(1 - k / n) - k * ln(k / n)) END AS ratio FROM u)
SELECT feature, n, k AS n_under, round(rate, 6) AS rate, round(ratio, 6) AS ratio, CASE WHEN ratio IS NOT NULL THEN round(1 - {ERF.format('sqrt(greatest(ratio, 0) / 2)')}, 6) END AS p_value FROM q""",
)
_add(
    "gap_theory", lambda spark, d: _rounded(st.gap_theory(spark.range(1, 10).select((F.col("id") / 10).alias("a")).join(spark.range(1, 13).select(F.col("id").alias("g")))), "a", "g", "mae_filter", "mae_smoother", "difference"),
    """WITH p AS (SELECT i / 10.0::DOUBLE AS a, g FROM range(1, 10) AS r(i), range(1, 13) AS s(g)), k AS (SELECT a, g, unnest(range(1, g + 1)) AS k FROM p), v AS (SELECT a, g, 1 - pow(a, 2 * k) AS f, (1 - pow(a, 2 * k)) * (1 - pow(a, 2 * (g + 1 - k))) / (1 - pow(a, 2 * (g + 1))) AS s FROM k),
m AS (SELECT a, g, sqrt(2 / pi()) * avg(sqrt(f)) AS f, sqrt(2 / pi()) * avg(sqrt(s)) AS s FROM v GROUP BY ALL) SELECT round(a, 6) AS a, g, round(f, 6) AS mae_filter, round(s, 6) AS mae_smoother, round(f - s, 6) AS difference FROM m""",
)
_add("explained", lambda spark, d: _rounded(st.explained(grid.embedding_cells(spark, d)), "component", "share", "cumulative"))
_add("r_squared", lambda spark, d: _rounded(st.r_squared(im.locf(grid.hourly_events(spark, d)).withColumn("x", F.col("fill")), "click"), "target", "r2", "n"))
_add(
    "race", lambda spark, d: _rounded(ap.race(grid.hourly_events(spark, d), ["locf", "global_mean"]), "method", "mae_full", "mae_causal"),
    f"""WITH {RAW}, m AS (SELECT feature, ord, x AS truth, x IS NOT NULL AND ord >= floor((max(ord) OVER {ALL} + 1) * 0.6::DOUBLE) AND {DRAW.format('feature, ord, 0')} < 200 AS hidden FROM g0), g AS (SELECT *, CASE WHEN NOT hidden THEN truth END AS x FROM m),
f AS (SELECT *, coalesce({LOCF}, 0) AS a, coalesce(last_value(x IGNORE NULLS) OVER {LAST24}, 0) AS b, coalesce(avg(x) OVER {ALL}, 0) AS c, coalesce(avg(x) OVER {LAST24}, 0) AS e FROM g)
SELECT 'locf' AS method, round(avg(abs(a - truth)), 6) AS mae_full, round(avg(abs(b - truth)), 6) AS mae_causal FROM f WHERE hidden UNION ALL SELECT 'global_mean', round(avg(abs(c - truth)), 6), round(avg(abs(e - truth)), 6) FROM f WHERE hidden""",
)
_add(
    "growth", lambda spark, d: _rounded(ap.growth(grid.hourly_events(spark, d)), "feature", "ord", "x"),
    f"WITH {G}, pp AS (SELECT feature, ord, CASE WHEN x > 0 THEN ln(x) END AS l FROM g) SELECT feature, ord, round(100 * (l - lag(l) OVER (PARTITION BY feature ORDER BY ord)), 6) AS x FROM pp",
)
AR = f"""o AS (SELECT feature, ord, x, lag(x) OVER (PARTITION BY feature ORDER BY ord) AS p FROM g WHERE x IS NOT NULL),
a AS (SELECT *, regr_slope(x, p) OVER w AS s, regr_intercept(x, p) OVER w AS i, count(p) OVER w AS n FROM o WINDOW w AS (PARTITION BY feature ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT feature, ord, x AS truth, p AS persistence, CASE WHEN n >= 10 THEN i + s * p ELSE p END AS ar1 FROM a WHERE p IS NOT NULL)"""
_add(
    "one_step", lambda spark, d: _rounded(ap.one_step(grid.hourly_events(spark, d)), "feature", "ord", "model", "truth", "fill"),
    f"WITH {G}, {AR} SELECT feature, ord, 'persistence' AS model, round(truth, 6) AS truth, round(persistence, 6) AS fill FROM q UNION ALL SELECT feature, ord, 'ar1', round(truth, 6), round(ar1, 6) FROM q",
)
_add(
    "by_horizon", lambda spark, d: _rounded(ap.by_horizon(ap.one_step(grid.hourly_events(spark, d)), F.col("ord").between(200, 400)), "sample", "model", "horizon", "n", "rmse", "skill"),
    f"""WITH {G}, {AR}, u AS (SELECT ord, 'persistence' AS model, truth, persistence AS fill FROM q UNION ALL SELECT ord, 'ar1', truth, ar1 FROM q), s AS (SELECT 'all' AS sample, * FROM u UNION ALL SELECT 'without', * FROM u WHERE ord NOT BETWEEN 200 AND 400),
r AS (SELECT sample, model, count(*) AS n, sqrt(avg((fill - truth) ** 2)) AS rmse FROM s GROUP BY ALL) SELECT sample, model, 1 AS horizon, n, round(rmse, 6) AS rmse, round(1 - rmse / max(rmse) FILTER (model = 'persistence') OVER (PARTITION BY sample), 6) AS skill FROM r""",
)
_add(
    "sharpening", lambda spark, d: _rounded(ap.sharpening(grid.hourly_events(spark, d), "click", 6), "age", "mae", "n"),
    f"""WITH {RAW}, g AS (SELECT feature, ord, x AS truth, CASE WHEN ord % 6 = 5 THEN x END AS x FROM g0 WHERE feature = 'click'), f AS (SELECT *, coalesce({LOCF}, 0) AS fill FROM g)
SELECT ord % 6 + 1 AS age, round(avg(abs(fill - truth)), 6) AS mae, count(*) AS n FROM f WHERE x IS NULL AND truth IS NOT NULL GROUP BY 1""",
)
_add("nowcast", lambda spark, d: _rounded(ap.nowcast(grid.hourly_events(spark, d), "click"), "ord", "model", "truth", "fill"))
_add("backtest", lambda spark, d: _rounded(ap.reported_and_live(ev.masked(grid.hourly_events(spark, d), "mcar", 0.2, 1), "linear_interp", "click"), "kind", "target", "n", "r2", "sharpe"))
_add("contemporaneous", lambda spark, d: _rounded(ap.contemporaneous(grid.hourly_events(spark, d), "click"), "ord", "y", "fill"))
_add("picked_target", lambda spark, d: spark.createDataFrame([(ap.picked_target(grid.hourly_events(spark, d)),)], "target string"))
_add("garch_variance", lambda spark, d: _rounded(ap.garch_variance(grid.hourly_events(spark, d)), "feature", "ord", "variance"))
_add("covariance_backtest", lambda spark, d: _rounded(ap.covariance_backtest(grid.embedding_cells(spark, d).where("feature < 10"), window=150), "model", "n", "volatility", "nll"))


def _benchmark_all(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ap.benchmark(grid.hourly_events(spark, d), [*METHODS]), "method", "causal", "mae", "rmse", "n", "place")


_add(
    "benchmark_windows", _benchmark_all,
    HIDE.split(", e AS (")[0].replace(f"{LOCF} AS held", f"{LOCF} AS held, avg(x) OVER {LAST24} AS rm, quantile_cont(x, 0.5) OVER {LAST24} AS rq, avg(x) OVER (PARTITION BY ord) AS xs")
    + """, l AS (SELECT truth, unnest([struct_pack(method := 'zero', v := 0.0::DOUBLE), struct_pack(method := 'locf', v := coalesce(held, 0)), struct_pack(method := 'mean_past', v := coalesce(mean, 0)), struct_pack(method := 'rolling_mean', v := coalesce(rm, 0)),
struct_pack(method := 'rolling_median', v := coalesce(rq, 0)), struct_pack(method := 'xsec_mean', v := coalesce(xs, held, 0))]) AS q FROM f WHERE hidden), t AS (SELECT q.method AS method, avg(abs(q.v - truth)) AS a, sqrt(avg((q.v - truth) ** 2)) AS b, count(*) AS n FROM l GROUP BY ALL)
SELECT method, true AS causal, round(a, 6) AS mae, round(b, 6) AS rmse, n, rank() OVER (ORDER BY a)::INT AS place FROM t""",
)
