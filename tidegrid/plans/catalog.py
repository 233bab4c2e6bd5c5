"""Named queries over the test tables, with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import scores as sc
from tidegrid.operators import audit as au
from tidegrid.operators import estimator as es
from tidegrid.operators import evaluate as ev
from tidegrid.operators import impute as im
from tidegrid.operators import matrix as mx
from tidegrid.sources import grid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

HOURLY = """p AS (SELECT event_type AS feature, date_trunc('hour', ts) AS step, avg(value) AS v FROM events GROUP BY ALL),
b AS (SELECT min(step) AS lo, max(step) AS hi FROM p), h AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS step, lo FROM b), k AS (SELECT DISTINCT feature FROM p),
g AS (SELECT k.feature, CAST(date_diff('hour', h.lo, h.step) AS BIGINT) AS ord, p.v AS x FROM h CROSS JOIN k LEFT JOIN p ON p.feature = k.feature AND p.step = h.step)"""
DAILY = """p AS (SELECT user_id AS entity, event_type AS feature, date_trunc('day', ts) AS step, avg(value) AS v FROM events GROUP BY ALL),
b AS (SELECT min(step) AS lo, max(step) AS hi FROM p), h AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS step, lo FROM b), k AS (SELECT DISTINCT entity, feature FROM p),
g AS (SELECT k.entity, k.feature, CAST(date_diff('day', h.lo, h.step) AS BIGINT) AS ord, p.v AS x FROM h CROSS JOIN k LEFT JOIN p ON p.entity = k.entity AND p.feature = k.feature AND p.step = h.step)"""
ALL = "(PARTITION BY feature)"
UP = "(PARTITION BY feature ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ON = "(PARTITION BY feature ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
LAST24 = "(PARTITION BY feature ORDER BY ord ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
LOCF = f"last_value(x IGNORE NULLS) OVER {UP}"


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _hourly(name: str, method, *choices: str, extra: str = "", source: str = "g") -> None:
    """An imputer on the hourly grid: feature, ord, fill."""
    sql = f"WITH {HOURLY}{extra} SELECT feature, ord, round(coalesce(x, {', '.join(choices)}), 6) AS fill FROM {source}" if choices else None
    _add(name, lambda spark, d: method(grid.hourly_events(spark, d)).select("feature", "ord", F.round("fill", 6).alias("fill")), sql)


_hourly("locf", im.locf, LOCF, "0.0")
_hourly("locf_mean_lead", lambda c: im.locf(c, lead="column_mean"), LOCF, f"avg(x) OVER {ALL}", "0.0")
_hourly("zero", im.zero, "0.0")
_hourly("nocb", im.nocb, f"first_value(x IGNORE NULLS) OVER {ON}", "0.0")
_hourly("nocb_locf_tail", lambda c: im.nocb(c, tail="last"), f"first_value(x IGNORE NULLS) OVER {ON}", LOCF, "0.0")
_hourly("forward_backward", im.forward_backward, LOCF, f"first_value(x IGNORE NULLS) OVER {ON}", "0.0")
_hourly("global_mean", im.global_mean, f"avg(x) OVER {ALL}", "0.0")
_hourly("mean_past", im.expanding_mean, f"avg(x) OVER {UP}", "0.0")
_hourly("mean_impute", lambda c: im.expanding_mean(c, fallback="column_mean"), f"avg(x) OVER {UP}", f"avg(x) OVER {ALL}", "0.0")
_hourly("rolling_mean", im.rolling_mean, f"avg(x) OVER {LAST24}", "0.0")
_hourly("rolling_mean_column_mean", lambda c: im.rolling_mean(c, fallback="column_mean"), f"avg(x) OVER {LAST24}", f"avg(x) OVER {ALL}", "0.0")
_hourly("rolling_median", im.rolling_median, f"quantile_cont(x, 0.5) OVER {LAST24}", "0.0")
_hourly("rolling_median_column_mean", lambda c: im.rolling_median(c, fallback="column_mean"), f"quantile_cont(x, 0.5) OVER {LAST24}", f"avg(x) OVER {ALL}", "0.0")
_hourly("seasonal_naive", im.seasonal_naive, "last_value(x IGNORE NULLS) OVER (PARTITION BY feature, ord % 24 ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", LOCF, f"avg(x) OVER {ALL}", "0.0")
_hourly("xsec_feature_mean", im.xsec_feature_mean, "avg(x) OVER (PARTITION BY ord)", LOCF, "0.0")
_hourly("two_way_mean", im.two_way_mean, f"avg(x) OVER {ALL} + avg(x) OVER (PARTITION BY ord) - avg(x) OVER ()", f"avg(x) OVER {ALL}", "0.0")
SEEN = f""", s AS (SELECT *, {LOCF} AS av, last_value(CASE WHEN x IS NOT NULL THEN ord END IGNORE NULLS) OVER {UP} AS at_, first_value(x IGNORE NULLS) OVER {ON} AS bv,
first_value(CASE WHEN x IS NOT NULL THEN ord END IGNORE NULLS) OVER {ON} AS bt FROM g)"""
_hourly("linear_interp", im.linear, "av + (bv - av) * (ord - at_) / nullif(bt - at_, 0)", "av", "bv", "0.0", extra=SEEN, source="s")
DRIFT = f""", o AS (SELECT feature, ord, (x - lag(x) OVER w) / (ord - lag(ord) OVER w) AS m FROM g WHERE x IS NOT NULL WINDOW w AS (PARTITION BY feature ORDER BY ord)),
j AS (SELECT g.*, o.m FROM g LEFT JOIN o USING (feature, ord)), s AS (SELECT feature, ord, x, {LOCF} AS v, last_value(CASE WHEN x IS NOT NULL THEN ord END IGNORE NULLS) OVER {UP} AS t,
last_value(CASE WHEN x IS NOT NULL THEN coalesce(m, 0) END IGNORE NULLS) OVER {UP} AS m FROM j)"""
_hourly("drift", im.drift, "v + m * (ord - t)", "0.0", extra=DRIFT, source="s")


def _recursive(name: str, method, state: str, start: str, step: str, fill: str) -> None:
    """A recurrence: state columns, their start, their step over (x, c.state), and the fill from the state before."""
    sql = f"""WITH RECURSIVE {HOURLY}, r AS (SELECT feature, CAST(-1 AS BIGINT) AS ord, CAST(NULL AS DOUBLE) AS x, {start}, CAST(0 AS DOUBLE) AS f FROM k
UNION ALL SELECT g.feature, g.ord, g.x, {step}, CAST({fill} AS DOUBLE) FROM r AS c JOIN g ON g.feature = c.feature AND g.ord = c.ord + 1)
SELECT feature, ord, round(coalesce(x, f), 6) AS fill FROM r WHERE ord >= 0"""
    _add(name, lambda spark, d: method(grid.hourly_events(spark, d)).select("feature", "ord", F.round("fill", 6).alias("fill")), sql)


D0, DN = "CAST(0 AS DOUBLE)", "CAST(NULL AS DOUBLE)"
LAM = repr(0.5 ** (1 / 5.0)) + "::DOUBLE"
_recursive("ewma", im.ewma, "num, den", f"{D0} AS num, {D0} AS den", f"CASE WHEN g.x IS NULL THEN c.num ELSE {LAM} * c.num + g.x END, CASE WHEN g.x IS NULL THEN c.den ELSE {LAM} * c.den + 1 END", "CASE WHEN c.den > 0 THEN c.num / c.den ELSE 0 END")
P5 = "(c.p + 0.05::DOUBLE)"
_recursive("kalman_local_level", im.kalman_level, "m, p, s", f"{D0} AS m, CAST(1 AS DOUBLE) AS p, {D0} AS s", f"CASE WHEN g.x IS NULL THEN c.m ELSE c.m + {P5} / ({P5} + 1) * (g.x - c.m) END, CASE WHEN g.x IS NULL THEN {P5} ELSE (1 - {P5} / ({P5} + 1)) * {P5} END, CASE WHEN g.x IS NULL THEN c.s ELSE {D0} + 1 END", "CASE WHEN c.s > 0 THEN c.m ELSE 0 END")
P1 = "(c.p + 0.01::DOUBLE)"
_recursive("kalman_filter", im.kalman_filter, "m, p", f"{DN} AS m, CAST(1 AS DOUBLE) AS p", f"CASE WHEN g.x IS NULL THEN c.m WHEN c.m IS NULL THEN g.x ELSE c.m + {P1} / ({P1} + 1) * (g.x - c.m) END, CASE WHEN g.x IS NULL THEN c.p WHEN c.m IS NULL THEN {D0} + 1 ELSE (1 - {P1} / ({P1} + 1)) * {P1} END", "coalesce(c.m, 0)")
NEW = "(CASE WHEN c.l IS NULL THEN g.x ELSE 0.4::DOUBLE * g.x + 0.6::DOUBLE * (c.l + c.b) END)"
_recursive("holt", im.holt, "l, b, a", f"{DN} AS l, {D0} AS b, {D0} AS a", f"CASE WHEN g.x IS NULL THEN c.l ELSE {NEW} END, CASE WHEN g.x IS NULL THEN c.b WHEN c.l IS NULL THEN {D0} ELSE 0.1::DOUBLE * ({NEW} - c.l) + 0.9::DOUBLE * c.b END, CASE WHEN g.x IS NULL THEN c.a + 1 ELSE {D0} END", "coalesce(c.l + least(c.a + 1, 10) * c.b, 0)")

_add(
    "missingness",
    lambda spark, d: ev.missingness(grid.hourly_events(spark, d)).select("feature", "ord", "was_imputed", "time_since_obs", "gap_length", F.round("missing_rate", 6).alias("missing_rate")),
    f"""WITH {HOURLY}, s AS (SELECT feature, ord, CAST(x IS NULL AS INT)::DOUBLE AS was_imputed, (ord - coalesce(max(CASE WHEN x IS NOT NULL THEN ord END) OVER {UP}, -1))::DOUBLE AS time_since_obs,
round(avg(CAST(x IS NULL AS INT)) OVER {UP}, 6) AS missing_rate FROM g) SELECT *, time_since_obs AS gap_length FROM s""",
)
_add(
    "gap_strata",
    lambda spark, d: ev.gap_lengths(grid.hourly_events(spark, d)).groupBy("feature", "gap").agg(F.count(F.lit(1)).alias("n_cells")),
    f"""WITH {HOURLY}, i AS (SELECT feature, ord - row_number() OVER (PARTITION BY feature ORDER BY ord) AS i FROM g WHERE x IS NULL), c AS (SELECT feature, i, count(*) AS gap FROM i GROUP BY ALL)
SELECT feature, gap, CAST(sum(gap) AS BIGINT) AS n_cells FROM c GROUP BY ALL""",
)
PANEL = "entity, feature, ord, round(coalesce(x, {}), 6) AS fill FROM {}"
PUP = "(PARTITION BY entity, feature ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _panel(name: str, method, choices: str, extra: str = "", source: str = "g") -> None:
    _add(name, lambda spark, d: method(grid.daily_users(spark, d)).select("entity", "feature", "ord", F.round("fill", 6).alias("fill")), f"WITH {DAILY}{extra} SELECT " + PANEL.format(choices, source))


_panel("xsec_entity_mean", im.xsec_entity_mean, f"avg(x) OVER (PARTITION BY feature, ord), last_value(x IGNORE NULLS) OVER {PUP}, 0.0")
_panel(
    "panel_locf", im.panel_locf, "v, mu, 0.0",
    f""", t AS (SELECT feature, ord, sum(x) AS s, count(x) AS n FROM g GROUP BY ALL), e AS (SELECT feature, ord, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS mu FROM t
WINDOW w AS (PARTITION BY feature ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), q AS (SELECT g.*, e.mu, last_value(x IGNORE NULLS) OVER {PUP} AS v FROM g JOIN e USING (feature, ord))""", "q",
)
_panel("panel_mean_past", lambda c: im.expanding_mean(c, ("entity", "feature")), f"avg(x) OVER {PUP}, 0.0")

DRAW = "('0x' || substr(md5(concat_ws('|', {})), 1, 8))::BIGINT % 1000"
PARTS = {"mcar": "feature, ord, 7", "mnar": "feature, ord, 7", "block": "feature, ord // 10, 7", "blackout": "ord // 10, 7"}
METRICS = """round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(sum(abs(e)) / sum(abs(truth)), 6) AS mre, round(avg(e), 6) AS bias, round(corr(fill, truth), 6) AS corr, count(*) AS n, CAST(0 AS BIGINT) AS n_bad"""


def _cells_sql(mechanism: str) -> str:
    cut = "100" if mechanism != "mnar" else "least(1000.0, 200.0 / (1 + exp(-(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0))))"
    return f"""c AS (SELECT vec_id AS ord, CAST(i AS BIGINT) - 1 AS feature, CAST(VEC[i] AS DOUBLE) AS v FROM (SELECT vec_id, VEC, unnest(range(1, len(VEC) + 1)) AS i FROM embeddings)),
m AS (SELECT feature, ord, v AS truth, {DRAW.format(PARTS[mechanism])} < {cut} AS hidden FROM c WINDOW w AS (PARTITION BY feature)), g AS (SELECT *, CASE WHEN NOT hidden THEN truth END AS x FROM m)"""


def _masked(mechanism: str, method: str, choices: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = ev.scores(im.impute(ev.masked(grid.embedding_cells(spark, d), mechanism, 0.1, 7), method))
        return out.select(*[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mre", "bias", "corr")], "n", "n_bad")

    _add(f"mask_{mechanism}_{method}", query, f"WITH {_cells_sql(mechanism)}, f AS (SELECT *, coalesce(x, {choices}) AS fill FROM g), e AS (SELECT *, fill - truth AS e FROM f WHERE hidden) SELECT {METRICS} FROM e".replace("VEC", "embedding"))


for _m in PARTS:
    _masked(_m, "locf", f"{LOCF}, 0.0")
    _masked(_m, "mean_past", f"avg(x) OVER {UP}, 0.0")
_masked("mcar", "global_mean", f"avg(x) OVER {ALL}, 0.0")

_add(
    "train_standardised",
    lambda spark, d: ev.train_standardised(grid.hourly_events(spark, d)).select("feature", "ord", F.round("z", 6).alias("z")),
    f"""WITH {HOURLY}, e AS (SELECT *, CASE WHEN ord < 0.6::DOUBLE * max(ord) OVER {ALL} THEN x END AS t FROM g)
SELECT feature, ord, round((x - avg(t) OVER {ALL}) / nullif(stddev_pop(t) OVER {ALL}, 0), 6) AS z FROM e""",
)


def _conformal(spark: SparkSession, d: str) -> DataFrame:
    filled = im.locf(ev.masked(grid.hourly_events(spark, d), "mcar", 0.15, 3)).where("hidden")
    return ev.conformal_quantile(filled.withColumn("score", F.abs(F.col("fill") - F.col("truth"))), 0.9, ("feature",)).select("feature", F.round("q", 6).alias("q"))


_add(
    "conformal_quantile", _conformal,
    f"""WITH {HOURLY.replace('g AS (', 'g0 AS (')}, m AS (SELECT feature, ord, x AS truth, x IS NOT NULL AND {DRAW.format('feature, ord, 3')} < 150 AS hidden FROM g0), g AS (SELECT *, CASE WHEN NOT hidden THEN truth END AS x FROM m),
f AS (SELECT *, coalesce(x, {LOCF}, 0.0) AS fill FROM g), s AS (SELECT feature, abs(fill - truth) AS s FROM f WHERE hidden),
r AS (SELECT feature, s, row_number() OVER (PARTITION BY feature ORDER BY s) AS r, count(*) OVER (PARTITION BY feature) AS n FROM s)
SELECT feature, round(s, 6) AS q FROM r WHERE r = least(n, CAST(ceil(0.9::DOUBLE * (n + 1)) AS BIGINT))""",
)


def _certificate(name: str) -> Query:
    return lambda spark, d: ev.causality_certificate(grid.hourly_events(spark, d), im.METHODS[name][0]).select("prefix", "cells", (F.col("max_revision") <= 1e-6).alias("holds"))


def _certificate_sql(fill: str, seen: str = "") -> str:
    """Fills of six growing prefixes, each computed by itself, against those of the whole. seen: a CTE s over g that the fill needs."""
    by_prefix = lambda t: t.replace("PARTITION BY feature", "PARTITION BY prefix, feature")
    return f"""WITH {HOURLY}{seen}, ends AS (SELECT max(ord) AS top FROM g), prefixes AS (SELECT DISTINCT round(top // 3 + (top - 1 - top // 3) * i / 5.0::DOUBLE)::BIGINT AS prefix FROM ends, range(0, 6) AS r(i)),
gp AS (SELECT prefix, g.* FROM prefixes JOIN g ON ord <= prefix){by_prefix(seen).replace(", s AS", ", sp AS").replace("FROM g", "FROM gp")}, whole AS (SELECT feature, ord, coalesce(x, {fill}, 0) AS a FROM {"s" if seen else "g"}),
part AS (SELECT prefix, feature, ord, coalesce(x, {by_prefix(fill)}, 0) AS b FROM {"sp" if seen else "gp"}) SELECT prefix, count(*) AS cells, max(abs(a - b)) <= 1e-6 AS holds FROM part JOIN whole USING (feature, ord) GROUP BY prefix"""


_add("audit_locf", _certificate("locf"), _certificate_sql(LOCF))
_add("audit_mean_past", _certificate("mean_past"), _certificate_sql(f"avg(x) OVER {UP}"))
_add("audit_linear_interp", _certificate("linear_interp"), _certificate_sql("av + (bv - av) * (ord - at_) / nullif(bt - at_, 0), av, bv", SEEN))
_add("audit_nocb", _certificate("nocb"), _certificate_sql(f"first_value(x IGNORE NULLS) OVER {ON}"))
_add("audit_holt", _certificate("holt"))
_add(
    "trailing_windows",
    lambda spark, d: ev.trailing_windows(grid.hourly_events(spark, d), 24).groupBy("feature", "win_id").agg(F.count("x").alias("n_seen"), F.round(F.avg("x"), 6).alias("mean_x")),
    f"WITH {HOURLY} SELECT feature, ord AS win_id, count(x) OVER {LAST24} AS n_seen, round(avg(x) OVER {LAST24}, 6) AS mean_x FROM g",
)

PANEL_KEYS = ("entity",)
_add("estimator", lambda spark, d: es.traced(grid.hourly_events(spark, d)).select("feature", "ord", F.round("fill", 6).alias("fill"), F.round("sigma", 6).alias("sigma"), *[F.round(p, 6).alias(p) for p in (*es.PARTS, "residual")]))
_add("estimator_per_entity", lambda spark, d: es.traced(grid.daily_users(spark, d), PANEL_KEYS).select("entity", "feature", "ord", F.round("fill", 6).alias("fill")))
_add("estimator_trust", lambda spark, d: es.selective(es.certificate(es.traced(grid.hourly_events(spark, d)))).select("feature", "ord", F.round("fill", 6).alias("fill"), F.round("trust", 6).alias("trust")))
_add("estimator_steps", lambda spark, d: es.steps(grid.hourly_events(spark, d)).select("ord", "effective_rank", *[F.round(c, 6).alias(c) for c in ("row_weight", "anomaly", "nu", "ar")]))
_add("estimator_network", lambda spark, d: es.network(grid.hourly_events(spark, d)).select("i", "j", F.round("corr", 6).alias("corr")))
_add("estimator_forecast", lambda spark, d: es.forecast(grid.hourly_events(spark, d), 24).select("feature", "ord", F.round("fill", 6).alias("fill")))
_add("audit_estimator", _certificate("estimator"))
for _m in mx.NAMES:
    _add(f"matrix_{_m}", lambda spark, d, m=_m: im.impute(grid.hourly_events(spark, d), m).select("feature", "ord", F.round("fill", 6).alias("fill")))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six digits, in these columns."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def _stat(name: str, build, columns: str, sql: str) -> None:
    _add(name, lambda spark, d: _rounded(build(grid.hourly_events(spark, d)), *columns.split()), f"WITH {HOURLY}{sql}")


_stat("hampel", sc.hampel, "feature ord score", """, w AS (SELECT *, list(x) FILTER (x IS NOT NULL) OVER (PARTITION BY feature ORDER BY ord ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS l FROM g), u AS (SELECT feature, ord, x, unnest(l) AS v FROM w),
m AS (SELECT feature, ord, median(v) AS m FROM u GROUP BY ALL), a AS (SELECT feature, ord, any_value(m) AS m, median(abs(v - m)) AS d FROM u JOIN m USING (feature, ord) GROUP BY feature, ord)
SELECT g.feature, g.ord, round(abs(x - m) / nullif(1.4826::DOUBLE * d, 0), 6) AS score FROM g LEFT JOIN a USING (feature, ord)""")
_stat("robust_standardised", sc.robust_standardised, "feature ord z", """, m AS (SELECT feature, median(x) AS m, stddev_pop(x) AS s FROM g GROUP BY ALL), d AS (SELECT feature, median(abs(x - m)) AS d FROM g JOIN m USING (feature) GROUP BY ALL)
SELECT feature, ord, round((x - m) / greatest(s, 1.4826::DOUBLE * d, 0.01), 6) AS z FROM g JOIN m USING (feature) JOIN d USING (feature)""")
_stat("lag_memory", sc.lag_memory, "feature memory n", """, q AS (SELECT feature, x, lag(x) OVER (PARTITION BY feature ORDER BY ord) AS p FROM g)
SELECT feature, round(corr(x, p), 6) AS memory, count(*) AS n FROM q WHERE x IS NOT NULL AND p IS NOT NULL GROUP BY ALL""")
_stat("tail_index", sc.tail_index, "feature nu", """, e AS (SELECT feature, kurtosis_pop(x) AS k FROM g GROUP BY ALL)
SELECT feature, round(CASE WHEN k > 0.2 THEN least(60, 4 + 6 / k) ELSE 60 END, 6) AS nu FROM e""")
_stat("correlations", sc.correlations, "i j corr n", """ SELECT a.feature AS i, b.feature AS j, round(corr(a.x, b.x), 6) AS corr, count(*) AS n FROM g AS a JOIN g AS b USING (ord) WHERE a.feature < b.feature AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL""")
_stat("selective_indicators", sc.selective_indicators, "feature difference informative", """, s AS (SELECT feature, stddev_pop(x) AS s FROM g GROUP BY ALL),
d AS (SELECT a.feature AS target, b.feature, avg(b.x) FILTER (a.x IS NULL) AS u, avg(b.x) FILTER (a.x IS NOT NULL) AS v, count(b.x) FILTER (a.x IS NULL) AS nu, count(b.x) FILTER (a.x IS NOT NULL) AS nv FROM g AS a JOIN g AS b USING (ord) WHERE a.feature <> b.feature GROUP BY ALL),
m AS (SELECT target, avg(abs(u - v) / nullif(s, 0)) AS difference FROM d JOIN s USING (feature) WHERE nu >= 8 AND nv >= 8 GROUP BY ALL)
SELECT k.feature, round(difference, 6) AS difference, coalesce(difference >= 0.15, false) AS informative FROM k LEFT JOIN m ON m.target = k.feature""")
HIDE = f"""WITH {HOURLY.replace('g AS (', 'g0 AS (')}, m AS (SELECT feature, ord, x AS truth, x IS NOT NULL AND {DRAW.format('feature, ord, 3')} < 150 AS hidden FROM g0), g AS (SELECT *, CASE WHEN NOT hidden THEN truth END AS x FROM m),
f AS (SELECT *, {LOCF} AS held, avg(x) OVER {UP} AS mean, ord - coalesce(max(CASE WHEN x IS NOT NULL THEN ord END) OVER {UP}, -1) AS gap FROM g), e AS (SELECT feature, ord, gap, abs(coalesce(held, 0) - truth) AS err FROM f WHERE hidden)"""


def _errors(spark: SparkSession, d: str) -> DataFrame:
    cells = im.locf(ev.missingness(ev.masked(grid.hourly_events(spark, d), "mcar", 0.15, 3)))
    return cells.where("hidden").select("feature", "ord", F.col("time_since_obs").cast("long").alias("gap"), F.abs(F.col("fill") - F.col("truth")).alias("err"))


_add("gap_error_spearman", lambda spark, d: _rounded(sc.spearman(_errors(spark, d), "gap", "err", ("feature",)), "feature", "spearman", "n"),
     HIDE + """, r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY gap) + (count(*) OVER (PARTITION BY feature, gap) - 1) / 2 AS a, rank() OVER (PARTITION BY feature ORDER BY err) + (count(*) OVER (PARTITION BY feature, err) - 1) / 2 AS b FROM e)
SELECT feature, round(corr(a, b), 6) AS spearman, count(*) AS n FROM r GROUP BY ALL""")  # fmt: skip
_add("gap_error_tertiles", lambda spark, d: _rounded(sc.by_tertile(_errors(spark, d), "gap", "err", ("feature",)), "feature", "stratum", "n", "mean_score"),
     HIDE + """, c AS (SELECT feature, quantile_cont(gap, 1 / 3) AS a, quantile_cont(gap, 2 / 3) AS b FROM e GROUP BY ALL)
SELECT feature, CASE WHEN gap <= a THEN 'short' WHEN gap <= b THEN 'medium' ELSE 'long' END AS stratum, count(*) AS n, round(avg(err), 6) AS mean_score FROM e JOIN c USING (feature) GROUP BY ALL""")  # fmt: skip


def _ensemble(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("m"))
    return _rounded(v.select("vec_id", sc.ensemble_crps(F.lit(0.05), F.col("m")).alias("crps")), "vec_id", "crps")


_add("ensemble_crps", _ensemble, """WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), r AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS i, count(*) OVER (PARTITION BY vec_id) AS n FROM u)
SELECT vec_id, round(avg(abs(v - 0.05::DOUBLE)) - sum((2 * i - n - 1) * v) / max(n * n), 6) AS crps FROM r GROUP BY ALL""")


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Three point-in-time methods on one mask, one row each, with their ranks; benchmark_windows has more."""
    from functools import reduce

    from pyspark.sql.window import Window

    cells = ev.masked(grid.hourly_events(spark, d), "mcar", 0.15, 3)
    rows = [ev.scores(im.impute(cells, m)).select(F.lit(m).alias("method"), "mae", "rmse", "n") for m in ("zero", "locf", "mean_past")]
    return _rounded(reduce(DataFrame.unionByName, rows).withColumn("place", F.rank().over(Window.orderBy("mae"))), "method", "mae", "rmse", "n", "place")


_add("benchmark", _benchmark, HIDE + """, l AS (SELECT truth, unnest([struct_pack(method := 'zero', v := 0.0::DOUBLE), struct_pack(method := 'locf', v := coalesce(held, 0)), struct_pack(method := 'mean_past', v := coalesce(mean, 0))]) AS q FROM f WHERE hidden),
t AS (SELECT q.method AS method, avg(abs(q.v - truth)) AS a, sqrt(avg((q.v - truth) ** 2)) AS b, count(*) AS n FROM l GROUP BY ALL) SELECT method, round(a, 6) AS mae, round(b, 6) AS rmse, n, CAST(rank() OVER (ORDER BY a) AS INT) AS place FROM t""")
_add("disagreements", lambda spark, d: sc.disagreements(spark.read.parquet(f"{d}/events.parquet"), ("user_id", "event_type"), "value").select("user_id", "event_type", "n_values", F.round("low", 6).alias("low"), F.round("high", 6).alias("high")),
     "SELECT user_id, event_type, count(DISTINCT value) AS n_values, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY ALL HAVING count(DISTINCT value) >= 2")
def _leakage_sql(name: str, fill: str, causal: str, seen: str = "") -> str:
    """Errors on all rows and at the right edge of trailing windows, averaged over two patterns and two rates, and the largest revision over prefixes."""
    runs = []
    for pattern, ids in (("mcar", "feature, ord, 3"), ("block", "feature, ord // 10, 3")):
        for rate in (100, 200):
            cells = f"SELECT feature, ord, x AS truth, x IS NOT NULL AND {DRAW.format(ids)} < {rate} AS hidden FROM whole_cells"
            seen_here = seen.replace(", s AS", f", windows_{pattern}_{rate} AS").replace("FROM g", f"FROM cells_{pattern}_{rate}") or f", windows_{pattern}_{rate} AS (SELECT * FROM cells_{pattern}_{rate})"
            runs.append((f", cells_{pattern}_{rate} AS (SELECT *, CASE WHEN NOT hidden THEN truth END AS x FROM ({cells})){seen_here}", f"SELECT avg(abs(full_fill - truth)) AS a, avg(abs(causal_fill - truth)) AS b FROM (SELECT truth, hidden, coalesce(x, {fill}, 0) AS full_fill, coalesce(x, {causal}, 0) AS causal_fill FROM windows_{pattern}_{rate}) WHERE hidden"))
    audit = _certificate_sql(fill, seen).split(" SELECT prefix, count(*)")[0]
    return f"""{audit}, whole_cells AS (SELECT feature, ord, x FROM g){''.join(a for a, _ in runs)}, errors AS ({' UNION ALL '.join(b for _, b in runs)}), mean_errors AS (SELECT avg(a) AS a, avg(b) AS b FROM errors),
revised AS (SELECT max(abs(part.b - whole.a)) AS r FROM part JOIN whole USING (feature, ord)) SELECT '{name}' AS method, round(a, 6) AS mae_full, round(b, 6) AS mae_causal, round(b - a, 6) AS delta, round(r, 6) AS max_revision, r <= 1e-6 AS holds FROM mean_errors, revised"""


LEAKAGE = {
    "nocb": _leakage_sql("nocb", f"first_value(x IGNORE NULLS) OVER {ON}", "0"),
    "linear_interp": _leakage_sql("linear_interp", "av + (bv - av) * (ord - at_) / nullif(bt - at_, 0), av, bv", f"last_value(x IGNORE NULLS) OVER {LAST24}", SEEN),
}
for _m in ("nocb", "linear_interp", "softimpute"):
    _add(f"leakage_{_m}", sql=LEAKAGE.get(_m), query=lambda spark, d, m=_m: _rounded(au.report(grid.hourly_events(spark, d), m), "method", "mae_full", "mae_causal", "delta", "max_revision", "holds"))
_add("right_edge", lambda spark, d: _rounded(au.right_edge(ev.trailing_windows(grid.hourly_events(spark, d), 24)), "feature", "win_id", "x"), f"WITH {HOURLY} SELECT feature, ord AS win_id, round(x, 6) AS x FROM g")
_add("trailing_multipliers", lambda spark, d: _rounded(au.trailing_multipliers(_errors(spark, d).withColumnRenamed("err", "score"), 0.9), "feature", "ord", "multiplier"),
     HIDE + f""", w AS (SELECT feature, ord, list(err) OVER (PARTITION BY feature ORDER BY ord ROWS BETWEEN 4000 PRECEDING AND 1 PRECEDING) AS l FROM e), n AS (SELECT feature, ord, list_sort(l) AS l, coalesce(len(l), 0) AS n FROM w)
SELECT feature, ord, round(CASE WHEN n < 30 THEN 1.6448536269514722::DOUBLE ELSE l[least(n, CAST(ceil(0.9::DOUBLE * (n + 1)) AS BIGINT))] END, 6) AS multiplier FROM n""")  # fmt: skip
