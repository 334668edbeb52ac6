"""Queries of the validation of predictions and of trades by resampling, with their SQL: draws are integer hashes, rank correlations come from whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators import backtest, forward, resampling, robustness
from barwright.plans.analysis_queries import NAMES, PEARSON, long_sql, p_sql, returns, screened, wide
from barwright.plans.bar_queries import BARS, Query, bars, r9, s9
from barwright.plans.forward_queries import ALPHA, FALLBACK, LASSO, MOST, STEP_DAYS, TEST_DAYS, THRESHOLD, TRAIN_DAYS, WALK_MODELS, daily_features
from barwright.plans.model_queries import BOOTSTRAP, LOOP, PERMUTATION, REPLICATES, draws_sql, mean_sql, result, s6, six
from barwright.sources import bars as B

DRAWS = 10_000


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screened(bars(spark, sf_dir), ["series", "ts"]).where(F.col("value").isNotNull() & F.col("target").isNotNull())
    best = robustness.top_feature(rows, ["series"])
    return best.withColumns({"value": r9("value"), "target": r9("target"), "week": F.floor(F.datediff("ts", F.lit("2020-01-06").cast("date")) / 7)})


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best feature of each series as its prediction; weeks are its periods."""
    out = robustness.validated(top(spark, sf_dir), "value", "target", "week", ["series"], ["ts"], DRAWS)
    return out.select("series", "n", *(F.round(c, 7).alias(c) for c in ("ic", "p_value", "mean", "low", "high", "z", "permutation_p", "yearly_sd", "yearly_min")), *(F.col(c).cast("int").alias(c) for c in ("passes_forward", "passes_interval", "passes_permutation", "passes_years", "n_passed", "is_valid")))


_RANK = lambda x, part: f"2 * rank() OVER (PARTITION BY {part} ORDER BY {x}) + count(*) OVER (PARTITION BY {part}, {x}) - 1"
_CORR = "CASE WHEN n * sum(a * a) - sum(a) * sum(a) > 0 AND n * sum(b * b) - sum(b) * sum(b) > 0 THEN CAST(n * sum(a * b) - sum(a) * sum(b) AS DOUBLE) / (sqrt(CAST(n * sum(a * a) - sum(a) * sum(a) AS DOUBLE)) * sqrt(CAST(n * sum(b * b) - sum(b) * sum(b) AS DOUBLE))) END"
TOP = f"""{BARS}, {long_sql("bars", "series, ts")}, ti AS (SELECT series, feature, {PEARSON} AS ic FROM l GROUP BY 1, 2 HAVING count(*) >= 10), tf AS (SELECT series, feature FROM ti WHERE ic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series ORDER BY abs(ic) DESC, feature) = 1),
t AS (SELECT series, ts, round(value, 9) + 0 AS x, round(target, 9) + 0 AS y, (CAST(ts AS DATE) - DATE '2020-01-06') // 7 AS week FROM l JOIN tf USING (series, feature)),
v AS (SELECT series, ts, x, y, week, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series) AS n, {_RANK("x", "series")} AS a, {_RANK("y", "series")} AS b FROM t)"""
GATES = f"""WITH {TOP}, {draws_sql(DRAWS)}, bx AS (SELECT d.series, d.b AS k, d.n, v.x, v.y FROM d JOIN v ON v.series = d.series AND v.i = d.h % d.n), bk AS (SELECT series, k, n, {_RANK("x", "series, k")} AS a, {_RANK("y", "series, k")} AS b FROM bx), bo AS (SELECT series, k, {_CORR} AS ic FROM bk GROUP BY series, k, n),
po AS (SELECT series, b AS k, j, n, row_number() OVER (PARTITION BY series, b ORDER BY h, j) - 1 AS place FROM d), pk AS (SELECT po.series, k, po.n, p.a, q.b FROM po JOIN v p ON p.series = po.series AND p.i = po.j JOIN v q ON q.series = po.series AND q.i = po.place), pe AS (SELECT series, k, {_CORR} AS ic FROM pk GROUP BY series, k, n),
re AS (SELECT series, n, {_CORR} AS ic FROM v GROUP BY series, n), bs AS (SELECT series, avg(ic) AS mean, quantile_cont(ic, 0.025) AS low, quantile_cont(ic, 0.975) AS high FROM bo GROUP BY 1),
ps AS (SELECT pe.series, avg(pe.ic) AS m, stddev_samp(pe.ic) AS s, avg(CAST(pe.ic >= re.ic AS INTEGER)) AS above, avg(CAST(pe.ic <= re.ic AS INTEGER)) AS below FROM pe JOIN re USING (series) GROUP BY 1),
wk AS (SELECT series, week, count(*) OVER w AS n, {_RANK("x", "series, week")} AS a, {_RANK("y", "series, week")} AS b FROM v WINDOW w AS (PARTITION BY series, week)), wi AS (SELECT series, week, CASE WHEN n >= 11 THEN {_CORR} END AS ic FROM wk GROUP BY series, week, n), ws AS (SELECT series, stddev_pop(ic) AS yearly_sd, min(ic) AS yearly_min FROM wi GROUP BY 1),
g AS (SELECT re.series, re.n, re.ic, {p_sql("re.ic", "re.n")} AS p_value, mean, low, high, (re.ic - m) / nullif(s, 0) AS z, CASE WHEN re.ic >= m THEN above ELSE below END AS permutation_p, yearly_sd, yearly_min FROM re JOIN bs USING (series) JOIN ps USING (series) LEFT JOIN ws USING (series)),
o AS (SELECT *, CAST(p_value < 0.01 AS INTEGER) AS passes_forward, CAST(low > 0 OR high < 0 AS INTEGER) AS passes_interval, CAST(permutation_p < 0.001 AS INTEGER) AS passes_permutation, coalesce(CAST(yearly_sd < 0.02 AND yearly_min > 0 AS INTEGER), 0) AS passes_years FROM g)
SELECT series, n, {", ".join(f"round({c}, 7) + 0 AS {c}" for c in ("ic", "p_value", "mean", "low", "high", "z", "permutation_p", "yearly_sd", "yearly_min"))}, passes_forward, passes_interval, passes_permutation, passes_years, passes_forward + passes_interval + passes_permutation + passes_years AS n_passed, CAST(passes_forward + passes_interval + passes_permutation + passes_years >= 3 AS INTEGER) AS is_valid FROM o"""


def trade_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(resampling.trade_bootstrap(backtest.trades(result(spark, sf_dir)), ["pair"], DRAWS))


_TRADES = f"v AS MATERIALIZED (SELECT pair AS series, row_number() OVER (PARTITION BY pair ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n, return_pct / 100 AS r FROM (WITH RECURSIVE {LOOP} SELECT * FROM tr))"
_FIVE = ", ".join(f"'{m}'" for m in resampling.TRADE_METRICS)
TRADE_BOOTSTRAP = f"""WITH {_TRADES}, {draws_sql(DRAWS)}, x AS (SELECT d.series, d.b, d.j, v.r FROM d JOIN v ON v.series = d.series AND v.i = d.h % d.n), {REPLICATES},
w AS (SELECT u.*, k.n FROM u JOIN (SELECT series, max(n) AS n FROM v GROUP BY 1) k USING (series)), a9 AS (SELECT series, metric, {mean_sql("v")} AS mean, stddev_pop(v) AS sd, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM w WHERE metric IN ({_FIVE}) GROUP BY 1, 2)
SELECT series AS pair, metric, {s6("mean")} AS mean, {s6("sd")} AS sd, {s6("low")} AS low, {s6("high")} AS high, CAST(low > 0 OR high < 0 AS INTEGER) AS significant FROM a9"""


def trade_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(resampling.trade_permutation(backtest.trades(result(spark, sf_dir)), ["pair"], DRAWS))


TRADE_PERMUTATION = f"""WITH {_TRADES}, {draws_sql(DRAWS)}, o AS (SELECT series, b, j, row_number() OVER (PARTITION BY series, b ORDER BY h, j) - 1 AS place FROM d), x AS (SELECT o.series, o.b, o.place AS j, v.r FROM o JOIN v ON v.series = o.series AND v.i = o.j UNION ALL SELECT series, -1, i, r FROM v), {REPLICATES},
w AS (SELECT series, metric, b, v, max(CASE WHEN b < 0 THEN v END) OVER (PARTITION BY series, metric) AS real FROM u WHERE metric IN ({_FIVE}))
SELECT series AS pair, metric, {s6("max(real)")} AS real, {s6("avg(v)")} AS mean, {s6("avg(CAST(round(v, 9) >= round(real, 9) AS INTEGER))")} AS p_value FROM w WHERE b >= 0 GROUP BY 1, 2"""


# ---- the same, and walk-forward models, from CSV


def bootstrap_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = B.scratch(spark)
    B.write_csv(returns(spark, sf_dir).select("series", F.col("ts").cast("timestamp").alias("ts"), (F.col("r") / 10).alias("r")), path)
    return six(resampling.bootstrap(B.returns_from_csv(spark, path, keys=("series",)), "r", ["ts"], keys=["series"]))


def permutation_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = B.scratch(spark)
    B.write_csv(wide(spark, sf_dir).select("series", F.col("ts").cast("timestamp").alias("ts"), (F.col("target") / 100).alias("y_true"), F.col("z").alias("y_pred")), path)
    return six(resampling.permutation(B.predictions_from_csv(spark, path, keys=("series",)), "y_pred", "y_true", ["ts"], keys=["series"]))


def walk_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [f"{B.scratch(spark)}.csv" for _ in range(2)]
    df = daily_features(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    B.write_csv(df.select("series", "ts", *NAMES), paths[0])
    B.write_csv(df.select("series", "ts", "target"), paths[1])
    both = B.features_with_target(spark, *paths, keys=("series",))
    models = forward.walk_forward_models(both, NAMES, "target", TRAIN_DAYS, TEST_DAYS, STEP_DAYS, ["series"], ALPHA, LASSO, MOST, THRESHOLD, FALLBACK)[1]
    return models.select("series", F.col("window").cast("bigint").alias("window"), "feature", F.col("votes").cast("bigint").alias("votes"), F.col("selected").cast("int").alias("selected"), *(F.round(c, 8).alias(c) for c in ("mean", "sd", "coef", "offset")))


QUERIES: dict[str, Query] = {
    "bootstrap_from_csv": (bootstrap_from_csv, BOOTSTRAP),
    "permutation_from_csv": (permutation_from_csv, PERMUTATION),
    "walk_forward_from_csv": (walk_from_csv, WALK_MODELS),
    "four_gates": (gates, GATES),
    "trade_bootstrap": (trade_bootstrap, TRADE_BOOTSTRAP),
    "trade_permutation": (trade_permutation, TRADE_PERMUTATION),
}
