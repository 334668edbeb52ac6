"""Queries of the statistics, consensus, cost, rule, backtest and model operators over derived bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions import rolling as R
from barwright.operators import align, backtest, consensus, costs, features, learning, metrics, processes, regimes, robustness, rules, stats
from barwright.plans.bar_queries import ADX_CTE, BARS, DAILY, N, ROW, Query, W, bars, bars_sql, daily, full, over, pos_sql, r9, s9, z_sql

NAMES = ["mean_ratio", "z", "pos", "ret"]


def screened(df: DataFrame, keep: list[str]) -> DataFrame:
    """feature, value, target rows: four features and the next bar's return."""
    x, w = F.col("close"), W()
    df = df.withColumns({"mean_ratio": F.try_divide(R.mean(x, 5, w), R.mean(x, N, w)), "z": R.zscore(x, N, w), "pos": R.position(x, N, w), "ret": R.ret(x, 5, w), "target": features.target(x, 1, "return", w)})
    return stats.long(df, NAMES, [*keep, "target"])


FEATURES = {"mean_ratio": f"({full(5, f'avg(close) {over(5)}')}) / ({full(N, f'avg(close) {over(N)}')})", "z": z_sql("close", N), "pos": pos_sql("close", N), "ret": f"close / lag(close, 5) {ROW} - 1"}
# rounded where ranks compare them, so that both engines see the same ties
WIDE = f"w AS (SELECT *, {', '.join(f'{v} AS f_{k}' for k, v in FEATURES.items())}, lead(close, 1) {ROW} / close - 1 AS target FROM {{0}})"


def long_sql(source: str, keep: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {keep}, '{k}' AS feature, f_{k} AS value, target FROM w" for k in FEATURES)
    return f"{WIDE.format(source)}, l AS (SELECT * FROM ({rows}) WHERE value IS NOT NULL AND target IS NOT NULL)"


PEARSON = "covar_samp(value, target) / nullif(stddev_samp(value) * stddev_samp(target), 0)"


def ic(by: list[str], keep: list[str], method: str, source=bars, least: int = 10):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = screened(source(spark, sf_dir).withColumn("year", F.year("ts").cast("bigint")), keep)
        if method == "spearman":
            rows = rows.withColumns({"value": r9("value"), "target": r9("target")})
        return stats.information_coefficient(rows, by, method, least).select(*by, "n", r9("ic").alias("ic"))

    return query


def ic_sql(by: list[str], keep: str, method: str, ctes: str = BARS, source: str = "bars") -> str:
    names = ", ".join(by)
    rows = long_sql(source, keep)
    if method == "spearman":
        part = f"PARTITION BY {names}"
        rows += f", k AS (SELECT {names}, round(value, 9) + 0 AS v, round(target, 9) + 0 AS t FROM l), rk AS (SELECT {names}, rank() OVER ({part} ORDER BY v) + (count(*) OVER ({part}, v) - 1) / 2.0 AS value, rank() OVER ({part} ORDER BY t) + (count(*) OVER ({part}, t) - 1) / 2.0 AS target FROM k)"
        return f"WITH {ctes}, {rows} SELECT {names}, count(*) AS n, {s9(f'CASE WHEN count(*) >= 10 THEN {PEARSON} END')} AS ic FROM rk GROUP BY {names}"
    return f"WITH {ctes}, {rows} SELECT {names}, count(*) AS n, {s9(f'CASE WHEN count(*) >= 10 THEN {PEARSON} END')} AS ic FROM l GROUP BY {names}"


DAILY_Y = f"{DAILY}, dy AS (SELECT *, year(ts) AS year FROM daily)"


def ic_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By fifths of the whole time span."""
    df = daily(spark, sf_dir)
    span = df.agg(F.min(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("b"))
    df = df.join(F.broadcast(span)).withColumn("period", F.least(F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.col("a")) / ((F.col("b") - F.col("a")) / 5)), F.lit(4)).cast("bigint"))  # span is one row
    return stats.information_coefficient(screened(df, ["period"]), ["feature", "period"], "pearson", 30).select("feature", "period", "n", r9("ic").alias("ic"))


IC_PERIOD = f"""WITH {DAILY}, s AS (SELECT min(epoch(ts)) AS a, max(epoch(ts)) AS b FROM daily), p AS (SELECT d.*, CAST(least(floor((epoch(ts) - a) / ((b - a) / 5)), 4) AS BIGINT) AS period FROM daily d, s), {long_sql("p", "period")}
SELECT feature, period, count(*) AS n, {s9(f"CASE WHEN count(*) >= 30 THEN {PEARSON} END")} AS ic FROM l GROUP BY 1, 2"""


def ic_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regimes.with_regimes(bars(spark, sf_dir), W())
    flags = ["is_trending", "is_ranging", "is_high_vol", "is_low_vol"]
    rows = screened(df, flags)
    rows = rows.withColumn("regime", F.explode(F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags)))))
    return stats.information_coefficient(rows, ["feature", "regime"]).select("feature", "regime", "n", r9("ic").alias("ic"))


IC_REGIME = f"""WITH {ADX_CTE}, p AS (SELECT *, atr / nullif(close, 0) * 100 AS atr_pct FROM adx), q AS (SELECT series, quantile_cont(atr_pct, 0.75) AS hi, quantile_cont(atr_pct, 0.25) AS lo FROM p GROUP BY 1),
g AS (SELECT p.series, p.ts, p.open, p.high, p.low, p.close, p.volume, coalesce(adx > 25, false) AS is_trending, coalesce(adx < 20, false) AS is_ranging, coalesce(atr_pct > hi, false) AS is_high_vol, coalesce(atr_pct < lo, false) AS is_low_vol FROM p JOIN q USING (series)),
{long_sql("g", "is_trending, is_ranging, is_high_vol, is_low_vol")},
r AS ({" UNION ALL ".join(f"SELECT feature, '{f}' AS regime, value, target FROM l WHERE {f}" for f in ("is_trending", "is_ranging", "is_high_vol", "is_low_vol"))})
SELECT feature, regime, count(*) AS n, {s9(f"CASE WHEN count(*) >= 10 THEN {PEARSON} END")} AS ic FROM r GROUP BY 1, 2"""


def ic_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.information_coefficient(screened(daily(spark, sf_dir).withColumn("year", F.year("ts")), ["year"]), ["feature", "year"])
    return stats.stability(found, ["feature"]).select("feature", "n_groups", *(r9(c).alias(c) for c in ("ic_mean", "ic_sd", "ic_min", "ic_max")), F.col("is_robust").cast("int").alias("is_robust"))


IC_STABILITY = f"""WITH {DAILY_Y}, {long_sql("dy", "year")}, i AS (SELECT feature, year, CASE WHEN count(*) >= 10 THEN {PEARSON} END AS ic FROM l GROUP BY 1, 2)
SELECT feature, count(ic) AS n_groups, {s9("avg(ic)")} AS ic_mean, {s9("stddev_pop(ic)")} AS ic_sd, {s9("min(ic)")} AS ic_min, {s9("max(ic)")} AS ic_max, CAST(stddev_pop(ic) < 0.02 AND min(ic) > 0 AS INTEGER) AS is_robust FROM i GROUP BY 1"""


def ic_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, p and its correction."""
    found = stats.significance(stats.information_coefficient(screened(bars(spark, sf_dir), []), ["feature"]))
    return found.select("feature", "n", *(r9(c).alias(c) for c in ("ic", "t_stat", "p_value", "p_value_corrected", "abs_ic")))


def p_sql(r: str, n: str) -> str:
    """stats.two_sided_p in SQL."""
    area = lambda a: f"(least(pi() / 2 - {a}, 14 / sqrt({n} - 2)) / 400 * list_sum(list_transform(range(401), lambda i: CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos({a} + i * least(pi() / 2 - {a}, 14 / sqrt({n} - 2)) / 400), 0), {n} - 3))))"
    return f"coalesce(CASE WHEN {n} > 2 THEN least({area(f'asin(least(abs({r}), 1))')} / {area('0.0')}, 1) END, 1)"


IC_SIGNIFICANCE = f"""WITH {BARS}, {long_sql("bars", "series")}, i AS (SELECT feature, count(*) AS n, {PEARSON} AS ic FROM l GROUP BY 1), t AS (SELECT *, ic * sqrt(n) AS t_stat FROM i), p AS (SELECT *, {p_sql("ic", "n")} AS p_value FROM t)
SELECT feature, n, {s9("ic")} AS ic, {s9("t_stat")} AS t_stat, {s9("p_value")} AS p_value, {s9("least(p_value * count(*) OVER (), 1)")} AS p_value_corrected, {s9("abs(ic)")} AS abs_ic FROM p"""


def binned_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screened(bars(spark, sf_dir), [])
    return stats.binned_mutual_information(rows.withColumns({"value": r9("value"), "target": r9("target")}), ["feature"]).select("feature", r9("mi").alias("mi"))


def mi_sql(rows: str, by: str) -> str:
    b = lambda x, lo, hi: f"CAST(least(floor(coalesce(({x} - {lo}) * 10 / nullif({hi} - {lo}, 0), 0)) + 1, 10) AS BIGINT)"
    return f"""{rows}, v AS (SELECT {by}, round(value, 9) + 0 AS value, round(target, 9) + 0 AS target FROM l), e AS (SELECT {by}, min(value) AS a, max(value) AS b, min(target) AS c, max(target) AS d, count(*) AS n FROM v GROUP BY ALL),
g AS (SELECT {by}, n, {b("value", "a", "b")} AS i, {b("target", "c", "d")} AS j FROM v JOIN e USING ({by})), j AS (SELECT {by}, n, i, j, count(*) AS nij FROM g GROUP BY ALL),
k AS (SELECT *, sum(nij) OVER (PARTITION BY {by}, i) AS ni, sum(nij) OVER (PARTITION BY {by}, j) AS nj FROM j)
SELECT {by}, {s9("sum(nij / n * ln(nij * n / (ni * nj)))")} AS mi FROM k GROUP BY {by}"""


def lagged_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependence of each series' return on the volume three bars before."""
    w = W()
    df = bars(spark, sf_dir).select("series", F.lag("volume", 3).over(w).alias("value"), r9(R.ret(F.col("close"), 1, w)).alias("target"))
    return stats.binned_mutual_information(df, ["series"]).select("series", r9("mi").alias("mi"))


LAGGED = f"WITH {BARS}, l AS (SELECT * FROM (SELECT series, lag(volume, 3) {ROW} AS value, close / lag(close, 1) {ROW} - 1 AS target FROM bars) WHERE value IS NOT NULL AND target IS NOT NULL)"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = F.col("close"), W()
    df = bars(spark, sf_dir)
    return df.withColumns({"mean_ratio": F.try_divide(R.mean(x, 5, w), R.mean(x, N, w)), "z": R.zscore(x, N, w), "pos": R.position(x, N, w), "ret": R.ret(x, 5, w), "d1": R.d1(x, w), "target": features.target(x, 1, "return", w)})


PAIRS = [(a, b) for i, a in enumerate(["mean_ratio", "z", "pos", "ret", "volume"]) for b in ["mean_ratio", "z", "pos", "ret", "volume"][i + 1 :]]


def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlation_pairs(wide(spark, sf_dir), ["mean_ratio", "z", "pos", "ret", "volume"]).select("a", "b", r9("r").alias("r"))


COMPLETE = f"{WIDE.format('bars')}, c AS (SELECT f_mean_ratio AS mean_ratio, f_z AS z, f_pos AS pos, f_ret AS ret, volume FROM w WHERE f_mean_ratio IS NOT NULL AND f_z IS NOT NULL AND f_pos IS NOT NULL AND f_ret IS NOT NULL)"
PAIR_ROWS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0) AS r FROM c" for a, b in PAIRS)


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.network(stats.correlation_pairs(wide(spark, sf_dir), ["mean_ratio", "z", "pos", "ret", "volume"]), 0.5)
    return found.select("node", "degree", r9("degree_centrality").alias("degree_centrality"), "triangles", r9("clustering").alias("clustering"))


NETWORK = f"""WITH {BARS}, {COMPLETE}, p AS ({PAIR_ROWS}), u AS (SELECT a, b FROM p WHERE abs(r) > 0.5), e AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), n AS (SELECT DISTINCT a AS node FROM p UNION SELECT b FROM p),
d AS (SELECT a AS node, count(*) AS degree FROM e GROUP BY 1), t AS (SELECT x.a AS node, count(*) AS triangles FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b GROUP BY 1)
SELECT node, coalesce(degree, 0) AS degree, {s9("coalesce(degree, 0) / (SELECT count(*) - 1 FROM n)")} AS degree_centrality, coalesce(triangles, 0) AS triangles, {s9("coalesce(2.0 * triangles / nullif(degree * (degree - 1), 0), 0)")} AS clustering FROM n LEFT JOIN d USING (node) LEFT JOIN t USING (node)"""


# ---- consensus over a score table of parts: five methods score a hundred features


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, feature, score: integer arithmetic over the nations and methods, so that any engine gets the same."""
    n = spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("k"))
    methods = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(i).alias("i")) for i, m in enumerate(consensus.METHODS, 1)))).alias("m")
    return n.select("k", methods).select("m.method", F.concat(F.lit("f"), "k").alias("feature"), ((F.col("k") * (7 + F.col("m.i")) + 3 * F.col("m.i")) % 29).cast("double").alias("score"))


SCORES = f"m AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{m}{chr(39)})' for i, m in enumerate(consensus.METHODS, 1))}) t(i, method)), s AS (SELECT method, 'f' || CAST(n_nationkey AS VARCHAR) AS feature, CAST((n_nationkey * (7 + i) + 3 * i) % 29 AS DOUBLE) AS score FROM nation, m)"
RANKED = f"{SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS rank FROM s QUALIFY rank <= 15)"
VOTES = f"{RANKED}, v AS (SELECT feature, count(*) AS n_methods, list_sort(list(DISTINCT method)) AS methods FROM r GROUP BY 1), c AS (SELECT *, CASE WHEN n_methods >= 5 THEN 'strong' WHEN n_methods >= 3 THEN 'medium' ELSE 'none' END AS category FROM v)"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.rankings(scores(spark, sf_dir), 15)


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.votes(ranked(spark, sf_dir), 5)


def approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = consensus.checked(voted(spark, sf_dir))
    return out.select("feature", "n_methods", "category", F.col("checks_passed").cast("bigint").alias("checks_passed"), F.col("checks_total").cast("bigint").alias("checks_total"), F.col("approved").cast("int").alias("approved"))


CHECKS = f"""WITH {VOTES}, k AS (SELECT *, CAST(n_methods >= CASE WHEN category = 'strong' THEN 5 ELSE 3 END AS INTEGER) + CAST(list_contains(methods, 'RF') AND list_contains(methods, 'XGBoost') AS INTEGER) + CAST(list_contains(methods, 'IC') AND list_contains(methods, 'MI') AS INTEGER) + CAST(list_contains(methods, 'Lasso') AS INTEGER) AS p FROM c WHERE category <> 'none')
SELECT feature, n_methods, category, CAST(p AS BIGINT) AS checks_passed, CAST(4 AS BIGINT) AS checks_total, CAST(p / 4.0 >= CASE WHEN category = 'strong' THEN 0.75 ELSE 0.60 END AS INTEGER) AS approved FROM k"""


def consensus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    of = lambda m, f=1.0: s.where(F.col("method") == m).select("feature", (F.col("score") / 1000 * f).alias("score"))
    out = consensus.consensus_table(s.select("feature").distinct(), of("IC"), of("MI"), of("Lasso"), of("RF"), of("XGBoost"), 0.01, 10)
    return out.select("feature", *(F.col(c).cast("int").alias(c) for c in ("ic_pass", "mi_pass", "lasso_pass", "rf_pass", "gb_pass")), F.col("n_pass").cast("bigint").alias("n_pass"), r9("consensus_pct").alias("consensus_pct"), "category")


CONSENSUS = f"""WITH {SCORES}, k AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score DESC) AS rk FROM s),
p AS (SELECT feature, max(CASE WHEN method = 'IC' THEN CAST(score / 1000 > 0.01 AS INTEGER) END) AS ic_pass, max(CASE WHEN method = 'MI' THEN CAST(score / 1000 > 0.01 AS INTEGER) END) AS mi_pass, max(CASE WHEN method = 'Lasso' THEN CAST(score <> 0 AS INTEGER) END) AS lasso_pass, max(CASE WHEN method = 'RF' THEN CAST(rk <= 10 AS INTEGER) END) AS rf_pass, max(CASE WHEN method = 'XGBoost' THEN CAST(rk <= 10 AS INTEGER) END) AS gb_pass FROM k GROUP BY 1),
n AS (SELECT *, CAST(ic_pass + mi_pass + lasso_pass + rf_pass + gb_pass AS BIGINT) AS n_pass FROM p)
SELECT *, {s9("n_pass / 5 * 100")} AS consensus_pct, CASE WHEN n_pass >= 4 THEN 'very strong' WHEN n_pass >= 3 THEN 'strong' WHEN n_pass >= 2 THEN 'moderate' ELSE 'weak' END AS category FROM n"""


# ---- costs


SPREAD_CTE = "sp AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {h}, {d}, CAST({(p := round(b * f * k, 1))} AS DOUBLE), CAST({round(p * costs.usd_per_pip(s), 2)} AS DOUBLE))" for s, k in costs.SERIES_FACTOR.items() for h, b in enumerate(costs.SPREAD_BY_HOUR) for d, f in enumerate(costs.WEEKDAY_FACTOR)) + ") t(pair, hour_utc, day_of_week, spread_pips, spread_usd_per_lot))"


def spread_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir).withColumn("series", F.when(F.col("series") == "click", "EUR_USD").when(F.col("series") == "error", "USD_JPY").otherwise(F.col("series")))
    return costs.with_spread(df, costs.spread_table(spark)).select("series", "ts", "spread")


SPREAD_JOIN = f"""WITH {SPREAD_CTE}, {BARS}, b AS (SELECT CASE series WHEN 'click' THEN 'EUR_USD' WHEN 'error' THEN 'USD_JPY' ELSE series END AS series, ts FROM bars)
SELECT series, ts, coalesce(spread_pips, 1.5) AS spread FROM b LEFT JOIN sp ON series = pair AND hour(ts) = hour_utc AND isodow(ts) - 1 = day_of_week"""


def slippage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regimes.with_atr(bars(spark, sf_dir), W())
    df = df.withColumn("usual", F.avg("atr").over(Window.partitionBy("series")))
    return df.select("series", "ts", r9(costs.slippage(F.col("atr"), F.col("usual"))).alias("slippage"))


SLIPPAGE = f"WITH {ADX_CTE}, u AS (SELECT series, ts, atr / nullif(avg(atr) OVER (PARTITION BY series), 0) AS q FROM a) SELECT series, ts, {s9('greatest(0.2, least(0.3 * (1 + 0.5 * (coalesce(q, 1) - 1)), 3.0))')} AS slippage FROM u"


# ---- rules


def rule_features(spark: SparkSession) -> DataFrame:
    rows = [("mean_ratio", 0.016, "Long"), ("z", -0.028, "Long"), ("pos", -0.019, "Short"), ("ret", 0.021, "Short")]
    return spark.createDataFrame(rows, "feature STRING, ic DOUBLE, signal STRING")


RULE_CTE = "f AS (SELECT * FROM (VALUES ('mean_ratio', 0.016::DOUBLE, 'Long'), ('z', -0.028::DOUBLE, 'Long'), ('pos', -0.019::DOUBLE, 'Short'), ('ret', 0.021::DOUBLE, 'Short')) t(feature, ic, signal))"


def rule_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.weights(rules.entry_rules(rule_features(spark)))
    values = screened(bars(spark, sf_dir), ["series", "ts"]).where(F.col("value").isNotNull()).withColumn("value", r9("value"))
    out = rules.rule_votes(values, rows, ["series", "ts"])
    return out.select("series", "ts", r9("long_score").alias("long_score"), r9("short_score").alias("short_score"), "decision")


RULE_VOTES = f"""WITH {BARS}, {WIDE.format("bars")}, l AS ({" UNION ALL ".join(f"SELECT series, ts, '{k}' AS feature, round(f_{k}, 9) + 0 AS value FROM w WHERE f_{k} IS NOT NULL" for k in FEATURES)}), {RULE_CTE},
g AS (SELECT *, CASE WHEN (ic > 0) = (signal = 'Long') THEN 1 ELSE -1 END AS side, CASE WHEN contains(feature, 'ratio') THEN 1 ELSE 0 END AS threshold, abs(ic) / sum(abs(ic)) OVER () AS weight FROM f),
h AS (SELECT sum(CASE WHEN signal = 'Long' THEN weight END) / 2 AS hl, sum(CASE WHEN signal = 'Short' THEN weight END) / 2 AS hs FROM g),
v AS (SELECT series, ts, coalesce(sum(CASE WHEN ok AND signal = 'Long' THEN weight END), 0) AS a, coalesce(sum(CASE WHEN ok AND signal = 'Short' THEN weight END), 0) AS b FROM (SELECT l.*, g.signal, g.weight, CASE WHEN side > 0 THEN value > threshold ELSE value < threshold END AS ok FROM l JOIN g USING (feature)) GROUP BY 1, 2)
SELECT series, ts, {s9("a")} AS long_score, {s9("b")} AS short_score, CASE WHEN a > hl AND a > b THEN 'LONG' WHEN b > hs AND b > a THEN 'SHORT' ELSE 'NEUTRAL' END AS decision FROM v, h"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regimes.with_atr(bars(spark, sf_dir), W())
    low, high = rules.exits(F.col("close"), F.lit("SHORT"), F.col("atr"))
    return df.select("series", "ts", r9(rules.position_size(F.lit(1000.0), F.lit(0.8), F.col("atr"), F.col("close"), F.lit(0.5))).alias("size"), r9(low).alias("stop"), r9(high).alias("take"))


SIZES = f"""WITH {ADX_CTE} SELECT series, ts, {s9("least(least(0.016, CASE WHEN atr * 2 > 0 THEN 1000 * 0.01 / (atr * 2) / close ELSE 0.01 END) * 0.75, 0.10)")} AS size, {s9("close + 2 * atr")} AS stop, {s9("close - 3 * atr")} AS take FROM a"""


# ---- returns and processes


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("r", R.ret(F.col("close"), 1, W()) / 10).where(F.col("r").isNotNull())


RETURNS = f"{BARS}, r AS (SELECT * FROM (SELECT series, ts, (close / lag(close, 1) {ROW} - 1) / 10 AS r FROM bars) WHERE r IS NOT NULL)"


def drawdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.drawdowns(returns(spark, sf_dir)).select("series", "ts", F.round("equity", 6).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


DRAWDOWN = f"WITH {RETURNS}, e AS (SELECT series, ts, product(1 + r) {over()} AS equity FROM r) SELECT series, ts, round(equity, 6) + 0 AS equity, round((equity / max(equity) {over()} - 1) * 100, 6) + 0 AS drawdown FROM e"


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.return_metrics(returns(spark, sf_dir), ["series"])
    return out.select("series", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


METRICS = f"""WITH {RETURNS} SELECT series, count(r) AS n, round(CASE WHEN stddev_samp(r) > 1e-10 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END, 6) + 0 AS sharpe, round(sum(CASE WHEN r > 0 THEN r END) / abs(sum(CASE WHEN r < 0 THEN r END)), 6) + 0 AS profit_factor, round(avg(CAST(r > 0 AS INTEGER)), 6) + 0 AS win_rate,
round(avg(CASE WHEN r > 0 THEN r END) / abs(avg(CASE WHEN r < 0 THEN r END)), 6) + 0 AS win_loss, round((product(1 + r) - 1) * 100, 6) + 0 AS total_return, round(avg(r) * 252 * 100, 6) + 0 AS annual_return FROM r GROUP BY 1"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


OU = f"""WITH {BARS}, d AS (SELECT series, close AS x, lead(close, 1) {ROW} - close AS dx FROM bars), f AS (SELECT series, regr_slope(dx, x) AS b, regr_intercept(dx, x) AS a, regr_r2(dx, x) AS r2, var_pop(dx) AS v FROM d WHERE dx IS NOT NULL GROUP BY 1)
SELECT series, {s9("-b")} AS theta, {s9("-a / b")} AS mu, {s9("sqrt(v * (1 - r2))")} AS sigma, {s9("CASE WHEN -b > 0 THEN ln(2) / -b END")} AS half_life, {s9("r2")} AS r2 FROM f"""
LOGS = f"{BARS}, r AS (SELECT * FROM (SELECT series, ts, ln(close / lag(close, 1) {ROW}) AS r FROM bars) WHERE r IS NOT NULL)"
GBM = f"WITH {LOGS}, f AS (SELECT series, avg(r) AS m, var_pop(r) AS v, count(r) AS n FROM r GROUP BY 1) SELECT series, {s9('m + v / 2')} AS drift, {s9('sqrt(v)')} AS volatility, {s9('m - 1.96 * sqrt(v / n)')} AS low, {s9('m + 1.96 * sqrt(v / n)')} AS high FROM f"
JUMPS = f"""WITH {LOGS}, m AS (SELECT series, r, abs(r - avg(r) OVER (PARTITION BY series)) > 2 * stddev_pop(r) OVER (PARTITION BY series) AS j FROM r)
SELECT series, count(*) FILTER (j) AS n_jumps, count(*) FILTER (j AND r > 0) AS n_up, count(*) FILTER (j AND r < 0) AS n_down, {s9("count(*) FILTER (j) / count(*)")} AS share, {s9("avg(CASE WHEN j THEN abs(r) END)")} AS mean_size FROM m GROUP BY 1"""
_chi = lambda x, k: f"least(list_sum(list_transform(range(401), lambda i: CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(sqrt(({x}) / 2) + i * 0.025, {k - 1}) * exp(-pow(sqrt(({x}) / 2) + i * 0.025, 2)))) * {0.025 / 3 * 2 / math.gamma(k / 2)!r}, 1)"
WALK = f"""WITH {BARS}, d AS (SELECT series, ts, row_number() {ROW} AS i, close - lag(close, 1) {ROW} AS d, close - lag(close, 5) {ROW} AS dk FROM bars), v AS (SELECT series, var_pop(CASE WHEN (i - 1) % 5 = 0 THEN dk END) / (5 * var_pop(d)) AS variance_ratio FROM d GROUP BY 1),
c AS (SELECT series, ts, d - avg(d) OVER (PARTITION BY series) AS c FROM d WHERE d IS NOT NULL), p AS (SELECT series, c, {", ".join(f"lag(c, {j}) OVER (PARTITION BY series ORDER BY ts) AS c{j}" for j in range(1, 11))} FROM c),
s AS (SELECT series, count(c) AS n, {", ".join(f"sum(c * c{j}) / sum(c * c) AS a{j}" for j in range(1, 11))} FROM p GROUP BY 1)
SELECT series, {s9("variance_ratio")} AS variance_ratio, {s9("a1")} AS autocorrelation, {", ".join(f"{s9('n * (n + 2) * (' + ' + '.join(f'a{j} * a{j} / (n - {j})' for j in range(1, m + 1)) + ')')} AS q_{m}" for m in (1, 5, 10))}, {", ".join(f"{s9(_chi('n * (n + 2) * (' + ' + '.join(f'a{j} * a{j} / (n - {j})' for j in range(1, m + 1)) + ')', m))} AS p_{m}" for m in (1, 5, 10))} FROM s JOIN v USING (series)"""
HURST = f"""WITH {LOGS}, n AS (SELECT series, r, row_number() {ROW} - 1 AS i FROM r), x AS (SELECT series, r, i, g.range AS lag, i // g.range AS chunk FROM n, range(2, 40) g), f AS (SELECT *, avg(r) OVER c AS m, count(*) OVER c AS k FROM x WINDOW c AS (PARTITION BY series, lag, chunk)),
y AS (SELECT series, lag, chunk, r, sum(r - m) OVER (PARTITION BY series, lag, chunk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM f WHERE k = lag), q AS (SELECT series, lag, (max(y) - min(y)) / nullif(stddev_pop(r), 0) AS rs FROM y GROUP BY series, lag, chunk), b AS (SELECT series, lag, avg(rs) AS rs FROM q WHERE rs > 0 GROUP BY 1, 2)
SELECT series, round(regr_slope(ln(rs), ln(lag)), 6) + 0 AS hurst, round(regr_r2(ln(rs), ln(lag)), 6) + 0 AS r2 FROM b GROUP BY 1"""


# ---- backtest, resampling, models


def signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = backtest.prepared(bars(spark, sf_dir), costs.spread_table(spark), backtest.Config())
    return df.select("series", "ts", r9("atr").alias("atr"), "spread", F.col("signal").cast("int").alias("signal"))


SIGNALS = f"""WITH {ADX_CTE}, g AS (SELECT series, ts, lag(atr, 1) {ROW} AS atr, row_number() {ROW} - 1 AS n, lag(close, 1) {ROW} / lag(close, 2) {ROW} - 1 AS r1, lag(close, 1) {ROW} / lag(close, 6) {ROW} - 1 AS r5 FROM a)
SELECT series, ts, {s9("atr")} AS atr, CAST(1.5 AS DOUBLE) AS spread, CASE WHEN hour(ts) IN (21, 22, 23) OR (isodow(ts) = 5 AND hour(ts) >= 17) OR n < 20 THEN 0 WHEN r1 > 0 AND r5 > 0 THEN 1 WHEN r1 < 0 AND r5 < 0 THEN -1 ELSE 0 END AS signal FROM g"""


def model_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = align.ratio_split(wide(spark, sf_dir).na.drop("any", subset=[*NAMES, "target"]))
    x = learning.assembled(df, NAMES, "target")
    train, test = learning.scaled(x.where("is_train"), x.where("NOT is_train"))
    return train, test


def tree_rows(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = learning.trees(model_table(spark, sf_dir)[0], kind)
        return learning.importances(spark, model, NAMES)

    return query


def sensitivity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 9, 10 and 11 bars against the next return, each judged by its neighbours."""
    w, x = W(), F.col("close")
    names = [f"mean_{n}__close" for n in (9, 10, 11)]
    df = bars(spark, sf_dir).withColumns({f"mean_{n}__close": R.mean(x, n, w) / x for n in (9, 10, 11)} | {"target": features.target(x, 1, "return", w)})
    found = stats.information_coefficient(stats.long(df, names, ["target"]), ["feature"])
    return rounded(robustness.sensitivity(found))


_MEANS = " UNION ALL ".join(f"SELECT 'mean_{n}__close' AS feature, m{n} AS value, target FROM w" for n in (9, 10, 11))
SENSITIVITY = f"""WITH {BARS}, w AS (SELECT {", ".join(f"({full(n, f'avg(close) {over(n)}')}) / close AS m{n}" for n in (9, 10, 11))}, lead(close, 1) {ROW} / close - 1 AS target FROM bars), l AS (SELECT * FROM ({_MEANS}) WHERE value IS NOT NULL AND target IS NOT NULL),
i AS (SELECT feature, CAST(regexp_extract(feature, '[0-9]+') AS INTEGER) AS p, {PEARSON} AS ic FROM l GROUP BY 1), g AS (SELECT b.feature AS base, i.ic FROM i b JOIN i ON i.p BETWEEN CAST(round(b.p * 0.9) AS INTEGER) AND CAST(round(b.p * 1.1) AS INTEGER)),
a AS (SELECT base, count(ic) AS n_variants, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_sd, min(ic) AS ic_min, max(ic) AS ic_max FROM g GROUP BY 1)
SELECT base, n_variants, {s9("ic_mean")} AS ic_mean, {s9("ic_sd")} AS ic_sd, {s9("ic_min")} AS ic_min, {s9("ic_max")} AS ic_max, {s9("abs(ic_sd / ic_mean)")} AS cv, CASE WHEN abs(ic_sd / ic_mean) < 0.2 THEN 'robust' WHEN abs(ic_sd / ic_mean) < 0.5 THEN 'moderate' ELSE 'sensitive' END AS verdict FROM a"""


def temporal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.information_coefficient(screened(daily(spark, sf_dir).withColumn("year", F.year("ts")), ["year"]), ["feature", "year"])
    return rounded(robustness.temporal_class(found, ["feature"]))


TEMPORAL = f"""WITH {DAILY_Y}, {long_sql("dy", "year")}, i AS (SELECT feature, year, CASE WHEN count(*) >= 10 THEN {PEARSON} END AS ic FROM l GROUP BY 1, 2),
a AS (SELECT feature, count(ic) AS n_periods, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_sd, min(ic) AS ic_min, avg(CAST(ic > 0 AS INTEGER)) AS share_positive FROM i GROUP BY 1)
SELECT feature, n_periods, {s9("ic_mean")} AS ic_mean, {s9("ic_sd")} AS ic_sd, {s9("ic_min")} AS ic_min, {s9("share_positive")} AS share_positive, CASE WHEN share_positive >= 0.8 AND coalesce(abs(ic_sd / nullif(ic_mean, 0)), 1) < 0.5 AND ic_min >= -0.02 THEN 'stable' WHEN share_positive >= 0.6 THEN 'moderate' ELSE 'unstable' END AS stability FROM a"""


def consistency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.information_coefficient(screened(bars(spark, sf_dir), ["series"]), ["series", "feature"], least=30)
    return rounded(robustness.series_class(found, ["feature"]))


CONSISTENCY = f"""WITH {BARS}, {long_sql("bars", "series")}, i AS (SELECT series, feature, CASE WHEN count(*) >= 30 THEN {PEARSON} END AS ic FROM l GROUP BY 1, 2),
a AS (SELECT feature, count(ic) AS n_series, avg(ic) AS ic_mean, greatest(avg(CAST(ic > 0 AS INTEGER)), avg(CAST(ic < 0 AS INTEGER))) AS agreement FROM i GROUP BY 1)
SELECT feature, n_series, {s9("ic_mean")} AS ic_mean, {s9("agreement")} AS agreement, CASE WHEN agreement >= 0.8 THEN 'universal' WHEN agreement >= 0.6 THEN 'partial' ELSE 'specific' END AS consistency FROM a"""


def gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robustness.regime_gate(ic_regime(spark, sf_dir), ["feature"], 0.05)
    return out.select("feature", F.col("is_robust").cast("int").alias("is_robust"), "weak_in")


GATE = f"""WITH i AS ({IC_REGIME}) SELECT feature, CAST(bool_and(coalesce(abs(ic) >= 0.05, false)) AS INTEGER) AS is_robust, coalesce(string_agg(CASE WHEN NOT coalesce(abs(ic) >= 0.05, false) THEN regime END, ',' ORDER BY regime), '') AS weak_in FROM i GROUP BY 1"""


def histogram_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.histogram(bars(spark, sf_dir), "close", 10)


HISTOGRAM = f"WITH {BARS}, e AS (SELECT min(close) AS a, max(close) AS b FROM bars) SELECT CAST(least(floor((close - a) * 10 / (b - a)) + 1, 10) AS BIGINT) AS bin, count(*) AS n FROM bars, e GROUP BY 1"


def tensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at which two series both have a sample, with a corner of each and the target."""
    df = bars(spark, sf_dir, "1 hour").withColumn("r", R.ret(F.col("close"), 1, W())).where(F.col("r").isNotNull())
    t = features.series_tensor(features.sequences(df, ["close"], 4, 1, 1, F.col("r")), ["click", "error"], "click")
    return t.select("ts", *(F.round(F.col("x")[s][0][0].cast("double"), 4).alias(f"first_{s}") for s in ("click", "error")), r9("y").alias("y"))


TENSOR = f"""WITH {bars_sql("1 hour")}, r AS (SELECT *, close / lag(close, 1) {ROW} - 1 AS r FROM bars), f AS (SELECT * FROM r WHERE r IS NOT NULL), s AS (SELECT series, ts, row_number() {ROW} AS n, lag(close, 3) {ROW} AS c, lead(r, 1) {ROW} AS y FROM f), k AS (SELECT * FROM s WHERE n >= 4 AND y IS NOT NULL)
SELECT a.ts, round(a.c, 4) + 0 AS first_click, round(b.c, 4) + 0 AS first_error, {s9("a.y")} AS y FROM k a JOIN k b ON a.ts = b.ts AND a.series = 'click' AND b.series = 'error'"""


def wavelet_sql(levels: int = 6) -> str:
    """Level by level: each value and its images beyond the ends, times the filters."""
    size = len(processes.DB4)
    taps = "tp AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in enumerate(zip(reversed(processes.DB4), [v * (-1) ** (k + 1) for k, v in enumerate(processes.DB4)], strict=True))) + ") t(k, lo, hi))"
    steps, energies = [f"l0 AS (SELECT series, row_number() {ROW} - 1 AS i, close AS v, count(*) OVER (PARTITION BY series) AS n FROM bars)"], []
    for j in range(1, levels + 1):
        steps.append(f"p{j} AS (SELECT series, v, n, i AS p FROM l{j - 1} WHERE n >= {size} UNION ALL SELECT series, v, n, -i - 1 FROM l{j - 1} WHERE n >= {size} AND i < {size - 1} UNION ALL SELECT series, v, n, 2 * n - 1 - i FROM l{j - 1} WHERE n >= {size} AND i >= n - {size - 1}), d{j} AS (SELECT series, (p - 1 + k) // 2 AS i, (n + {size - 1}) // 2 AS n, sum(lo * v) AS v, sum(hi * v) AS d FROM p{j}, tp WHERE (p - 1 + k) % 2 = 0 AND p - 1 + k >= 0 AND (p - 1 + k) // 2 < (n + {size - 1}) // 2 GROUP BY 1, 2, 3), l{j} AS (SELECT series, i, v, n FROM d{j})")
        energies += [f"SELECT series, {j} AS level, sum(d * d) AS energy FROM d{j} GROUP BY 1", f"SELECT series, 0, sum(v * v) FROM l{j - 1} WHERE n < {size} GROUP BY 1"]
    energies.append(f"SELECT series, 0, sum(v * v) FROM l{levels} GROUP BY 1")
    return f"WITH {BARS}, {taps}, {', '.join(steps)}, en AS ({' UNION ALL '.join(energies)}) SELECT series, level, round(energy, 7) + 0 AS energy, round(energy / sum(energy) OVER (PARTITION BY series), 7) + 0 AS share FROM en"


LYAPUNOV = f"""WITH {BARS}, e AS (SELECT series, row_number() {ROW} - 1 AS i, close AS a, lead(close, 1) {ROW} AS b, lead(close, 2) {ROW} AS c, lead(close, 10) {ROW} AS la, lead(close, 11) {ROW} AS lb, lead(close, 12) {ROW} AS lc FROM bars), p AS (SELECT * FROM e WHERE lc IS NOT NULL), n AS (SELECT series, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 10), ch AS (SELECT DISTINCT series, CAST(floor(range * n / 50) AS BIGINT) AS i FROM n, range(50)), q AS (SELECT p.* FROM p JOIN ch USING (series, i)),
m AS (SELECT q.series, q.i AS q, arg_min(struct_pack(d := sqrt(pow(q.a - p.a, 2) + pow(q.b - p.b, 2) + pow(q.c - p.c, 2)), later := sqrt(pow(q.la - p.la, 2) + pow(q.lb - p.lb, 2) + pow(q.lc - p.lc, 2))), struct_pack(d := sqrt(pow(q.a - p.a, 2) + pow(q.b - p.b, 2) + pow(q.c - p.c, 2)), i := p.i)) AS x FROM q JOIN p ON p.series = q.series AND abs(p.i - q.i) > 3 GROUP BY 1, 2)
SELECT s.series, round(avg(CASE WHEN x.d > 1e-12 AND x.later > 1e-12 THEN ln(x.later / x.d) / 10 END), 7) + 0 AS exponent FROM (SELECT DISTINCT series FROM bars) s LEFT JOIN m USING (series) GROUP BY 1"""


QUERIES: dict[str, Query] = {
    "parameter_sensitivity": (sensitivity_rows, SENSITIVITY),
    "temporal_stability": (temporal_rows, TEMPORAL),
    "series_agreement": (consistency_rows, CONSISTENCY),
    "regime_gate": (gate_rows, GATE),
    "histogram": (histogram_rows, HISTOGRAM),
    "series_tensor": (tensor_rows, TENSOR),
    "wavelet_energy": (lambda s, d: rounded(processes.wavelet_energy(bars(s, d)), 7), wavelet_sql()),
    "lyapunov": (lambda s, d: rounded(processes.lyapunov(bars(s, d)), 7), LYAPUNOV),
    "ic_pearson": (ic(["feature"], [], "pearson"), ic_sql(["feature"], "series", "pearson")),
    "ic_spearman": (ic(["feature"], [], "spearman"), ic_sql(["feature"], "series", "spearman")),
    "ic_by_series": (ic(["series", "feature"], ["series"], "spearman"), ic_sql(["series", "feature"], "series", "spearman")),
    "ic_by_year": (ic(["feature", "year"], ["year"], "pearson", daily), ic_sql(["feature", "year"], "year", "pearson", DAILY_Y, "dy")),
    "ic_by_period": (ic_period, IC_PERIOD),
    "ic_by_regime": (ic_regime, IC_REGIME),
    "ic_stability": (ic_stability, IC_STABILITY),
    "ic_significance": (ic_significance, IC_SIGNIFICANCE),
    "binned_mi": (binned_mi, f"WITH {BARS}, {mi_sql(long_sql('bars', 'series'), 'feature')}"),
    "lagged_mi": (lagged_mi, mi_sql(LAGGED, "series")),
    "corr_pairs": (corr_pairs, f"WITH {BARS}, {COMPLETE}, p AS ({PAIR_ROWS}) SELECT a, b, {s9('r')} AS r FROM p"),
    "network_degree": (network, NETWORK),
    "topk_per_method": (ranked, f"WITH {RANKED} SELECT method, feature, score, CAST(rank AS INTEGER) AS rank FROM r"),
    "votes": (lambda s, d: voted(s, d).select("feature", "n_methods", F.array_join("methods", ",").alias("methods"), "category"), f"WITH {VOTES} SELECT feature, n_methods, array_to_string(methods, ',') AS methods, category FROM c"),
    "consensus_checks": (approved, CHECKS),
    "consensus_table": (consensus_rows, CONSENSUS),
    "spread_join": (spread_join, SPREAD_JOIN),
    "slippage_cost": (slippage_rows, SLIPPAGE),
    "rule_votes": (rule_votes, RULE_VOTES),
    "position_sizes": (sizes, SIZES),
    "drawdown": (drawdown_rows, DRAWDOWN),
    "return_metrics": (metric_rows, METRICS),
    "ou_fit": (lambda s, d: rounded(processes.ornstein_uhlenbeck(bars(s, d))), OU),
    "gbm_fit": (lambda s, d: rounded(processes.geometric_brownian(bars(s, d))), GBM),
    "jumps": (lambda s, d: rounded(processes.jumps(bars(s, d), threshold=2.0)), JUMPS),
    "variance_ratio": (lambda s, d: rounded(processes.random_walk(bars(s, d))), WALK),
    "hurst": (lambda s, d: rounded(processes.hurst(bars(s, d), high=40), 6), HURST),
    "backtest_signals": (signal_rows, SIGNALS),
    "forest_importance": (tree_rows("forest"), None),
    "boosting_importance": (tree_rows("boosting"), None),
}
