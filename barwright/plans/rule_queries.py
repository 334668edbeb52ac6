"""Queries of costs, rules, redundancy and splits over what the tables hold: spreads at the hours of bars, swaps and costs of positions that bars open, rules from coefficients of features of bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import rolling as R
from barwright.operators import align, costs, features, rules, stats
from barwright.plans.analysis_queries import PEARSON, SPREAD_CTE
from barwright.plans.bar_queries import BARS, ROW, Query, W, bars, bars_sql, daily, full, over, pos_sql, r9, s9, z_sql

# ---- costs

#: Event types stand for currency pairs.
PAIR_OF = {"click": "EUR_USD", "view": "GBP_USD", "purchase": "USD_JPY", "signup": "EUR_JPY", "error": "GBP_JPY"}


def as_pairs(df: DataFrame) -> DataFrame:
    """Bars of event types as those of currency pairs."""
    to = F.create_map(*(F.lit(x) for kv in PAIR_OF.items() for x in kv))
    return df.withColumn("series", F.coalesce(to[F.col("series")], F.col("series")))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with hour, weekday and the spread that holds then."""
    df = costs.with_spread(as_pairs(bars(spark, sf_dir, "1 hour")), costs.spread_table(spark))
    return df.select(F.col("series").alias("pair"), "ts", "open", "high", "low", "close", "volume", F.hour("ts").alias("hour_utc"), F.weekday("ts").alias("day_of_week"), F.col("spread").alias("spread_pips"))


_PAIR = "CASE series " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PAIR_OF.items()) + " ELSE series END"
OBSERVED = f"{SPREAD_CTE}, {bars_sql('1 hour')}, pb AS (SELECT {_PAIR} AS pair, ts, open, high, low, close, volume, CAST(hour(ts) AS INTEGER) AS hour_utc, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM bars), ob AS (SELECT pb.*, coalesce(sp.spread_pips, 1.5) AS spread_pips FROM pb LEFT JOIN sp USING (pair, hour_utc, day_of_week))"
_USD = "CASE WHEN contains(pair, 'JPY') THEN 9.0 ELSE 10.0 END"


def spread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreads of the hours in which there were bars, and of how many."""
    usd = costs.in_usd(F.col("spread_pips"), F.lit(1.0), F.col("pair")).alias("spread_usd_per_lot")
    return observed(spark, sf_dir).groupBy("pair", "hour_utc", "day_of_week", "spread_pips").agg(F.count(F.lit(1)).alias("n_bars")).select("pair", "hour_utc", "day_of_week", "spread_pips", usd, "n_bars")


SPREADS = f"WITH {OBSERVED} SELECT pair, hour_utc, day_of_week, spread_pips, round(spread_pips * {_USD}, 2) AS spread_usd_per_lot, count(*) AS n_bars FROM ob GROUP BY pair, hour_utc, day_of_week, spread_pips"
SUMMARY = f"WITH {OBSERVED} SELECT pair, round(min(spread_pips), 2) AS lowest, round(avg(spread_pips) + 0, 2) AS mean, round(max(spread_pips), 2) AS highest FROM ob GROUP BY 1"


def spread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.spread_summary(observed(spark, sf_dir))


def spread_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = costs.spread_by_hour(observed(spark, sf_dir))
    return out.select("hour_utc", *(r9(str(d)).alias(f"d{d}") for d in range(5)))


PIVOT = f"WITH {OBSERVED} SELECT hour_utc, {', '.join(f'{s9(f"avg(CASE WHEN day_of_week = {d} THEN spread_pips END)")} AS d{d}' for d in range(5))} FROM ob GROUP BY 1"


def best_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole weeks alone, so that every hour has the same weekdays behind it."""
    weekdays = observed(spark, sf_dir).where("day_of_week < 5").select("pair", "hour_utc", "day_of_week", "spread_pips").distinct()
    whole = weekdays.groupBy("pair", "hour_utc").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.round(F.col("spread_pips") * 10).cast("bigint")).alias("spread_pips")).where("_n = 5")
    return costs.best_hours(whole)


HOURS = f"WITH {OBSERVED}, d AS (SELECT DISTINCT pair, hour_utc, day_of_week, spread_pips FROM ob WHERE day_of_week < 5), m AS (SELECT pair, hour_utc, sum(CAST(round(spread_pips * 10) AS BIGINT)) AS m FROM d GROUP BY 1, 2 HAVING count(*) = 5) SELECT pair, arg_min(hour_utc, m * 100 + hour_utc) AS best_hour, arg_max(hour_utc, m * 100 - hour_utc) AS worst_hour FROM m GROUP BY 1"

HELD = 10


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each bar a position of its volume in lots, in its direction, held over ten bars."""
    df = as_pairs(bars(spark, sf_dir)).withColumn("nights", F.coalesce(F.datediff(F.lead("ts", HELD).over(W()), "ts"), F.lit(0)))
    df = df.join(costs.swap_rates(spark), F.col("series") == F.col("pair")).withColumn("direction", F.when(F.col("close") >= F.col("open"), "long").otherwise("short"))
    return df.withColumn("rate", F.when(F.col("direction") == "long", F.col("swap_long")).otherwise(F.col("swap_short")))


def swap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    return p.select("pair", "ts", "direction", "nights", costs.swap(F.col("rate"), F.col("volume"), F.col("nights"), F.weekday("ts")).alias("swap_usd"))


RATES = "rt AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in costs.SWAP.items()) + ") t(pair, swap_long, swap_short))"
POSITIONS = f"{BARS}, {RATES}, ps AS (SELECT {_PAIR} AS pair, ts, volume, CAST(isodow(ts) - 1 AS INTEGER) AS open_day, CASE WHEN close >= open THEN 'long' ELSE 'short' END AS direction, coalesce(CAST(CAST(lead(ts, {HELD}) {ROW} AS DATE) - CAST(ts AS DATE) AS INTEGER), 0) AS nights FROM bars), po AS (SELECT ps.*, CASE direction WHEN 'long' THEN swap_long ELSE swap_short END AS rate, swap_long, swap_short FROM ps JOIN rt USING (pair))"
_TRIPLE = "CASE WHEN (7 - open_day % 5) % 5 < nights THEN 2 ELSE 0 END"
SWAP = f"WITH {POSITIONS} SELECT pair, ts, direction, nights, round(rate * volume * (nights + {_TRIPLE}), 2) + 0 AS swap_usd FROM po"


def swap_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the pairs that there are positions in, and how many there are on each side."""
    return positions(spark, sf_dir).groupBy("pair", "swap_long", "swap_short").agg(F.count_if(F.col("direction") == "long").alias("n_long"), F.count_if(F.col("direction") == "short").alias("n_short"))


SWAPS = f"WITH {POSITIONS} SELECT pair, swap_long, swap_short, count(*) FILTER (direction = 'long') AS n_long, count(*) FILTER (direction = 'short') AS n_short FROM po GROUP BY 1, 2, 3"


def total_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of each hourly bar's volume in lots, bought and held for a night; slippage by the bar's range against the pair's mean range."""
    from pyspark.sql import Window

    s = observed(spark, sf_dir).join(costs.swap_rates(spark), "pair").withColumn("usual", F.avg(F.col("high") - F.col("low")).over(Window.partitionBy("pair")))
    lots = F.col("volume")
    s = s.withColumns({"spread_usd": costs.in_usd(F.col("spread_pips"), lots, F.col("pair")), "slippage_usd": costs.in_usd(costs.slippage(F.col("high") - F.col("low"), F.col("usual")), lots, F.col("pair")), "swap_usd": costs.swap(F.col("swap_long"), lots, F.lit(1), F.col("day_of_week")), "commission_usd": costs.commission(lots, 3.5)})
    return s.select("pair", "ts", "spread_usd", "slippage_usd", "swap_usd", "commission_usd", F.round(costs.total_cost(F.col("spread_usd"), F.col("slippage_usd"), F.col("swap_usd"), F.col("commission_usd")), 2).alias("total"))


TOTAL_COSTS = f"""WITH {OBSERVED}, {RATES}, q AS (SELECT ob.*, swap_long, day_of_week AS open_day, 1 AS nights, (high - low) / nullif(avg(high - low) OVER (PARTITION BY pair), 0) AS q FROM ob JOIN rt USING (pair)),
c AS (SELECT pair, ts, round(spread_pips * {_USD} * volume, 2) AS spread_usd, round(greatest(0.2, least(0.3 * (1 + 0.5 * (coalesce(q, 1) - 1)), 3.0)) * {_USD} * volume, 2) AS slippage_usd, round(swap_long * volume * (nights + {_TRIPLE}), 2) + 0 AS swap_usd, round(volume * 3.5, 2) AS commission_usd FROM q)
SELECT *, round(spread_usd + slippage_usd + abs(least(swap_usd, 0)) + commission_usd, 2) AS total FROM c"""

# ---- rules, from the coefficients of named features

TURN = 2 * math.pi / 24


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, ic, signal: the coefficient over all bars; the side that the feature speaks for among clicks."""
    x, w = F.col("close"), W()
    made = {"R_1_C": R.ret(x, 1, w), "R_24_C_minus_R_96_C": R.ret(x, 24, w) - R.ret(x, 96, w), "Pos_20_C": R.position(x, 20, w), "sigma_10_C_div_sigma_50_C": F.try_divide(R.sd(x, 10, w), R.sd(x, 50, w)), "hour_sin_times_R_4_C": F.sin(F.hour("ts") * TURN) * R.ret(x, 4, w), "Z_50_C": R.zscore(x, 50, w), "mu_20_C": R.mean(x, 20, w), "target": features.target(x, 1, "return", w)}
    rows = stats.long(bars(spark, sf_dir).withColumns(made), list(made)[:-1], ["series", "target"]).where(F.col("value").isNotNull() & F.col("target").isNotNull())
    own = F.when(F.col("series") == "click", F.col("value"))
    return rows.groupBy("feature").agg(stats.pearson("value", "target").alias("ic"), F.covar_samp(own, "target").alias("_c")).select("feature", "ic", F.when(F.col("_c") > 0, "Long").otherwise("Short").alias("signal"))


_RET = lambda n: f"(close / nullif(lag(close, {n}) {ROW}, 0) - 1)"
_SD = lambda n: full(n, f"stddev_samp(close) {over(n)}")
NAMED_SQL = {"R_1_C": _RET(1), "R_24_C_minus_R_96_C": f"{_RET(24)} - {_RET(96)}", "Pos_20_C": pos_sql("close", 20), "sigma_10_C_div_sigma_50_C": f"({_SD(10)}) / nullif({_SD(50)}, 0)", "hour_sin_times_R_4_C": f"sin(hour(ts) * {TURN!r}::DOUBLE) * {_RET(4)}", "Z_50_C": z_sql("close", 50), "mu_20_C": full(20, f"avg(close) {over(20)}")}
NAMED = f"""{BARS}, nw AS (SELECT series, {", ".join(f"{v} AS {k}" for k, v in NAMED_SQL.items())}, lead(close, 1) {ROW} / close - 1 AS target FROM bars),
nl AS (FROM nw UNPIVOT (value FOR feature IN ({", ".join(NAMED_SQL)}))), f AS (SELECT feature, {PEARSON} AS ic, CASE WHEN covar_samp(CASE WHEN series = 'click' THEN value END, target) > 0 THEN 'Long' ELSE 'Short' END AS signal FROM nl WHERE value IS NOT NULL AND target IS NOT NULL GROUP BY 1)"""


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.entry_rules(named(spark, sf_dir))
    return out.select("feature", "component", "operator", "threshold", rules.pattern(F.col("feature"), F.col("ic")).alias("pattern"), rules.period(F.col("feature")).alias("period"))


_COMPONENT = "CASE WHEN contains(feature, 'Pos') THEN 'position' WHEN contains(feature, 'minus') OR contains(feature, '-') THEN 'difference' WHEN contains(feature, 'div') OR contains(feature, '/') THEN 'ratio' WHEN contains(feature, 'times') OR contains(feature, '*') THEN 'product' WHEN contains(feature, 'R_1') THEN 'immediate momentum' WHEN contains(feature, 'R') THEN 'momentum' WHEN contains(feature, 'sigma') THEN 'volatility' WHEN contains(feature, 'mu') THEN 'mean' ELSE 'complex' END"
_KIND = "CASE WHEN ic <= 0 AND regexp_matches(lower(feature), 'pos|z|rank') THEN 'mean reversion' WHEN ic > 0 AND regexp_matches(lower(feature), 'r|delta') THEN 'momentum' WHEN contains(lower(feature), 'sigma') THEN 'volatility' WHEN regexp_matches(lower(feature), 'hour|day|month') THEN 'seasonality' WHEN regexp_matches(lower(feature), 'minus|-|diff') THEN 'difference of scales' WHEN regexp_matches(lower(feature), 'div|/|ratio') THEN 'relative level' ELSE 'complex' END"
RULES = f"""WITH {NAMED} SELECT feature, {_COMPONENT} AS component, CASE WHEN (ic > 0) = (signal = 'Long') THEN '>' ELSE '<' END AS operator,
CAST(CASE WHEN contains(feature, 'Pos') THEN CASE WHEN ic > 0 THEN 0.7 ELSE 0.3 END WHEN contains(feature, 'R_1') THEN 0 WHEN contains(feature, 'minus') OR contains(feature, 'diff') THEN 0 WHEN contains(feature, 'div') OR contains(feature, 'ratio') THEN CASE WHEN contains(feature, 'sigma') THEN CASE WHEN ic > 0 THEN 1.2 ELSE 0.8 END ELSE 1 END WHEN contains(feature, 'sigma') THEN 0 WHEN contains(feature, 'Z') THEN CASE WHEN ic > 0 THEN 1 ELSE -1 END ELSE 0 END AS DOUBLE) AS threshold,
{_KIND} AS pattern, TRY_CAST(nullif(regexp_extract(feature, '[0-9]+'), '') AS INTEGER) AS period FROM f"""


def weight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.weights(named(spark, sf_dir)).select("feature", "signal", r9("weight").alias("weight"), r9("signed_weight").alias("signed_weight"))


WEIGHTS = f"WITH {NAMED} SELECT feature, signal, {s9('abs(ic) / sum(abs(ic)) OVER ()')} AS weight, {s9('CASE signal WHEN ' + chr(39) + 'Short' + chr(39) + ' THEN -1 ELSE 1 END * abs(ic) / sum(abs(ic)) OVER ()')} AS signed_weight FROM f"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, name = named(spark, sf_dir), F.col("feature")
    return df.select("feature", rules.in_words(name).alias("words"), rules.interpretation(name, F.col("ic")).alias("text"), F.array_join(F.transform(rules.parameters(name), lambda x: x.cast("string")), ",").alias("parameters"))


def words_sql() -> str:
    x = "replace(feature, '_', ' ')"
    for part, word in rules.WORDS:
        x = f"replace({x}, '{part}', '{word}')"
    return f"WITH {NAMED} SELECT feature, {x} AS words, {_KIND} || ': ' || {x} || ' speaks for ' || CASE WHEN ic > 0 THEN 'higher' ELSE 'lower' END || ' prices' AS text, array_to_string(list_transform(regexp_extract_all(feature, '[0-9]+'), lambda y: CAST(CAST(y AS INTEGER) AS VARCHAR)), ',') AS parameters FROM f"


def component_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).groupBy(rules.component_type(F.col("feature")).alias("component")).agg(F.count(F.lit(1)).alias("n"))


COMPONENTS = f"WITH {NAMED} SELECT {_COMPONENT} AS component, count(*) AS n FROM f GROUP BY 1"


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.strategy_summary(named(spark, sf_dir)).withColumn("value", r9("value"))


STRATEGY = f"WITH {NAMED} SELECT * FROM (SELECT 'long rules' AS part, CAST(count(*) FILTER (signal = 'Long') AS DOUBLE) AS value FROM f UNION ALL SELECT 'short rules', CAST(count(*) FILTER (signal = 'Short') AS DOUBLE) FROM f UNION ALL SELECT * FROM (VALUES ('base size %', 2.0::DOUBLE), ('largest size %', 10.0), ('risk a trade %', 1.0), ('stop in ATR', 2.0), ('target in ATR', 3.0), ('reward to risk', 1.5), ('timeout in bars', 50.0)) t(part, value))"

# ---- redundancy, counts, splits

ALIKE = ["mean_18", "mean_19", "mean_20", "mean_22", "sd_10", "sd_11", "sd_20", "ret_5"]


def alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = F.col("close"), W()
    of = {"mean": R.mean, "sd": R.sd, "ret": R.ret}
    return bars(spark, sf_dir).withColumns({c: of[c.split("_")[0]](x, int(c.split("_")[1]), w) for c in ALIKE} | {"target": features.target(x, 1, "return", w)})


def not_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of bars, of which some are nearly the same: of each pair in order the one with the smaller coefficient goes, unless one of them has gone before."""
    df = alike(spark, sf_dir)
    scores = stats.information_coefficient(stats.long(df, ALIKE, ["target"]), ["feature"]).select("feature", F.col("ic").alias("score"))
    return stats.redundancy(stats.correlation_pairs(df, ALIKE), scores, 0.9).select("feature", F.col("kept").cast("int").alias("kept"))


_OF = {"mean": lambda n: full(n, f"avg(close) {over(n)}"), "sd": _SD, "ret": _RET}
_ALIKE = {c: _OF[c.split("_")[0]](int(c.split("_")[1])) for c in ALIKE}
NOT_REDUNDANT = f"""WITH RECURSIVE {BARS}, w AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _ALIKE.items())}, lead(close, 1) {ROW} / close - 1 AS target FROM bars), c AS (SELECT * FROM w WHERE {" AND ".join(f"{k} IS NOT NULL" for k in ALIKE)}),
p AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0) AS r FROM c" for i, a in enumerate(ALIKE) for b in ALIKE[i + 1 :])}),
l AS (FROM w UNPIVOT (value FOR feature IN ({", ".join(ALIKE)}))), s AS (SELECT feature, {PEARSON} AS score FROM l WHERE value IS NOT NULL AND target IS NOT NULL GROUP BY 1),
o AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS i FROM p WHERE abs(r) > 0.9),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS gone UNION ALL SELECT o.i, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, CASE WHEN abs(x.score) < abs(y.score) THEN a ELSE b END) END FROM g JOIN o ON o.i = g.i + 1 JOIN s x ON x.feature = a JOIN s y ON y.feature = b)
SELECT feature, CAST(NOT list_contains((SELECT gone FROM g ORDER BY i DESC LIMIT 1), feature) AS INTEGER) AS kept FROM s"""


def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features each level has; the sixth is of the pairs of the series that there are."""
    return features.counted_levels(bars(spark, sf_dir))


_LEVELS = {"level1": 560, "level2": 182, "level3": 14, "level4": 16, "level5": 10, "level6": 0}
COUNTS = f"WITH n AS (SELECT count(DISTINCT event_type) AS n FROM events) SELECT level, CASE WHEN level = 'level6' THEN n * (n - 1) // 2 * 40 ELSE c END AS n FROM n, (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, CAST({v} AS BIGINT))' for k, v in _LEVELS.items())}) t(level, c)"


def division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of the daily bars, cut at month ends."""
    a, b = (x.isoformat() for x in daily(spark, sf_dir).agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first())  # two days
    return spark.createDataFrame(align.split_info(a, b), "part STRING, first STRING, last STRING, days INT, share DOUBLE")


DIVISION = """WITH d AS (SELECT min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem),
e AS (SELECT a, b, CAST(date_trunc('month', a + CAST(floor((b - a) * 0.6) AS INTEGER)) AS DATE) - 1 AS t, CAST(date_trunc('month', a + CAST(floor((b - a) * (0.6::DOUBLE + 0.2::DOUBLE)) AS INTEGER)) AS DATE) - 1 AS v FROM d),
p AS (SELECT 'total' AS part, a AS x, b AS y, 1.0::DOUBLE AS share FROM e UNION ALL SELECT 'train', a, t, 0.6 FROM e UNION ALL SELECT 'validation', t + 1, v, 0.2 FROM e UNION ALL SELECT 'test', v + 1, b, 0.2 FROM e)
SELECT part, CAST(x AS VARCHAR) AS first, CAST(y AS VARCHAR) AS last, CAST(y - x AS INTEGER) AS days, share FROM p"""


QUERIES: dict[str, Query] = {
    "spread_table": (spread_rows, SPREADS),
    "spread_summary": (spread_summary, SUMMARY),
    "spread_pivot": (spread_pivot, PIVOT),
    "best_hours": (best_hours, HOURS),
    "swap_cost": (swap_rows, SWAP),
    "swap_rates": (swap_rates, SWAPS),
    "total_costs": (total_costs, TOTAL_COSTS),
    "entry_rules": (rule_rows, RULES),
    "weights": (weight_rows, WEIGHTS),
    "feature_words": (words, words_sql()),
    "component_counts": (component_counts, COMPONENTS),
    "strategy_summary": (summary, STRATEGY),
    "collinearity_filter": (not_redundant, NOT_REDUNDANT),
    "feature_counts": (feature_counts, COUNTS),
    "split_info": (division, DIVISION),
}
