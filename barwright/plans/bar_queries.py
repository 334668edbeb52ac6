"""Queries over bars derived from the event and shipment tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import rolling as R
from barwright.functions.ema import with_ema
from barwright.operators import align, features, normalise, regimes
from barwright.functions.blocks import by_blocks
from barwright.sources import bars as B

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, every: str = "4 hours") -> DataFrame:
    return B.event_bars(read(spark, sf_dir, "events"), every)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.daily_bars(read(spark, sf_dir, "lineitem"))


def bars_sql(every: str = "4 hours", name: str = "bars") -> str:
    p = "(1 + value / 100)"
    return f"{name} AS (SELECT event_type AS series, time_bucket(INTERVAL '{every}', ts) AS ts, arg_min({p}, ts) AS open, max({p}) AS high, min({p}) AS low, arg_max({p}, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"


BARS = bars_sql()
DAILY = """daily AS (SELECT l_returnflag AS series, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, arg_min(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""
BY = "PARTITION BY series ORDER BY ts"


def over(n: int | None = None, last: str = "CURRENT ROW") -> str:
    """A frame of the last n rows, or of all so far; without one for lag and lead."""
    return f"OVER ({BY} ROWS BETWEEN {'UNBOUNDED' if n is None else n - 1} PRECEDING AND {last})"


ROW = f"OVER ({BY})"


def r9(x: Column | str) -> Column:
    """Nine decimals, so that the order of a sum is of no account."""
    return F.round(F.col(x) if isinstance(x, str) else x, 9)


def s9(x: str) -> str:
    return f"(round({x}, 9) + 0)"


def full(n: int, value: str, x: str = "close") -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {value} END"


N = 20
MEAN, SD = (full(N, f"{f}(close) {over(N)}") for f in ("avg", "stddev_samp"))
HIGH, LOW = (full(N, f"{f}(close) {over(N)}") for f in ("max", "min"))


def z_sql(x: str, n: int) -> str:
    sd = f"stddev_samp({x}) {over(n)}"
    return full(n, f"({x} - avg({x}) {over(n)}) / CASE WHEN {sd} = 0 THEN 1e-10 ELSE {sd} END", x)


def pos_sql(x: str, n: int) -> str:
    low, high = f"min({x}) {over(n)}", f"max({x}) {over(n)}"
    return full(n, f"({x} - {low}) / CASE WHEN {high} - {low} = 0 THEN 1e-10 ELSE {high} - {low} END", x)


def rolling(column: Callable[[Column], Column], sql: str, source: str = "bars") -> Query:
    """One operator over the close."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = bars(spark, sf_dir)
        return df.select("series", "ts", r9(column(F.col("close"))).alias("value"))

    return query, f"WITH {BARS} SELECT series, ts, {s9(sql)} AS value FROM {source}"


W = R.series_window


def many(columns: Callable[[DataFrame], DataFrame], sql: dict[str, str], ctes: str = BARS, source: str = "bars", every: str = "4 hours", where: str = "", rounded: bool = True) -> Query:
    """Several columns by name over bars; columns() adds them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = columns(bars(spark, sf_dir, every))
        return df.select("series", "ts", *(r9(c).alias(c) if rounded else F.col(c) for c in sql))

    picked = ", ".join(f"{s9(x) if rounded else x} AS {c}" for c, x in sql.items())
    return query, f"WITH {ctes} SELECT series, ts, {picked} FROM {source} {where}"


def plain_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("series", "ts", *(r9(c).alias(c) for c in B.OHLCV))


def plain_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select("series", F.col("ts").cast("timestamp_ntz").alias("ts"), *(r9(c).alias(c) for c in B.OHLCV))


OHLCV_SQL = ", ".join(f"{s9(c)} AS {c}" for c in B.OHLCV)


def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ema(bars(spark, sf_dir), "close", N, "value").select("series", "ts", r9("value").alias("value"))


EMA_SQL = f"""WITH RECURSIVE {BARS}, b AS (SELECT series, ts, close, row_number() {ROW} AS i FROM bars),
e AS (SELECT series, ts, i, close AS y FROM b WHERE i = 1 UNION ALL SELECT b.series, b.ts, b.i, (2.0 / 21) * b.close + (1 - 2.0 / 21) * e.y FROM e JOIN b ON b.series = e.series AND b.i = e.i + 1)
SELECT series, ts, {s9("y")} AS value FROM e"""


def with_columns(columns: Callable[[], dict[str, Column]]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns(columns())


SPAN = "(high - low)"
RATIOS = {"c_o_ratio": "close / open", "h_l_ratio": "high / low", "c_h_ratio": "close / high", "c_l_ratio": "close / low"} | {k: f"CASE WHEN high - low <> 0 THEN ({x}) / {SPAN} ELSE 0 END" for k, x in (("cl_hl_ratio", "close - low"), ("hc_hl_ratio", "high - close"), ("co_hl_ratio", "close - open"))}
DIFFS = {"h_l_diff": "high - low", "c_o_diff": "close - open", "h_c_diff": "high - close", "c_l_diff": "close - low"}
MEANS = {"hl2": "(high + low) / 2", "hlc3": "(high + low + close) / 3", "ohlc4": "(open + high + low + close) / 4"}
DOW = "(isodow(ts) - 1)"
CYCLES = {f"{k}_{f}": f"{f}(2 * pi() * {x} / {n})" for k, x, n in (("hour", "hour(ts)", 24), ("dow", DOW, 5), ("month", "month(ts)", 12)) for f in ("sin", "cos")}
FLAGS = {"is_monday": f"CAST({DOW} = 0 AS INTEGER)", "is_friday": f"CAST({DOW} = 4 AS INTEGER)", "is_month_start": "CAST(day(ts) <= 5 AS INTEGER)", "is_month_end": "CAST(day(ts) >= 25 AS INTEGER)"}


def planned(levels: tuple[int, ...], names: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: features.add_features(df, features.FeaturePlan(windows=(5, 20), variables=("close",), levels=levels))


def compositions_sql() -> str:
    inner = f"SELECT *, {MEAN} AS m20, {full(10, f'avg(close) {over(10)}')} AS m10, {SD} AS s20, {z_sql('close', 20)} AS z20, close - lag(close, 1) {ROW} AS d1, close / lag(close, 1) {ROW} - 1 AS r1 FROM bars"
    columns = {"z_20__mean_10__close": z_sql("m10", 20), "pos_50__sd_20__close": pos_sql("s20", 50), "d1__mean_20__close": f"m20 - lag(m20, 1) {ROW}", "d2__z_20__close": f"z20 - 2 * lag(z20, 1) {ROW} + lag(z20, 2) {ROW}", "z_20__delta_1__close": z_sql("d1", 20), "pos_20__ret_1__close": pos_sql("r1", 20)}
    return f"WITH {BARS}, c AS ({inner}) SELECT series, ts, {', '.join(f'{s9(x)} AS {k}' for k, x in columns.items())} FROM c"


def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["z_20__mean_10__close", "pos_50__sd_20__close", "d1__mean_20__close", "d2__z_20__close", "z_20__delta_1__close", "pos_20__ret_1__close"]
    df = features.add_features(bars(spark, sf_dir), features.FeaturePlan(levels=(3,)))
    return df.select("series", "ts", *(r9(c).alias(c) for c in names))


def pair_sql() -> dict[str, str]:
    m = {n: full(n, f"avg(close) {over(n)}") for n in (5, 20)}
    s = {n: full(n, f"stddev_samp(close) {over(n)}") for n in (5, 20)}
    return {"mean_5_mean_20_ratio": f"({m[5]}) / ({m[20]})", "mean_5_mean_20_diff": f"({m[5]}) - ({m[20]})", "sd_5_sd_20_ratio": f"({s[5]}) / (({s[20]}) + 1e-10)"}


def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels 1 to 5 with a few windows: the wide table."""
    return features.add_features(bars(spark, sf_dir), features.FeaturePlan(windows=(5, 20)))


# ---- targets, normalisers, regimes


def before(n: int) -> str:
    return f"OVER ({BY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def pit(n: int, value: str) -> str:
    return f"CASE WHEN count(close) {before(n)} = {n} THEN {value} END"


PIT_RANK = f"""WITH {BARS}, l AS (SELECT *, list(close) {before(N)} AS v, lag(close, 1) {ROW} AS p FROM bars)
SELECT series, ts, {s9(f"CASE WHEN len(v) = {N} THEN (len(list_filter(v, lambda x: x < p)) + (len(list_filter(v, lambda x: x = p)) + 1) / 2.0) / {N} END")} AS value FROM l"""
EXPANDING = f"OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
TR = f"greatest(high - low, abs(high - lag(close, 1) {ROW}), abs(low - lag(close, 1) {ROW}))"
ATR_CTE = f"{BARS}, t AS (SELECT *, {TR} AS tr FROM bars), a AS (SELECT *, CASE WHEN count(tr) {over(14)} = 14 THEN avg(tr) {over(14)} END AS atr FROM t)"
ADX_CTE = f"""{ATR_CTE},
m AS (SELECT *, CASE WHEN lag(close, 1) {ROW} IS NOT NULL THEN greatest(high - lag(high, 1) {ROW}, 0) END AS u, CASE WHEN lag(close, 1) {ROW} IS NOT NULL THEN greatest(lag(low, 1) {ROW} - low, 0) END AS d FROM a),
k AS (SELECT *, CASE WHEN u >= d THEN u WHEN u IS NOT NULL THEN 0 END AS up, CASE WHEN d > u THEN d WHEN d IS NOT NULL THEN 0 END AS dn FROM m),
i AS (SELECT *, 100 * (CASE WHEN count(up) {over(14)} = 14 THEN avg(up) {over(14)} END) / nullif(atr, 0) AS pdi, 100 * (CASE WHEN count(dn) {over(14)} = 14 THEN avg(dn) {over(14)} END) / nullif(atr, 0) AS mdi FROM k),
x AS (SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + 1e-10) AS dx FROM i),
adx AS (SELECT *, CASE WHEN count(dx) {over(14)} = 14 THEN avg(dx) {over(14)} END AS adx FROM x)"""


def regime_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regimes.with_regimes(bars(spark, sf_dir), W())
    return df.select("series", "ts", r9("atr_pct").alias("atr_pct"), *(F.col(c).cast("int").alias(c) for c in ("is_trending", "is_ranging", "is_high_vol", "is_low_vol")))


REGIME_SQL = f"""WITH {ADX_CTE}, p AS (SELECT *, atr / nullif(close, 0) * 100 AS atr_pct FROM adx), q AS (SELECT series, quantile_cont(atr_pct, 0.75) AS hi, quantile_cont(atr_pct, 0.25) AS lo FROM p GROUP BY 1)
SELECT series, ts, {s9("atr_pct")} AS atr_pct, CAST(coalesce(adx > 25, false) AS INTEGER) AS is_trending, CAST(coalesce(adx < 20, false) AS INTEGER) AS is_ranging, CAST(coalesce(atr_pct > hi, false) AS INTEGER) AS is_high_vol, CAST(coalesce(atr_pct < lo, false) AS INTEGER) AS is_low_vol FROM p JOIN q USING (series)"""


# ---- alignment


def grid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.on_grid(bars(spark, sf_dir, "1 hour"), "1 HOUR", ["close", "volume"], 2).select("series", "ts", r9("close").alias("close"), "volume")


GRID = f"""{bars_sql("1 hour")}, e AS (SELECT series, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1), g AS (SELECT series, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM e), j AS (SELECT g.series, g.ts, close, volume FROM g LEFT JOIN bars USING (series, ts))"""
FILL = "last_value({0} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
GRID_SQL = f"WITH {GRID} SELECT series, ts, {s9(FILL.format('close'))} AS close, {FILL.format('volume')} AS volume FROM j"


def empty_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir, "15 minutes")
    grid = align.time_grid(df, "15 MINUTES").join(df, ["series", "ts"], "left")
    return align.drop_empty_times(grid).select("series", "ts", r9("close").alias("close"))


EMPTY_SQL = f"""WITH {bars_sql("15 minutes")}, e AS (SELECT series, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1), g AS (SELECT series, unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS ts FROM e), j AS (SELECT g.series, g.ts, close FROM g LEFT JOIN bars USING (series, ts))
SELECT series, ts, {s9("close")} AS close FROM j QUALIFY max(CASE WHEN close IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ts) = 1"""


def as_of_query(spark: SparkSession, sf_dir: str, block: str | None = None) -> DataFrame:
    fast, slow = bars(spark, sf_dir, "1 hour"), bars(spark, sf_dir, "1 day")
    return align.as_of(fast, slow, ["close", "high"], "7 DAYS", "d_", block=block).select("series", "ts", r9("close").alias("close"), r9("d_close").alias("d_close"), r9("d_high").alias("d_high"))


AS_OF_SQL = f"""WITH {bars_sql("1 hour", "f")}, {bars_sql("1 day", "s")}
SELECT f.series, f.ts, {s9("f.close")} AS close, {s9("CASE WHEN s.ts >= f.ts - INTERVAL 7 DAY THEN s.close END")} AS d_close, {s9("CASE WHEN s.ts >= f.ts - INTERVAL 7 DAY THEN s.high END")} AS d_high FROM f ASOF LEFT JOIN s ON f.series = s.series AND f.ts >= s.ts"""


def as_of_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As as_of_query, but a day's bar is known only when the day is over."""
    fast, slow = bars(spark, sf_dir, "1 hour"), bars(spark, sf_dir, "1 day")
    return align.as_of(fast, slow, ["close"], "7 DAYS", "d_", ready="1 DAY").select("series", "ts", r9("d_close").alias("d_close"))


AS_OF_READY_SQL = f"""WITH {bars_sql("1 hour", "f")}, {bars_sql("1 day", "s0")}, s AS (SELECT series, ts + INTERVAL 1 DAY AS ts, close FROM s0)
SELECT f.series, f.ts, {s9("CASE WHEN s.ts >= f.ts - INTERVAL 7 DAY THEN s.close END")} AS d_close FROM f ASOF LEFT JOIN s ON f.series = s.series AND f.ts >= s.ts"""


def common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.common_times(bars(spark, sf_dir, "1 hour")).select("series", "ts", r9("close").alias("close"))


COMMON_SQL = f"""WITH {bars_sql("1 hour")} SELECT series, ts, {s9("close")} AS close FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM bars))"""


def common_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.common_range(bars(spark, sf_dir, "1 hour"))


COMMON_RANGE_SQL = f"WITH {bars_sql('1 hour')}, e AS (SELECT series, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1) SELECT max(a) AS start, min(b) AS \"end\" FROM e"


def ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = align.split_dates("1995-01-01", "2001-12-31")
    df = align.calendar_split(daily(spark, sf_dir), a, b)
    return ntz(df.groupBy("series", "split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")), "first", "last")


def split_sql() -> str:
    a, b = align.split_dates("1995-01-01", "2001-12-31")
    return f"WITH {DAILY} SELECT series, CASE WHEN CAST(ts AS DATE) <= DATE '{a}' THEN 'train' WHEN CAST(ts AS DATE) <= DATE '{b}' THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(ts) AS first, max(ts) AS last FROM daily GROUP BY 1, 2"


def ratio_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.ratio_split(bars(spark, sf_dir)).select("series", "ts", F.col("is_train").cast("int").alias("is_train"))


RATIO_SQL = f"WITH {BARS} SELECT series, ts, CAST(row_number() {ROW} <= floor(count(*) OVER (PARTITION BY series) * (1 - 0.2)) AS INTEGER) AS is_train FROM bars"


def walk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = align.walk_forward(daily(spark, sf_dir), 730, 182, 91)
    return df.select(F.col("window").cast("bigint").alias("window"), *(F.col(c).cast("string").alias(c) for c in ("train_start", "train_end", "test_end")), F.col("n_train").cast("bigint").alias("n_train"), F.col("n_test").cast("bigint").alias("n_test"))


WALK_SQL = f"""WITH {DAILY}, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM daily GROUP BY 1), s AS (SELECT min(day) AS a, max(day) AS b FROM d),
k AS (SELECT a, unnest(generate_series(0, CAST(greatest(floor((b - a - 730) / 91), 0) AS BIGINT))) AS w FROM s),
v AS (SELECT w, a + CAST(w * 91 AS INTEGER) AS train_start, a + CAST(w * 91 + 730 AS INTEGER) AS train_end, a + CAST(w * 91 + 730 + 182 AS INTEGER) AS test_end FROM k)
SELECT w AS "window", CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end, CAST(test_end AS VARCHAR) AS test_end, CAST(coalesce(sum(CASE WHEN day < train_end THEN n END), 0) AS BIGINT) AS n_train, CAST(coalesce(sum(CASE WHEN day >= train_end THEN n END), 0) AS BIGINT) AS n_test
FROM d JOIN v ON day >= train_start AND day < test_end GROUP BY ALL HAVING n_train >= 100 AND n_test >= 20"""


def sequence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir).withColumn("r", R.ret(F.col("close"), 1, W())).where(F.col("r").isNotNull())
    s = features.sequences(df, ["close", "volume"], 5, 1, 2, F.col("r"))
    flat = [F.round(F.col("x")[i][j].cast("double"), 4).alias(f"x_{i}_{j}") for i in (0, 4) for j in range(2)]
    return s.select("series", "ts", F.size("x").cast("bigint").alias("n"), *flat, r9("y").alias("y"))


SEQUENCE_SQL = f"""WITH {BARS}, r AS (SELECT *, close / lag(close, 1) {ROW} - 1 AS r FROM bars), f AS (SELECT * FROM r WHERE r IS NOT NULL),
s AS (SELECT *, row_number() {ROW} AS n, list(close) {over(5)} AS c, list(volume) {over(5)} AS v, lead(r, 1) {ROW} AS y FROM f)
SELECT series, ts, len(c) AS n, round(c[1], 4) AS x_0_0, round(v[1], 4) AS x_0_1, round(c[5], 4) AS x_4_0, round(v[5], 4) AS x_4_1, {s9("y")} AS y FROM s WHERE n >= 5 AND (n - 5) % 2 = 0 AND y IS NOT NULL"""


def copies(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    return B.keep_first(e, [F.col("event_id")]) if first else B.drop_all_copies(e)


COPIES = "e AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, event_id, value FROM events)"


def cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir).withColumn("z", R.zscore(F.col("close"), N, W())).withColumn("y", features.target(F.col("close"), 1, "return", W()))
    return features.finite_rows(df, ["z", "y"]).groupBy("series").agg(F.count(F.lit(1)).alias("n"), r9(F.avg("z")).alias("mean_z"), r9(F.stddev_pop("y")).alias("sd_y"))


CLEANING_SQL = f"""WITH {BARS}, c AS (SELECT series, {z_sql("close", N)} AS z, lead(close, 1) {ROW} / close - 1 AS y FROM bars)
SELECT series, count(*) AS n, {s9("avg(z)")} AS mean_z, {s9("stddev_pop(y)")} AS sd_y FROM c WHERE z IS NOT NULL AND y IS NOT NULL AND isfinite(z) AND isfinite(y) GROUP BY 1"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir).withColumn("z", R.zscore(F.col("close"), N, W()))
    return features.matrix_summary(df, ["close", "volume", "z"]).select("n_rows", "n_columns", *(r9(c).alias(c) for c in ("lowest", "highest", "mean", "sd")), "missing")


SUMMARY_SQL = f"""WITH {BARS}, c AS (SELECT close, volume, {z_sql("close", N)} AS z FROM bars), v AS (SELECT close AS v FROM c UNION ALL SELECT volume FROM c UNION ALL SELECT z FROM c)
SELECT CAST(count(*) / 3 AS BIGINT) AS n_rows, 3 AS n_columns, {s9("min(v)")} AS lowest, {s9("max(v)")} AS highest, {s9("avg(v)")} AS mean, {s9("stddev_pop(v)")} AS sd, count(*) FILTER (v IS NULL) AS missing FROM v"""


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op_z in blocks of 64 bars."""
    x = F.col("close")
    df = by_blocks(bars(spark, sf_dir), lambda d, keys: d.withColumn("value", R.zscore(x, N, W(keys))), 64, N - 1)
    return df.select("series", "ts", r9("value").alias("value"))


QUERIES: dict[str, Query] = {
    "bars_events_4h": (plain_bars, f"WITH {BARS} SELECT series, ts, {OHLCV_SQL} FROM bars"),
    "bars_lineitem_daily": (plain_daily, f"WITH {DAILY} SELECT series, ts, {OHLCV_SQL} FROM daily"),
    "op_delta": rolling(lambda x: R.delta(x, 5, W()), f"close - lag(close, 5) {ROW}"),
    "op_ret": rolling(lambda x: R.ret(x, 5, W()), f"close / lag(close, 5) {ROW} - 1"),
    "op_logret": rolling(lambda x: R.logret(x, 5, W()), f"ln(close / lag(close, 5) {ROW})"),
    "op_mean": rolling(lambda x: R.mean(x, N, W()), MEAN),
    "op_sd": rolling(lambda x: R.sd(x, N, W()), SD),
    "op_max": rolling(lambda x: R.highest(x, N, W()), HIGH),
    "op_min": rolling(lambda x: R.lowest(x, N, W()), LOW),
    "op_z": rolling(lambda x: R.zscore(x, N, W()), z_sql("close", N)),
    "op_z_blocked": (blocked, f"WITH {BARS} SELECT series, ts, {s9(z_sql('close', N))} AS value FROM bars"),
    "op_pos": rolling(lambda x: R.position(x, N, W()), pos_sql("close", N)),
    "op_rank": rolling(lambda x: R.rank(x, N, W()), f"CASE WHEN len(v) = {N} THEN (len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2.0) / {N} END", f"(SELECT *, list(close) {over(N)} AS v FROM bars)"),
    "op_p75": rolling(lambda x: R.percentile(x, 75, N, W()), full(N, f"quantile_cont(close, 0.75) {over(N)}")),
    "op_d1": rolling(lambda x: R.d1(x, W()), f"close - lag(close, 1) {ROW}"),
    "op_d2": rolling(lambda x: R.d2(x, W()), f"close - 2 * lag(close, 1) {ROW} + lag(close, 2) {ROW}"),
    "op_rho": rolling(lambda x: R.rho(x, F.col("volume"), N, W()), full(N, f"covar_samp(close, volume) {over(N)} / nullif(stddev_samp(close) {over(N)} * stddev_samp(volume) {over(N)}, 0)")),
    "op_ema": (ema, EMA_SQL),
    "candle_ratios": many(with_columns(features.candle_ratios), RATIOS),
    "candle_diffs": many(with_columns(features.candle_diffs), DIFFS),
    "candle_means": many(with_columns(features.candle_means), MEANS),
    "calendar_cyclic": many(with_columns(features.calendar), CYCLES),
    "calendar_flags": many(with_columns(features.calendar), FLAGS, rounded=False),
    "level1_close": many(planned((1,), []), {"mean_5__close": full(5, f"avg(close) {over(5)}"), "z_20__close": z_sql("close", 20), "max_20__close": HIGH, "d1__close": f"close - lag(close, 1) {ROW}"}),
    "level2_combos": many(planned((2,), []), {"mean_5__hl2": full(5, f"avg((high + low) / 2) {over(5)}"), "sd_20__h_l_diff": full(20, f"stddev_samp(high - low) {over(20)}"), "z_20__c_o_ratio": z_sql("(close / open)", 20)}),
    "level3_compositions": (compositions, compositions_sql()),
    "level4_fast_slow": many(planned((4,), []), pair_sql()),
    "features_wide": (all_features, None),
    "target_return": rolling(lambda x: features.target(x, 3, "return", W()), f"lead(close, 3) {ROW} / close - 1"),
    "target_log": rolling(lambda x: features.target(x, 3, "log", W()), f"ln(greatest(lead(close, 3) {ROW} / close, 1e-10))"),
    "target_direction": rolling(lambda x: features.target(x, 3, "direction", W()), f"CAST(sign(lead(close, 3) {ROW} / close - 1) AS DOUBLE)"),
    "pit_zscore": rolling(lambda x: normalise.pit_zscore(x, N, W()), pit(N, f"(close - avg(close) {before(N)}) / (stddev_samp(close) {before(N)} + 1e-8)")),
    "pit_expanding": rolling(lambda x: normalise.pit_expanding(x, W()), f"CASE WHEN count(close) {EXPANDING} >= 30 THEN (close - avg(close) {EXPANDING}) / (stddev_samp(close) {EXPANDING} + 1e-8) END"),
    "pit_minmax": rolling(lambda x: normalise.pit_minmax(x, N, W()), pit(N, f"(close - min(close) {before(N)}) / (max(close) {before(N)} - min(close) {before(N)} + 1e-8)")),
    "pit_rank": (rolling(lambda x: normalise.pit_rank(x, N, W()), "0")[0], PIT_RANK),
    "current_zscore": rolling(lambda x: normalise.current_zscore(x, N, W()), full(N, f"(close - avg(close) {over(N)}) / nullif(stddev_samp(close) {over(N)}, 0)")),
    "atr14": many(lambda df: regimes.with_atr(df, W()), {"atr": "atr"}, ATR_CTE, "a"),
    "adx14": many(lambda df: regimes.with_adx(df, W()), {"adx": "adx"}, ADX_CTE, "adx"),
    "regimes": (regime_query, REGIME_SQL),
    "grid_ffill": (grid_fill, GRID_SQL),
    "weekend_drop": (empty_times, EMPTY_SQL),
    "asof_multi_tf": (as_of_query, AS_OF_SQL),
    "asof_blocked": (lambda s, d: as_of_query(s, d, "day"), AS_OF_SQL),
    "asof_closed_bars": (as_of_ready, AS_OF_READY_SQL),
    "common_timestamps": (common, COMMON_SQL),
    "common_range": (common_range, COMMON_RANGE_SQL),
    "dedup_drop_all": (lambda s, d: copies(s, d, False), f"WITH {COPIES} SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY series, ts) = 1"),
    "dedup_keep_first": (lambda s, d: copies(s, d, True), f"WITH {COPIES} SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY event_id) = 1"),
    "calendar_split": (split_query, split_sql()),
    "ratio_split": (ratio_query, RATIO_SQL),
    "walk_forward_windows": (walk_query, WALK_SQL),
    "sequences_flat": (sequence_query, SEQUENCE_SQL),
    "clean_rows": (cleaning, CLEANING_SQL),
    "matrix_summary": (summary, SUMMARY_SQL),
}
