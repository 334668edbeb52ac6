"""Queries of readers and sinks, feature tables, selections, alignments and validation, each with the SQL that gives the same rows. Those of readers write a table to the shared folder first and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions import rolling as R
from barwright.operators import align, consensus, costs, features, metrics, normalise, robustness, rules, stats
from barwright.plans import analysis_queries as A
from barwright.plans.analysis_queries import PEARSON, SCORES, long_sql, p_sql, rounded, scores, screened
from barwright.plans.bar_queries import BARS, BY, DAILY, N, OHLCV_SQL, ROW, Query, W, bars, bars_sql, daily, full, ntz, over, pos_sql, r9, read, s9, z_sql
from barwright.sources import bars as B

FEATURED = f"f AS (SELECT series, ts, close, {z_sql('close', N)} AS z, {pos_sql('close', N)} AS pos, close / lag(close, 1) {ROW} - 1 AS ret FROM bars)"


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = F.col("close"), W()
    return bars(spark, sf_dir).select("series", "ts", "close", R.zscore(x, N, w).alias("z"), R.position(x, N, w).alias("pos"), R.ret(x, 1, w).alias("ret"))


# ---- readers and sinks


def csv_bars(spark: SparkSession, sf_dir: str, timeframe: str | None = None) -> DataFrame:
    root = B.scratch(spark)
    B.write_ohlcv_csv(bars(spark, sf_dir), root, timeframe)
    out = ntz(B.read_ohlcv_csv(spark, f"{root}/*.csv", timeframe), "ts")
    return out.select("series", *(["timeframe"] if timeframe else []), "ts", *(r9(c).alias(c) for c in B.OHLCV))


def stored_features(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A feature table written and read again, of which three columns are asked for."""
    path = f"{B.scratch(spark)}.{kind}"
    df = featured(spark, sf_dir)
    if kind == "csv":
        B.write_csv(df.withColumn("ts", F.col("ts").cast("timestamp")), path)
    else:
        B.write_features(df, path)
    return ntz(B.read_features(spark, path, ["series", "ts", "z", "ret"]), "ts").select("series", "ts", r9("z").alias("z"), r9("ret").alias("ret"))


STORED = f"WITH {BARS}, {FEATURED} SELECT series, ts, {s9('z')} AS z, {s9('ret')} AS ret FROM f"


def found_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of each series as CSV, and of some as Parquet too; Parquet comes first."""
    root, df = B.scratch(spark), bars(spark, sf_dir)
    B.write_ohlcv_csv(df, root, "H4")
    for row in df.select("series").distinct().where(F.col("series") < "m").collect():  # names of series
        df.where(F.col("series") == row["series"]).write.parquet(f"{root}/{row['series']}_H4.parquet")
    return B.discovered(spark, root, "H4")


FOUND = "SELECT DISTINCT event_type AS name, CASE WHEN event_type < 'm' THEN 'parquet' ELSE 'csv' END AS kind FROM events"


def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = featured(spark, sf_dir).where(F.col("ret").isNotNull())
    path = B.scratch(spark)
    B.write_samples(features.sequences(df, ["close", "ret"], 4, 1, 3, F.col("ret")), path)
    x = B.read_samples(spark, path)
    return x.select("series", "ts", F.size("x").cast("bigint").alias("n_rows"), F.size(F.col("x")[0]).cast("bigint").alias("n_columns"), *(F.round(F.col("x")[i][j].cast("double"), 4).alias(f"x_{i}_{j}") for i in (0, 3) for j in (0, 1)), r9("y").alias("y"))


STORED_SAMPLES = f"""WITH {BARS}, {FEATURED}, k AS (SELECT * FROM f WHERE ret IS NOT NULL), s AS (SELECT series, ts, row_number() {ROW} AS n, lag(close, 3) {ROW} AS c0, lag(ret, 3) {ROW} AS r0, close AS c3, ret AS r3, lead(ret, 1) {ROW} AS y FROM k)
SELECT series, ts, CAST(4 AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_columns, round(c0, 4) + 0 AS x_0_0, round(r0, 4) + 0 AS x_0_1, round(c3, 4) + 0 AS x_3_0, round(r3, 4) + 0 AS x_3_1, {s9("y")} AS y FROM s WHERE n >= 4 AND (n - 4) % 3 = 0 AND y IS NOT NULL"""


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the nations, some of them missing, as CSV with a full stop for none."""
    path = B.scratch(spark)
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("bigint")
    rows = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("series_id"), F.lit("rates").alias("category"), F.lit("d").alias("frequency"), F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")).alias("date"), F.when(k % 4 == 1, ".").otherwise((k * 1.5).cast("double").cast("string")).alias("value"))
    B.write_csv(rows, path)
    return B.read_macro_csv(spark, path).withColumn("date", F.col("date").cast("string"))


MACRO = "m AS (SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS series_id, CAST(DATE '2020-01-01' + CAST(n_nationkey AS INTEGER) AS VARCHAR) AS date, n_nationkey * 1.5 AS value FROM nation WHERE n_nationkey % 4 <> 1)"


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = B.scratch(spark)
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    rows = n.select(F.col("n_name").alias("name"), (-(k % 5)).cast("int").alias("pipLocation"), (k / 100).alias("marginRate"), F.struct((k / 10).alias("longRate"), (-k / 10).alias("shortRate")).alias("financing"))
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)))).write.text(path)  # one array, as a broker's answer
    return B.read_instruments(spark, path).select("name", F.col("pipLocation").alias("pip_location"), r9("marginRate").alias("margin_rate"), r9("financing.longRate").alias("long_rate"), r9("financing.shortRate").alias("short_rate"))


INSTRUMENTS = f"SELECT n_name AS name, -(n_nationkey % 5) AS pip_location, {s9('n_nationkey / 100')} AS margin_rate, {s9('n_nationkey / 10')} AS long_rate, {s9('-n_nationkey / 10')} AS short_rate FROM nation"


def stored_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes from results that were stored before: information coefficients as JSON, the others as CSV."""
    root, s = B.scratch(spark), scores(spark, sf_dir)
    of = lambda m: s.where(F.col("method") == m).select("feature", (F.col("score") / 1000).alias("score"))
    B.write_json(of("IC"), f"{root}/ic")
    for m in ("MI", "RF", "XGBoost"):
        B.write_csv(of(m), f"{root}/{m}")
    ic = spark.read.schema("feature STRING, score DOUBLE").json(f"{root}/ic")
    mi, rf, mlp = (spark.read.schema("feature STRING, score DOUBLE").option("header", True).csv(f"{root}/{m}") for m in ("MI", "RF", "XGBoost"))
    out = consensus.cached_votes(s.select("feature").distinct(), ic, mi, rf, mlp.where(F.col("score") > 0.02).select("feature"), 0.01, 10)
    return out.select("feature", *(F.col(c).cast("int").alias(c) for c in out.columns[1:5]), F.col("n_votes").cast("bigint").alias("n_votes"), "category")


STORED_ANALYSES = f"""WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS rk FROM s),
v AS (SELECT feature, max(CASE WHEN method = 'IC' THEN CAST(score > 10 AS INTEGER) END) AS vote_ic, max(CASE WHEN method = 'MI' THEN CAST(score > 10 AS INTEGER) END) AS vote_mi, max(CASE WHEN method = 'RF' THEN CAST(rk <= 10 AS INTEGER) END) AS vote_rf, max(CASE WHEN method = 'XGBoost' THEN CAST(score > 20 AS INTEGER) END) AS vote_mlp FROM k GROUP BY 1),
n AS (SELECT *, CAST(vote_ic + vote_mi + vote_rf + vote_mlp AS BIGINT) AS n_votes FROM v) SELECT *, CASE WHEN n_votes >= 3 THEN 'strong' WHEN n_votes = 2 THEN 'medium' ELSE 'weak' END AS category FROM n"""


def exported_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings written as CSV by method, and read again."""
    path = B.scratch(spark)
    B.write_csv(A.ranked(spark, sf_dir).select("method", "feature", "score", "rank"), path, by="method")
    got = spark.read.schema("feature STRING, score DOUBLE, rank INT, method STRING").option("header", True).csv(path)
    return got.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.min_by("feature", "rank").alias("best"), F.sum("score").alias("total"))


EXPORTED = f"WITH {A.RANKED} SELECT method, count(*) AS n, arg_min(feature, rank) AS best, sum(score) AS total FROM r GROUP BY 1"


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles that are complete: here those of more than four ticks."""
    df = bars(spark, sf_dir, "1 hour").withColumn("complete", F.col("volume") > 4)
    return B.only_complete(df).select("series", "ts", r9("close").alias("close"))


# ---- feature tables


def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table ready for screening: finite rows with a target, without the column that is constant."""
    df = featured(spark, sf_dir).withColumn("one", F.lit(1.0))
    out, kept = features.screening_table(df, ["z", "pos", "ret", "one"])
    return out.select("series", "ts", *(r9(c).alias(c) for c in kept), r9("target").alias("target"))


SCREENING = f"WITH {BARS}, {FEATURED}, t AS (SELECT *, ln(greatest(lead(close, 1) {ROW} / close, 1e-10)) AS target FROM f) SELECT series, ts, {s9('z')} AS z, {s9('pos')} AS pos, {s9('ret')} AS ret, {s9('target')} AS target FROM t WHERE z IS NOT NULL AND pos IS NOT NULL AND ret IS NOT NULL AND target IS NOT NULL"


def approved_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a stored table only the approved features and the close, and the target made from it."""
    path = f"{B.scratch(spark)}.parquet"
    B.write_features(featured(spark, sf_dir), path)
    approved = [r["feature"] for r in spark.createDataFrame([("z",), ("ret",), ("gone",)], "feature STRING").collect()]  # names of features
    there = [c for c in spark.read.parquet(path).columns if c in approved]
    out, kept = features.screening_table(B.read_features(spark, path, ["series", "ts", B.close_column(["z", "close"]), *there]), there, kind="return")
    return ntz(out, "ts").select("series", "ts", *(r9(c).alias(c) for c in sorted(kept)), r9("target").alias("target"))


APPROVED = f"WITH {BARS}, {FEATURED}, t AS (SELECT *, lead(close, 1) {ROW} / close - 1 AS target FROM f) SELECT series, ts, {s9('ret')} AS ret, {s9('z')} AS z, {s9('target')} AS target FROM t WHERE z IS NOT NULL AND ret IS NOT NULL AND target IS NOT NULL"


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = featured(spark, sf_dir).withColumns({"one": F.lit(1.0), "none": F.lit(None).cast("double"), "endless": F.when(F.col("ret") > 0, float("inf")).otherwise(F.col("ret"))})
    return spark.createDataFrame([(c,) for c in features.admission(df, ["z", "pos", "ret", "one", "none", "endless"])], "feature STRING")


ADMITTED = f"""WITH {BARS}, {FEATURED}, g AS (SELECT z, pos, ret, 1.0::DOUBLE AS one, NULL::DOUBLE AS none, CASE WHEN ret > 0 THEN 'inf'::DOUBLE ELSE ret END AS endless FROM f), u AS (SELECT * FROM g UNPIVOT INCLUDE NULLS (v FOR feature IN (z, pos, ret, one, none, endless)))
SELECT feature FROM u GROUP BY 1 HAVING count(v) > 0 AND count(*) FILTER (isinf(v)) = 0 AND stddev_samp(CASE WHEN isfinite(v) THEN v END) > 1e-10"""


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.run_summary(featured(spark, sf_dir), ["z", "pos", "ret"]).withColumn("megabytes", r9("megabytes"))


SIZED = f"WITH {BARS} SELECT series, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_features, count(*) * 3 AS n_values, {s9('count(*) * 24 / 1e6')} AS megabytes FROM bars GROUP BY 1"


def every_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every bar, each with the return that follows it, values measured within the sample."""
    df = featured(spark, sf_dir).where(F.col("ret").isNotNull())
    s = features.sequences(df, ["close", "ret"], 8, 1, 1, F.col("ret")).withColumn("x", features.in_sample(F.col("x")))
    return s.select("series", "ts", *(F.round(F.col("x")[i][0].cast("double"), 3).alias(f"x_{i}") for i in (0, 3, 7)), r9("y").alias("y"))


def _scaled(i: int) -> str:
    seen = [f"CAST(lag(close, {7 - j}) {ROW} AS FLOAT)::DOUBLE" if j < 7 else "CAST(close AS FLOAT)::DOUBLE" for j in range(max(i - 5, 0), i + 1)]
    mean = f"(({' + '.join(seen)}) / {len(seen)})"
    return f"round(({seen[-1]} - {mean}) / (sqrt(({' + '.join(f'({v} - {mean}) * ({v} - {mean})' for v in seen)}) / {len(seen)}) + 1e-8), 3) + 0"


EVERY_SAMPLE = f"""WITH {BARS}, {FEATURED}, k AS (SELECT * FROM f WHERE ret IS NOT NULL), s AS (SELECT series, ts, row_number() {ROW} AS n, {", ".join(f"{_scaled(i)} AS x_{i}" for i in (0, 3, 7))}, lead(ret, 1) {ROW} AS y FROM k)
SELECT series, ts, x_0, x_3, x_7, {s9("y")} AS y FROM s WHERE n >= 8 AND y IS NOT NULL"""


def before(n: int) -> str:
    return f"OVER ({BY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of every series measured against the bars before, then cut into samples: the last row of each."""
    df = normalise.normalised(bars(spark, sf_dir), ["close", "volume"], "zscore_rolling", N, W())
    s = features.sequences(df.where(F.col("close").isNotNull() & F.col("volume").isNotNull()), ["close", "volume"], 3, 1, 1, F.col("close"))
    return s.select("series", "ts", *(F.round(F.col("x")[i][j].cast("double"), 3).alias(f"x_{i}_{j}") for i in (0, 2) for j in (0, 1)))


_PIT = lambda x: f"CAST(CASE WHEN count({x}) {before(N)} = {N} THEN ({x} - avg({x}) {before(N)}) / (stddev_samp({x}) {before(N)} + 1e-8) END AS FLOAT)"
NORMALISED = f"""WITH {BARS}, n AS (SELECT series, ts, {_PIT("close")} AS c, {_PIT("volume")} AS v FROM bars), k AS (SELECT * FROM n WHERE c IS NOT NULL AND v IS NOT NULL), s AS (SELECT series, ts, row_number() {ROW} AS i, lag(c, 2) {ROW} AS c0, lag(v, 2) {ROW} AS v0, c, v, lead(c, 1) {ROW} AS y FROM k)
SELECT series, ts, round(c0::DOUBLE, 3) + 0 AS x_0_0, round(v0::DOUBLE, 3) + 0 AS x_0_1, round(c::DOUBLE, 3) + 0 AS x_2_0, round(v::DOUBLE, 3) + 0 AS x_2_1 FROM s WHERE i >= 3 AND y IS NOT NULL"""


def normalised_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalise.normalised(bars(spark, sf_dir), ["close", "volume"], "minmax", N, W())
    return df.select("series", "ts", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("close", "volume")))


_MM = lambda x: f"round(CAST(CASE WHEN count({x}) {before(N)} = {N} THEN ({x} - min({x}) {before(N)}) / (max({x}) {before(N)} - min({x}) {before(N)} + 1e-8) END AS FLOAT)::DOUBLE, 3) + 0"
NORMALISED_FLAT = f"WITH {BARS} SELECT series, ts, {_MM('close')} AS close, {_MM('volume')} AS volume FROM bars"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalise.window_scores(bars(spark, sf_dir), ["close"], N, W())
    return df.select("series", "ts", r9("close_z").alias("close_z"), r9("close_rank").alias("close_rank"))


SCORED = f"""WITH {BARS}, l AS (SELECT *, list(close) {over(N)} AS v, row_number() {ROW} AS n, ({full(N, f"(close - avg(close) {over(N)}) / nullif(stddev_samp(close) {over(N)}, 0)")}) AS z FROM bars)
SELECT series, ts, {s9("z")} AS close_z, {s9(f"(len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2.0) / {N}")} AS close_rank FROM l WHERE n > {N}"""


def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three transforms tried at two times; the forward return sees the future."""
    df = bars(spark, sf_dir, "1 day")
    times = [r["ts"] for r in df.groupBy("ts").count().orderBy("ts").limit(20).collect()][9::9]
    x = F.col("close")
    checks = {"pit": (lambda d: d.withColumn("v", normalise.pit_zscore(x, 5, W())), "v"), "mean": (lambda d: d.withColumn("v", R.mean(x, 5, W())), "v"), "forward": (lambda d: d.withColumn("v", features.target(x, 1, "return", W())), "v")}
    out = normalise.look_ahead_report(checks, df, "ts", times, "close")
    return out.select("name", "n_checks", "n_passed", F.col("is_clean").cast("int").alias("is_clean"))


LOOK_AHEAD = "SELECT * FROM (VALUES ('forward', 2, 0, 0), ('mean', 2, 2, 1), ('pit', 2, 2, 1)) t(name, n_checks, n_passed, is_clean)"


# ---- selections


def scores_of(spark: SparkSession, sf_dir: str, method: str, by: float = 1.0) -> DataFrame:
    return scores(spark, sf_dir).where(F.col("method") == method).select("feature", (F.col("score") / by).alias("score"))


def selected(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    ic = scores_of(spark, sf_dir, "IC", 1000).select("feature", F.col("score").alias("ic"), (1 / (F.col("score") * 1000 + 1)).alias("p_value"))
    mi = scores_of(spark, sf_dir, "MI").select("feature", F.col("score").alias("mi"))
    return consensus.robust_selection(ic, mi, 0.005, 0.1, 8, least).select("feature", r9("abs_ic").alias("abs_ic"))


def selected_sql(least: int) -> str:
    return f"""WITH {SCORES}, i AS (SELECT feature, score / 1000 AS abs_ic FROM s WHERE method = 'IC' AND score / 1000 > 0.005 AND 1 / (score + 1) < 0.1), hi AS (SELECT feature FROM s WHERE method = 'MI' QUALIFY score > quantile_cont(score, 0.9) OVER ()), b AS (SELECT * FROM i WHERE feature IN (SELECT feature FROM hi)),
c AS (SELECT * FROM b WHERE (SELECT count(*) FROM b) >= {least} UNION ALL SELECT * FROM i WHERE (SELECT count(*) FROM b) < {least}) SELECT feature, {s9("abs_ic")} AS abs_ic FROM c ORDER BY c.abs_ic DESC, feature LIMIT 8"""


def significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with an ic far enough from 0 and a small p-value."""
    found = stats.significance(stats.information_coefficient(screened(bars(spark, sf_dir), []), ["feature"]))
    return found.where((F.col("abs_ic") > 0.01) & (F.col("p_value") < 0.5)).select("feature", r9("ic").alias("ic"), r9("p_value").alias("p_value"))


IC_P = f"i AS (SELECT feature, count(*) AS n, {PEARSON} AS ic FROM l GROUP BY 1), p AS (SELECT *, {p_sql('ic', 'n')} AS p_value FROM i)"
SIGNIFICANT = f"WITH {BARS}, {long_sql('bars', 'series')}, {IC_P} SELECT feature, {s9('ic')} AS ic, {s9('p_value')} AS p_value FROM p WHERE abs(ic) > 0.01 AND p_value < 0.5"


def redundant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlation_pairs(A.wide(spark, sf_dir), ["mean_ratio", "z", "pos", "ret", "volume"]).where(F.abs("r") > 0.6).select("a", "b", r9("r").alias("r"))


REDUNDANT = f"WITH {BARS}, {A.COMPLETE}, p AS ({A.PAIR_ROWS}) SELECT a, b, {s9('r')} AS r FROM p WHERE abs(r) > 0.6"


def mi_to_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    mi, ic = scores_of(spark, sf_dir, "MI").withColumnRenamed("score", "mi"), scores_of(spark, sf_dir, "IC").where("score > 5").withColumnRenamed("score", "ic")
    return mi.join(ic, "feature", "left").select("feature", "mi", "ic", r9(F.try_divide("mi", F.abs("ic"))).alias("ratio"))


MI_TO_IC = f"WITH {SCORES} SELECT a.feature, a.score AS mi, b.score AS ic, {s9('a.score / abs(b.score)')} AS ratio FROM s a LEFT JOIN s b ON a.feature = b.feature AND b.method = 'IC' AND b.score > 5 WHERE a.method = 'MI'"


def validated_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated features with their ic; those without one go."""
    valid, ic = A.voted(spark, sf_dir).where("category <> 'none'").select("feature", "n_methods"), scores_of(spark, sf_dir, "IC").where("score > 5").withColumnRenamed("score", "ic")
    return valid.join(ic, "feature", "left").na.drop("any", subset=["ic"])


VALIDATED = f"WITH {A.VOTES} SELECT c.feature, c.n_methods, s.score AS ic FROM c JOIN s ON s.feature = c.feature AND s.method = 'IC' AND s.score > 5 WHERE category <> 'none'"


def whole_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = consensus.run(scores(spark, sf_dir), 15)
    return out.select("feature", "n_methods", "category", F.col("checks_passed").cast("bigint").alias("checks_passed"), F.col("approved").cast("int").alias("approved"))


WHOLE = f"WITH x AS ({A.CHECKS}), {A.VOTES} SELECT c.feature, c.n_methods, c.category, x.checks_passed, coalesce(x.approved, 0) AS approved FROM c LEFT JOIN x USING (feature)"


def at_least_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda m: scores_of(spark, sf_dir, m, 1000)
    table = consensus.consensus_table(scores(spark, sf_dir).select("feature").distinct(), s("IC"), s("MI"), s("Lasso"), s("RF"), s("XGBoost"), 0.01, 10)
    return consensus.at_least(table, "strong").select("feature", "category")


def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of the ranked features of two methods, sorted."""
    r = A.ranked(spark, sf_dir)
    a, b = (r.where(F.col("method") == m).select("feature") for m in ("IC", "RF"))
    out = None
    for name, part in (("union", a.union(b).distinct()), ("both", a.intersect(b)), ("first only", a.subtract(b))):
        part = part.select(F.lit(name).alias("kind"), "feature")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("kind", "feature")


SETS = f"WITH {A.RANKED}, a AS (SELECT feature FROM r WHERE method = 'IC'), b AS (SELECT feature FROM r WHERE method = 'RF') SELECT 'union' AS kind, feature FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'both', feature FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first only', feature FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"


def best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features of the most votes, of as many the ones with the largest score in all."""
    r = A.ranked(spark, sf_dir).groupBy("feature").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("total"))
    return r.orderBy(F.desc("votes"), F.desc("total"), "feature").limit(10)


BEST_FIRST = f"WITH {A.RANKED} SELECT feature, count(*) AS votes, sum(score) AS total FROM r GROUP BY 1 ORDER BY votes DESC, total DESC, feature LIMIT 10"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and times from text; what is none becomes NULL."""
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 7 == 0, "x").otherwise(""), F.col("value").cast("string")).alias("v"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"))
    return e.select("event_id", r9(F.col("v").try_cast("double")).alias("value"), F.to_timestamp("t").cast("timestamp_ntz").alias("ts"), F.signum(F.col("v").try_cast("double") - 50).cast("int").alias("side"))


TYPED = f"SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN {s9('value')} END AS value, date_trunc('second', ts) AS ts, CASE WHEN event_id % 7 <> 0 THEN CAST(sign(value - 50) AS INTEGER) END AS side FROM events"


# ---- alignment


def side_by_side(spark: SparkSession, sf_dir: str, three: bool) -> DataFrame:
    hour, half = bars(spark, sf_dir, "1 hour"), bars(spark, sf_dir, "30 minutes")
    frames = [hour.select("series", "ts", r9("close").alias("close")), half.select("series", "ts", r9("high").alias("half_high"))]
    if three:
        frames.append(bars(spark, sf_dir).select("series", "ts", r9("low").alias("long_low")))
    return align.inner_times(*frames)


SIDES = f"{bars_sql('1 hour', 'h')}, {bars_sql('30 minutes', 'm')}, {BARS}"
TWO = f"WITH {SIDES} SELECT h.series, h.ts, {s9('h.close')} AS close, {s9('m.high')} AS half_high FROM h JOIN m USING (series, ts)"
THREE = f"WITH {SIDES} SELECT h.series, h.ts, {s9('h.close')} AS close, {s9('m.high')} AS half_high, {s9('b.low')} AS long_low FROM h JOIN m USING (series, ts) JOIN bars b USING (series, ts)"


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned_bars(bars(spark, sf_dir, "15 minutes"), "15 MINUTES", ["close", "volume"], 2).select("series", "ts", r9("close").alias("close"), "volume")


ALIGNED = f"""WITH {bars_sql("15 minutes")}, e AS (SELECT series, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1), c AS (SELECT unnest(generate_series(max(a), min(b), INTERVAL 15 MINUTE)) AS ts FROM e), g AS (SELECT series, ts FROM e, c), j AS (SELECT g.series, g.ts, close, volume FROM g LEFT JOIN bars USING (series, ts)),
k AS (SELECT series, ts, {"last_value(close IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"} AS close, {"last_value(volume IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"} AS volume FROM j)
SELECT series, ts, {s9("close")} AS close, volume FROM k QUALIFY max(CASE WHEN close IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ts) = 1"""


def timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.multi_timeframe(bars(spark, sf_dir, "1 hour"), {"h4": bars(spark, sf_dir), "d": bars(spark, sf_dir, "1 day")}, ["close"], "7 DAYS", {"h4": "4 HOURS", "d": "1 DAY"})
    return out.select("series", "ts", *(r9(c).alias(c) for c in ("close", "h4_close", "d_close")))


TIMEFRAMES = f"""WITH {bars_sql("1 hour", "f")}, {bars_sql("4 hours", "x0")}, {bars_sql("1 day", "y0")}, x AS (SELECT series, ts + INTERVAL 4 HOUR AS ts, close FROM x0), y AS (SELECT series, ts + INTERVAL 1 DAY AS ts, close FROM y0)
SELECT f.series, f.ts, {s9("f.close")} AS close, {s9("CASE WHEN x.ts >= f.ts - INTERVAL 7 DAY THEN x.close END")} AS h4_close, {s9("CASE WHEN y.ts >= f.ts - INTERVAL 7 DAY THEN y.close END")} AS d_close FROM f ASOF LEFT JOIN x ON f.series = x.series AND f.ts >= x.ts ASOF LEFT JOIN y ON f.series = y.series AND f.ts >= y.ts"""


def chosen_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series between two days, both with them."""
    df = daily(spark, sf_dir).where(F.col("series").isin("A", "N") & F.to_date("ts").between("1996-01-01", "1996-12-31"))
    return df.groupBy("series").agg(F.count(F.lit(1)).alias("n"), r9(F.sum("volume")).alias("volume"))


CHOSEN = f"WITH {DAILY} SELECT series, count(*) AS n, {s9('sum(volume)')} AS volume FROM daily WHERE series IN ('A', 'N') AND CAST(ts AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY 1"


# ---- robustness and validation


def thirds(spark: SparkSession, sf_dir: str, least: int = 10) -> DataFrame:
    """ic of each feature in each third of the rows of all series in order."""
    df = bars(spark, sf_dir)
    w = W()
    n = F.count(F.lit(1)).over(Window.partitionBy("series"))
    df = df.withColumn("part", F.least(F.floor((F.row_number().over(w) - 1) / F.greatest(F.floor(n / 3), F.lit(1))), F.lit(2)).cast("bigint"))
    return stats.information_coefficient(screened(df, ["part"]), ["feature", "part"], least=least)


def third_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robustness.thirds_gate(thirds(spark, sf_dir), ["feature"], 0.1).withColumn("is_stable", F.col("is_stable").cast("int")))


THIRD_ROWS = f"t3 AS (SELECT *, CAST(least(floor((row_number() {ROW} - 1) / greatest(floor(count(*) OVER (PARTITION BY series) / 3), 1)), 2) AS BIGINT) AS part FROM bars)"
THIRD_GATE = f"""WITH {BARS}, {THIRD_ROWS}, {long_sql("t3", "part")}, i AS (SELECT feature, part, {PEARSON} AS ic FROM l GROUP BY 1, 2)
SELECT feature, count(ic) AS n_parts, {s9("min(ic)")} AS ic_min, {s9("max(ic)")} AS ic_max, {s9("stddev_pop(ic)")} AS ic_sd, CAST(min(ic) * max(ic) > 0 AND stddev_pop(ic) < 0.1 AS INTEGER) AS is_stable FROM i GROUP BY 1"""


def regime_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robustness.regime_significance(A.ic_regime(spark, sf_dir), 0.2, 30)
    return out.select("feature", "regime", "n", r9("p_value").alias("p_value"), F.col("is_significant").cast("int").alias("is_significant"))


REGIME_P = f"WITH i AS ({A.IC_REGIME}), p AS (SELECT *, {p_sql('ic', 'n')} AS p_value FROM i) SELECT feature, regime, n, {s9('p_value')} AS p_value, CAST(p_value < 0.2 AND n >= 30 AS INTEGER) AS is_significant FROM p"


def whole_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.report(time=A.temporal_rows(spark, sf_dir), series=A.consistency_rows(spark, sf_dir), regimes=A.gate_rows(spark, sf_dir).select("feature", "is_robust"))


REPORT = f"""WITH a AS ({A.TEMPORAL}), b AS ({A.CONSISTENCY}), c AS ({A.GATE})
SELECT 'time' AS analysis, * FROM a UNION ALL BY NAME SELECT 'series' AS analysis, * FROM b UNION ALL BY NAME SELECT 'regimes' AS analysis, feature, is_robust FROM c"""


def predicted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.wide(spark, sf_dir).where(F.col("z").isNotNull() & F.col("target").isNotNull()).withColumn("y", F.col("target") / 100)
    out = metrics.prediction_metrics(df, "z", "y", ["series"])
    return out.select("series", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


PREDICTED_CTE = f"{BARS}, y AS (SELECT series, ts, {z_sql('close', N)} AS z, (lead(close, 1) {ROW} / close - 1) / 100 AS y FROM bars), k AS (SELECT *, sign(z) * y AS r FROM y WHERE z IS NOT NULL AND y IS NOT NULL)"
PREDICTED = f"""WITH {PREDICTED_CTE}, e AS (SELECT *, product(1 + r) {over()} AS equity FROM k), d AS (SELECT *, (equity / max(equity) {over()} - 1) * 100 AS dd FROM e)
SELECT series, count(r) AS n, round(covar_samp(z, y) / nullif(stddev_samp(z) * stddev_samp(y), 0), 6) + 0 AS ic, round(CASE WHEN stddev_samp(r) > 1e-10 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END, 6) + 0 AS sharpe, round(avg(r) * 252 * 100, 6) + 0 AS annual_return, round(stddev_samp(r) * sqrt(252) * 100, 6) + 0 AS volatility, round(min(dd), 6) + 0 AS max_drawdown FROM d GROUP BY 1"""


def forward_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ic of each feature in tenths of the time, as windows of a validation."""
    df = bars(spark, sf_dir)
    n = F.count(F.lit(1)).over(Window.partitionBy("series"))
    df = df.withColumn("window", F.least(F.floor((F.row_number().over(W()) - 1) / F.greatest(F.floor(n / 8), F.lit(1))), F.lit(7)).cast("bigint"))
    return stats.information_coefficient(screened(df, ["window"]), ["feature", "window"])


WINDOW_IC = f"""{BARS}, t8 AS (SELECT *, CAST(least(floor((row_number() {ROW} - 1) / greatest(floor(count(*) OVER (PARTITION BY series) / 8), 1)), 7) AS BIGINT) AS win FROM bars), {long_sql("t8", "win")}, i AS (SELECT feature, win, CASE WHEN count(*) >= 10 THEN {PEARSON} END AS ic FROM l GROUP BY 1, 2)"""


def decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robustness.degradation(forward_ic(spark, sf_dir), ["feature"])
    return rounded(out.withColumns({c: F.col(c).cast("int") for c in ("last_two_negative", "is_declining")}))


DECLINE = f"""WITH {WINDOW_IC}, k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY win DESC) AS n FROM i), a AS (SELECT feature, count(ic) AS n_windows, regr_slope(ic, win) AS slope, avg(CASE WHEN n <= 3 THEN ic END) AS recent, coalesce(bool_and(CASE WHEN n <= 2 THEN ic < 0 END), false) AS neg FROM k GROUP BY 1)
SELECT feature, n_windows, {s9("slope")} AS slope, {s9("recent")} AS recent, CAST(neg AS INTEGER) AS last_two_negative, CASE WHEN n_windows >= 3 THEN CAST(slope < -0.001 OR recent < 0.01 OR neg AS INTEGER) END AS is_declining FROM a"""


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robustness.forward_verdict(forward_ic(spark, sf_dir), ["feature"]))


VERDICT = f"""WITH {WINDOW_IC}, a AS (SELECT feature, count(ic) AS n_windows, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_sd, avg(CAST(ic > 0 AS INTEGER)) AS share_positive FROM i GROUP BY 1)
SELECT feature, n_windows, {s9("ic_mean")} AS ic_mean, {s9("ic_sd")} AS ic_sd, {s9("share_positive")} AS share_positive, CASE WHEN share_positive = 1 THEN 'real' WHEN share_positive > 0 THEN 'unstable' ELSE 'overfitted' END AS verdict FROM a"""


def network_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stats.correlation_pairs(A.wide(spark, sf_dir), ["mean_ratio", "z", "pos", "ret", "volume"])
    return stats.closeness(pairs, 0.5).withColumn("closeness", r9("closeness"))


CLOSENESS = f"""WITH RECURSIVE {BARS}, {A.COMPLETE}, p AS ({A.PAIR_ROWS}), u AS (SELECT a, b FROM p WHERE abs(r) > 0.5), e AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), nd AS (SELECT DISTINCT a AS node FROM p UNION SELECT b FROM p),
wk AS (SELECT node AS source, node AS target, 0 AS steps FROM nd UNION SELECT source, b, steps + 1 FROM wk JOIN e ON target = a WHERE steps < 5), d AS (SELECT source, target, min(steps) AS steps FROM wk GROUP BY 1, 2)
SELECT source AS node, count(*) - 1 AS reached, {s9("coalesce((count(*) - 1) * (count(*) - 1) / nullif(sum(steps) * ((SELECT count(*) FROM nd) - 1), 0), 0)")} AS closeness FROM d GROUP BY 1"""


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of samples of three series side by side, and the return of one of them."""
    df = bars(spark, sf_dir).withColumn("r", R.ret(F.col("close"), 1, W())).where(F.col("r").isNotNull())
    t = features.tensor_4d(features.sequences(df, ["close", "volume"], 4, 1, 1, F.col("r")), ["click", "error", "purchase"], "error")
    return t.select("ts", F.size("x").cast("bigint").alias("n_series"), *(F.round(F.col("x")[i][j][0].cast("double"), 4).alias(f"x_{i}_{j}") for i in range(3) for j in (0, 3)), r9("y").alias("y"))


TENSORS = f"""WITH {BARS}, r AS (SELECT *, close / lag(close, 1) {ROW} - 1 AS r FROM bars), f AS (SELECT * FROM r WHERE r IS NOT NULL), s AS (SELECT series, ts, row_number() {ROW} AS n, lag(close, 3) {ROW} AS c0, close AS c3, lead(r, 1) {ROW} AS y FROM f), k AS (SELECT * FROM s WHERE n >= 4 AND y IS NOT NULL)
SELECT a.ts, CAST(3 AS BIGINT) AS n_series, {", ".join(f"round({t}.c{j}, 4) + 0 AS x_{i}_{j}" for i, t in enumerate("abc") for j in (0, 3))}, {s9("b.y")} AS y FROM k a JOIN k b ON a.ts = b.ts AND a.series = 'click' AND b.series = 'error' JOIN k c ON c.ts = a.ts AND c.series = 'purchase'"""


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = features.matrix(featured(spark, sf_dir), ["z", "pos", "ret"])
    return m.select("series", "ts", *(F.round(F.col("x")[i].cast("double"), 3).alias(f"x_{i}") for i in range(3)))


MATRICES = f"WITH {BARS}, {FEATURED} SELECT series, ts, {', '.join(f'round({c}::FLOAT::DOUBLE, 3) + 0 AS x_{i}' for i, c in enumerate(('z', 'pos', 'ret')))} FROM f WHERE z IS NOT NULL AND pos IS NOT NULL AND ret IS NOT NULL"


QUERIES: dict[str, Query] = {
    "scan_ohlcv_csv": (csv_bars, f"WITH {BARS} SELECT series, ts, {OHLCV_SQL} FROM bars"),
    "scan_ohlcv_timeframe": (lambda s, d: csv_bars(s, d, "H4"), f"WITH {BARS} SELECT series, 'H4' AS timeframe, ts, {OHLCV_SQL} FROM bars"),
    "scan_features_parquet": (lambda s, d: stored_features(s, d, "parquet"), STORED),
    "scan_features_csv": (lambda s, d: stored_features(s, d, "csv"), STORED),
    "discovered_tables": (found_tables, FOUND),
    "stored_samples": (stored_samples, STORED_SAMPLES),
    "macro_observations": (lambda s, d: macro(s, d).select("series_id", "date", "value"), f"WITH {MACRO} SELECT * FROM m"),
    "macro_wide": (lambda s, d: B.macro_wide(macro(s, d), [f"r{i}" for i in range(5)]), f"WITH {MACRO} SELECT date, " + ", ".join(f"max(CASE WHEN series_id = 'r{i}' THEN value END) AS r{i}" for i in range(5)) + " FROM m GROUP BY 1"),
    "instruments": (instruments, INSTRUMENTS),
    "stored_analyses": (stored_analyses, STORED_ANALYSES),
    "exported_consensus": (exported_consensus, EXPORTED),
    "complete_candles": (completed, f"WITH {bars_sql('1 hour')} SELECT series, ts, {s9('close')} AS close FROM bars WHERE volume > 4"),
    "screening_table": (screening, SCREENING),
    "approved_columns": (approved_columns, APPROVED),
    "admitted_features": (admitted, ADMITTED),
    "run_summary": (sized, SIZED),
    "samples_in_sample": (every_sample, EVERY_SAMPLE),
    "normalised_samples": (normalised, NORMALISED),
    "normalised_columns": (normalised_flat, NORMALISED_FLAT),
    "window_scores": (scored, SCORED),
    "look_ahead_report": (look_ahead, LOOK_AHEAD),
    "robust_selection": (lambda s, d: selected(s, d, 1), selected_sql(1)),
    "robust_selection_fallback": (lambda s, d: selected(s, d, 20), selected_sql(20)),
    "significant_features": (significant, SIGNIFICANT),
    "redundant_pairs": (redundant_pairs, REDUNDANT),
    "mi_to_ic": (mi_to_ic, MI_TO_IC),
    "validated_ic": (validated_ic, VALIDATED),
    "consensus_run": (whole_consensus, WHOLE),
    "consensus_at_least": (at_least_strong, f"WITH x AS ({A.CONSENSUS}) SELECT feature, category FROM x WHERE category IN ('strong', 'very strong')"),
    "feature_sets": (feature_sets, SETS),
    "best_first": (best_first, BEST_FIRST),
    "typed_columns": (typed, TYPED),
    "inner_times_two": (lambda s, d: side_by_side(s, d, False), TWO),
    "inner_times_three": (lambda s, d: side_by_side(s, d, True), THREE),
    "aligned_bars": (aligned, ALIGNED),
    "multi_timeframe": (timeframes, TIMEFRAMES),
    "chosen_days": (chosen_days, CHOSEN),
    "thirds_gate": (third_gate, THIRD_GATE),
    "regime_significance": (regime_p, REGIME_P),
    "robustness_report": (whole_report, REPORT),
    "prediction_metrics": (predicted_metrics, PREDICTED),
    "forward_decline": (decline, DECLINE),
    "forward_verdict": (verdict, VERDICT),
    "network_closeness": (network_closeness, CLOSENESS),
    "tensor_4d": (tensors, TENSORS),
    "matrix_2d": (matrices, MATRICES),
}
