"""Queries of samples in more dimensions: NPZ archives written and read again, tensors normalised by series, and timeframes side by side, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import rolling as R
from barwright.operators import features
from barwright.plans.bar_queries import BARS, N, ROW, Query, W, bars, bars_sql, before, r9, s9
from barwright.plans.table_queries import MATRICES, TENSORS, featured
from barwright.sources import npz
from barwright.sources.bars import scratch

THREE = ["click", "error", "purchase"]


def tensor_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of three series as an array of four dimensions in archives, and their targets beside them, read again."""
    df = bars(spark, sf_dir).withColumn("r", R.ret(F.col("close"), 1, W())).where(F.col("r").isNotNull())
    t = features.tensor_4d(features.sequences(df, ["close", "volume"], 4, 1, 1, F.col("r")), THREE, "error").withColumn("i", F.unix_timestamp(F.col("ts").cast("timestamp")))
    path = scratch(spark)
    npz.write_npz(npz.entries(t, "X", "i", "x", 3).unionByName(npz.entries(t.withColumn("y", F.array("y")), "y", "i", "y", 1)), path)
    x = npz.read_npz(spark, path, "X").select("index", "shape", "values")
    y = npz.read_npz(spark, path, "y").select("index", F.col("values")[0].alias("y"))
    at = lambda i, j: F.get("values", (i * F.get("shape", F.lit(1)) + j) * F.get("shape", F.lit(2))).alias(f"x_{i}_{j}")
    out = x.join(y, "index")
    return out.select(F.timestamp_seconds("index").cast("timestamp_ntz").alias("ts"), F.get("shape", F.lit(0)).alias("n_series"), *(F.round(at(i, j), 4).alias(f"x_{i}_{j}") for i in range(3) for j in (0, 3)), r9("y").alias("y"))


def matrix_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices of all series, an array each, read again in one load."""
    m = features.matrix(featured(spark, sf_dir), ["z", "pos", "ret"]).withColumn("i", F.unix_timestamp(F.col("ts").cast("timestamp")))
    path = scratch(spark)
    npz.write_npz(npz.entries(m, F.col("series"), "i", "x", 1), path)
    out = npz.read_npz(spark, path)
    return out.select(F.col("array").alias("series"), F.timestamp_seconds("index").cast("timestamp_ntz").alias("ts"), *(F.round(F.get("values", F.lit(i)), 3).alias(f"x_{i}") for i in range(3)))


def normalised_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars(spark, sf_dir).withColumn("r", R.ret(F.col("close"), 1, W()))
    t = features.normalised_tensor(df, ["close", "volume"], "zscore_rolling", N, 3, 1, 1, F.col("r"), THREE, "error")
    return t.select("ts", *(F.round(F.col("x")[i][j][k].cast("double"), 3).alias(f"x_{i}_{j}_{k}") for i in range(3) for j in (0, 2) for k in range(2)), r9("y").alias("y"))


_PIT = lambda x: f"CAST(CASE WHEN count({x}) {before(N)} = {N} THEN ({x} - avg({x}) {before(N)}) / (stddev_samp({x}) {before(N)} + 1e-8) END AS FLOAT)"
NORMALISED_TENSOR = f"""WITH {BARS}, n AS (SELECT series, ts, {_PIT("close")} AS c, {_PIT("volume")} AS v, close / lag(close, 1) {ROW} - 1 AS r FROM bars), f AS (SELECT * FROM n WHERE c IS NOT NULL AND v IS NOT NULL AND r IS NOT NULL),
s AS (SELECT series, ts, row_number() {ROW} AS i, lag(c, 2) {ROW} AS c0, lag(v, 2) {ROW} AS v0, c, v, lead(r, 1) {ROW} AS y FROM f), k AS (SELECT * FROM s WHERE i >= 3 AND y IS NOT NULL)
SELECT a.ts, {", ".join(f"round({t}.{x}::DOUBLE, 3) + 0 AS x_{i}_{j}_{k}" for i, t in enumerate("abc") for j, k, x in ((0, 0, "c0"), (0, 1, "v0"), (2, 0, "c"), (2, 1, "v")))}, {s9("b.y")} AS y FROM k a JOIN k b ON a.ts = b.ts AND a.series = 'click' AND b.series = 'error' JOIN k c ON c.ts = a.ts AND c.series = 'purchase'"""


def timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.cross_timeframe(bars(spark, sf_dir, "1 hour"), {"h4": bars(spark, sf_dir), "d": bars(spark, sf_dir, "1 day")}, ["close", "volume"], 3, {"h4": "4 HOURS", "d": "1 DAY"})
    return out.select("series", F.col("ts").cast("timestamp_ntz").alias("ts"), *(F.round(F.col("x")[i][j][k].cast("double"), 4).alias(f"x_{i}_{j}_{k}") for i in range(3) for j in (0, 2) for k in range(2)))


_FRAME = lambda name, every, wait: f"{bars_sql(every, name + '0')}, {name} AS (SELECT series, ts{wait} AS ts, row_number() {ROW} AS i, lag(close, 2) {ROW} AS c0, lag(volume, 2) {ROW} AS v0, close AS c, volume AS v FROM {name}0)"
TIMEFRAMES = f"""WITH {_FRAME("f", "1 hour", "")}, {_FRAME("x", "4 hours", " + INTERVAL 4 HOUR")}, {_FRAME("y", "1 day", " + INTERVAL 1 DAY")}, xx AS (SELECT * FROM x WHERE i >= 3), yy AS (SELECT * FROM y WHERE i >= 3)
SELECT f.series, f.ts, {", ".join(f"round({t}.{c}::FLOAT::DOUBLE, 4) + 0 AS x_{i}_{j}_{k}" for i, t in enumerate(("f", "x", "y")) for j, k, c in ((0, 0, "c0"), (0, 1, "v0"), (2, 0, "c"), (2, 1, "v")))} FROM f ASOF JOIN xx x ON f.series = x.series AND f.ts >= x.ts ASOF JOIN yy y ON f.series = y.series AND f.ts >= y.ts WHERE f.i >= 3 AND x.ts >= f.ts - INTERVAL 7 DAY AND y.ts >= f.ts - INTERVAL 7 DAY"""


QUERIES: dict[str, Query] = {
    "npz_tensor": (tensor_archives, TENSORS),
    "npz_matrices": (matrix_archives, MATRICES),
    "normalised_tensor_4d": (normalised_tensor, NORMALISED_TENSOR),
    "cross_timeframe": (timeframes, TIMEFRAMES),
}
