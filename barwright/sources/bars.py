"""Candles: schema, readers, sinks, and bars derived from tick tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLCV = ("open", "high", "low", "close", "volume")
BAR = T.StructType([T.StructField("series", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in OHLCV)])
CSV_BAR = T.StructType([T.StructField("time", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in OHLCV)])
#: Columns of a feature table that are text.
TEXTS = ("series", "timeframe")
#: Bar lengths by code.
TIMEFRAMES = {"S5": "5 seconds", "M1": "1 minute", "M5": "5 minutes", "M15": "15 minutes", "M30": "30 minutes", "H1": "1 hour", "H4": "4 hours", "D": "1 day", "W": "7 days"}


def require(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """One mark for a missing number: NaN becomes NULL at the source."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns))


def read_ohlcv_csv(spark: SparkSession, path: str, timeframe: str | None = None) -> DataFrame:
    """Candle files named <series>.csv or <series>_<timeframe>.csv, all in one scan, by an explicit schema. The bar's time is its opening."""
    raw = spark.read.schema(CSV_BAR).option("header", True).csv(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1)
    series = F.regexp_replace(name, f"_{timeframe}$", "") if timeframe else name
    out = raw.select(series.alias("series"), F.col("time").alias("ts"), *OHLCV)
    return nulls_for_nans(out if not timeframe else out.withColumn("timeframe", F.lit(timeframe)))


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A feature table, Parquet or CSV by its suffix; with columns only those reach the scan. Of a CSV, `series` and `timeframe` are text, `ts` is a time and the rest are numbers."""
    if path.endswith(".csv"):
        names = spark.read.option("header", True).csv(path).columns  # reads the first line
        kinds = {c: "STRING" if c in TEXTS else "TIMESTAMP" if c in ("ts", "time") else "DOUBLE" for c in names}
        df = spark.read.schema(", ".join(f"`{c}` {k}" for c, k in kinds.items())).option("header", True).csv(path)
    elif path.endswith(".parquet") or "." not in path.rsplit("/", 1)[-1]:
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"neither Parquet nor CSV: {path}")
    return df.select(*columns) if columns else df


def read_numbers_csv(spark: SparkSession, path: str, columns: list[str], time: str = "ts") -> DataFrame:
    """Times and numbers of CSV files with a header, by name, as ts and those columns; `series` is text if it is asked for. Rows without one of the numbers are left out, as a resample needs whole rows."""
    names = spark.read.option("header", True).csv(path).columns  # reads the first line
    if missing := [c for c in [time, *columns] if c not in names]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    kinds = {c: "TIMESTAMP" if c == time else "STRING" if c in TEXTS else "DOUBLE" if c in columns else "STRING" for c in names}
    raw = spark.read.schema(", ".join(f"`{c}` {k}" for c, k in kinds.items())).option("header", True).csv(path)
    numbers = [c for c in columns if c not in TEXTS]
    return nulls_for_nans(raw.select(F.col(time).alias("ts"), *columns)).na.drop("any", subset=numbers)


def returns_from_csv(spark: SparkSession, path: str, column: str = "r", keys: tuple[str, ...] = (), time: str = "ts") -> DataFrame:
    """keys, ts and r for resampling.bootstrap."""
    return read_numbers_csv(spark, path, [*keys, column], time).select(*keys, "ts", F.col(column).alias("r"))


def predictions_from_csv(spark: SparkSession, path: str, predicted: str = "y_pred", actual: str = "y_true", keys: tuple[str, ...] = (), time: str = "ts") -> DataFrame:
    """keys, ts, y_true and y_pred for resampling.permutation."""
    return read_numbers_csv(spark, path, [*keys, actual, predicted], time).select(*keys, "ts", F.col(actual).alias("y_true"), F.col(predicted).alias("y_pred"))


def features_with_target(spark: SparkSession, features: str, target: str, y: str = "target", keys: tuple[str, ...] = ()) -> DataFrame:
    """A feature table and a target table, Parquet or CSV, side by side at the times that both have: what walk-forward validation starts from."""
    a, b = (df.withColumnRenamed("time", "ts") for df in (read_features(spark, features), read_features(spark, target)))
    return a.join(b.select(*keys, "ts", y), [*keys, "ts"])


def read_macro_csv(spark: SparkSession, path: str) -> DataFrame:
    """Macro observations (series_id, category, frequency, date, value); '.' stands for none."""
    schema = "series_id STRING, category STRING, frequency STRING, date DATE, value STRING"
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.where(F.col("value") != ".").withColumn("value", F.expr("try_cast(value AS DOUBLE)"))


def macro_wide(macro: DataFrame, series: list[str]) -> DataFrame:
    return macro.groupBy("date").pivot("series_id", series).agg(F.first("value"))


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    schema = "name STRING, displayName STRING, pipLocation INT, marginRate DOUBLE, financing STRUCT<longRate: DOUBLE, shortRate: DOUBLE>, commission STRUCT<commission: DOUBLE, unitsTraded: DOUBLE, minimumCommission: DOUBLE>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def only_complete(candles: DataFrame) -> DataFrame:
    return candles.where(F.col("complete")).drop("complete")


def write_features(df: DataFrame, path: str, keys: tuple[str, ...] = ("series",), mode: str = "errorifexists") -> None:
    df.repartition(*keys).write.mode(mode).option("compression", "snappy").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_ohlcv_csv(bars: DataFrame, root: str, timeframe: str | None = None, mode: str = "errorifexists") -> None:
    """Each series as <root>/<series>[_<timeframe>].csv, as read_ohlcv_csv reads them; one write for each series."""
    for row in bars.select("series").distinct().collect():  # names of series
        name = row["series"] + (f"_{timeframe}" if timeframe else "")
        write_csv(bars.where(F.col("series") == row["series"]).select(F.col("ts").cast("timestamp").alias("time"), *OHLCV), f"{root.rstrip('/')}/{name}.csv", mode=mode)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Samples as features.sequences() gives them: x as one array of numbers with its two lengths, so that any reader can shape it again."""
    flat = samples.withColumn("rows", F.size("x")).withColumn("columns", F.size(F.col("x")[0])).withColumn("x", F.flatten("x"))
    flat.write.mode(mode).parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    x = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.slice("x", i * F.col("columns") + 1, F.col("columns")))
    return df.withColumn("x", x).drop("rows", "columns")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names for checkpoints; in a local one only where everything runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="barwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/barwright/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that what reads it several times computes it once and lost executors cost nothing of it."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discovered(spark: SparkSession, root: str, timeframe: str | None = None) -> DataFrame:
    """name, kind of the tables <name>[_<timeframe>].parquet and .csv under root, files or folders; Parquet where there are both. Only paths are read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    found = paths.select(F.regexp_extract("path", r"/([^/]+)\.(parquet|csv)(?:/|$)", 1).alias("name"), F.regexp_extract("path", r"/([^/]+)\.(parquet|csv)(?:/|$)", 2).alias("kind")).where(F.col("name") != "")
    if timeframe:
        found = found.where(F.col("name").endswith(f"_{timeframe}")).withColumn("name", F.regexp_replace("name", f"_{timeframe}$", ""))
    return found.groupBy("name").agg(F.max("kind").alias("kind"))


def close_column(names: list[str]) -> str:
    """close, or else the first column with close in its name."""
    found = [c for c in names if c == "close"] or [c for c in names if "close" in c.lower()]
    if not found:
        raise ValueError("no column of closing prices")
    return found[0]


# ---- bars from ticks


def tick_bars(ticks: DataFrame, every: str, series: Column, price: Column, volume: Column, ts: Column, order: Column) -> DataFrame:
    """Open, high, low, close and volume of each series by time bucket; first and last tick by `order`. One shuffle with partial aggregates."""
    picked = ticks.select(series.alias("series"), F.window(ts, every)["start"].alias("bar"), price.cast("double").alias("p"), volume.cast("double").alias("v"), order.alias("o"))
    return picked.groupBy("series", F.col("bar").alias("ts")).agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("volume"))


def event_bars(events: DataFrame, every: str = "4 hours") -> DataFrame:
    """Bars of an event table: one series for each type, price 1 + value / 100, volume the number of events."""
    return tick_bars(events, every, F.col("event_type"), 1 + F.col("value") / 100, F.lit(1.0), F.col("ts"), F.struct("ts", "event_id"))


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars of shipments: one series for each return flag, price an item, volume the quantity."""
    return tick_bars(lineitem, "1 day", F.col("l_returnflag"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.col("l_shipdate"), F.struct("l_orderkey", "l_linenumber"))


# ---- duplicates


def drop_all_copies(df: DataFrame, keys: tuple[str, ...] = ("ts", "series")) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") == 1).drop("_n")


def keep_first(df: DataFrame, order: list[Column], keys: tuple[str, ...] = ("ts", "series")) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")
