"""Trading costs: spreads by hour and weekday, slippage, swaps, commission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pips by UTC hour, weekday factors (Monday first), factors and swap rates (long, short; USD a lot and night) by series.
SPREAD_BY_HOUR = (1.8, 1.7, 1.6, 1.6, 1.5, 1.5, 1.4, 1.4, 1.3, 1.3, 1.3, 1.3, 1.3, 1.2, 1.2, 1.2, 1.3, 1.4, 1.5, 1.6, 1.8, 2.2, 2.8, 2.5)
WEEKDAY_FACTOR = (1.00, 0.95, 0.95, 0.95, 1.15)
SERIES_FACTOR = {"EUR_USD": 1.0, "GBP_USD": 1.3, "USD_JPY": 0.9, "EUR_JPY": 1.5, "GBP_JPY": 2.0, "AUD_USD": 1.1}
SWAP = {"EUR_USD": (-6.50, 1.20), "GBP_USD": (-5.80, 0.80), "USD_JPY": (4.20, -8.50), "EUR_JPY": (-2.30, -4.10), "GBP_JPY": (1.50, -9.20), "AUD_USD": (-3.40, -1.80)}
DEFAULT_SPREAD = 1.5
SLIPPAGE_BASE, SLIPPAGE_LOW, SLIPPAGE_HIGH, SLIPPAGE_PER_VOLATILITY = 0.3, 0.2, 3.0, 0.5


def usd_per_pip(series: str) -> float:
    return 9.0 if "JPY" in series else 10.0


def spread_table(spark: SparkSession, series: list[str] | None = None) -> DataFrame:
    """pair, hour_utc, day_of_week, spread_pips, spread_usd_per_lot: 120 rows for each series."""
    rows = []
    for s in series or list(SERIES_FACTOR):
        for hour, base in enumerate(SPREAD_BY_HOUR):
            for day, factor in enumerate(WEEKDAY_FACTOR):
                pips = round(base * factor * SERIES_FACTOR.get(s, 1.0), 1)
                rows.append((s, hour, day, pips, round(pips * usd_per_pip(s), 2)))
    return spark.createDataFrame(rows, "pair STRING, hour_utc INT, day_of_week INT, spread_pips DOUBLE, spread_usd_per_lot DOUBLE")


def with_spread(df: DataFrame, spreads: DataFrame, series: str = "series", ts: str = "ts") -> DataFrame:
    """df with spread, by hour and weekday; the default where the table has none. The table has 120 rows a series."""
    s = spreads.select(F.col("pair").alias("_p"), F.col("hour_utc").alias("_h"), F.col("day_of_week").alias("_d"), "spread_pips")
    joined = df.join(s, (F.col(series) == F.col("_p")) & (F.hour(ts) == F.col("_h")) & (F.weekday(ts) == F.col("_d")), "left")
    return joined.withColumn("spread", F.coalesce("spread_pips", F.lit(DEFAULT_SPREAD))).drop("_p", "_h", "_d", "spread_pips")


def spread_summary(spreads: DataFrame) -> DataFrame:
    return spreads.groupBy("pair").agg(F.round(F.min("spread_pips"), 2).alias("lowest"), F.round(F.avg("spread_pips"), 2).alias("mean"), F.round(F.max("spread_pips"), 2).alias("highest"))


def spread_by_hour(spreads: DataFrame) -> DataFrame:
    """Mean spread by hour, a column for each weekday."""
    return spreads.groupBy("hour_utc").pivot("day_of_week", [0, 1, 2, 3, 4]).agg(F.avg("spread_pips"))


def best_hours(spreads: DataFrame) -> DataFrame:
    by_hour = spreads.groupBy("pair", "hour_utc").agg(F.avg("spread_pips").alias("m"))
    return by_hour.groupBy("pair").agg(F.min_by("hour_utc", F.struct("m", "hour_utc")).alias("best_hour"), F.max_by("hour_utc", F.struct("m", -F.col("hour_utc"))).alias("worst_hour"))


def slippage(atr: Column, usual: Column, news: Column | None = None) -> Column:
    """Pips, more with volatility above its usual level, within bounds; the upper bound on news."""
    pips = SLIPPAGE_BASE * (1 + SLIPPAGE_PER_VOLATILITY * (F.coalesce(F.try_divide(atr, usual), F.lit(1.0)) - 1))
    bounded = F.greatest(F.lit(SLIPPAGE_LOW), F.least(pips, F.lit(SLIPPAGE_HIGH)))
    return bounded if news is None else F.when(news, F.lit(SLIPPAGE_HIGH)).otherwise(bounded)


def swap_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in SWAP.items()], "pair STRING, swap_long DOUBLE, swap_short DOUBLE")


def swap(rate: Column, lots: Column, nights: Column, open_day: Column) -> Column:
    """USD for the nights held; the first Wednesday night counts three times."""
    days = F.when(nights > 0, F.sequence(F.lit(0), nights - 1)).otherwise(F.array().cast("array<int>"))
    triple = F.exists(days, lambda d: F.pmod(open_day + d, F.lit(5)) == 2)
    return F.round(rate * lots * (nights + F.when(triple, 2).otherwise(0)), 2)


def commission(lots: Column, per_lot: float = 0.0) -> Column:
    return F.round(lots * per_lot, 2)


def total_cost(spread_usd: Column, slippage_usd: Column, swap_usd: Column, commission_usd: Column) -> Column:
    """A swap earned is no cost, and doesn't lessen the others."""
    return spread_usd + slippage_usd + F.abs(F.least(swap_usd, F.lit(0.0))) + commission_usd


def pip_size(series: Column) -> Column:
    return F.when(series.contains("JPY"), F.lit(0.01)).otherwise(F.lit(0.0001))


def in_usd(pips: Column, lots: Column, series: Column) -> Column:
    """What pips are worth, by the value of a pip of a lot."""
    return F.round(pips * F.when(series.contains("JPY"), 9.0).otherwise(10.0) * lots, 2)
