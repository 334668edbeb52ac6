"""True range, trend strength and market regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barwright.functions import rolling as R


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close", 1).over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(bars: DataFrame, w: WindowSpec, n: int = 14, out: str = "atr") -> DataFrame:
    return bars.withColumn("_tr", true_range(w)).withColumn(out, R.mean(F.col("_tr"), n, w)).drop("_tr")


def with_adx(bars: DataFrame, w: WindowSpec, n: int = 14, out: str = "adx") -> DataFrame:
    """Average directional index by simple means. Of the two directional moves only the larger counts; equal ones count upward."""
    up = F.greatest(F.col("high") - F.lag("high", 1).over(w), F.lit(0.0))
    down = F.greatest(F.lag("low", 1).over(w) - F.col("low"), F.lit(0.0))
    first = F.lag("close", 1).over(w).isNull()
    moved = bars.withColumn("_tr", true_range(w)).withColumn("_u", F.when(~first, up)).withColumn("_d", F.when(~first, down))
    moved = moved.withColumns({"_up": F.when(F.col("_u") >= F.col("_d"), F.col("_u")).when(F.col("_u").isNotNull(), 0.0), "_down": F.when(F.col("_d") > F.col("_u"), F.col("_d")).when(F.col("_d").isNotNull(), 0.0)})
    atr = R.mean(F.col("_tr"), n, w)
    moved = moved.withColumns({"_pdi": 100 * F.try_divide(R.mean(F.col("_up"), n, w), atr), "_mdi": 100 * F.try_divide(R.mean(F.col("_down"), n, w), atr)})
    moved = moved.withColumn("_dx", 100 * F.abs(F.col("_pdi") - F.col("_mdi")) / (F.col("_pdi") + F.col("_mdi") + 1e-10))
    return moved.withColumn(out, R.mean(F.col("_dx"), n, w)).drop("_tr", "_u", "_d", "_up", "_down", "_pdi", "_mdi", "_dx")


def with_regimes(bars: DataFrame, w: WindowSpec, n: int = 14, trending: float = 25, ranging: float = 20, high: float = 0.75, low: float = 0.25) -> DataFrame:
    """bars with adx, atr, atr_pct and four flags; volatility is judged by each series' own quantiles."""
    df = with_adx(with_atr(bars, w, n), w, n).withColumn("atr_pct", F.try_divide("atr", "close") * 100)
    cuts = df.groupBy("series").agg(F.percentile("atr_pct", F.lit(high)).alias("_high"), F.percentile("atr_pct", F.lit(low)).alias("_low"))
    flags = {"is_trending": F.col("adx") > trending, "is_ranging": F.col("adx") < ranging, "is_high_vol": F.col("atr_pct") > F.col("_high"), "is_low_vol": F.col("atr_pct") < F.col("_low")}
    return df.join(cuts, "series").withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).drop("_high", "_low")
