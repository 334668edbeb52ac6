"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, every: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Open, high, low, close and volume by series and bucket; ticks later than `late` are dropped, and a bar is final once the watermark passes its end. ticks: series, ts, price, volume, order."""
    marked = ticks.withWatermark("ts", late)
    by = marked.groupBy("series", F.window("ts", every).alias("w"))
    bars = by.agg(F.min_by("price", F.struct("ts", "order")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "order")).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("series", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
