"""Long series in blocks, so that a window over one series is many tasks instead of one.

A row's number in its series comes from counts by day, summed over days, and its number within the day: no task sees a series as a whole. Each block also gets the last rows of the one before it, as many as the longest window looks back, and these are dropped once the windows are computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, out: str, keys: tuple[str, ...] = ("series",), order: str = "ts", coarse: str = "day") -> DataFrame:
    """df with each row's number in its series, from 0, by counts of days: no task sees more than a day of a series."""
    marked = df.withColumn("_day", F.date_trunc(coarse, F.col(order).cast("timestamp")))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    firsts = marked.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row for each day
    within = Window.partitionBy(*keys, "_day").orderBy(order)
    return marked.withColumn("_i", F.row_number().over(within) - 1).join(firsts, [*keys, "_day"]).select(*df.columns, (F.col("_i") + F.col("_first")).alias(out))


def in_blocks(df: DataFrame, rows: int, halo: int, keys: tuple[str, ...] = ("series",), order: str = "ts", coarse: str = "day") -> DataFrame:
    """df with _block and _halo; rows of the halo come twice, once as such."""
    if not 0 <= halo <= rows:
        raise ValueError("the halo is at most a block")
    block = F.floor(F.col("_i") / rows)
    again = F.when(F.col("_i") % rows >= rows - halo, F.array(F.struct(block.alias("b"), F.lit(False).alias("h")), F.struct((block + 1).alias("b"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(block.alias("b"), F.lit(False).alias("h"))))
    return numbered(df, "_i", keys, order, coarse).withColumn("_at", F.explode(again)).select(*df.columns, F.col("_at.b").alias("_block"), F.col("_at.h").alias("_halo"))


def by_blocks(df: DataFrame, compute: Callable[[DataFrame, tuple[str, ...]], DataFrame], rows: int = 1_000_000, halo: int = 400, keys: tuple[str, ...] = ("series",), order: str = "ts") -> DataFrame:
    """compute(df, keys) with windows of no more than halo + 1 rows in all, block by block."""
    return compute(in_blocks(df, rows, halo, keys, order), (*keys, "_block")).where(~F.col("_halo")).drop("_block", "_halo")
