"""All queries of the library but those of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.plans import analysis_queries, bar_queries, forward_queries, gate_queries, model_queries, network_queries, rule_queries, sample_queries, table_queries, tree_queries

_ALL = bar_queries.QUERIES | analysis_queries.QUERIES | table_queries.QUERIES | model_queries.QUERIES | forward_queries.QUERIES | gate_queries.QUERIES | network_queries.QUERIES | rule_queries.QUERIES | sample_queries.QUERIES | tree_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten features of four-hour bars."""
    from barwright.functions import rolling as R

    w, x = R.series_window(), F.col("close")
    made = {"delta_5": R.delta(x, 5, w), "ret_5": R.ret(x, 5, w), "mean_5": R.mean(x, 5, w), "sd_5": R.sd(x, 5, w), "max_5": R.highest(x, 5, w), "min_5": R.lowest(x, 5, w), "z_5": R.zscore(x, 5, w), "pos_5": R.position(x, 5, w), "d1": R.d1(x, w), "d2": R.d2(x, w)}
    return bar_queries.bars(spark, sf_dir).withColumns(made)
