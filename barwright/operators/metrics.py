"""Return and trade metrics as aggregates; drawdowns as windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 999.99
_TINY = 1e-10


def sharpe(r: str, periods: int) -> Column:
    sd = F.stddev_samp(r)
    return F.when(sd > _TINY, F.avg(r) / sd * math.sqrt(periods)).otherwise(F.lit(0.0))


def profit_factor(r: str, break_even: float = 0.0) -> Column:
    won, lost = F.coalesce(F.sum(F.when(F.col(r) > 0, F.col(r))), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(F.col(r) < 0, F.col(r))), F.lit(0.0)))
    return F.when(lost > _TINY, won / F.when(lost > _TINY, lost)).when(won > _TINY, F.lit(CAP)).otherwise(F.lit(break_even))


def win_rate(r: str) -> Column:
    return F.avg((F.col(r) > 0).cast("double"))


def win_loss(r: str) -> Column:
    won, lost = F.avg(F.when(F.col(r) > 0, F.col(r))), F.abs(F.avg(F.when(F.col(r) < 0, F.col(r))))
    return F.when(won.isNull(), F.lit(0.0)).when(lost.isNull(), F.lit(CAP)).otherwise(F.try_divide(won, lost))


def total_return(r: str) -> Column:
    return (F.product(1 + F.col(r)) - 1) * 100


def annual_return(r: str, periods: int) -> Column:
    return F.avg(r) * periods * 100


def metrics(r: str = "r", periods: int = 252) -> list[Column]:
    return [F.count(r).alias("n"), sharpe(r, periods).alias("sharpe"), profit_factor(r).alias("profit_factor"), win_rate(r).alias("win_rate"), win_loss(r).alias("win_loss"), total_return(r).alias("total_return"), annual_return(r, periods).alias("annual_return")]


def return_metrics(df: DataFrame, by: list[str], r: str = "r", periods: int = 252) -> DataFrame:
    return df.groupBy(*by).agg(*metrics(r, periods))


def drawdowns(df: DataFrame, r: str = "r", keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """df with equity (compounded returns) and drawdown (percent below the highest so far, from 1 on)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.product(1 + F.col(r)).over(w))
    return df.withColumn("drawdown", (F.col("equity") / F.max("equity").over(w) - 1) * 100)


def strategy_returns(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    return df.withColumn("r", F.signum(predicted) * F.col(actual))


def trade_metrics(trades: DataFrame, equity: DataFrame, capital: float, by: str = "pair", per_year: int = 24_192) -> DataFrame:
    """Of each pair's trades and equity curve: win rate, profit factor, Sharpe, Sortino, Calmar, drawdowns, costs. Deviations are of the population."""
    t = trades.withColumn("r", F.col("return_pct") / 100)
    sd = F.stddev_pop("r")
    down = F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r"))))
    root = math.sqrt(per_year)
    a = t.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("net_pnl") > 0).alias("n_wins"), F.count_if(F.col("net_pnl") < 0).alias("n_losses"),
        (F.avg((F.col("net_pnl") > 0).cast("double")) * 100).alias("win_rate"), profit_factor("net_pnl", 1.0).alias("profit_factor"), (F.sum("net_pnl") / capital * 100).alias("total_return"),
        F.when(sd > _TINY, F.avg("r") / sd * root).otherwise(0.0).alias("sharpe"), F.coalesce(F.when(down > _TINY, F.avg("r") / down * root), F.lit(0.0)).alias("sortino"),
        F.avg(F.when(F.col("net_pnl") > 0, F.col("net_pnl"))).alias("avg_win"), F.avg(F.when(F.col("net_pnl") < 0, F.col("net_pnl"))).alias("avg_loss"),
        (F.sum("cost_spread") + F.sum("cost_slippage") + F.abs(F.sum("cost_swap"))).alias("total_costs"),
    )
    w = Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    dd = equity.withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)
    e = dd.groupBy(by).agg((F.abs(F.min("dd")) * 100).alias("max_drawdown"), (F.abs(F.coalesce(F.avg(F.when(F.col("dd") < 0, F.col("dd"))), F.lit(0.0))) * 100).alias("avg_drawdown"), (F.floor((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86_400) / 365.25).alias("years"))
    out = a.join(e, by).withColumn("annual_return", F.coalesce(F.try_divide("total_return", "years"), F.lit(0.0)))
    return out.withColumn("calmar", F.when(F.col("max_drawdown") > 0.01, F.col("annual_return") / F.col("max_drawdown")).otherwise(F.when(F.col("annual_return") > 0, CAP).otherwise(0.0))).drop("years")


def prediction_metrics(df: DataFrame, predicted: str, actual: str, by: list[str], order: tuple[str, ...] = ("ts",), periods: int = 252) -> DataFrame:
    """ic of predictions with what came, and Sharpe, annual return and volatility (%) and largest drawdown (%) of following their signs."""
    from barwright.operators.stats import pearson

    r = drawdowns(strategy_returns(df, predicted, actual), "r", tuple(by), order)
    return r.groupBy(*by).agg(F.count("r").alias("n"), pearson(predicted, actual).alias("ic"), sharpe("r", periods).alias("sharpe"), annual_return("r", periods).alias("annual_return"), (F.stddev_samp("r") * math.sqrt(periods) * 100).alias("volatility"), F.min("drawdown").alias("max_drawdown"))
