"""Event-driven backtest: what each bar's position would come to is computed as columns, the positions that are taken are found by doubling steps, and only the capital goes from trade to trade."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.blocks import numbered
from barwright.functions.rolling import series_window
from barwright.operators import costs, regimes
from barwright.sources.bars import OHLCV, require, stored


@dataclass(frozen=True)
class Config:
    capital: float = 100_000.0
    risk: float = 0.01
    most: float = 0.10
    stop: float = 2.5
    take: float = 3.5
    timeout: int = 50
    most_spread: float = 5.0
    avoid_hours: tuple[int, ...] = (21, 22, 23)
    bars_per_day: int = 96
    swap_per_night: float = -6.50

    def __post_init__(self) -> None:
        if not 0 < self.risk <= 0.1:
            raise ValueError("risk lies above 0 and is 0.1 at most")
        if not 0 < self.most <= 1:
            raise ValueError("the largest position lies above 0 and is 1 at most")


def prepared(bars: DataFrame, spreads: DataFrame, config: Config, keys: tuple[str, ...] = ("series",), n: str | None = None) -> DataFrame:
    """bars with the previous bar's atr, spread, pip and signal (1 long, -1 short, 0 none): momentum of one and five bars, both up or both down, outside the hours of rollover, wide spreads and late Friday. n: a column with the bar's number in its series, if there is one."""
    require(bars, ["series", "ts", *OHLCV])
    w = series_window(keys)
    df = regimes.with_atr(bars, w).withColumn("atr", F.lag("atr", 1).over(w))
    if n is None:
        n, df = "n", df.withColumn("n", F.row_number().over(w) - 1)
    df = df.withColumns({"ret_1": F.try_divide(F.lag("close", 1).over(w), F.lag("close", 2).over(w)) - 1, "ret_5": F.try_divide(F.lag("close", 1).over(w), F.lag("close", 6).over(w)) - 1})
    df = costs.with_spread(df, spreads).withColumn("pip", costs.pip_size(F.col("series")))
    hour = F.hour("ts")
    blocked = hour.isin(*config.avoid_hours) | (F.col("spread") > config.most_spread) | ((F.weekday("ts") == 4) & (hour >= 17)) | (F.col(n) < 20)
    up, down = (F.col("ret_1") > 0) & (F.col("ret_5") > 0), (F.col("ret_1") < 0) & (F.col("ret_5") < 0)
    return df.withColumn("signal", F.when(blocked, 0).when(up, 1).when(down, -1).otherwise(0))


#: Bars that the columns of `prepared` look back.
LOOKS_BACK = 40
#: Bars of a series in a task.
BLOCK_ROWS = 200_000


def in_blocks(bars: DataFrame, rows: int, before: int, after: int) -> DataFrame:
    """bars with n (number in the series, from 0), _block, and _halo: rows that a block has besides its own, the last ones before it and the first ones after it."""
    if not max(before, after) <= rows:
        raise ValueError("a block has as many rows as its neighbours look into")
    own, place = F.floor(F.col("n") / rows).cast("bigint"), F.col("n") % rows
    one = lambda block, halo, when: F.when(when, F.struct(block.alias("b"), F.lit(halo).alias("h")))
    at = F.array_compact(F.array(one(own, False, F.lit(True)), one(own + 1, True, place >= rows - before), one(own - 1, True, (place < after) & (own > 0))))
    return numbered(bars, "n").withColumn("_at", F.explode(at)).withColumns({"_block": F.col("_at.b"), "_halo": F.col("_at.h")}).drop("_at")


def entries(ready: DataFrame, c: Config) -> DataFrame:
    """ready (prepared bars in blocks) with what a position opened at each bar would come to: entry, stop, stop_loss, take_profit, and age and why of its end, the first bar of the next `timeout` that meets the stop, or else the target, or else the last of them, or the series' last bar. valid: whether one may be opened there."""
    w = Window.partitionBy("series", "_block").orderBy("n")
    side = F.col("signal")
    entry = F.col("close") + side * (F.col("spread") + costs.SLIPPAGE_BASE) * F.col("pip")
    df = ready.withColumns({"entry": entry, "stop": F.col("atr") * c.stop})
    valid = (side != 0) & (F.col("atr") > 0) & (F.col("stop") >= F.col("entry") * 0.0001) & ~F.col("_halo")
    df = df.withColumns({"valid": F.coalesce(valid, F.lit(False)), "stop_loss": F.col("entry") - side * F.col("stop"), "take_profit": F.col("entry") + side * F.col("atr") * c.take})
    df = df.withColumn("_path", F.collect_list(F.struct("low", "high")).over(w.rowsBetween(1, c.timeout)))
    long = side > 0
    first = lambda hit: F.array_min(F.transform("_path", lambda p, i: F.when(hit(p), i + 1)))
    df = df.where("valid OR NOT _halo").withColumns({"_sl": F.when(F.col("valid"), first(lambda p: F.when(long, p["low"] <= F.col("stop_loss")).otherwise(p["high"] >= F.col("stop_loss")))), "_tp": F.when(F.col("valid"), first(lambda p: F.when(long, p["high"] >= F.col("take_profit")).otherwise(p["low"] <= F.col("take_profit")))), "_left": F.size("_path")})
    met = F.least("_sl", "_tp")
    why = F.when(met.isNotNull(), F.when(F.col("_sl") == met, "SL").otherwise("TP")).when(F.col("_left") == c.timeout, "TIMEOUT").otherwise("FIN_BACKTEST")
    return df.withColumns({"age": F.coalesce(met, F.col("_left")), "why": why}).where(~F.col("_halo")).drop("_path", "_sl", "_tp", "_left", "_halo")


def next_valid(bars: DataFrame) -> DataFrame:
    """series, n, next: the first bar from n on at which a position may be opened."""
    w = Window.partitionBy("series", "_block").orderBy("n").rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("valid"), F.col("n"))
    later = Window.partitionBy("series").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    beyond = bars.groupBy("series", "_block").agg(F.min(own).alias("_first")).withColumn("_later", F.min("_first").over(later)).drop("_first")  # a row for each block
    return bars.withColumn("_next", F.min(own).over(w)).join(beyond, ["series", "_block"]).select("series", "n", F.coalesce("_next", "_later").alias("next"))


def chain(nodes: DataFrame) -> DataFrame:
    """series, n, rank of the nodes (series, n, next; next is NULL or greater) on the way from each series' least n.

    In round k the steps are of length 2 ** k: every node known to be on the way gives the one that far ahead, and the steps are doubled by a join with themselves, so there are as many rounds as the number of trades has bits."""
    steps = stored(nodes.where(F.col("next").isNotNull()).select("series", "n", "next"))
    found = [nodes.groupBy("series").agg(F.min("n").alias("n")).select("series", "n", F.lit(0).cast("bigint").alias("rank"))]
    length = 1
    while True:
        known = found[0]
        for more in found[1:]:
            known = known.union(more)
        new = stored(known.join(steps, ["series", "n"]).select("series", F.col("next").alias("n"), (F.col("rank") + length).alias("rank")))
        if new.isEmpty():
            return known
        found.append(new)
        to = steps.select("series", F.col("n").alias("next"), F.col("next").alias("_then"))
        steps = stored(steps.join(to, ["series", "next"]).select("series", "n", F.col("_then").alias("next")))
        length *= 2


def capital_path(c: Config):
    """Adds size_frac, before (the capital at entry) and net_pnl to trades that come series by series in order: the one thing that each trade needs of the one before."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, capital = None, c.capital
        for t in batches:
            out = []
            for series, entry, stop, side, real, nights in zip(t["series"], t["entry"], t["stop"], t["signal"], t["exit_price_real"], t["nights"], strict=True):
                if series != at:
                    at, capital = series, c.capital
                size = min(capital * c.risk / stop / entry, c.most)
                units = capital * size / entry
                net = side * (real - entry) * units - c.swap_per_night * nights * capital * size / 100_000
                out.append((size, capital, net))
                capital += net
            yield t.assign(**dict(zip(("size_frac", "before", "net_pnl"), zip(*out, strict=True), strict=True))) if out else t.assign(size_frac=0.0, before=0.0, net_pnl=0.0)

    return run


def slipped(bar_atr: Column, entry_atr: Column) -> Column:
    return costs.slippage(bar_atr, F.when(entry_atr > 0, entry_atr))


def simulated(bars: DataFrame, spreads: DataFrame, c: Config, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The bars, prepared and numbered, and the trades on the way from each series' first entry."""
    ready = prepared(in_blocks(bars, block_rows, LOOKS_BACK, c.timeout), spreads, c, ("series", "_block"), "n")
    every = stored(entries(ready, c).select("series", "_block", "n", "ts", "close", "atr", "spread", "pip", "signal", "valid", "entry", "stop", "stop_loss", "take_profit", "age", "why"))
    may = every.where("valid")
    ends = may.where("why <> 'FIN_BACKTEST'").select("series", F.col("n").alias("_n"), (F.col("n") + F.col("age")).alias("n"))
    nodes = may.select("series", "n").join(ends.join(next_valid(every), ["series", "n"]).select("series", F.col("_n").alias("n"), "next"), ["series", "n"], "left")
    taken = may.join(chain(nodes), ["series", "n"]).withColumn("exit_n", F.col("n") + F.col("age"))
    at_exit = every.select("series", F.col("n").alias("exit_n"), F.col("ts").alias("exit_time"), F.col("close").alias("_close"), F.col("spread").alias("exit_spread"), F.col("atr").alias("_atr"))
    t = taken.join(at_exit, ["series", "exit_n"])
    side = F.col("signal")
    price = F.when(F.col("why") == "SL", F.col("stop_loss")).when(F.col("why") == "TP", F.col("take_profit")).otherwise(F.col("_close"))
    t = t.withColumns({"exit_price": price, "exit_slippage": slipped(F.col("_atr"), F.col("atr")), "nights": F.floor(F.col("age") / c.bars_per_day)})
    t = t.withColumn("exit_price_real", F.col("exit_price") - side * (F.col("exit_spread") + F.col("exit_slippage")) * F.col("pip")).drop("_close", "_atr", "valid", "_block")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema)
    paid = t.repartition("series").sortWithinPartitions("series", "rank").mapInPandas(capital_path(c), f"{fields}, size_frac DOUBLE, before DOUBLE, net_pnl DOUBLE")
    return every, stored(paid)


def equity_rows(every: DataFrame, trades: DataFrame, c: Config) -> DataFrame:
    """Of every bar: capital, what the open position is worth, and whether there is one."""
    held = F.struct("n", "exit_n", "why", "signal", "entry", "atr", "size_frac", "before", "net_pnl")
    opened = trades.select("series", "n", held.alias("_t"))
    df = every.select("series", "_block", "n", "ts", "close", "atr", "spread", "pip").join(opened, ["series", "n"], "left")
    before = Window.partitionBy("series").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = df.groupBy("series", "_block").agg(F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col("n"))).alias("_last"))
    carried = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")  # a row for each block
    so_far = Window.partitionBy("series", "_block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_now", F.last("_t", ignorenulls=True).over(so_far)).join(carried, ["series", "_block"])
    p = F.coalesce("_now", "_carry")
    df = df.withColumn("_p", p).drop("_t", "_now", "_carry")
    p = F.col("_p")
    is_open = F.coalesce((F.col("n") < p["exit_n"]) | (p["why"] == "FIN_BACKTEST"), F.lit(False))
    leaves = F.col("close") - p["signal"] * (F.col("spread") + slipped(F.col("atr"), p["atr"])) * F.col("pip")
    open_pnl = F.when(is_open, p["signal"] * (leaves - p["entry"]) * p["before"] * p["size_frac"] / p["entry"]).otherwise(0.0)
    capital = F.when(p.isNull(), c.capital).when(is_open, p["before"]).otherwise(p["before"] + p["net_pnl"])
    return df.select("series", "ts", capital.alias("capital"), open_pnl.alias("unrealized"), (capital + open_pnl).alias("equity"), is_open.cast("int").alias("n_positions"))


def trade_rows(t: DataFrame, c: Config) -> DataFrame:
    side, risk = F.col("signal"), F.col("before") * F.col("size_frac")
    units = risk / F.col("entry")
    swap = c.swap_per_night * F.col("nights") * risk / 100_000
    return t.select(
        "series", (F.col("rank") + 1).cast("int").alias("id"), F.when(side > 0, "LONG").otherwise("SHORT").alias("direction"), F.col("ts").alias("entry_time"), F.col("entry").alias("entry_price"), F.col("spread").alias("entry_spread"), F.lit(costs.SLIPPAGE_BASE).alias("entry_slippage"), "size_frac", risk.alias("at_risk"), "stop_loss", "take_profit", F.col("atr").alias("atr_entry"), F.col("age").cast("int").alias("bars_open"),
        F.col("exit_time").alias("ts"), "exit_price", "exit_price_real", "exit_spread", "exit_slippage", F.col("why").alias("exit_reason"), (F.col("net_pnl") + swap).alias("gross_pnl"), ((F.col("spread") + F.col("exit_spread")) * F.col("pip") * units).alias("cost_spread"), ((costs.SLIPPAGE_BASE + F.col("exit_slippage")) * F.col("pip") * units).alias("cost_slippage"), swap.alias("cost_swap"), "net_pnl", (F.col("before") + F.col("net_pnl")).alias("capital"), (F.col("net_pnl") / c.capital * 100).alias("return_pct"), (F.col("net_pnl") / risk * 100).alias("return_on_position"),
    )


def run(bars: DataFrame, spreads: DataFrame, config: Config | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trades (kind trade) and the equity curve (kind equity) of all series. An open position is settled first: stop before target before timeout; a flat bar may then open one at its close. What is open at the end is closed.

    Where a position would end doesn't depend on the capital, so every bar's is found at once, in blocks of bars; which of them are taken is a chain from one to the next after it, found by doubling steps; the capital alone goes from trade to trade. A series without a signal has equity rows alone."""
    c = config or Config()
    every, t = simulated(bars, spreads, c, block_rows)
    return trade_rows(t, c).withColumn("kind", F.lit("trade")).unionByName(equity_rows(every, t, c).withColumn("kind", F.lit("equity")), allowMissingColumns=True)


def trades(result: DataFrame) -> DataFrame:
    return result.where(F.col("kind") == "trade").drop("kind", "unrealized", "equity", "n_positions").withColumnsRenamed({"series": "pair", "ts": "exit_time", "capital": "capital_after"})


def equity(result: DataFrame) -> DataFrame:
    return result.where(F.col("kind") == "equity").select(F.col("series").alias("pair"), "ts", "capital", "unrealized", "equity", "n_positions")


def sweep(bars: DataFrame, spreads: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """Sharpe of the first 60 % of the trades and of the rest for each named configuration; robust if they differ by less than 30 %."""
    parts = None
    for name, c in configs.items():
        t = trades(run(bars, spreads, c)).withColumn("config", F.lit(name))
        parts = t if parts is None else parts.unionByName(t)
    w = Window.partitionBy("config")
    cut = parts.withColumn("early", F.row_number().over(w.orderBy("exit_time", "pair", "id")) <= 0.6 * F.count(F.lit(1)).over(w))
    s = lambda early: F.try_divide(F.avg(F.when(F.col("early") == early, F.col("return_pct"))), F.stddev_pop(F.when(F.col("early") == early, F.col("return_pct"))))
    out = cut.groupBy("config").agg(s(True).alias("sharpe_early"), s(False).alias("sharpe_late"))
    return out.withColumn("is_robust", F.abs(F.try_divide(F.col("sharpe_early") - F.col("sharpe_late"), "sharpe_early")) < 0.3)
