"""Bootstrap and permutation tests, parallel over replicates.

Draws are hashes of (seed, replicate, place), so a lost task redoes the same ones, and any engine can. The returns of a series go as one array to the tasks that share its replicates, and none to the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Replicates that a task makes.
BLOCK = 100
#: Returns that are resampled at once.
_HELD = 1_000_000
_CAP = 999.99


_MASK = 2**31 - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 31 bits over 31 bits."""
    for _ in range(2):
        x = x ^ (x >> 16)
        x = (x * 73_244_475) & _MASK
    return x ^ (x >> 16)


def hashes(replicates: list[int], n: int, seed: int) -> np.ndarray:
    """A row for each replicate: hashes of the places 0 to n - 1."""
    own = _mixed((np.array(replicates, dtype=np.int64) * 2_654_435 + seed) & _MASK)
    return _mixed((own[:, None] + np.arange(n, dtype=np.int64)[None] * 40_503) & _MASK)


def _metrics(r: np.ndarray, periods: int) -> dict[str, np.ndarray]:
    """Of each row of r."""
    sd = r.std(axis=1, ddof=1) if r.shape[1] > 1 else np.zeros(len(r))
    won, lost = np.where(r > 0, r, 0).sum(axis=1), np.abs(np.where(r < 0, r, 0).sum(axis=1))
    path = np.cumprod(1 + r, axis=1)
    return {
        "sharpe": np.divide(r.mean(axis=1) * np.sqrt(periods), sd, out=np.zeros(len(r)), where=sd > 1e-10),
        "profit_factor": np.where(lost > 1e-10, won / np.maximum(lost, 1e-300), np.where(won > 1e-10, _CAP, 0.0)),
        "win_rate": (r > 0).mean(axis=1),
        "max_drawdown": (path / np.maximum.accumulate(path, axis=1) - 1).min(axis=1) * 100,
        "total_return": (path[:, -1] - 1) * 100,
        "annual_return": r.mean(axis=1) * periods * 100,
    }


def mean_of(v: str, n: str) -> Column:
    """Mean of a metric's replicates. Win rates are whole numbers of the n returns, and are added as such, so that their mean is exact."""
    wins = F.sum(F.round(F.col(v) * F.col(n)).cast("bigint")) / (F.max(n) * F.count(F.lit(1)))
    return F.when(F.col("metric") == "win_rate", wins).otherwise(F.avg(v))


METRICS = ("sharpe", "profit_factor", "win_rate", "max_drawdown", "total_return", "annual_return")


def replicates(df: DataFrame, draw, n: int, seed: int, periods: int, columns: list[str], order: list[str], keys: list[str] | None = None, real=None) -> DataFrame:
    """keys, replicate, size (returns of the series) and metrics of n resamples for each series (rows with the same keys); draw(values, hashes) gives the returns of the resamples that rows of hashes stand for. If there is a real, real(values) is replicate -1."""
    keys = keys or []
    line = F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))))
    vectors = df.groupBy(*keys).agg(line.alias("v")).where(F.size("v") > 0).select(*keys, *(F.col("v").getField(f"c{i}").alias(f"c{i}") for i in range(len(columns))))
    blocks = -(-n // BLOCK)
    rows = vectors.crossJoin(df.sparkSession.range(blocks).withColumnRenamed("id", "block")).repartition(blocks)

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                v = np.stack([np.asarray(row[f"c{i}"], dtype=float) for i in range(len(columns))], axis=1)
                todo = list(range(row["block"] * BLOCK, min((row["block"] + 1) * BLOCK, n)))
                if real is not None and row["block"] == 0:
                    yield pd.DataFrame({k: [row[k]] for k in keys} | {"replicate": [-1], "size": [len(v)]} | _metrics(real(v)[None], periods))
                step = max(1, _HELD // len(v))
                for at in range(0, len(todo), step):
                    some = todo[at : at + step]
                    yield pd.DataFrame({k: [row[k]] * len(some) for k in keys} | {"replicate": some, "size": [len(v)] * len(some)} | _metrics(draw(v, hashes(some, len(v), seed)), periods))

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInPandas(run, kinds + "replicate BIGINT, size BIGINT, " + ", ".join(f"{m} DOUBLE" for m in METRICS))


def bootstrap(df: DataFrame, r: str = "r", order: list[str] | None = None, n: int = 10_000, seed: int = 42, confidence: float = 0.95, periods: int = 252, keys: list[str] | None = None) -> DataFrame:
    """keys, metric, mean, sd, low, high, significant (0 is outside) over resamples with replacement of each series."""
    reps = replicates(df, lambda v, h: v[h % len(v), 0], n, seed, periods, [r], order or [r], keys)
    return interval(reps, confidence, keys)


def interval(reps: DataFrame, confidence: float, keys: list[str] | None = None, deviation=F.stddev_samp) -> DataFrame:
    tail = (1 - confidence) / 2
    keys = keys or []
    rows = reps.select(*keys, "size", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS))).alias("x")).select(*keys, "size", "x.*")
    out = rows.groupBy(*keys, "metric").agg(mean_of("v", "size").alias("mean"), deviation("v").alias("sd"), F.percentile("v", F.lit(tail)).alias("low"), F.percentile("v", F.lit(1 - tail)).alias("high"))
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def permutation(df: DataFrame, predicted: str, actual: str, order: list[str], n: int = 10_000, seed: int = 42, periods: int = 252, keys: list[str] | None = None) -> DataFrame:
    """keys, metric, real, mean, sd, z, p_value (one-sided by the side of the real value), significant, against shuffled predictions of each series. Values are compared at nine decimals, so that a replicate with the real one's returns in another order is no less."""
    keys = keys or []

    def draw(v: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.sign(v[np.argsort(h, axis=1, kind="stable"), 0]) * v[:, 1]

    reps = replicates(df, draw, n, seed, periods, [predicted, actual], order, keys, lambda v: np.sign(v[:, 0]) * v[:, 1])
    rows = reps.select(*keys, "replicate", "size", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS))).alias("x")).select(*keys, "replicate", "size", "x.*")
    own = Window.partitionBy(*keys, "metric")
    rows = rows.withColumn("real", F.max(F.when(F.col("replicate") < 0, F.col("v"))).over(own)).where(F.col("replicate") >= 0)
    out = rows.groupBy(*keys, "metric").agg(F.first("real").alias("real"), mean_of("v", "size").alias("mean"), F.stddev_samp("v").alias("sd"), F.avg((F.round("v", 9) >= F.round("real", 9)).cast("double")).alias("above"), F.avg((F.round("v", 9) <= F.round("real", 9)).cast("double")).alias("below"))
    p = F.when(F.col("real") >= F.col("mean"), F.col("above")).otherwise(F.col("below"))
    return out.select(*keys, "metric", "real", "mean", "sd", F.try_divide(F.col("real") - F.col("mean"), "sd").alias("z"), p.alias("p_value"), (p < 0.05).alias("significant"))


# ---- rank correlation


def doubled_ranks(counts: np.ndarray) -> np.ndarray:
    """Of each row of counts by ordered value: twice the average rank of every value. Whole numbers, so that sums of them are exact."""
    upto = np.cumsum(counts, axis=1)
    return 2 * (upto - counts) + counts + 1


def rank_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of doubled ranks; NaN where a side is constant."""
    n = x.shape[1]
    sx, sy, sxy, sxx, syy = (v.sum(axis=1, dtype=np.int64) for v in (x, y, x * y, x * x, y * y))
    side = ((n * sxx - sx * sx).astype(float), (n * syy - sy * sy).astype(float))
    both = np.sqrt(side[0]) * np.sqrt(side[1])
    return np.divide((n * sxy - sx * sy).astype(float), both, out=np.full(len(x), np.nan), where=both > 0)


def rank_replicates(df: DataFrame, predicted: str, actual: str, order: list[str], n: int = 10_000, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """keys, kind (real, bootstrap: rows drawn with replacement, permutation: predictions dealt anew), replicate, ic: rank correlations of each series."""
    keys = keys or []
    line = F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(predicted).cast("double").alias("p"), F.col(actual).cast("double").alias("a"))))
    vectors = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).groupBy(*keys).agg(line.alias("v")).select(*keys, F.col("v.p").alias("p"), F.col("v.a").alias("a"))
    blocks = -(-n // BLOCK)
    rows = vectors.crossJoin(df.sparkSession.range(blocks).withColumnRenamed("id", "block")).repartition(blocks)

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                codes = [np.unique(np.asarray(row[c], dtype=float), return_inverse=True)[1].astype(np.int64) for c in "pa"]
                size = [int(c.max()) + 1 for c in codes]
                whole = [doubled_ranks(np.bincount(c, minlength=k)[None])[0][c] for c, k in zip(codes, size, strict=True)]
                own = lambda kind, ids, ic: pd.DataFrame({k: [row[k]] * len(ids) for k in keys} | {"kind": kind, "replicate": ids, "ic": ic})  # noqa: B023, E731
                if row["block"] == 0:
                    yield own("real", [-1], rank_correlation(whole[0][None], whole[1][None]))
                todo = list(range(row["block"] * BLOCK, min((row["block"] + 1) * BLOCK, n)))
                step = max(1, _HELD // len(codes[0]))
                for at in range(0, len(todo), step):
                    some = todo[at : at + step]
                    h = hashes(some, len(codes[0]), seed)
                    drawn = []
                    for c, k in zip(codes, size, strict=True):
                        got = c[h % len(c)]
                        counts = np.bincount((got + np.arange(len(some))[:, None] * k).ravel(), minlength=len(some) * k).reshape(len(some), k)
                        drawn.append(np.take_along_axis(doubled_ranks(counts), got, axis=1))
                    yield own("bootstrap", some, rank_correlation(*drawn))
                    dealt = whole[0][np.argsort(h, axis=1, kind="stable")]
                    yield own("permutation", some, rank_correlation(dealt, np.broadcast_to(whole[1], dealt.shape)))

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInPandas(run, kinds + "kind STRING, replicate BIGINT, ic DOUBLE").withColumn("ic", F.nanvl("ic", F.lit(None).cast("double")))


def rank_tests(reps: DataFrame, keys: list[str], confidence: float = 0.95) -> DataFrame:
    """Of rank_replicates: keys, ic, mean, low and high of resamples, z and permutation_p (one-sided, by the side of the real value) against dealt predictions."""
    tail = (1 - confidence) / 2
    of = lambda kind: F.when(F.col("kind") == kind, F.col("ic"))
    one = reps.groupBy(*keys).agg(F.max(of("real")).alias("ic"), F.avg(of("bootstrap")).alias("mean"), F.percentile(of("bootstrap"), F.lit(tail)).alias("low"), F.percentile(of("bootstrap"), F.lit(1 - tail)).alias("high"), F.avg(of("permutation")).alias("_m"), F.stddev_samp(of("permutation")).alias("_s"))
    beside = reps.where("kind = 'permutation'").join(one.select(*keys, F.col("ic").alias("_real")), keys)
    share = beside.groupBy(*keys).agg(F.avg((F.col("ic") >= F.col("_real")).cast("double")).alias("_above"), F.avg((F.col("ic") <= F.col("_real")).cast("double")).alias("_below"))
    out = one.join(share, keys)
    return out.select(*keys, "ic", "mean", "low", "high", F.try_divide(F.col("ic") - F.col("_m"), "_s").alias("z"), F.when(F.col("ic") >= F.col("_m"), F.col("_above")).otherwise(F.col("_below")).alias("permutation_p"))


# ---- trades


def trade_bootstrap(trades: DataFrame, keys: list[str], n: int = 10_000, seed: int = 42, confidence: float = 0.95, periods: int = 252) -> DataFrame:
    """bootstrap of the trades' returns (return_pct) in their order: keys, metric (five of them), mean, sd (of the population of replicates), low, high, significant."""
    r = trades.withColumn("_r", F.col("return_pct") / 100)
    reps = replicates(r, lambda v, h: v[h % len(v), 0], n, seed, periods, ["_r"], ["id"], keys)
    out = interval(reps, confidence, keys, F.stddev_pop)
    return out.where(F.col("metric").isin(*TRADE_METRICS))


#: What a resample of trades is judged by.
TRADE_METRICS = ("sharpe", "profit_factor", "win_rate", "max_drawdown", "total_return")


def trade_permutation(trades: DataFrame, keys: list[str], n: int = 10_000, seed: int = 42, periods: int = 252) -> DataFrame:
    """Trades' returns in shuffled order: keys, metric, real, mean, p_value (share of orders that are as good or better). Only the drawdown depends on the order; for the other metrics every order is as good, and the value is 1."""
    r = trades.withColumn("_r", F.col("return_pct") / 100)
    shuffled = lambda v, h: v[np.argsort(h, axis=1, kind="stable"), 0]
    reps = replicates(r, shuffled, n, seed, periods, ["_r"], ["id"], keys, lambda v: v[:, 0])
    rows = reps.select(*keys, "replicate", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in TRADE_METRICS))).alias("x")).select(*keys, "replicate", "x.*")
    rows = rows.withColumn("real", F.max(F.when(F.col("replicate") < 0, F.col("v"))).over(Window.partitionBy(*keys, "metric"))).where(F.col("replicate") >= 0)
    as_good = F.round("v", 9) >= F.round("real", 9)
    return rows.groupBy(*keys, "metric").agg(F.first("real").alias("real"), F.avg("v").alias("mean"), F.avg(as_good.cast("double")).alias("p_value"))
