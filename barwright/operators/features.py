"""Feature sets: five levels of compositions of the rolling algebra, planned in batches that keep whole-stage code generation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barwright.functions import rolling as R
from barwright.functions.ema import with_emas
from barwright.sources.bars import OHLCV, require

#: Windows, and the pairs of fast and slow ones.
WINDOWS = (1, 2, 3, 4, 5, 10, 20, 50, 100, 200)
FAST_SLOW = ((5, 20), (10, 50), (20, 100), (50, 200))
KEY_OPERATORS = ("mean", "sd", "z", "pos")
KEY_WINDOWS = (5, 20, 50)
#: Fixed values: (outer operator, its window, inner operator, its window), on the close.
COMPOSITIONS = (
    ("z", 20, "mean", 10),
    ("z", 20, "mean", 50),
    ("z", 50, "ema", 20),
    ("pos", 50, "sd", 20),
    ("pos", 100, "sd", 20),
    ("d1", 0, "mean", 20),
    ("d1", 0, "mean", 50),
    ("d1", 0, "ema", 20),
    ("d2", 0, "z", 50),
    ("d2", 0, "z", 20),
    ("z", 20, "delta", 1),
    ("z", 50, "delta", 5),
    ("pos", 20, "ret", 1),
    ("pos", 50, "logret", 1),
)
#: Columns in one projection, below the limit of whole-stage code generation.
BATCH = 90


def apply(op: str, x: Column, n: int, w: WindowSpec) -> Column:
    return R.PLAIN[op](x, w) if op in R.PLAIN else R.WINDOWED[op](x, n, w)


def feature_name(op: str, n: int, x: str) -> str:
    return f"{op}__{x}" if op in R.PLAIN else f"{op}_{n}__{x}"


# The formulas of the ratios, differences and means below.
def candle_ratios() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - l
    within = lambda x: F.when(span != 0, x / span).otherwise(F.lit(0.0))
    return {"c_o_ratio": F.try_divide(c, o), "h_l_ratio": F.try_divide(h, l), "c_h_ratio": F.try_divide(c, h), "c_l_ratio": F.try_divide(c, l), "cl_hl_ratio": within(c - l), "hc_hl_ratio": within(h - c), "co_hl_ratio": within(c - o)}


def candle_diffs() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {"h_l_diff": h - l, "c_o_diff": c - o, "h_c_diff": h - c, "c_l_diff": c - l}


def candle_means() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {"hl2": (h + l) / 2, "hlc3": (h + l + c) / 3, "ohlc4": (o + h + l + c) / 4}


def calendar() -> dict[str, Column]:
    """Cyclic hour, weekday (Monday 0, a week of five) and month, and flags."""
    out: dict[str, Column] = {}
    ts = F.col("ts")
    for name, value, period in (("hour", F.hour(ts), 24), ("dow", F.weekday(ts), 5), ("month", F.month(ts), 12)):
        angle = value * (2 * math.pi) / period
        out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    day = F.dayofmonth(ts)
    flags = {"is_monday": F.weekday(ts) == 0, "is_friday": F.weekday(ts) == 4, "is_month_start": day <= 5, "is_month_end": day >= 25}
    return out | {k: v.cast("int") for k, v in flags.items()}


@dataclass
class FeaturePlan:
    """Which features to make. windows, variables and levels narrow it down."""

    windows: tuple[int, ...] = WINDOWS
    variables: tuple[str, ...] = OHLCV
    levels: tuple[int, ...] = (1, 2, 3, 4, 5)
    keys: tuple[str, ...] = ("series",)
    order: tuple[str, ...] = ("ts",)
    operators: tuple[str, ...] = field(default_factory=lambda: tuple(R.WINDOWED))

    def level1(self) -> list[str]:
        simple = [feature_name(op, n, x) for x in self.variables for op in (*self.operators, "ema") for n in self.windows]
        return simple + [feature_name(op, 0, x) for x in self.variables for op in R.PLAIN]

    def level2(self) -> list[str]:
        combos = [*candle_ratios(), *candle_diffs(), *candle_means()]
        return combos + [feature_name(op, n, x) for x in combos for op in KEY_OPERATORS for n in KEY_WINDOWS]

    def level3(self) -> list[str]:
        return [f"{feature_name(a, n, feature_name(b, m, 'close'))}" for a, n, b, m in COMPOSITIONS]

    def level4(self) -> list[str]:
        return [f"{op}_{m}_{op}_{n}_{what}" for m, n in FAST_SLOW for op, what in (("mean", "ratio"), ("mean", "diff"), ("sd", "ratio"), ("ema", "ratio"))]

    def level5(self) -> list[str]:
        return list(calendar())

    def lookback(self) -> int:
        """Bars before a bar that its features need, exponential averages apart."""
        reach = [1, 2]
        reach += [max(self.windows, default=0)] if 1 in self.levels else []
        reach += [max(KEY_WINDOWS)] if 2 in self.levels else []
        reach += [n + m + 2 for _, n, _, m in COMPOSITIONS] if 3 in self.levels else []
        reach += [n for pair in FAST_SLOW for n in pair] if 4 in self.levels else []
        return max(reach)

    def names(self) -> list[str]:
        return [x for level in self.levels for x in getattr(self, f"level{level}")()]


def add_features(bars: DataFrame, plan: FeaturePlan | None = None, block_rows: int | None = None) -> DataFrame:
    """bars with every feature of the plan. Bars are dealt out by series once; all windows share that exchange and its sort. With block_rows, series are cut into blocks of so many bars, each with the bars before it that the windows look back to, so that one series is many tasks."""
    plan = plan or FeaturePlan()
    if block_rows is not None:
        from barwright.functions.blocks import in_blocks

        names, keys = plan.names(), (*plan.keys, "_block")
        cut = in_blocks(with_needed_emas(bars, plan), block_rows, plan.lookback(), plan.keys, plan.order[0])
        made = add_features(cut, replace(plan, keys=keys)).where(~F.col("_halo"))
        return made.select(*bars.columns, *names)
    require(bars, [*plan.keys, *plan.order, *OHLCV])
    w = R.series_window(plan.keys, plan.order)
    df = with_needed_emas(bars, plan)
    first: dict[str, Column] = {}
    if 1 in plan.levels:
        first |= {feature_name(op, n, x): R.WINDOWED[op](F.col(x), n, w) for x in plan.variables for op in plan.operators for n in plan.windows}
        first |= {feature_name(op, 0, x): R.PLAIN[op](F.col(x), w) for x in plan.variables for op in R.PLAIN}
    if 2 in plan.levels:
        first |= candle_ratios() | candle_diffs() | candle_means()
    if 3 in plan.levels:
        first |= {feature_name(b, m, "close"): apply(b, F.col("close"), m, w) for _, _, b, m in COMPOSITIONS if b != "ema"}
    if 4 in plan.levels:
        first |= {feature_name(op, n, "close"): R.WINDOWED[op](F.col("close"), n, w) for pair in FAST_SLOW for n in pair for op in ("mean", "sd")}
    if 5 in plan.levels:
        first |= calendar()
    df = batched(df, first)
    second: dict[str, Column] = {}
    if 2 in plan.levels:
        combos = [*candle_ratios(), *candle_diffs(), *candle_means()]
        second |= {feature_name(op, n, x): R.WINDOWED[op](F.col(x), n, w) for x in combos for op in KEY_OPERATORS for n in KEY_WINDOWS}
    if 3 in plan.levels:
        second |= {feature_name(a, n, feature_name(b, m, "close")): apply(a, F.col(feature_name(b, m, "close")), n, w) for a, n, b, m in COMPOSITIONS}
    if 4 in plan.levels:
        for m, n in FAST_SLOW:
            fast, slow = ({op: F.col(f"{op}_{k}__close") for op in ("mean", "sd", "ema")} for k in (m, n))
            second |= {f"mean_{m}_mean_{n}_ratio": F.try_divide(fast["mean"], slow["mean"]), f"mean_{m}_mean_{n}_diff": fast["mean"] - slow["mean"], f"sd_{m}_sd_{n}_ratio": fast["sd"] / (slow["sd"] + R.EPSILON), f"ema_{m}_ema_{n}_ratio": F.try_divide(fast["ema"], slow["ema"])}
    return batched(df, second).select(*bars.columns, *plan.names())


#: Bars of a series that a task makes features of at once.
BLOCK_ROWS = 200_000


def feature_rows(bars: DataFrame, plan: FeaturePlan | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, order, feature and value of every feature of the plan: what add_features gives as columns, as rows, for plans whose columns Catalyst would take long to plan. Series are cut into blocks, each with the bars before it that the windows look back to, and a block's features are arrays in one task. Only operators of functions/arrays.py will do."""
    from barwright.functions import arrays as A
    from barwright.functions.blocks import in_blocks

    plan = plan or FeaturePlan()
    require(bars, [*plan.keys, *plan.order, *OHLCV])
    if missing := [op for op in plan.operators if op not in A.OPERATORS]:
        raise ValueError(f"no array form of {', '.join(missing)}")
    df = with_needed_emas(bars, plan)
    combos = candle_ratios() | candle_diffs() | candle_means() if 2 in plan.levels else {}
    made = list(combos) if 2 in plan.levels else []
    names = plan.names()
    outside = [*combos, *(calendar() if 5 in plan.levels else {})]
    given = [n for n in names if n in outside or n in df.columns]
    df = batched(df, combos | (calendar() if 5 in plan.levels else {}))
    used = list(dict.fromkeys([*plan.variables, "close", *made, *given, *(c for c in df.columns if c.startswith("ema_"))]))
    cut = in_blocks(df.select(*plan.keys, *plan.order, *(F.col(c).cast("double").alias(c) for c in used)), max(block_rows, plan.lookback()), plan.lookback(), plan.keys, plan.order[0])

    def columns_of(p: pd.DataFrame) -> dict[str, np.ndarray]:
        out = {c: p[c].to_numpy(dtype=float) for c in used}
        if 1 in plan.levels:
            for x in plan.variables:
                for n in plan.windows:
                    out |= {feature_name(op, n, x): v for op, v in A.operators(out[x], n, list(plan.operators)).items()}
                out |= {feature_name(op, 0, x): A.LAGGED[op](out[x], 0) for op in R.PLAIN}
        for x in made:
            for n in KEY_WINDOWS:
                out |= {feature_name(op, n, x): v for op, v in A.operators(out[x], n, list(KEY_OPERATORS)).items()}
        if 3 in plan.levels:
            for a, n, b, m in COMPOSITIONS:
                inner = feature_name(b, m, "close")
                if inner not in out:
                    out[inner] = A.operators(out["close"], m, [b])[b]
                out[feature_name(a, n, inner)] = A.operators(out[inner], n, [a])[a]
        if 4 in plan.levels:
            for m, n in FAST_SLOW:
                fast, slow = ({op: A.operators(out["close"], k, [op])[op] for op in ("mean", "sd")} | {"ema": out[f"ema_{k}__close"]} for k in (m, n))
                out |= {f"mean_{m}_mean_{n}_ratio": A.divided(fast["mean"], slow["mean"]), f"mean_{m}_mean_{n}_diff": fast["mean"] - slow["mean"], f"sd_{m}_sd_{n}_ratio": fast["sd"] / (slow["sd"] + R.EPSILON), f"ema_{m}_ema_{n}_ratio": A.divided(fast["ema"], slow["ema"])}
        return out

    keep = [*plan.keys, *plan.order]

    def rows(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(list(plan.order), kind="stable")
        with np.errstate(invalid="ignore", divide="ignore"):
            values = columns_of(p)
        own = np.flatnonzero(~p["_halo"].to_numpy())
        out = {c: np.tile(p[c].to_numpy()[own], len(names)) for c in keep}
        return pd.DataFrame(out | {"feature": np.repeat(names, len(own)), "value": np.concatenate([values[n][own] for n in names]) if names else []})

    fields = ", ".join(f"`{c}` {bars.schema[c].dataType.simpleString()}" for c in keep)
    return cut.groupBy(*plan.keys, "_block").applyInPandas(rows, f"{fields}, feature STRING, value DOUBLE").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def with_needed_emas(bars: DataFrame, plan: FeaturePlan) -> DataFrame:
    """bars with the exponential averages that the plan's levels use and bars don't have yet."""
    emas = {(x, n) for x in plan.variables for n in plan.windows} if 1 in plan.levels else set()
    emas |= {("close", 20)} if 3 in plan.levels else set()
    emas |= {("close", n) for pair in FAST_SLOW for n in pair} if 4 in plan.levels else set()
    wanted = {f"ema_{n}__{x}": (x, n) for x, n in sorted(emas) if f"ema_{n}__{x}" not in bars.columns}
    return with_emas(bars, wanted, plan.keys, plan.order) if wanted else bars


def batched(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    items = list(columns.items())
    for i in range(0, len(items), BATCH):
        df = df.withColumns(dict(items[i : i + BATCH]))
    return df


def admission(df: DataFrame, features: list[str], tolerance: float = 1e-10) -> list[str]:
    """Features that have values, vary, and are finite, from one aggregate pass whose result is a row."""
    checks = [F.struct(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.max(F.when(F.abs(F.col(x).cast("double")) == float("inf"), 1).otherwise(0)).alias("inf")).alias(x) for x in features]
    found = df.agg(*checks).first()
    return [x for x in features if found[x]["n"] and found[x]["sd"] is not None and found[x]["sd"] > tolerance and not found[x]["inf"]]


def theoretical_counts(series: int = 1) -> dict[str, int]:
    """How many features each level has, before admission; level 6 is forty for each pair of series."""
    plan = FeaturePlan()
    out = {f"level{i}": len(getattr(plan, f"level{i}")()) for i in range(1, 6)}
    return out | {"level6": series * (series - 1) // 2 * 40}


def counted_levels(bars: DataFrame) -> DataFrame:
    """level, n of theoretical_counts for the series that bars have."""
    n = F.count_distinct("series").cast("bigint")
    one = bars.agg(n.alias("_s"))
    pairs = F.expr("_s * (_s - 1) div 2 * 40")
    levels = F.array(*(F.struct(F.lit(k).alias("level"), (pairs if k == "level6" else F.lit(v).cast("bigint")).alias("n")) for k, v in theoretical_counts().items()))
    return one.select(F.explode(levels).alias("x")).select("x.*")


def estimated_bytes(features: int, bars: int = 31_000) -> int:
    return features * bars * 8


# ---- targets and matrices


def target(x: Column, horizon: int, kind: str, w: WindowSpec) -> Column:
    """Forward return, its log, or its sign."""
    ahead = F.lead(x, horizon).over(w)
    if kind == "return":
        return F.try_divide(ahead, x) - 1
    if kind == "log":
        return F.ln(F.greatest(F.try_divide(ahead, x), F.lit(1e-10)))
    if kind == "direction":
        return F.signum(F.try_divide(ahead, x) - 1)
    raise ValueError(f"no such target: {kind}")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(F.forall(F.array(*(F.col(c).cast("double") for c in columns)), finite))


def varying(df: DataFrame, columns: list[str], tolerance: float = 1e-10) -> list[str]:
    found = df.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    return [c for c in columns if found[c] is not None and found[c] > tolerance]


def sequences(df: DataFrame, columns: list[str], lookback: int, horizon: int, step: int, y: Column, keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Samples of `lookback` rows (array of arrays of float) and the target horizon - 1 rows after the last of them, every `step` rows. Nothing is held beyond a frame."""
    w = R.series_window(keys, order)
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("x", F.collect_list(F.array(*(F.col(c).cast("float") for c in columns))).over(R.last(w, lookback))).withColumn("y", F.lead(y, horizon).over(w))
    return rows.where((F.col("_n") >= lookback) & ((F.col("_n") - lookback) % step == 0) & F.col("y").isNotNull()).select(*keys, *order, "x", "y")


def matrix_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Over all values: rows, columns, minimum, maximum, mean, population deviation, missing."""
    values = df.select(F.explode(F.array(*(F.col(c).cast("double") for c in columns))).alias("v"))
    return values.agg((F.count(F.lit(1)) / len(columns)).cast("bigint").alias("n_rows"), F.lit(len(columns)).alias("n_columns"), F.min("v").alias("lowest"), F.max("v").alias("highest"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count_if(F.col("v").isNull()).alias("missing"))


def series_tensor(samples: DataFrame, series: list[str], target_series: str) -> DataFrame:
    """ts, x (map from series to its sample) and the target series' y, of the times at which all series have a sample (as sequences() gives them)."""
    picked = samples.where(F.col("series").isin(series))
    wide = picked.groupBy("ts").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("series", "x")))).alias("x"), F.max(F.when(F.col("series") == target_series, F.col("y"))).alias("y"))
    return wide.where(F.size("x") == len(series))


def screening_table(df: DataFrame, columns: list[str], close: str = "close", horizon: int = 1, kind: str = "log", keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("ts",)) -> tuple[DataFrame, list[str]]:
    """df with the target from closing prices, of finite rows and columns that vary; and those columns' names."""
    w = R.series_window(keys, order)
    made = df.withColumn("target", target(F.col(close), horizon, kind, w))
    kept = varying(made, columns)
    return finite_rows(made, [*kept, "target"]).select(*keys, *order, *kept, "target"), kept


def in_sample(x: Column, back: int = 5) -> Column:
    """A sample (array of rows) with each value measured against that of its own column in up to `back` rows before and its own, by population deviation."""
    row = lambda t: F.slice(x, F.greatest(t - back, F.lit(0)) + 1, F.least(t, F.lit(back)) + 1)

    def scaled(t: Column) -> Column:
        def one(v: Column, j: Column) -> Column:
            seen = F.transform(row(t), lambda r: F.get(r, j).cast("double"))
            n = F.size(seen)
            mean = F.aggregate(seen, F.lit(0.0), lambda a, b: a + b) / n
            sd = F.sqrt(F.aggregate(seen, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean)) / n)
            return (v - mean) / (sd + 1e-8)

        return F.transform(F.get(x, t), one)

    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), scaled)


def run_summary(df: DataFrame, features: list[str], keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Rows, features, values and megabytes of each series' table."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("n_rows"), F.lit(len(features)).cast("bigint").alias("n_features"), (n * len(features)).alias("n_values"), (n * len(features) * 8 / 1e6).alias("megabytes"))


def tensor_4d(samples: DataFrame, series: list[str], target_series: str) -> DataFrame:
    """ts, x (series, then rows, then columns, in the given order of series) and y, of the times at which all series have a sample."""
    made = series_tensor(samples, series, target_series)
    return made.withColumn("x", F.array(*(F.col("x")[s] for s in series)))


def normalised_tensor(bars: DataFrame, columns: list[str], method: str, window: int, lookback: int, horizon: int, step: int, y: Column, series: list[str], target_series: str) -> DataFrame:
    """tensor_4d of columns that are normalised for each series by itself, each bar once and against the bars before it; y is of the bars as they are. Bars without a full window take no part."""
    from barwright.operators import normalise

    w = R.series_window()
    made = normalise.normalised(bars.withColumn("_y", y), columns, method, window, w)
    return tensor_4d(sequences(made.na.drop("any", subset=[*columns, "_y"]), columns, lookback, horizon, step, F.col("_y")), series, target_series)


def cross_timeframe(base: DataFrame, frames: dict[str, DataFrame], columns: list[str], lookback: int, ready: dict[str, str], tolerance: str = "7 DAYS") -> DataFrame:
    """series, ts, x (base first, then the frames in order; then `lookback` rows, then columns): of each bar of base, the last rows of every timeframe that are known by its opening. ready: how long after its opening a frame's bar is known. Bars for which a frame has no `lookback` rows within the tolerance are left out."""
    from barwright.operators import align

    w = R.series_window()

    def rows(df: DataFrame) -> DataFrame:
        line = F.collect_list(F.array(*(F.col(c).cast("float") for c in columns))).over(R.last(w, lookback))
        return df.select("series", "ts", line.alias("x")).where(F.size("x") == lookback)

    out = rows(base).withColumnRenamed("x", "_base")
    for name, frame in frames.items():
        out = align.as_of(out, rows(frame), ["x"], tolerance, f"_{name}_", ready=ready.get(name))
    made = ["_base", *(f"_{name}_x" for name in frames)]
    return out.na.drop("any", subset=made).select("series", "ts", F.array(*made).alias("x"))


def matrix(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """A row's columns as one array of float, of rows without gaps."""
    return df.na.drop("any", subset=columns).select(*keys, *order, F.array(*(F.col(c).cast("float") for c in columns)).alias("x"))
