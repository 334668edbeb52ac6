"""Time alignment: grids, fills, as-of joins, splits and walk-forward windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_grid(bars: DataFrame, every: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """series, ts: every step between each series' first and last bar, or between start and end."""
    ends = bars.groupBy("series").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    a, b = start if start is not None else F.col("a"), end if end is not None else F.col("b")
    return ends.select("series", F.explode(F.sequence(a, b, F.expr(f"INTERVAL {every}"))).alias("ts"))


def common_range(bars: DataFrame) -> DataFrame:
    """One row: the latest first bar and the earliest last bar of all series."""
    ends = bars.groupBy("series").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.agg(F.max("a").alias("start"), F.min("b").alias("end"))


def on_grid(bars: DataFrame, every: str, columns: list[str], most: int) -> DataFrame:
    """bars on a gap-free grid; each column keeps its last value for up to `most` missing steps."""
    grid = time_grid(bars, every)
    w = Window.partitionBy("series").orderBy("ts").rowsBetween(-most, 0)
    joined = grid.join(bars, ["series", "ts"], "left")
    return joined.select("series", "ts", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in columns))


def drop_empty_times(grid: DataFrame, column: str = "close") -> DataFrame:
    """Times at which no series has a value (weekends) go."""
    some = F.max(F.col(column).isNotNull().cast("int")).over(Window.partitionBy("ts"))
    return grid.withColumn("_some", some).where(F.col("_some") == 1).drop("_some")


def common_times(bars: DataFrame) -> DataFrame:
    """Bars of the times that all series have."""
    n = bars.agg(F.count_distinct("series").alias("n"))
    times = bars.groupBy("ts").agg(F.count_distinct("series").alias("m")).join(F.broadcast(n), F.col("m") == F.col("n")).select("ts")  # n is one row
    return bars.join(times, "ts", "left_semi")


def as_of(left: DataFrame, right: DataFrame, columns: list[str], tolerance: str, prefix: str, key: str = "series", ts: str = "ts", ready: str | None = None, block: str | None = None) -> DataFrame:
    """left with the last row of right at or before its time, if that is no older than the tolerance.

    One exchange by key: both sides are laid on one time line, right before left at equal times, and the last right row is carried forward. ready delays right rows, as a bar stamped at its opening is known only when it closes. block ('day', 'month'): a key's line is cut into blocks of that length, each a task's work, and the last right row before a block comes from a row for each block; the inputs are read twice then."""
    known = F.col(ts) if ready is None else F.col(ts) + F.expr(f"INTERVAL {ready}")
    a = left.select(key, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(F.col(ts).alias("_at"), *columns)).schema[0].dataType).alias("_r"))
    b = right.select(key, known.alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(known.alias("_at"), *columns).alias("_r"))
    line = a.unionByName(b)
    if block is not None:
        line = line.withColumn("_b", F.date_trunc(block, F.col("_t").cast("timestamp")))
    keys = [key] if block is None else [key, "_b"]
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    if block is not None:
        before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        last = line.groupBy(*keys).agg(F.max_by("_r", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
        carried = last.select(F.col(key).alias("_k"), F.col("_b").alias("_d"), F.last("_last", ignorenulls=True).over(before).alias("_carry"))  # a row for each block
        met = met.join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_d"))).withColumn("_m", F.coalesce("_m", "_carry"))
    line = met
    near = F.col("_m._at") >= F.col("_t") - F.expr(f"INTERVAL {tolerance}")
    return line.select("_l.*", *(F.when(near, F.col(f"_m.{c}")).alias(f"{prefix}{c}") for c in columns))


def calendar_split(df: DataFrame, train_end: str, val_end: str, ts: str = "ts") -> DataFrame:
    """df with split: train up to and with the first date, val up to the second, test after."""
    day = F.to_date(ts)
    return df.withColumn("split", F.when(day <= F.lit(train_end).cast("date"), "train").when(day <= F.lit(val_end).cast("date"), "val").otherwise("test"))


def split_dates(start: str, end: str, train: float = 0.6, val: float = 0.2) -> tuple[str, str]:
    """Last days of the training and validation sets, at month ends."""
    from datetime import date, timedelta

    a, b = date.fromisoformat(start), date.fromisoformat(end)

    def before_month(d: date) -> str:
        return (d.replace(day=1) - timedelta(days=1)).isoformat()

    days = (b - a).days
    return before_month(a + timedelta(days=int(days * train))), before_month(a + timedelta(days=int(days * (train + val))))


def ratio_split(df: DataFrame, test: float = 0.2, keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """df with is_train: the first int(n * (1 - test)) rows of each series."""
    w = Window.partitionBy(*keys)
    return df.withColumn("is_train", F.row_number().over(w.orderBy(*order)) <= F.floor(F.count(F.lit(1)).over(w) * (1 - test)))


def walk_forward(df: DataFrame, train_days: int, test_days: int, step_days: int, expanding: bool = False, least_train: int = 100, least_test: int = 20) -> DataFrame:
    """Windows (window, train_start, train_end, test_end, n_train, n_test) of calendar days, as long as both parts have rows enough. Days are counted first, so what meets the windows is a row a day."""
    per_day = df.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = per_day.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    steps = span.select("a", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.datediff("b", "a") - train_days) / step_days).cast("int"), F.lit(0)))).alias("window"))
    cut = F.date_add("a", F.col("window") * step_days + train_days)
    windows = steps.select("window", (F.col("a") if expanding else F.date_add("a", F.col("window") * step_days)).alias("train_start"), cut.alias("train_end"), F.date_add(cut, test_days).alias("test_end"))
    met = per_day.join(F.broadcast(windows), (F.col("day") >= F.col("train_start")) & (F.col("day") < F.col("test_end")))  # windows: a row for each step of the calendar
    counted = met.groupBy("window", "train_start", "train_end", "test_end").agg(F.coalesce(F.sum(F.when(F.col("day") < F.col("train_end"), F.col("n"))), F.lit(0)).alias("n_train"), F.coalesce(F.sum(F.when(F.col("day") >= F.col("train_end"), F.col("n"))), F.lit(0)).alias("n_test"))
    return counted.where((F.col("n_train") >= least_train) & (F.col("n_test") >= least_test))


def split_info(start: str, end: str, train: float = 0.6, val: float = 0.2) -> list[tuple[str, str, str, int, float]]:
    """part, first day, last day, days between them and share of the whole, of train, validation, test and all."""
    from datetime import date, timedelta

    a, b = split_dates(start, end, train, val)
    after = lambda d: (date.fromisoformat(d) + timedelta(days=1)).isoformat()
    parts = [("total", start, end, 1.0), ("train", start, a, train), ("validation", after(a), b, val), ("test", after(b), end, round(1 - train - val, 10))]
    return [(name, x, y, (date.fromisoformat(y) - date.fromisoformat(x)).days, share) for name, x, y, share in parts]


def inner_times(*frames: DataFrame, on: tuple[str, ...] = ("series", "ts")) -> DataFrame:
    """Rows of the times that all frames have, side by side; their other columns must differ in name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(on))
    return out


def aligned_bars(bars: DataFrame, every: str, columns: list[str], most: int) -> DataFrame:
    """All series on one grid over the time that they have in common, gaps filled for up to `most` steps, times without any close (weekends) left out."""
    span = common_range(bars)
    steps = span.select(F.explode(F.sequence("start", "end", F.expr(f"INTERVAL {every}"))).alias("ts"))
    grid = bars.select("series").distinct().join(F.broadcast(steps))  # steps: the times of one grid
    w = Window.partitionBy("series").orderBy("ts").rowsBetween(-most, 0)
    joined = grid.join(bars, ["series", "ts"], "left")
    return drop_empty_times(joined.select("series", "ts", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in columns)))


def multi_timeframe(base: DataFrame, others: dict[str, DataFrame], columns: list[str], tolerance: str = "7 DAYS", ready: dict[str, str] | None = None) -> DataFrame:
    """base with the columns of slower frames as of each bar, prefixed by the frame's name. ready: how long after its opening a frame's bar is known; without it the bar that is still forming counts."""
    out = base
    for name, frame in others.items():
        out = as_of(out, frame, columns, tolerance, f"{name}_", ready=(ready or {}).get(name))
    return out
