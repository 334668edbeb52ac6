"""Point-in-time normalisers: a bar is measured against bars before it only."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from barwright.functions import rolling as R

#: Added to a denominator.
EPSILON = 1e-8


def pit_zscore(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    f = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(f) >= (least or n), (x - F.avg(x).over(f)) / (F.stddev_samp(x).over(f) + EPSILON))


def pit_expanding(x: Column, w: WindowSpec, least: int = 30) -> Column:
    from pyspark.sql import Window

    f = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.when(F.count(x).over(f) >= least, (x - F.avg(x).over(f)) / (F.stddev_samp(x).over(f) + EPSILON))


def pit_minmax(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    f = w.rowsBetween(-n, -1)
    low, high = F.min(x).over(f), F.max(x).over(f)
    return F.when(F.count(x).over(f) >= (least or n), (x - low) / (high - low + EPSILON))


def pit_rank(x: Column, n: int, w: WindowSpec) -> Column:
    """The previous bar's rank in its own window."""
    values = F.lag(F.struct(x.alias("x")), 1).over(w)["x"]
    window = F.collect_list(x).over(w.rowsBetween(-n, -1))
    less, same = F.size(F.filter(window, lambda v: v < values)), F.size(F.filter(window, lambda v: v == values))
    return F.when(F.count(x).over(w.rowsBetween(-n, -1)) == n, (less + (same + 1) / 2) / F.lit(n))


def current_zscore(x: Column, n: int, w: WindowSpec) -> Column:
    """Against a window with the current bar; NULL where it is constant."""
    return F.try_divide(x - R.mean(x, n, w), R.sd(x, n, w))


METHODS = {"zscore_rolling": pit_zscore, "zscore_expanding": lambda x, n, w: pit_expanding(x, w), "rank": pit_rank, "minmax": pit_minmax}


def normalised(df, columns: list[str], method: str, n: int, w: WindowSpec):
    """df with each column normalised, as FLOAT."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    return df.withColumns({c: METHODS[method](F.col(c), n, w).cast("float") for c in columns})


def sees_the_future(transform, df, ts: str, at, column: str, out: str, tolerance: float = 1e-6) -> bool:
    """Whether changing `column` after a time changes `out` at or before it."""
    changed = df.withColumn(column, F.when(F.col(ts) > at, F.col(column) * 2 + 1).otherwise(F.col(column)))
    keys = [c for c in ("series", ts) if c in df.columns]
    a, b = (transform(x).where(F.col(ts) <= at).select(*keys, F.col(out).alias(n)) for x, n in ((df, "a"), (changed, "b")))
    apart = F.col("a").isNull() != F.col("b").isNull()
    return not a.join(b, keys).where(apart | (F.abs(F.col("a") - F.col("b")) > tolerance)).isEmpty()


def window_scores(df, columns: list[str], n: int, w: WindowSpec):
    """For each column x, x_z and x_rank within a window that holds the current bar; the first n bars of a series are cut off."""
    made = {f"{c}_z": current_zscore(F.col(c), n, w) for c in columns} | {f"{c}_rank": R.rank(F.col(c), n, w) for c in columns}
    return df.withColumns(made).withColumn("_n", F.row_number().over(w)).where(F.col("_n") > n).drop("_n")


def look_ahead_report(checks: dict, df, ts: str, times: list, column: str, tolerance: float = 1e-6):
    """name, n_checks, n_passed, is_clean: each transform (a function of df and the name of what it makes) tried at several times; clean ones come last. What is gathered is a truth value for each check."""
    rows = []
    for name, (transform, out) in checks.items():
        passed = sum(not sees_the_future(transform, df, ts, at, column, out, tolerance) for at in times)
        rows.append((name, len(times), passed, passed == len(times)))
    return df.sparkSession.createDataFrame(rows, "name STRING, n_checks INT, n_passed INT, is_clean BOOLEAN").orderBy("is_clean", "name")
