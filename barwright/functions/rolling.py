"""The rolling operator algebra: functions from columns to columns over one window spec, all NULL until their window is full.

Windows include the current bar. Every operator of one spec shares a single exchange and sort; Catalyst computes equal frames once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Stands for a zero deviation or range in Z and Pos.
EPSILON = 1e-10
#: Values outside make a log return meaningless.
LOG_LOW, LOG_HIGH = 1e-4, 1e4


def series_window(keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("ts",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def last(w: WindowSpec, n: int) -> WindowSpec:
    """The frame of the last n bars."""
    return w.rowsBetween(-(n - 1), 0)


def full(x: Column, n: int, w: WindowSpec, value: Column) -> Column:
    """value where all of the last n bars have an x."""
    return F.when(F.count(x).over(last(w, n)) == n, value)


def or_epsilon(x: Column) -> Column:
    return F.when(x == 0, F.lit(EPSILON)).otherwise(x)


def delta(x: Column, n: int, w: WindowSpec) -> Column:
    return x - F.lag(x, n).over(w)


def ret(x: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def logret(x: Column, n: int, w: WindowSpec) -> Column:
    """NULL where either value is out of [LOG_LOW, LOG_HIGH]; `admission` drops features that meet such values."""
    before = F.lag(x, n).over(w)
    fine = x.between(LOG_LOW, LOG_HIGH) & before.between(LOG_LOW, LOG_HIGH)
    return F.when(fine, F.ln(F.try_divide(x, before)))


def mean(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, n, w, F.avg(x).over(last(w, n)))


def sd(x: Column, n: int, w: WindowSpec) -> Column:
    """Sample deviation; NULL for one bar."""
    return full(x, n, w, F.stddev_samp(x).over(last(w, n))) if n > 1 else F.lit(None).cast("double")


def highest(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, n, w, F.max(x).over(last(w, n)))


def lowest(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, n, w, F.min(x).over(last(w, n)))


def zscore(x: Column, n: int, w: WindowSpec) -> Column:
    return (x - mean(x, n, w)) / or_epsilon(sd(x, n, w))


def position(x: Column, n: int, w: WindowSpec) -> Column:
    """Place in the window's range, 0 to 1."""
    low = lowest(x, n, w)
    return (x - low) / or_epsilon(highest(x, n, w) - low)


def rank(x: Column, n: int, w: WindowSpec) -> Column:
    """Share of the window at or below the current value, ties by half."""
    values = F.collect_list(x).over(last(w, n))
    less, same = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    return full(x, n, w, (less + (same + 1) / 2) / F.lit(n))


def percentile(x: Column, k: float, n: int, w: WindowSpec) -> Column:
    if not 0 <= k <= 100:
        raise ValueError(f"a percentile lies between 0 and 100, not {k}")
    return full(x, n, w, F.percentile(x, F.lit(k / 100)).over(last(w, n)))


def d1(x: Column, w: WindowSpec) -> Column:
    return x - F.lag(x, 1).over(w)


def d2(x: Column, w: WindowSpec) -> Column:
    return x - 2 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w)


def rho(x: Column, y: Column, n: int, w: WindowSpec) -> Column:
    """Pearson correlation; NULL where either side is constant."""
    f = last(w, n)
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    value = F.try_divide(F.covar_samp(x, y).over(f), F.stddev_samp(x).over(f) * F.stddev_samp(y).over(f))
    return F.when(F.count(both).over(f) == n, value)


#: Windowed operators by name; register() adds more.
WINDOWED: dict[str, Callable[[Column, int, WindowSpec], Column]] = {
    "delta": delta,
    "ret": ret,
    "logret": logret,
    "mean": mean,
    "sd": sd,
    "max": highest,
    "min": lowest,
    "z": zscore,
    "pos": position,
    "rank": rank,
}
#: Operators without a window.
PLAIN: dict[str, Callable[[Column, WindowSpec], Column]] = {"d1": d1, "d2": d2}


def register(name: str, operator: Callable[[Column, int, WindowSpec], Column]) -> None:
    if name in WINDOWED or name in PLAIN or name == "ema":
        raise ValueError(f"{name} is taken")
    WINDOWED[name] = operator
