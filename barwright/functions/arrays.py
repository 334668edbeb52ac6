"""The rolling algebra over arrays, for plans of hundreds of features: a block of a series is one array for each column, and all statistics of a window length come from one pass over its frames, CHUNK rows at a time.

Results are those of functions/rolling.py; NaN stands for NULL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from barwright.functions.rolling import EPSILON, LOG_HIGH, LOG_LOW

#: Rows whose frames are in memory at once.
CHUNK = 4_096
FRAMED = ("mean", "sd", "max", "min", "rank")


def lagged(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if n < len(x):
        out[n:] = x[: len(x) - n]
    return out


def divided(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.full(len(x), np.nan), where=y != 0)


def framed(x: np.ndarray, n: int, wanted: set[str]) -> dict[str, np.ndarray]:
    """mean, sd, max, min and rank of the last n values, as far as they are wanted."""
    out = {k: np.full(len(x), np.nan) for k in FRAMED if k in wanted}
    if n > len(x):
        return out
    frames = np.lib.stride_tricks.sliding_window_view(x, n)
    for a in range(0, len(frames), CHUNK):
        v = np.ascontiguousarray(frames[a : a + CHUNK])
        at = slice(a + n - 1, a + n - 1 + len(v))
        gap = np.isnan(v).any(axis=1)
        first = v[:, :1]
        off = v - first  # a constant frame has exactly no deviation
        middle = off.mean(axis=1)
        if "mean" in out:
            out["mean"][at] = first[:, 0] + middle
        if "sd" in out and n > 1:
            out["sd"][at] = np.sqrt(((off - middle[:, None]) ** 2).sum(axis=1) / (n - 1))
        if "max" in out:
            out["max"][at] = v.max(axis=1)
        if "min" in out:
            out["min"][at] = v.min(axis=1)
        if "rank" in out:
            last = v[:, -1:]
            out["rank"][at] = ((v < last).sum(axis=1) + ((v == last).sum(axis=1) + 1) / 2) / n
        for k in out:
            out[k][at][gap] = np.nan
    return out


def _z(x: np.ndarray, f: dict[str, np.ndarray]) -> np.ndarray:
    return (x - f["mean"]) / np.where(f["sd"] == 0, EPSILON, f["sd"])


def _pos(x: np.ndarray, f: dict[str, np.ndarray]) -> np.ndarray:
    span = f["max"] - f["min"]
    return (x - f["min"]) / np.where(span == 0, EPSILON, span)


def _logret(x: np.ndarray, n: int) -> np.ndarray:
    before = lagged(x, n)
    fine = (x >= LOG_LOW) & (x <= LOG_HIGH) & (before >= LOG_LOW) & (before <= LOG_HIGH)
    return np.where(fine, np.log(np.where(fine, x, 1.0) / np.where(fine, before, 1.0)), np.nan)


#: Operators that need the value n bars before alone.
LAGGED: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"delta": lambda x, n: x - lagged(x, n), "ret": lambda x, n: divided(x, lagged(x, n)) - 1, "logret": _logret, "d1": lambda x, n: x - lagged(x, 1), "d2": lambda x, n: x - 2 * lagged(x, 1) + lagged(x, 2)}
#: Operators made of a frame's statistics, and which.
MADE: dict[str, tuple[Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray], tuple[str, ...]]] = {"z": (_z, ("mean", "sd")), "pos": (_pos, ("max", "min"))}
OPERATORS = {*LAGGED, *MADE, *FRAMED}


def operators(x: np.ndarray, n: int, names: list[str]) -> dict[str, np.ndarray]:
    """Each named operator of x with window n."""
    needed = {k for k in names if k in FRAMED} | {k for o in names if o in MADE for k in MADE[o][1]}
    f = framed(x, n, needed) if needed else {}
    return {o: LAGGED[o](x, n) if o in LAGGED else MADE[o][0](x, f) if o in MADE else f[o] for o in names}
