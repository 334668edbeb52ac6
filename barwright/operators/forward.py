"""Linear models from co-moments: penalised fits, cross-validation, and the validation that refits forward in time.

Rows are read once. Each stretch of days (a unit, of which every window is a whole number) or fold gets its co-moment matrix; a window's or fold's matrix is the sum of those of its parts, so that all windows are one job and a fit is a small system that one task solves, whatever the number of rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.blocks import numbered
from barwright.operators import align
from barwright.operators.comoments import Moments, comoments, merged, whole
from barwright.sources.bars import stored

#: Rounds of coordinate descent at most, and the change that ends it.
ROUNDS, STILL = 10_000, 1e-13


class Scaled:
    """Correlations of features with each other and the target, from co-moments whose last column is the target. Deviations are of the population; constant features have no part."""

    def __init__(self, m: Moments) -> None:
        sd = np.sqrt(np.maximum(m.product.diagonal() / m.n, 0.0))
        self.n, self.mean, self.sd = m.n, m.mean, sd
        self.alive = np.flatnonzero(sd[:-1] > 0)
        size = sd[self.alive]
        self.gram = m.product[np.ix_(self.alive, self.alive)] / m.n / np.outer(size, size)
        self.toward = m.product[self.alive, -1] / m.n / size  # covariance of scaled features with the target

    def filled(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sd) - 1)
        out[self.alive] = w
        return out

    def ic(self) -> np.ndarray:
        return self.filled(self.toward / self.sd[-1] if self.sd[-1] > 0 else np.zeros(len(self.alive)))

    def ridge(self, alpha: float, among: np.ndarray | None = None) -> np.ndarray:
        """Coefficients of scaled features; alpha is the penalty a table. among: flags of the features that may take part."""
        use = np.ones(len(self.alive), dtype=bool) if among is None else among[self.alive]
        w = np.zeros(len(self.alive))
        if use.any():
            w[use] = np.linalg.solve(self.gram[np.ix_(use, use)] * self.n + alpha * np.eye(int(use.sum())), self.toward[use] * self.n)
        return self.filled(w)

    def lasso(self, alpha: float, start: np.ndarray | None = None) -> np.ndarray:
        """Coefficients of scaled features by coordinate descent; alpha is the penalty a row."""
        w = np.zeros(len(self.alive)) if start is None else start[self.alive]
        return self.filled(descend(self.gram, self.toward, alpha, w, self.sd[-1]))


def best_places(score: np.ndarray, names: list[str], most: int, only: np.ndarray | None = None) -> np.ndarray:
    """Flags of the `most` highest scores; equal ones by name."""
    order = sorted((i for i in range(len(names)) if only is None or only[i]), key=lambda i: (-score[i], names[i]))
    out = np.zeros(len(names), dtype=bool)
    out[order[:most]] = True
    return out


# ---- forward in time


def windows_of(df: DataFrame, train_days: int, test_days: int, step_days: int, expanding: bool = False, least_train: int = 100, least_test: int = 20) -> tuple[DataFrame, DataFrame, int]:
    """Windows as align.walk_forward has them, with numbers of units; (window, unit) for each unit of a window's training part; and days a unit."""
    days = math.gcd(math.gcd(train_days, step_days), test_days)
    first = df.agg(F.min(F.to_date("ts")).alias("first"))
    windows = align.walk_forward(df, train_days, test_days, step_days, expanding, least_train, least_test).join(F.broadcast(first))  # one row
    at = lambda c: F.floor(F.datediff(c, "first") / days).cast("int")
    windows = stored(windows.select("window", "train_start", "train_end", "test_end", "n_train", "n_test", "first", at("train_start").alias("_a"), at("train_end").alias("_b")))
    return windows.drop("_a", "_b"), windows.select("window", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("unit")), days


def walk_forward_models(df: DataFrame, features: list[str], y: str, train_days: int, test_days: int, step_days: int, keys: list[str] | None = None, alpha: float = 1.0, lasso_alpha: float = 0.01, most: int = 100, threshold: int = 3, fallback: int = 50, expanding: bool = False, least_train: int = 100, least_test: int = 20, votes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows, and models (keys, window, feature, votes, selected, mean, sd, coef, offset): of each window's training part, the features that `threshold` methods have among their `most` best (information coefficient, ridge, lasso, and those of `votes`: keys, window, feature, a row for each further vote), else the `fallback` best by information coefficient; these scaled by the part's means and deviations and fitted by a ridge. offset is the mean of y.

    Rows without a feature or y take no part. A key without two rows in a window has no model there; a constant feature gets no votes by score 0 and the coefficient 0."""
    keys = keys or []
    windows, units, days = windows_of(df, train_days, test_days, step_days, expanding, least_train, least_test)
    numbered = df.join(F.broadcast(windows.agg(F.min("first").alias("_first")))).withColumn("unit", F.floor(F.datediff(F.to_date("ts"), "_first") / days).cast("int"))  # one row
    blocks = stored(comoments(numbered, [*features, y], [*keys, "unit"]))
    sums = merged(blocks.join(units, "unit").drop("unit"), [*keys, "window"])
    names = [*keys, "window"]
    if votes is not None:
        more = votes.groupBy(*names).agg(F.collect_list("feature").alias("_more"))
        sums = sums.join(more, names, "left")
    else:
        sums = sums.withColumn("_more", F.lit(None).cast("array<string>"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        columns = [*names, "feature", "votes", "selected", "mean", "sd", "coef", "offset"]
        m = whole(rows.to_dict("records"), len(features) + 1)
        if m.n < 2:
            return pd.DataFrame(columns=columns)
        s = Scaled(m)
        scores = [np.abs(s.ic()), np.abs(s.ridge(alpha)), np.abs(s.lasso(lasso_alpha))]
        chosen = [best_places(x, features, most, x > 0) for x in scores]
        count = np.sum(chosen, axis=0)
        more = rows["_more"].iloc[0]
        for f in more if more is not None else []:
            count[features.index(f)] += 1
        selected = count >= threshold
        if not selected.any():
            selected = best_places(scores[0], features, fallback, scores[0] > 0)
        w = s.ridge(alpha, selected)
        own = {c: [rows[c].iloc[0]] * len(features) for c in names}
        return pd.DataFrame(own | {"feature": features, "votes": count, "selected": selected, "mean": s.mean[:-1], "sd": s.sd[:-1], "coef": w, "offset": s.mean[-1]})[columns]

    fields = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return windows, sums.groupBy(*names).applyInPandas(fit, fields + "window INT, feature STRING, votes INT, selected BOOLEAN, mean DOUBLE, sd DOUBLE, coef DOUBLE, offset DOUBLE")


def walk_forward_predictions(df: DataFrame, windows: DataFrame, models: DataFrame, features: list[str], y: str, keys: list[str] | None = None) -> DataFrame:
    """keys, window, ts, y_true, y_pred of every whole row of every window's test part."""
    keys = keys or []
    whole_rows = df.na.drop("any", subset=[*features, y])
    day = F.to_date("ts")
    test = whole_rows.join(F.broadcast(windows.select("window", "train_end", "test_end")), (day >= F.col("train_end")) & (day < F.col("test_end")))  # a row for each step of the calendar
    line = F.struct("feature", F.when(F.col("sd") > 0, F.col("coef") / F.col("sd")).otherwise(0.0).alias("w"), "mean")
    packed = models.groupBy(*keys, "window").agg(F.first("offset").alias("_offset"), F.map_from_entries(F.collect_list(F.struct("feature", line))).alias("_model"))
    of = lambda f: F.element_at("_model", F.lit(f))
    pred = sum(((F.col(f) - of(f)["mean"]) * of(f)["w"] for f in features), F.col("_offset"))
    return test.join(packed, [*keys, "window"]).select(*keys, "window", "ts", F.col(y).cast("double").alias("y_true"), pred.alias("y_pred"))


# ---- cross-validated lasso


def penalties(s: Scaled, n: int = 100, least: float = 1e-3) -> np.ndarray:
    """From the least penalty that leaves no coefficient, down to `least` of it, in equal ratios."""
    top = float(np.abs(s.toward).max()) if len(s.toward) else 0.0
    return np.geomspace(top, top * least, n) if top > 0 else np.zeros(n)


def lasso_cv(df: DataFrame, features: list[str], y: str, keys: list[str] | None = None, folds: int = 5, n_penalties: int = 100, order: str = "ts") -> DataFrame:
    """keys, feature, alpha, coef, abs_coef, non_zero: a lasso of scaled features whose penalty is the one with the least mean squared error over folds, which are equal stretches of time order (the first ones a row longer).

    Features are scaled by all rows, the intercept is free in every fold. Of equal errors the greatest penalty is taken. A key with fewer rows than folds has no result; a constant feature has the coefficient 0."""
    keys = keys or []
    rows = df.na.drop("any", subset=[*features, y])
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(rows, "_i", tuple(keys), order) if keys else numbered(rows.withColumn("_one", F.lit(0)), "_i", ("_one",), order)
    placed = placed.join(n, keys) if keys else placed.crossJoin(F.broadcast(n))  # one row
    short, more = F.floor(F.col("_n") / folds), F.col("_n") % folds
    long = more * (short + 1)  # rows in the longer folds
    fold = F.when(F.col("_i") < long, F.floor(F.col("_i") / (short + 1))).otherwise(more + F.floor((F.col("_i") - long) / short)).cast("int")
    blocks = comoments(placed.where(F.col("_n") >= folds).withColumn("fold", fold), [*features, y], [*keys, "fold"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        k = len(features) + 1
        parts = [whole(r.to_dict("records"), k) for _, r in rows.groupby("fold")]
        every = parts[0]
        for p in parts[1:]:
            every = every + p
        s = Scaled(every)
        path = penalties(s, n_penalties)
        error = np.zeros(n_penalties)
        for held in parts:
            train = every - held
            # in units of all rows' deviations; each fold has its own means
            unit = np.where(s.sd[:-1] > 0, s.sd[:-1], 1.0)
            gram, toward = train.product[:-1, :-1] / train.n / np.outer(unit, unit), train.product[:-1, -1] / train.n / unit
            w = np.zeros(k - 1)
            for at, alpha in enumerate(path):
                w = descend(gram, toward, alpha, w, s.sd[-1])
                raw = w / unit
                bias = (held.mean[-1] - train.mean[-1]) - (held.mean[:-1] - train.mean[:-1]) @ raw  # mean error of the held rows
                square = held.product[-1, -1] - 2 * raw @ held.product[:-1, -1] + raw @ held.product[:-1, :-1] @ raw
                error[at] += square / held.n + bias * bias
        alpha = float(path[int(np.argmin(error))])
        unit = np.where(s.sd[:-1] > 0, s.sd[:-1], 1.0)
        w = np.zeros(k - 1)
        for step in path:
            w = descend(every.product[:-1, :-1] / every.n / np.outer(unit, unit), every.product[:-1, -1] / every.n / unit, float(step), w, s.sd[-1])
            if step <= alpha:
                break
        own = {c: [rows[c].iloc[0]] * (k - 1) for c in keys}
        return pd.DataFrame(own | {"feature": features, "alpha": alpha, "coef": w, "abs_coef": np.abs(w), "non_zero": w != 0})

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)
    schema = fields + "feature STRING, alpha DOUBLE, coef DOUBLE, abs_coef DOUBLE, non_zero BOOLEAN"
    return blocks.groupBy(*keys).applyInPandas(fit, schema)


def descend(gram: np.ndarray, toward: np.ndarray, alpha: float, start: np.ndarray, size: float) -> np.ndarray:
    """Coordinate descent from `start`; size: what a coefficient of note is measured by. Features without variance stay 0."""
    w = start.copy()
    diagonal = gram.diagonal()
    for _ in range(ROUNDS):
        moved = 0.0
        for i in np.flatnonzero(diagonal > 0):
            rest = toward[i] - gram[i] @ w + diagonal[i] * w[i]
            new = math.copysign(max(abs(rest) - alpha, 0.0), rest) / diagonal[i]
            moved, w[i] = max(moved, abs(new - w[i])), new
        if moved < STILL * max(size, 1e-300):
            break
    return w
