"""Mutual information by nearest neighbours (the estimator that counts, for each point, those nearer than its k-th neighbour on each axis).

Values are divided by their deviation and held as whole billionths of it, so that distances and comparisons are exact and every engine finds the same neighbours. Points that repeat are one point with a count.

The plane of each group is cut into cells of about CELL points, by quantiles on one axis and again by quantiles within each part, so that every cell is a task's work, however the points lie. A cell gives each of its points a bound, the k-th distance within the cell; a point then visits those other cells alone that its square of that size reaches. In a cell, points are searched outwards along one axis until the bound. Counts on the axes come from running sums over ranges of the axis. Nothing pairs all rows, and no group is one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.sources.bars import stored

#: Units of a deviation that values are held in.
UNITS = 1_000_000_000
#: Points of a cell; parts of an axis at most (a power of two): 64 * 64 cells a group, whose edges are all that the driver sees of it.
CELL, PARTS = 512, 64
FAR = np.int64(1) << np.int64(61)


def digamma(n: Column) -> Column:
    """Of whole numbers from 1 on: the asymptotic series at n + 6, moved back."""
    x = n + 6.0
    back = sum((1.0 / (n + i) for i in range(6)), F.lit(0.0))
    return F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6)) + 1 / (240 * F.pow(x, 8)) - back


def in_units(rows: DataFrame, by: list[str], value: str, target: str) -> DataFrame:
    """by, x, y, m (how many rows are there) and n (rows of the group)."""
    rows = rows.where(F.col(value).isNotNull() & F.col(target).isNotNull() & ~F.isnan(value) & ~F.isnan(target)).select(*by, F.col(value).alias("_v"), F.col(target).alias("_t"))
    size = rows.groupBy(*by).agg(F.stddev_pop("_v").alias("_a"), F.stddev_pop("_t").alias("_b"), F.count(F.lit(1)).alias("n"))
    unit = lambda v, sd: F.round(F.col(v) / F.when(F.col(sd) > 0, F.col(sd)).otherwise(1.0) * UNITS).cast("bigint")
    return rows.join(size, by).select(*by, "n", unit("_v", "_a").alias("x"), unit("_t", "_b").alias("y")).groupBy(*by, "n", "x", "y").agg(F.count(F.lit(1)).alias("m"))


def axis_cuts(points: DataFrame, by: list[str], axis: str) -> DataFrame:
    share = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    return points.groupBy(*by).agg(F.array_distinct(F.percentile_approx(axis, share, F.lit(4_000))).alias("cuts"), F.count(F.lit(1)).alias("points"))


def in_cells(points: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """points with cell numbers i and j, and by, i, cuts of y, low and high of x (in x, above low and up to high) for each part i of each group."""
    across = axis_cuts(points, by, "x")
    thin = lambda want: F.filter("cuts", lambda c, at: ((at + 1) % F.greatest(F.floor(F.lit(PARTS) / want), F.lit(1))) == 0)
    side = F.least(F.lit(PARTS), F.greatest(F.lit(1), F.floor(F.sqrt(F.col("points") / CELL)).cast("int")))
    across = stored(across.select(*by, thin(side).alias("cuts")))
    placed = points.join(across, by).withColumn("i", F.size(F.filter("cuts", lambda c: c < F.col("x"))))
    edges = lambda at: F.get("cuts", at)
    placed = placed.withColumns({"low": edges(F.col("i") - 1), "high": edges(F.col("i"))}).drop("cuts")
    up = axis_cuts(placed, [*by, "i"], "y")
    side = F.least(F.lit(PARTS), F.greatest(F.lit(1), F.floor(F.col("points") / CELL).cast("int")))
    up = stored(up.select(*by, "i", thin(side).alias("cuts")))
    parts = placed.groupBy(*by, "i").agg(F.first("low").alias("low"), F.first("high").alias("high")).join(up, [*by, "i"])
    out = placed.drop("low", "high").join(up, [*by, "i"]).withColumn("j", F.size(F.filter("cuts", lambda c: c < F.col("y")))).drop("cuts")
    return stored(out), parts


def swept(x: np.ndarray, y: np.ndarray, m: np.ndarray, qx: np.ndarray, qy: np.ndarray, best: np.ndarray, own: bool) -> np.ndarray:
    """best (k least distances of each query so far, ascending) brought up to date with points sorted by x; own: queries are the points, and don't meet themselves."""
    k = best.shape[1]
    left = np.arange(len(qx)) - 1 if own else np.searchsorted(x, qx) - 1
    right = left + (2 if own else 1)
    for at, step in ((left, -1), (right, 1)):
        alive = np.flatnonzero((at >= 0) & (at < len(x)))
        at = at[alive]
        while len(alive):
            aside = np.abs(x[at] - qx[alive])
            on = aside < best[alive, -1]
            alive, at, aside = alive[on], at[on], aside[on]
            if not len(alive):
                break
            apart = np.maximum(aside, np.abs(y[at] - qy[alive]))
            for times in range(k):
                hit = (m[at] > times) & (apart < best[alive, -1])
                if not hit.any():
                    break
                rows = best[alive[hit]]
                rows[:, -1] = apart[hit]
                best[alive[hit]] = np.sort(rows, axis=1)
            at = at + step
            inside = (at >= 0) & (at < len(x))
            alive, at = alive[inside], at[inside]
    return best


def neighbour_distances(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, n, x, y, m, eps: the distance to the k-th nearest row, the greater of both axes'; NULL where a group has no more than k rows."""
    cells, parts = in_cells(points, by)
    schema = cells.select(*by).schema
    names = by
    edges: dict[tuple, list] = {}
    for r in parts.collect():  # parts of an axis, with their edges: PARTS rows of PARTS numbers for each group at most
        edges.setdefault(tuple(r[b] for b in by), []).append((r["i"], r["low"], r["high"], sorted(r["cuts"])))
    shared = points.sparkSession.sparkContext.broadcast({key: sorted(x, key=lambda p: p[0]) for key, x in edges.items()})
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)

    def at_home(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.sort_values("x", kind="stable")
        x, y, m = (p[c].to_numpy() for c in ("x", "y", "m"))
        best = np.full((len(x), k), FAR)
        for times in range(min(k, int(m.max()) - 1)):  # other rows at the same point
            best[m - 1 > times, times] = 0
        best = swept(x, y, m, x, y, best, True)
        out = {b: [v] * len(x) for b, v in zip(names, key, strict=False)}
        home = pd.DataFrame(out | {"n": p["n"].to_numpy(), "x": x, "y": y, "m": m, "best": best.tolist()})
        i, j = key[len(names)], key[len(names) + 1]
        bound = best[:, -1]
        made = [home.assign(ti=-1, tj=-1)]
        for part, low, high, cuts in shared.value[tuple(key[: len(names)])]:
            near = np.ones(len(x), dtype=bool)
            if low is not None:
                near &= x + bound > low + 1
            if high is not None:
                near &= x - bound < high
            if not near.any():
                continue
            cuts = np.array(cuts, dtype=np.int64)
            first = np.searchsorted(cuts, y - bound + 1)  # the number of the part that holds the square's lowest y, and its highest
            last = np.searchsorted(cuts, y + bound - 1)
            for other in range(int(first[near].min()), int(last[near].max()) + 1):
                hit = near & (first <= other) & (other <= last)
                if (part, other) != (i, j) and hit.any():
                    made.append(home[hit].assign(ti=part, tj=other))
        return pd.concat(made)

    home = stored(cells.groupBy(*by, "i", "j").applyInPandas(at_home, fields + "n BIGINT, x BIGINT, y BIGINT, m BIGINT, best ARRAY<BIGINT>, ti INT, tj INT"))
    visits = home.where(F.col("ti") >= 0)

    def away(key: tuple, there: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if not len(guests) or not len(there):
            return guests[[*names, "n", "x", "y", "m", "best"]].iloc[:0]
        there = there.sort_values("x", kind="stable")
        bound = np.array([b[-1] for b in guests["best"]], dtype=np.int64)
        best = np.repeat(bound[:, None], k, axis=1)  # nothing farther counts
        swept(there["x"].to_numpy(), there["y"].to_numpy(), there["m"].to_numpy(), guests["x"].to_numpy(), guests["y"].to_numpy(), best, False)
        return guests[[*names, "n", "x", "y", "m"]].assign(best=best.tolist())

    keyed = visits.withColumnsRenamed({"ti": "i", "tj": "j"})
    met = cells.groupBy(*by, "i", "j").cogroup(keyed.groupBy(*by, "i", "j")).applyInPandas(away, fields + "n BIGINT, x BIGINT, y BIGINT, m BIGINT, best ARRAY<BIGINT>")
    every = home.where(F.col("ti") < 0).select(*by, "n", "x", "y", "m", "best").unionByName(met)
    bound = F.col("best")[k - 1]
    ends = every.groupBy(*by, "n", "x", "y", "m").agg(F.max(bound).alias("_most"), F.array_sort(F.flatten(F.collect_list("best"))).alias("_all"))
    return ends.select(*by, "n", "x", "y", "m", F.when(F.col("n") > k, F.col("_all")[k - 1]).alias("eps"))


def interval_counts(points: DataFrame, by: list[str], axis: str) -> DataFrame:
    """by, x, y and the number of other rows of the group that are less than eps away on the axis."""
    cuts = axis_cuts(points, by, axis).select(*by, "cuts")
    data = points.select(*by, F.col(axis).alias("v"), F.lit(1).alias("kind"), "m", F.lit(None).cast("bigint").alias("x"), F.lit(None).cast("bigint").alias("y"))
    ask = F.explode(F.array(F.struct((F.col(axis) + F.col("eps")).alias("v"), F.lit(0).alias("kind")), F.struct((F.col(axis) - F.col("eps")).alias("v"), F.lit(2).alias("kind"))))
    asked = points.select(*by, "x", "y", ask.alias("q")).select(*by, "q.v", "q.kind", F.lit(0).cast("bigint").alias("m"), "x", "y")
    line = data.unionByName(asked).join(cuts, by).withColumn("_part", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows a group
    firsts = line.groupBy(*by, "_part").agg(F.sum("m").alias("_m")).withColumn("_first", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    so_far = Window.partitionBy(*by, "_part").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = line.withColumn("_c", F.sum("m").over(so_far)).join(firsts, [*by, "_part"]).where(F.col("kind") != 1)
    total = F.sum(F.when(F.col("kind") == 0, F.col("_c") + F.col("_first")).otherwise(-F.col("_c") - F.col("_first")))
    return counted.groupBy(*by, "x", "y").agg(F.greatest(total - 1, F.lit(0)).alias(f"n_{axis}"))


def neighbour_mutual_information(rows: DataFrame, by: list[str], value: str = "value", target: str = "target", k: int = 3) -> DataFrame:
    """by, n, mi (nats, 0 at least) of value and target in each group, over rows that have both.

    Group keys are not null. A group of k rows or fewer has NULL. A constant side gives 0. Ties count as they are: rows at equal distance are no nearer, so that a point with k copies has no neighbours to count."""
    if k < 1:
        raise ValueError("k is 1 at least")
    found = stored(neighbour_distances(stored(in_units(rows, by, value, target)), by, k))
    asked = found.where(F.col("eps").isNotNull())
    counts = interval_counts(asked, by, "x").join(interval_counts(asked, by, "y"), [*by, "x", "y"])
    each = found.join(counts, [*by, "x", "y"], "left")
    share = F.sum(F.col("m") * (digamma(F.col("n_x") + 1) + digamma(F.col("n_y") + 1)))
    out = each.groupBy(*by, "n").agg(share.alias("_s"))
    return out.select(*by, "n", F.when(F.col("n") > k, F.greatest(digamma(F.col("n")) + digamma(F.lit(k)) - F.col("_s") / F.col("n"), F.lit(0.0))).alias("mi"))
