"""Screening statistics: information coefficients, mutual information, correlation networks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.comoments import correlations
from barwright.operators.networks import edges_of
from barwright.sources.bars import stored


def long(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """feature, value rows of a wide table."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features))).alias("f")).select(*keep, "f.feature", "f.value")


def pearson(x: str, y: str) -> Column:
    """NULL where a side is constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


#: Ranges that a group's values are cut into before they are ranked.
RANGES = 64


def average_ranks(rows: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """rows with the rank of x in its group, ties by their mean. Groups are cut into ranges of about equal size, which are ranked by themselves and moved on by the counts of those before, so that one group is many tasks' work."""
    cuts = rows.groupBy(*by).agg(F.percentile_approx(x, F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), F.lit(2_000)).alias("_cuts"))
    at = rows.join(cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a group
    firsts = at.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    part = Window.partitionBy(*by, "_range").orderBy(x)
    ties = Window.partitionBy(*by, "_range", x)
    return at.join(firsts, [*by, "_range"]).withColumn(out, F.col("_first") + F.rank().over(part) + (F.count(F.lit(1)).over(ties) - 1) / 2).drop("_range", "_first")


def information_coefficient(rows: DataFrame, by: list[str], method: str = "pearson", least: int = 10) -> DataFrame:
    """n and ic of value with target for each group, of rows that have both; NULL below `least` rows. Pearson needs one aggregation; Spearman ranks each group first."""
    rows = rows.where(F.col("value").isNotNull() & F.col("target").isNotNull())
    if method == "spearman":
        for c in ("value", "target"):
            rows = average_ranks(rows, by, c, f"_{c}")
        rows = rows.withColumns({"value": F.col("_value"), "target": F.col("_target")})
    elif method != "pearson":
        raise ValueError(f"no such method: {method}")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson("value", "target").alias("ic")).withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


#: Steps of the quadrature in `two_sided_p`, an even number.
STEPS = 400


def two_sided_p(r: Column, n: Column) -> Column:
    """Chance of a correlation at least as far from 0 among n independent rows: the tail of the t distribution with n - 2 degrees of freedom. With t = tan(u) * sqrt(n - 2) its density goes as cos(u) ** (n - 3), which Simpson's rule sums; beyond 14 deviations nothing is left."""
    v = n - 2
    start = F.asin(F.least(F.abs(r), F.lit(1.0)))

    def area(a: Column) -> Column:
        h = F.least(F.lit(math.pi / 2) - a, 14 / F.sqrt(v)) / STEPS
        weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return h * F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + weight(i) * F.pow(F.greatest(F.cos(a + i * h), F.lit(0.0)), v - 1))

    return F.when(v > 0, F.least(F.try_divide(area(start), area(F.lit(0.0))), F.lit(1.0)))


def significance(ic: DataFrame) -> DataFrame:
    """ic with t_stat (ic times the root of n), p_value (two-sided) and p_value_corrected (Bonferroni)."""
    m = F.count(F.lit(1)).over(Window.partitionBy())  # a row for each feature
    out = ic.withColumn("t_stat", F.col("ic") * F.sqrt("n")).withColumn("p_value", F.coalesce(two_sided_p(F.col("ic"), F.col("n")), F.lit(1.0)))
    return out.withColumn("p_value_corrected", F.least(F.col("p_value") * m, F.lit(1.0))).withColumn("abs_ic", F.abs("ic"))


def width_bins(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Number of the equal-width bin, 1 to bins; the largest value falls into the last."""
    return F.least(F.floor(F.coalesce(F.try_divide((x - low) * bins, high - low), F.lit(0.0))) + 1, F.lit(bins))


def binned_mutual_information(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """mi (nats) of value and target over equal-width bins."""
    rows = rows.where(F.col("value").isNotNull() & F.col("target").isNotNull())
    edges = rows.groupBy(*by).agg(F.min("value").alias("_a"), F.max("value").alias("_b"), F.min("target").alias("_c"), F.max("target").alias("_d"), F.count(F.lit(1)).alias("_n"))
    binned = rows.join(edges, by).select(*by, "_n", width_bins(F.col("value"), F.col("_a"), F.col("_b"), bins).alias("i"), width_bins(F.col("target"), F.col("_c"), F.col("_d"), bins).alias("j"))
    joint = binned.groupBy(*by, "_n", "i", "j").agg(F.count(F.lit(1)).alias("nij"))
    joint = joint.withColumn("ni", F.sum("nij").over(Window.partitionBy(*by, "i"))).withColumn("nj", F.sum("nij").over(Window.partitionBy(*by, "j")))
    return joint.groupBy(*by).agg(F.sum(F.col("nij") / F.col("_n") * F.ln(F.col("nij") * F.col("_n") / (F.col("ni") * F.col("nj")))).alias("mi"))


def correlation_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """a, b, r for every pair of features (a before b in the list) over complete rows, in one pass by blocks of the co-moment matrix, so that hundreds of features are one plan."""
    return correlations(df, features).select("a", "b", "r")


def network(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """node, degree, degree_centrality, triangles and clustering of the graph of pairs with |r| above the threshold."""
    edges = pairs.where(F.abs("r") > threshold).select("a", "b")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    total = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    degree = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    x, y = both.select(F.col("a").alias("node"), F.col("b").alias("p")), both.select(F.col("a").alias("node"), F.col("b").alias("q"))
    closed = x.join(y, "node").where(F.col("p") < F.col("q")).join(both.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"]).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    out = nodes.join(degree, "node", "left").join(closed, "node", "left").na.fill(0, ["degree", "triangles"]).join(F.broadcast(total))  # total is one row
    d = F.col("degree")
    return out.select("node", "degree", F.try_divide(d, F.col("n_nodes") - 1).alias("degree_centrality"), "triangles", F.coalesce(F.try_divide(2.0 * F.col("triangles"), d * (d - 1)), F.lit(0.0)).alias("clustering"))


def stability(ic: DataFrame, by: list[str], most: float = 0.02) -> DataFrame:
    """Of several ic in a group: mean, population deviation, least, and whether they are all positive and steady."""
    out = ic.groupBy(*by).agg(F.count("ic").alias("n_groups"), F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_sd"), F.min("ic").alias("ic_min"), F.max("ic").alias("ic_max"))
    return out.withColumn("is_robust", (F.col("ic_sd") < most) & (F.col("ic_min") > 0))


def redundancy(pairs: DataFrame, scores: DataFrame, threshold: float = 0.95, keys: list[str] | None = None) -> DataFrame:
    """feature, kept of all features in pairs (a, b, r), by scores (feature, score; none counts as 0): of each pair above the threshold, in the order of the pairs' names, the one with the smaller score goes, unless one of the two has gone before.

    The pairs above the threshold of one key, of features and not of rows, are one task's work."""
    keys = keys or []
    pairs = stored(pairs.select(*keys, "a", "b", "r"))
    score = lambda side: scores.select(*keys, F.col("feature").alias(side), F.coalesce("score", F.lit(0.0)).alias(f"_{side}"))
    close = pairs.where(F.abs("r") > threshold).join(score("a"), [*keys, "a"], "left").join(score("b"), [*keys, "b"], "left").na.fill(0.0, ["_a", "_b"])

    def drop(rows: pd.DataFrame) -> pd.DataFrame:
        gone: set[str] = set()
        for a, b, x, y in rows.sort_values(["a", "b"])[["a", "b", "_a", "_b"]].itertuples(index=False):
            if a not in gone and b not in gone:
                gone.add(a if abs(x) < abs(y) else b)
        out = sorted(gone)
        return pd.DataFrame({c: [rows[c].iloc[0]] * len(out) for c in keys} | {"feature": out})

    fields = "".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}, " for c in keys)
    gone = close.groupBy(*keys).applyInPandas(drop, fields + "feature STRING").withColumn("_gone", F.lit(True))
    names = pairs.select(*keys, F.col("a").alias("feature")).union(pairs.select(*keys, "b")).distinct()
    return names.join(gone, [*keys, "feature"], "left").select(*keys, "feature", F.col("_gone").isNull().alias("kept"))


def closeness(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """node, reached, closeness of the graph of pairs with |r| above the threshold: the share of nodes that it reaches, over their mean distance in steps. A round for each step of the longest distance; the graph is of features, not rows."""
    nodes, both = edges_of(pairs, threshold)
    nodes, both = stored(nodes), stored(both)
    seen = frontier = nodes.select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit(0).alias("steps"))
    steps = 0
    while True:
        steps += 1
        reached = frontier.join(both, F.col("target") == F.col("a")).select("source", F.col("b").alias("target")).distinct()
        frontier = stored(reached.join(seen, ["source", "target"], "left_anti").withColumn("steps", F.lit(steps)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    total = nodes.agg(F.count(F.lit(1)).alias("n"))
    out = seen.groupBy(F.col("source").alias("node")).agg((F.count(F.lit(1)) - 1).alias("reached"), F.sum("steps").alias("far"))
    return out.join(F.broadcast(total)).select("node", "reached", F.coalesce(F.try_divide(F.col("reached") * F.col("reached"), F.col("far") * (F.col("n") - 1)), F.lit(0.0)).alias("closeness"))  # total is one row
