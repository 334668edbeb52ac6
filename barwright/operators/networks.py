"""Graphs of correlated features: shortest paths through a node, communities, and what a graph is like as a whole.

Edges join features whose correlation is above a threshold, so a graph has as many nodes as there are features; paths from all nodes are one table, and a round of joins goes one step further from all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.sources.bars import stored


def edges_of(pairs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """node, and both directions (a, b) of every edge."""
    kept = stored(pairs.select("a", "b", "r"))
    one = kept.where(F.abs("r") > threshold).select("a", "b")
    nodes = kept.select(F.col("a").alias("node")).union(kept.select("b")).distinct()
    return nodes, one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b")))


def betweenness(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """node, betweenness: the share of shortest paths between other nodes that lead through it, over all pairs of them.

    Steps forward count the shortest paths from every source; steps back add up what depends on each node (Brandes, 2001). There are as many rounds as the longest shortest path has steps. A graph of fewer than three nodes has 0 everywhere; nodes without a path between them count for nothing."""
    nodes, both = edges_of(pairs, threshold)
    both = stored(both)
    seen = stored(nodes.select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit(1.0).alias("paths")))
    levels = [seen]
    while True:
        ahead = levels[-1].join(both, F.col("target") == F.col("a")).groupBy("source", F.col("b").alias("target")).agg(F.sum("paths").alias("paths"))
        level = stored(ahead.join(seen, ["source", "target"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.union(level)
    depends = levels[-1].select("source", "target", "paths", F.lit(0.0).alias("share"))
    total = depends
    for before in reversed(levels[:-1]):
        to = depends.select("source", F.col("target").alias("b"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        back = before.join(both, F.col("target") == F.col("a")).join(to, ["source", "b"]).groupBy("source", "target").agg(F.sum("part").alias("part"))
        depends = stored(before.join(back, ["source", "target"], "left").select("source", "target", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")))
        total = total.union(depends)
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    through = total.where(F.col("source") != F.col("target")).groupBy(F.col("target").alias("node")).agg(F.sum("share").alias("through"))
    out = nodes.join(through, "node", "left").join(F.broadcast(n))  # one row
    return out.select("node", F.coalesce(F.try_divide("through", (F.col("n") - 1) * (F.col("n") - 2)), F.lit(0.0)).alias("betweenness"))


def merged_groups(names: list[str], edges: list[tuple[int, int]]) -> list[int]:
    """The group of each node (its least member), by merging the two joined groups whose merger gains most modularity, of equal gains the first by name, as long as none is lost. Gains are whole numbers: twice the edges' number times the edges between, less the product of degrees."""
    n, m = len(names), len(edges)
    between = np.zeros((n, n), dtype=np.int64)
    for a, b in edges:
        between[a, b] = between[b, a] = 1
    degree = between.sum(axis=1)
    group = np.arange(n)
    while True:
        gain = np.where(np.triu(between, 1) > 0, 2 * m * between - np.outer(degree, degree), -1)
        at = int(gain.argmax())
        u, v = divmod(at, n)
        if gain[u, v] < 0:
            return group.tolist()
        group[group == v] = u
        between[u] += between[v]
        between[:, u] += between[:, v]
        between[v] = between[:, v] = between[u, u] = 0
        degree[u], degree[v] = degree[u] + degree[v], 0


def communities(pairs: DataFrame, threshold: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """keys, node, community (the name of its least member) of each key's graph, by greedy modularity. One task merges the groups of one graph, whose size is the square of the number of features; graphs of different keys are different tasks."""
    keys = keys or []

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["a"], *rows["b"]})
        at = {x: i for i, x in enumerate(names)}
        over = rows[rows["r"].abs() > threshold]
        group = merged_groups(names, [(at[a], at[b]) for a, b in zip(over["a"], over["b"], strict=True)]) if names else []
        own = {c: [rows[c].iloc[0]] * len(names) for c in keys}
        return pd.DataFrame(own | {"node": names, "community": [names[g] for g in group]})

    fields = "".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}, " for c in keys)
    return pairs.select(*keys, "a", "b", "r").groupBy(*keys).applyInPandas(merge, fields + "node STRING, community STRING")


def network_summary(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """n_nodes, n_edges, density (edges of all that there could be), n_communities, modularity, and the leader: the node of most edges, the first by name."""
    nodes, both = edges_of(pairs, threshold)
    both = stored(both)
    groups = stored(communities(pairs, threshold))
    of = groups.select(F.col("node").alias("a"), F.col("community").alias("ca")), groups.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    degree = nodes.join(both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree")), "node", "left").na.fill(0, ["degree"])
    first = degree.agg(F.count(F.lit(1)).alias("n_nodes"), F.min_by("node", F.struct(-F.col("degree"), "node")).alias("leader"), (F.sum("degree") / 2).cast("bigint").alias("n_edges"))
    inside = both.join(of[0], "a").join(of[1], "b").agg(F.count_if(F.col("ca") == F.col("cb")).alias("_inside"))
    square = degree.join(groups, "node").groupBy("community").agg(F.sum("degree").alias("d")).agg(F.count(F.lit(1)).alias("n_communities"), F.sum(F.col("d") * F.col("d")).alias("_square"))
    one = first.join(inside).join(square)  # a row each
    twice = 2 * F.col("n_edges")
    modularity = F.coalesce(F.try_divide(F.col("_inside"), twice) - F.try_divide(F.col("_square"), twice * twice), F.lit(0.0))
    return one.select("n_nodes", "n_edges", F.coalesce(F.try_divide(twice, F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0)).alias("density"), "n_communities", modularity.alias("modularity"), "leader")
