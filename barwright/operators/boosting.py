"""Boosted trees of second order over histograms, level by level or leaf by leaf.

Values become numbers of quantile bins once, a byte or two each. For a split, tasks add up gradients and hessians by node, feature and bin, and what they send is as small as that; of two siblings only the smaller one is added up, the other is the parent less it. The best split of a node is found where the sums meet, and the driver gets one row for each node. Trees so far are applied in the tasks; every few trees the rows are stored with their margins, so that a lost executor redoes little. The model is arrays of a few hundred numbers a tree.

Rows without a feature or label take no part in fitting; in prediction such a value goes left. Of equal gains the first feature in the list and the lowest bin count. A feature of one value is never split. Without rows the model has no trees and predicts 0."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.sources.bars import stored


@dataclass(frozen=True)
class Settings:
    """growth: depth (all leaves of a level that gain, to `depth`) or leaf (the leaf that gains most, to `leaves`)."""

    trees: int = 100
    rate: float = 0.1
    growth: str = "depth"
    depth: int = 5
    leaves: int = 31
    l2: float = 1.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    least_rows: int = 1
    bins: int = 256
    task: str = "regression"
    store_every: int = 20

    def __post_init__(self) -> None:
        if self.growth not in ("depth", "leaf") or self.task not in ("regression", "classification"):
            raise ValueError("growth is depth or leaf, task is regression or classification")
        if not 2 <= self.bins <= 65_536:
            raise ValueError("there are 2 to 65536 bins")


@dataclass
class Tree:
    """Nodes by number: feature -1 is a leaf; a row goes left if its bin is cut or less."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        for x, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            x += [v, v]
        n = len(self.feature)
        self.feature[node], self.cut[node], self.gain[node], self.left[node], self.right[node] = feature, cut, gain, n - 2, n - 1
        return n - 2, n - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])


@dataclass
class Model:
    features: list[str]
    cuts: list[np.ndarray]
    base: float
    settings: Settings
    trees: list[Tree] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        kind = np.uint8 if self.settings.bins <= 256 else np.uint16
        return np.stack([np.where(np.isnan(v), 0, np.searchsorted(c, v)).astype(kind) for v, c in zip(columns, self.cuts, strict=True)], axis=1)

    def margin(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees[first:]:
            out += np.array(tree.value)[tree.leaf_of(x)]
        return out

    def importance(self) -> list[tuple[str, float, int]]:
        """feature, share of all gain, number of splits."""
        gain, n = np.zeros(len(self.features)), np.zeros(len(self.features), dtype=int)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    gain[f] += g
                    n[f] += 1
        total = gain.sum()
        return [(f, float(g / total) if total > 0 else 0.0, int(k)) for f, g, k in zip(self.features, gain, n, strict=True)]


def gradients(y: np.ndarray, margin: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray]:
    if task == "regression":
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p)


SUMS = "node INT, feature INT, g ARRAY<DOUBLE>, h ARRAY<DOUBLE>, n ARRAY<DOUBLE>"


def sums_of(model: Model, tree: Tree, nodes: list[int], first: int):
    """Sums by node, feature and bin of a task's rows (b, y, margin), for the given leaves of a tree that is being made; margins hold the first `first` trees."""
    k, bins, task = len(model.features), model.settings.bins, model.settings.task
    number = {node: i for i, node in enumerate(nodes)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(nodes), k, bins, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, margin = rows_of(batch, k, bins)
            leaf = tree.leaf_of(x)
            take = np.array([number.get(i, -1) for i in range(len(tree.feature))])[leaf]
            on = take >= 0
            if not on.any():
                continue
            x, take = x[on], take[on]
            g, h = gradients(y[on], margin[on] + model.margin(x, first), task)
            for f in range(k):
                place = take * bins + x[:, f]
                for i, w in enumerate((g, h, None)):
                    total[:, f, :, i] += np.bincount(place, w, len(nodes) * bins).reshape(len(nodes), bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, k), pa.int32()), pa.array(np.tile(np.arange(k), len(nodes)), pa.int32()), *(pa.array(total[..., i].reshape(-1, bins).tolist(), pa.list_(pa.float64())) for i in range(3))], names=["node", "feature", "g", "h", "n"])

    return run


def rows_of(batch: pa.RecordBatch, k: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = b"".join(batch.column("b").to_pylist())
    x = np.frombuffer(raw, dtype=np.uint8 if bins <= 256 else np.uint16).reshape(-1, k).astype(np.int64)
    return x, batch.column("y").to_numpy(), batch.column("margin").to_numpy()


def added(parts: DataFrame) -> DataFrame:
    """Sums of one node and feature made one; what is added in a task comes in order, one part after another."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), *(pa.array([v.tolist()], pa.list_(pa.float64())) for v in total)], names=["node", "feature", "g", "h", "n"])

        for batch in batches:
            for r in batch.to_pylist():
                key, value = (r["node"], r["feature"]), [np.array(r[c]) for c in ("g", "h", "n")]
                if key == at:
                    total = [a + b for a, b in zip(total, value, strict=True)]
                else:
                    if at is not None:
                        yield out()
                    at, total = key, value
        if at is not None:
            yield out()

    return parts.repartition("node", "feature").sortWithinPartitions("node", "feature").mapInArrow(run, SUMS)


def best_splits(sums: DataFrame, s: Settings) -> list[dict]:
    """Of each node its best split, and its sums: a row for each node comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                g, h, n = (np.array(r[c]) for c in ("g", "h", "n"))
                gl, hl, nl = g.cumsum()[:-1], h.cumsum()[:-1], n.cumsum()[:-1]
                gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
                gain = (gl * gl / (hl + s.l2) + gr * gr / (hr + s.l2) - g.sum() ** 2 / (h.sum() + s.l2)) / 2
                may = (hl >= s.least_hessian) & (hr >= s.least_hessian) & (nl >= s.least_rows) & (nr >= s.least_rows) & (nl > 0) & (nr > 0)
                gain = np.where(may, gain, -np.inf)
                cut = int(gain.argmax()) if len(gain) else 0
                best = float(gain[cut]) if len(gain) and np.isfinite(gain[cut]) else None
                out.append({"node": r["node"], "feature": r["feature"], "cut": cut, "gain": best, "left": float(nl[cut]) if len(nl) else 0.0, "G": float(g.sum()), "H": float(h.sum()), "N": float(n.sum())})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=SPLIT)

    found = sums.mapInArrow(run, "node INT, feature INT, cut INT, gain DOUBLE, left DOUBLE, G DOUBLE, H DOUBLE, N DOUBLE")
    order = F.struct(F.coalesce("gain", F.lit(-math.inf)), -F.col("feature"))
    return [r["best"].asDict() for r in found.groupBy("node").agg(F.max_by(F.struct(*found.columns), order).alias("best")).collect()]


SPLIT = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()), ("left", pa.float64()), ("G", pa.float64()), ("H", pa.float64()), ("N", pa.float64())])


def grown(rows: DataFrame, model: Model, first: int) -> Tree | None:
    s, tree = model.settings, Tree()
    sums = stored(added(rows.mapInArrow(sums_of(model, tree, [0], first), SUMS)))
    known = {r["node"]: r for r in best_splits(sums, s)}
    if not known:
        return None
    depth, leaves = {0: 0}, 1
    while True:
        ready = [r for n, r in known.items() if tree.feature[n] < 0 and r["gain"] is not None and r["gain"] > s.least_gain and (s.growth == "leaf" or depth[n] < s.depth)]
        ready.sort(key=lambda r: (-r["gain"], r["node"]))
        if s.growth == "leaf":
            ready = ready[:1] if leaves < s.leaves else []
        if not ready:
            break
        small, large = [], {}
        for r in sorted(ready, key=lambda r: r["node"]):
            a, b = tree.split(r["node"], r["feature"], r["cut"], r["gain"])
            depth[a] = depth[b] = depth[r["node"]] + 1
            leaves += 1
            less, more = (a, b) if 2 * r["left"] <= r["N"] else (b, a)
            small.append(less)
            large[less] = (r["node"], more)
        done = s.growth == "depth" and min(depth[x] for x in small) >= s.depth
        own = added(rows.mapInArrow(sums_of(model, tree, small, first), SUMS))
        parent, sibling = (F.create_map(*(F.lit(v) for k, pair in large.items() for v in (k, pair[i])))[F.col("node")] for i in range(2))
        own = stored(own)
        rest = own.select("feature", parent.alias("_p"), sibling.alias("_s"), *(F.col(c).alias(f"_{c}") for c in "ghn")).join(sums.withColumnRenamed("node", "_p"), ["_p", "feature"])
        rest = rest.select(F.col("_s").alias("node"), "feature", *(F.zip_with(c, f"_{c}", lambda a, b: a - b).alias(c) for c in "ghn"))
        new = stored(own.unionByName(rest))
        known |= {r["node"]: r for r in best_splits(new, s)}
        sums = new if s.growth == "depth" else sums.union(new)
        if done:
            break
    for n, r in known.items():
        if tree.feature[n] < 0:
            tree.value[n] = -s.rate * r["G"] / (r["H"] + s.l2)
    return tree


def fit(df: DataFrame, features: list[str], y: str, settings: Settings | None = None) -> Model:
    """A model of y, a number or, for classification, 0 or 1."""
    s = settings or Settings()
    whole = df.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(y).cast("double").alias("_y")).na.drop("any")
    share = F.array(*(F.lit(i / s.bins) for i in range(1, s.bins)))
    one = whole.agg(F.avg("_y").alias("_mean"), *(F.array_sort(F.array_distinct(F.percentile_approx(c, share, F.lit(10_000)))).alias(c) for c in features)).first()  # quantiles by feature
    mean = one["_mean"]
    base = 0.0 if mean is None else mean if s.task == "regression" else math.log(min(max(mean, 1e-9), 1 - 1e-9) / (1 - min(max(mean, 1e-9), 1 - 1e-9)))
    model = Model(features, [np.array(one[c] or [], dtype=float) for c in features], base, s)
    if mean is None:
        return model

    def bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.binned([batch.column(c).to_numpy() for c in features]) if batch.num_rows else np.zeros((0, len(features)), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("_y"), pa.array(np.full(len(x), base))], names=["b", "y", "margin"])

    rows, first = stored(whole.mapInArrow(bins, "b BINARY, y DOUBLE, margin DOUBLE")), 0
    for t in range(s.trees):
        tree = grown(rows, model, first)
        if tree is None or len(tree.feature) == 1:
            break
        model.trees.append(tree)
        if (t + 1) % s.store_every == 0 and t + 1 < s.trees:
            rows, first = stored(rows.mapInArrow(moved(model, first), "b BINARY, y DOUBLE, margin DOUBLE")), t + 1
    return model


def moved(model: Model, first: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, _, margin = rows_of(batch, len(model.features), model.settings.bins)
                yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("y"), pa.array(margin + model.margin(x, first))], names=["b", "y", "margin"])

    return run


def predicted(model: Model, df: DataFrame, out: str = "prediction") -> DataFrame:
    """df with the model's value, or for classification the chance of 1."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.binned([batch.column(names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in model.features]) if batch.num_rows else np.zeros((0, len(model.features)), np.uint8)
            m = model.base + model.margin(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m if model.settings.task == "regression" else 1 / (1 + np.exp(-m)))], names=[*names, out])

    return df.mapInArrow(run, f"{schema}, `{out}` DOUBLE")


def importances(model: Model, df: DataFrame) -> DataFrame:
    """feature, importance (share of the gain of all splits), splits."""
    return df.sparkSession.createDataFrame(model.importance(), "feature STRING, importance DOUBLE, splits INT")
