"""Models that are fitted by sums over all rows: a kernel machine over random Fourier features, and a multilayer perceptron with early stopping.

A step sends the weights to the tasks; each task adds up what its rows give to one vector of fixed size, vectors are added in parts, and the driver gets MERGED of them at most, whatever the number of rows. Draws (features of the kernel, first weights, batches, dropout) come from seeds and hashes of a row's key, so that a lost task gives the same again. Rows without one of the features or the label take no part in fitting."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.sources.bars import stored

#: Vectors that reach the driver in a step.
MERGED = 8


def summed(rows: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of work(batch), vectors of `size` numbers, over all batches."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    parts = rows.mapInArrow(partial, "v BINARY").withColumn("p", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    out = np.zeros(size)
    for r in parts.repartition(MERGED, "p").mapInArrow(added, "v BINARY").collect():  # MERGED vectors
        out += np.frombuffer(r["v"])
    return out


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)


def scaling(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations; 1 for a constant."""
    one = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    mean = np.array([one[f"m{i}"] or 0.0 for i in range(len(features))])
    sd = np.array([one[f"s{i}"] or 1.0 for i in range(len(features))])
    return mean, sd


def whole(df: DataFrame, features: list[str], y: str, key: tuple[str, ...] = ()) -> DataFrame:
    picked = [F.col(c).cast("double").alias(c) for c in features] + [F.col(y).cast("double").alias("_y")]
    return df.select(*picked, *([F.xxhash64(*key).alias("_key")] if key else [])).na.drop("any")


# ---- kernel machine


@dataclass
class KernelMachine:
    """Signs by a support vector machine with the kernel exp(-gamma |a - b|^2) over scaled features, in random Fourier features."""

    features: list[str]
    mean: np.ndarray
    sd: np.ndarray
    directions: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    losses: list[float]

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.cos((x - self.mean) / self.sd @ self.directions + self.shifts) * np.sqrt(2 / len(self.shifts))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)


#: Widths of the parabola that rounds the corner of the hinge, one after the other.
ROUNDED = (1.0, 0.3, 0.1)


def kernel_machine(df: DataFrame, features: list[str], y: str, c: float = 1.0, gamma: float | None = None, size: int = 512, seed: int = 42, steps: int = 12) -> KernelMachine:
    """Of y above 0 against the rest. c is the weight of a row's hinge loss, as of a machine in its usual form; gamma is one over the number of features unless given. `size` random features stand for the kernel: Newton steps on the hinge with a rounded corner, halved until the loss falls, each one sum over the rows of size * size numbers.

    One class alone gives its sign everywhere; without rows all scores are 0."""
    rows = stored(whole(df, features, y))
    mean, sd = scaling(rows, features)
    g = np.random.default_rng(seed)
    gamma = gamma if gamma is not None else 1 / len(features)
    m = KernelMachine(features, mean, sd, g.normal(size=(len(features), size)) * np.sqrt(2 * gamma), g.uniform(0, 2 * np.pi, size), np.zeros(size + 1), [])
    d = size + 1

    def evaluated(w: np.ndarray, h: float) -> tuple[float, np.ndarray, np.ndarray]:
        def work(batch: pa.RecordBatch) -> np.ndarray:
            z = m.mapped(matrix(batch, features)) * np.where(batch.column("_y").to_numpy() > 0, 1.0, -1.0)[:, None]
            t = 1 - z @ w
            inside, beyond = (t > 0) & (t < h), t >= h
            loss = (t[inside] ** 2).sum() / (2 * h) + (t[beyond] - h / 2).sum()
            slope = np.where(inside, t / h, beyond)
            return np.concatenate([[loss], slope @ z, (z[inside].T @ z[inside] / h).ravel()])

        out = summed(rows, work, 1 + d + d * d)
        return w @ w / 2 + c * out[0], w - c * out[1 : 1 + d], np.eye(d) + c * out[1 + d :].reshape(d, d)

    w = m.weights
    for h in ROUNDED:
        loss, slope, curve = evaluated(w, h)
        for _ in range(steps):
            move = np.linalg.solve(curve, slope)
            share = 1.0
            while True:
                new = evaluated(w - share * move, h)
                if new[0] <= loss or share < 1e-3:
                    break
                share /= 2
            gained = loss - new[0]
            if gained > 0:
                w, (loss, slope, curve) = w - share * move, new
                m.losses.append(loss)
            if gained <= 1e-6 * max(abs(loss), 1.0):
                break
    m.weights = w
    return m


def kernel_scores(m: KernelMachine, df: DataFrame, out: str = "score") -> DataFrame:
    """df with the machine's score; its sign is the class. NULL without one of the features."""
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = m.mapped(matrix(batch, m.features)) @ m.weights if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, mask=np.isnan(score))], names=[*names, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` DOUBLE")


# ---- multilayer perceptron


@dataclass(frozen=True)
class Training:
    hidden: tuple[int, ...] = (128, 64, 32)
    dropout: float = 0.3
    rate: float = 0.001
    epochs: int = 100
    batches: int = 8
    patience: int = 10
    slower_after: int = 5
    least_rate: float = 1e-7
    seed: int = 42


@dataclass
class Perceptron:
    """Weights and biases layer by layer; losses: epoch, of training (mean over its batches, with dropout) and of validation, and the rate."""

    features: list[str]
    mean: np.ndarray
    sd: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    losses: list[tuple[int, float, float, float]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        a = (x - self.mean) / self.sd
        for i, (w, b) in enumerate(self.layers):
            a = a @ w + b
            if i + 1 < len(self.layers):
                a = np.maximum(a, 0)
        return a[:, 0]


def draws(key: np.ndarray, seed: int) -> np.ndarray:
    """Numbers from 0 to 1, a hash of each key and the seed (the finaliser of SplitMix64)."""
    x = key.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def kept_units(key: np.ndarray, units: int, step: int, layer: int, t: Training) -> np.ndarray:
    """What dropout multiplies each row's units by in a step: 0, or more than 1 for those that stay."""
    each = key[:, None].view(np.uint64) ^ (np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None]
    return (draws(each.view(np.int64), t.seed + 7919 * step + layer) >= t.dropout) / (1 - t.dropout)


def batch_of(key: np.ndarray, epoch: int, t: Training) -> np.ndarray:
    return np.minimum((draws(key, t.seed + 104_729 * (epoch + 1)) * t.batches).astype(np.int64), t.batches - 1)


def first_layers(k: int, t: Training) -> list[tuple[np.ndarray, np.ndarray]]:
    g = np.random.default_rng(t.seed)
    sizes = [k, *t.hidden, 1]
    return [(g.normal(size=(a, b)) * np.sqrt(2 / a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def slopes(layers: list, x: np.ndarray, y: np.ndarray, masks: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """Sum of squared errors of rows, and its derivative by every weight and bias."""
    inputs, a = [], x
    for i, (w, b) in enumerate(layers):
        inputs.append(a)
        a = a @ w + b
        if i + 1 < len(layers):
            a = np.maximum(a, 0) * masks[i]
    off = a[:, 0] - y
    back, out = 2 * off[:, None], []
    for i in range(len(layers) - 1, -1, -1):
        out += [back.sum(axis=0), inputs[i].T @ back]
        if i:
            back = back @ layers[i][0].T * (inputs[i] > 0) * masks[i - 1]
    return float(off @ off), out[::-1]


def perceptron(train: DataFrame, validation: DataFrame, features: list[str], y: str, key: tuple[str, ...] = ("series", "ts"), training: Training | None = None) -> Perceptron:
    """Fitted to train by Adam on mean squared errors of batches, `batches` of them an epoch, each a sum over rows; the weights of the epoch with the least error on validation (a later part of time) stay. The rate is halved after `slower_after` epochs without a better one, and `patience` of them end the training."""
    t = training or Training()
    rows, later = stored(whole(train, features, y, key)), stored(whole(validation, features, y, key))
    mean, sd = scaling(rows, features)
    m = Perceptron(features, mean, sd, first_layers(len(features), t), [])
    shapes = [p.shape for layer in m.layers for p in layer]
    size = sum(int(np.prod(s)) for s in shapes)
    one, two, step, rate = np.zeros(size), np.zeros(size), 0, t.rate
    best, best_layers, waited, slow = np.inf, m.layers, 0, 0

    def unpacked(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        cut = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        p = [x.reshape(s) for x, s in zip(np.split(v, cut), shapes, strict=True)]
        return list(zip(p[::2], p[1::2], strict=True))

    def held(layers: list) -> float:
        now = Perceptron(features, mean, sd, layers, [])

        def work(batch: pa.RecordBatch) -> np.ndarray:
            off = now.predict(matrix(batch, features)) - batch.column("_y").to_numpy()
            return np.array([off @ off, len(off)])

        error, n = summed(later, work, 2)
        return error / n if n else np.nan

    for epoch in range(t.epochs):
        total = n_all = 0.0
        for number in range(t.batches):
            layers, at = m.layers, step

            def work(batch: pa.RecordBatch) -> np.ndarray:
                ids = batch.column("_key").to_numpy()
                on = batch_of(ids, epoch, t) == number  # noqa: B023
                x, ys, ids = (matrix(batch, features)[on] - mean) / sd, batch.column("_y").to_numpy()[on], ids[on]
                masks = [kept_units(ids, w.shape[1], at, i, t) for i, (w, _) in enumerate(layers[:-1])]  # noqa: B023
                loss, by = slopes(layers, x, ys, masks)  # noqa: B023
                return np.concatenate([[loss, len(x)], *(v.ravel() for v in by)])

            out = summed(rows, work, 2 + size)
            if not out[1]:
                continue
            step += 1
            slope = out[2:] / out[1]
            one, two = 0.9 * one + 0.1 * slope, 0.999 * two + 0.001 * slope * slope
            w = np.concatenate([p.ravel() for layer in m.layers for p in layer])
            m.layers = unpacked(w - rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-7))
            total, n_all = total + out[0], n_all + out[1]
        error = held(m.layers)
        m.losses.append((epoch, float(total / n_all) if n_all else np.nan, float(error), rate))
        if error < best:
            best, best_layers, waited, slow = error, m.layers, 0, 0
            continue
        waited, slow = waited + 1, slow + 1
        if slow >= t.slower_after:
            rate, slow = max(rate / 2, t.least_rate), 0
        if waited >= t.patience:
            break
    m.layers = best_layers
    return m


def perceptron_predictions(m: Perceptron, df: DataFrame, out: str = "prediction") -> DataFrame:
    """df with predictions; NULL without one of the features."""
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = m.predict(matrix(batch, m.features)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, mask=np.isnan(p))], names=[*names, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` DOUBLE")
