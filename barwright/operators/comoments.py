"""Counts, means and co-moments of many columns at once, as blocks of a matrix that add up.

A task turns its batches into one matrix for each key by shifted sums and merges matrices pairwise (the update that keeps a small variance beside a large mean, and a constant column at exactly 0). Matrices leave a task cut into blocks of WIDTH columns squared, and blocks of equal place are merged, first within salts, then across them. So the work for 762 columns is one pass over the rows, with 21 blocks a key to merge, whatever the number of pairs.

Rows with a null or NaN in any of the columns take no part. A key without such rows has no blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns on a side of a block.
WIDTH = 128
#: Bytes of matrices that a task holds before it sends them on.
HELD = 64 << 20
#: Parts in which blocks of one place are merged first.
SALTS = 16


class Moments:
    """n, means and co-moments of rows; + merges two of disjoint rows."""

    __slots__ = ("mean", "n", "product")

    def __init__(self, n: int, mean: np.ndarray, product: np.ndarray) -> None:
        self.n, self.mean, self.product = n, mean, product

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        first = x[0]
        rest = x - first
        mean = rest.mean(axis=0)
        rest -= mean
        return Moments(len(x), first + mean, rest.T @ rest)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.product + other.product + np.outer(apart, apart) * (self.n * other.n / n))

    def __sub__(self, other: Moments) -> Moments:
        """The rest of the rows, if other's are some of them (and not all)."""
        n = self.n - other.n
        mean = self.mean + (self.mean - other.mean) * (other.n / n)
        apart = other.mean - mean
        return Moments(n, mean, self.product - other.product - np.outer(apart, apart) * (n * other.n / self.n))


def _fields(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


BLOCK = "i INT, j INT, n BIGINT, mean_i ARRAY<DOUBLE>, mean_j ARRAY<DOUBLE>, square_i ARRAY<DOUBLE>, square_j ARRAY<DOUBLE>, product ARRAY<DOUBLE>"


def _partial(columns: list[str], keys: list[str]):
    k = len(columns)

    def blocks(held: dict[tuple, Moments], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for key, m in held.items():
            square = m.product.diagonal()
            for i in range(0, k, WIDTH):
                for j in range(i, k, WIDTH):
                    a, b = slice(i, i + WIDTH), slice(j, j + WIDTH)
                    arrays = [m.mean[a], m.mean[b], square[a], square[b], m.product[a, b].ravel()]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(key, types, strict=True)), pa.array([i // WIDTH], pa.int32()), pa.array([j // WIDTH], pa.int32()), pa.array([m.n], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in arrays)], names=[*keys, "i", "j", "n", "mean_i", "mean_j", "square_i", "square_j", "product"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(x).type for x in keys]
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1) if batch.num_rows else np.zeros((0, k))
            whole = ~np.isnan(x).any(axis=1)
            if not whole.any():
                continue
            x = x[whole]
            if keys:
                rows = batch.select(keys).filter(pa.array(whole)).to_pylist()
                at: dict[tuple, list[int]] = {}
                for i, r in enumerate(rows):
                    at.setdefault(tuple(r.values()), []).append(i)
                parts = [(key, x[i]) for key, i in at.items()]
            else:
                parts = [((), x)]
            for key, part in parts:
                m = Moments.of(part)
                held[key] = held[key] + m if key in held else m
            if len(held) * (k * k + k) * 8 > HELD:
                yield from blocks(held, types)
                held = {}
        yield from blocks(held, types)

    return run


def _merged(keys: list[str]):
    names = [*keys, "i", "j"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, types = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(at, types, strict=True)), pa.array([sums[0]], pa.int64()), *(pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in sums[1:])], names=[*names, "n", "mean_i", "mean_j", "square_i", "square_j", "product"])

        for batch in batches:
            types = [batch.schema.field(x).type for x in names]
            for r in batch.to_pylist():
                key = tuple(r[x] for x in names)
                n, a, b, s, t = r["n"], *(np.array(r[x]) for x in ("mean_i", "mean_j", "square_i", "square_j"))
                p = np.array(r["product"]).reshape(len(a), len(b))
                if key != at:
                    if at is not None:
                        yield out()
                    at, sums = key, (n, a, b, s, t, p)
                    continue
                m, a0, b0, s0, t0, p0 = sums
                da, db, w = a - a0, b - b0, m * n / (m + n)
                sums = (m + n, a0 + da * (n / (m + n)), b0 + db * (n / (m + n)), s0 + s + da * da * w, t0 + t + db * db * w, p0 + p + np.outer(da, db) * w)
        if at is not None:
            yield out()

    return run


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (keys and those of BLOCK) of one place and key made one, first within salts, so that a key of any number of parts is many tasks' work."""
    names, own = [*keys, "i", "j"], [x.split()[0] for x in BLOCK.split(", ")]
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).select(*keys, "_salt", *own)
    once = salted.repartition(*names, "_salt").sortWithinPartitions(*names, "_salt").mapInArrow(_merged([*keys, "_salt"]), _fields(parts, keys) + "_salt INT, " + BLOCK)
    return once.drop("_salt").repartition(*names).sortWithinPartitions(*names).mapInArrow(_merged(keys), _fields(parts, keys) + BLOCK)


def comoments(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rows of keys, i, j (numbers of blocks, i not after j), n, and of these columns the means, squares (sums of squared deviations) and product (sums of products of deviations, row by row)."""
    keys = keys or []
    picked = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns))
    return merged(picked.mapInArrow(_partial(columns, keys), _fields(df, keys) + BLOCK), keys)


def entries(blocks: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, a, b, n, mean_a, mean_b, square_a, square_b, product for each pair of columns, a not after b in their order."""
    keys = keys or []
    names = F.array(*(F.lit(c) for c in columns))
    whole = F.transform("product", lambda p, at: F.struct(F.floor(at / F.size("mean_j")).cast("int").alias("u"), (at % F.size("mean_j")).alias("v"), p.alias("p")))
    flat = blocks.select(*keys, "i", "j", "n", "mean_i", "mean_j", "square_i", "square_j", F.explode(whole).alias("e"))
    u, v = F.col("e.u"), F.col("e.v")
    flat = flat.where((F.col("i") < F.col("j")) | (u <= v))
    return flat.select(*keys, F.get(names, F.col("i") * WIDTH + u).alias("a"), F.get(names, F.col("j") * WIDTH + v).alias("b"), "n", F.get("mean_i", u).alias("mean_a"), F.get("mean_j", v).alias("mean_b"), F.get("square_i", u).alias("square_a"), F.get("square_j", v).alias("square_b"), F.col("e.p").alias("product"))


def correlations(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, a, b, n, covariance (of the sample), r for each pair of different columns, over rows that have all of them. r is NULL where a side is constant."""
    keys = keys or []
    e = entries(comoments(df, columns, keys), columns, keys).where(F.col("a") != F.col("b"))
    return e.select(*keys, "a", "b", "n", F.try_divide("product", F.col("n") - 1).alias("covariance"), F.try_divide("product", F.sqrt("square_a") * F.sqrt("square_b")).alias("r"))


def whole(rows: list[dict], k: int) -> Moments:
    """The matrix of k columns of all blocks of one key, as dictionaries: for tasks that solve systems."""
    m = Moments(0, np.zeros(k), np.zeros((k, k)))
    for r in rows:
        a, b = (slice(r[x] * WIDTH, r[x] * WIDTH + len(r[f"mean_{x}"])) for x in ("i", "j"))
        p = np.array(r["product"]).reshape(len(r["mean_i"]), len(r["mean_j"]))
        m.n, m.mean[a], m.mean[b], m.product[a, b], m.product[b, a] = r["n"], r["mean_i"], r["mean_j"], p, p.T
    return m
