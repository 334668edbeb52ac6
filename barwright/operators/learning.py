"""Linear, tree, component and cluster models over feature tables, by MLlib; and the validation that refits them forward in time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.operators.comoments import comoments, whole


def assembled(df: DataFrame, features: list[str], y: str | None = None) -> DataFrame:
    """Rows without gaps, with the vector x (and label)."""
    rows = df.na.drop("any", subset=[*features, *([y] if y else [])])
    out = VectorAssembler(inputCols=features, outputCol="x").transform(rows)
    return out.withColumn("label", F.col(y).cast("double")) if y else out


def scaled(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """x standardised by the first table's means and deviations."""
    model = StandardScaler(inputCol="x", outputCol="_scaled", withMean=True).fit(train)
    return [model.transform(d).drop("x").withColumnRenamed("_scaled", "x") for d in (train, *others)]


def linear(train: DataFrame, test: DataFrame, kind: str = "ols", alpha: float = 1.0):
    """Model and test metrics (r2, mse, mae). Ridge takes alpha a table, lasso alpha a row."""
    n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    # MLlib divides what it is given by the label's deviation, which a squared penalty must not be
    params = {"ols": (0.0, 0.0), "ridge": (0.0, alpha / max(n, 1) * (sd or 1.0)), "lasso": (1.0, alpha)}[kind]
    model = LinearRegression(featuresCol="x", labelCol="label", elasticNetParam=params[0], regParam=params[1], standardization=False, solver="normal" if kind != "lasso" else "auto", maxIter=1_000, tol=1e-12).fit(train)
    e = model.evaluate(test)
    return model, {"r2": e.r2, "mse": e.meanSquaredError, "mae": e.meanAbsoluteError}


def coefficients(spark: SparkSession, model, features: list[str]) -> DataFrame:
    rows = [(f, float(c)) for f, c in zip(features, model.coefficients, strict=True)]
    return spark.createDataFrame(rows, "feature STRING, coef DOUBLE").withColumn("abs_coef", F.abs("coef")).withColumn("non_zero", F.col("abs_coef") > 1e-10)


def principal_components(df: DataFrame, k: int):
    """PCA model of a standardised x, with component, explained, cumulative."""
    model = PCA(k=k, inputCol="x", outputCol="pc").fit(df)
    total, rows = 0.0, []
    for i, v in enumerate(model.explainedVariance.toArray().tolist(), 1):
        total += v
        rows.append((i, v, total))
    return model, df.sparkSession.createDataFrame(rows, "component INT, explained DOUBLE, cumulative DOUBLE")


def components_for(components: DataFrame, shares: tuple[float, ...] = (0.80, 0.90, 0.95)) -> DataFrame:
    """share, n: how many of the first components (component, cumulative) explain at least that share; NULL if all together don't."""
    want = F.explode(F.array(*(F.lit(s) for s in shares))).alias("share")
    return components.select("component", "cumulative", want).groupBy("share").agg(F.min(F.when(F.col("cumulative") >= F.col("share") - 1e-12, F.col("component"))).alias("n"))


TREES = {("forest", "regression"): RandomForestRegressor, ("forest", "classification"): RandomForestClassifier, ("boosting", "regression"): GBTRegressor, ("boosting", "classification"): GBTClassifier}


def trees(train: DataFrame, kind: str = "forest", task: str = "regression", size: int = 100, depth: int | None = None, seed: int = 42):
    options = {"featuresCol": "x", "labelCol": "label", "maxDepth": depth or (10 if kind == "forest" else 5), "seed": seed}
    options |= {"numTrees": size} if kind == "forest" else {"maxIter": size, "stepSize": 0.1}
    return TREES[kind, task](**options).fit(train)


def importances(spark: SparkSession, model, features: list[str]) -> DataFrame:
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)], "feature STRING, importance DOUBLE")


def permutation_importance(model, df: DataFrame, features: list[str], repeats: int = 10, seed: int = 42, block: int = 10_000, order: tuple[str, ...] = ("series", "ts")) -> DataFrame:
    """Mean rise of the squared error when one feature is dealt anew among the rows.

    Rows are put into blocks of about `block` by a hash of their place in `order`; within a block values go to the row whose hash comes next to their own in a second order, so every block is one task's work and a lost one is redone alike. All repeats of a feature are one job."""
    rows = df.select(*features, "label", F.xxhash64(*order).alias("_h"))
    blocks = max(1, rows.count() // block)
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(blocks)))
    error = F.avg((F.col("prediction") - F.col("label")) * (F.col("prediction") - F.col("label")))
    vector = VectorAssembler(inputCols=features, outputCol="x")
    base = model.transform(vector.transform(rows)).agg(error.alias("e")).first()["e"]
    found = None
    for f in features:
        many = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        mixed = many.withColumn("_k", F.xxhash64("_h", "_r", F.lit(seed)))
        part = Window.partitionBy("_r", "_b")
        numbered = mixed.withColumn("_i", F.row_number().over(part.orderBy("_h"))).withColumn("_j", F.row_number().over(part.orderBy("_k", "_h")))
        dealt = numbered.drop(f).join(numbered.select("_r", "_b", F.col("_j").alias("_i"), f), ["_r", "_b", "_i"])
        one = model.transform(vector.transform(dealt)).agg((error - base).alias("importance")).select(F.lit(f).alias("feature"), "importance")
        found = one if found is None else found.unionByName(one)
    return found


def linear_svm(train: DataFrame, reg: float = 1.0):
    """Sign of y by a linear support vector machine; MLlib has no kernels."""
    return LinearSVC(featuresCol="x", labelCol="label", regParam=reg).fit(train.withColumn("label", (F.col("label") > 0).cast("double")))


def linked(d: np.ndarray, clusters: int) -> np.ndarray:
    """Average linkage of a matrix of distances, cut into so many groups: chains of nearest neighbours end in pairs that are nearest to each other, which merge; the nearest mergers count, of equal ones those that come first."""
    n = len(d)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, dtype=bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        row = np.where(alive, d[chain[-1]], np.inf)
        near = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[near]:
            near = chain[-2]
        if len(chain) < 2 or near != chain[-2]:
            chain.append(near)
            continue
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((float(d[a, b]), a, b))
        both = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = both, both
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    group = np.arange(n)
    for _, a, b in sorted(merges)[: max(0, n - max(1, clusters))]:
        group[group == group[b]] = group[a]
    return group


def centred(g: np.ndarray, clusters: int, rounds: int = 300) -> np.ndarray:
    """K-means of vectors of which only the inner products are known. The first seed is the vector farthest from the mean of all, each next one the farthest from its nearest seed; equal distances go to the first."""
    square = g.diagonal()
    seeds = [int(np.argmax(square - 2 * g.mean(axis=1)))]
    while len(seeds) < min(clusters, len(g)):
        seeds.append(int(np.argmax((square[:, None] + square[seeds][None, :] - 2 * g[:, seeds]).min(axis=1))))
    group = np.argmin(square[:, None] + square[seeds][None, :] - 2 * g[:, seeds], axis=1)
    for _ in range(rounds):
        names = np.unique(group)
        apart = np.stack([square - 2 * g[:, group == c].mean(axis=1) + g[np.ix_(group == c, group == c)].mean() for c in names], axis=1)
        new = names[np.argmin(apart, axis=1)]
        if (new == group).all():
            break
        group = new
    return group


def feature_clusters(df: DataFrame, features: list[str], clusters: int = 20, method: str = "average", keys: list[str] | None = None) -> DataFrame:
    """keys, feature, cluster (from 1, by the least feature in the list's order), is_representative (the largest variance, of equal ones the last name) over complete rows.

    average: average linkage on 1 - |r|; kmeans: k-means of the features as vectors of their values. Both need the inner products of features alone, which one pass over the rows gives by blocks; grouping them is one task for each key. A constant feature has r 0 with all."""
    if method not in ("average", "kmeans"):
        raise ValueError(f"no such method: {method}")
    keys = keys or []

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        m = whole(rows.to_dict("records"), len(features))
        spread = m.product.diagonal() / m.n
        if method == "average":
            sd = np.sqrt(m.product.diagonal())
            r = np.divide(m.product, np.outer(sd, sd), out=np.zeros_like(m.product), where=np.outer(sd, sd) > 0)
            found = linked(1 - np.abs(r), clusters)
        else:
            found = centred(m.product + m.n * np.outer(m.mean, m.mean), clusters)
        order = {g: i for i, g in enumerate(dict.fromkeys(found.tolist()), 1)}
        best = {g: max((i for i in range(len(features)) if found[i] == g), key=lambda i: (spread[i], features[i])) for g in order}
        own = {c: [rows[c].iloc[0]] * len(features) for c in keys}
        return pd.DataFrame(own | {"feature": features, "cluster": [order[g] for g in found.tolist()], "is_representative": [best[g] == i for i, g in enumerate(found.tolist())], "variance": spread})

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)
    return comoments(df, features, keys).groupBy(*keys).applyInPandas(group, fields + "feature STRING, cluster INT, is_representative BOOLEAN, variance DOUBLE")
