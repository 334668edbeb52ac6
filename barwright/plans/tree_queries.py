"""Queries of boosted trees over the features of bars, with their SQL: each level of each tree is a few CTEs. The kernel machine and the perceptron have none; tests hold them to second computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators import align, boosting, gradient
from barwright.plans.analysis_queries import NAMES, wide
from barwright.plans.bar_queries import Query, r9, s9
from barwright.plans.model_queries import TRAIN

SETTINGS = boosting.Settings(trees=2, rate=0.3, depth=2, bins=8)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.ratio_split(wide(spark, sf_dir).na.drop("any", subset=[*NAMES, "target"])).where("is_train")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = train(spark, sf_dir)
    out = boosting.predicted(boosting.fit(df, NAMES, "target", SETTINGS), df.select("series", "ts", *NAMES))
    return out.select("series", F.col("ts").cast("timestamp_ntz").alias("ts"), r9("prediction").alias("prediction"))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = train(spark, sf_dir)
    return boosting.importances(boosting.fit(df, NAMES, "target", SETTINGS), df).select("feature", r9("importance").alias("importance"), F.col("splits").cast("bigint").alias("splits"))


def boosted_sql(s: boosting.Settings = SETTINGS) -> str:
    """CTEs up to m<trees> (id, series, ts, y, m: the margin) and s<tree>_<level>, the splits (node, f, cut, gain)."""
    shares = ", ".join(f"{i / s.bins!r}" for i in range(1, s.bins))
    cuts = ", ".join(f"list_sort(list_distinct(quantile_disc({f}, [{shares}]))) AS c{i}" for i, f in enumerate(NAMES))
    bins = ", ".join(f"CAST(len(list_filter(c{i}, lambda c: c < {f})) AS BIGINT) AS b{i}" for i, f in enumerate(NAMES))
    out = [f"cu AS (SELECT {cuts}, avg(target) AS base FROM tn)", f"m0 AS MATERIALIZED (SELECT row_number() OVER () AS id, series, ts, target AS y, base AS m, {bins} FROM tn, cu)"]
    for t in range(1, s.trees + 1):
        out.append(f"n{t}_0 AS MATERIALIZED (SELECT *, m - y AS g, 0 AS node FROM m{t - 1})")
        for d in range(s.depth):
            at = f"n{t}_{d}"
            long = " UNION ALL ".join(f"SELECT node, {i} AS f, b{i} AS b, g FROM {at}" for i in range(len(NAMES)))
            out.append(f"""s{t}_{d} AS MATERIALIZED (SELECT node, f, b AS cut, gain FROM (
SELECT node, f, b, gl, hl, gt, ht, (gl * gl / (hl + {s.l2}) + (gt - gl) * (gt - gl) / (ht - hl + {s.l2}) - gt * gt / (ht + {s.l2})) / 2 AS gain FROM (
SELECT node, f, b, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER v AS gt, sum(h) OVER v AS ht FROM (SELECT node, f, b, sum(g) AS g, CAST(count(*) AS DOUBLE) AS h FROM ({long}) GROUP BY ALL) WINDOW w AS (PARTITION BY node, f ORDER BY b), v AS (PARTITION BY node, f))
WHERE hl >= 1 AND ht - hl >= 1) WHERE gain > 0 AND node >= {2**d - 1} QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, f, b) = 1)""")
            which = " ".join(f"WHEN {i} THEN b{i}" for i in range(len(NAMES)))
            out.append(f"n{t}_{d + 1} AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN f IS NULL THEN x.node WHEN CASE f {which} END <= cut THEN 2 * x.node + 1 ELSE 2 * x.node + 2 END AS node) FROM {at} x LEFT JOIN s{t}_{d} USING (node))")
        out.append(f"m{t} AS MATERIALIZED (SELECT id, series, ts, y, m - {s.rate} * sum(g) OVER (PARTITION BY node) / (count(*) OVER (PARTITION BY node) + {s.l2}) AS m, {', '.join(f'b{i}' for i in range(len(NAMES)))} FROM n{t}_{s.depth})")
    return ", ".join(out)


_BOOSTED = f"WITH {TRAIN}, {boosted_sql()}"
PREDICTIONS = f"{_BOOSTED} SELECT series, ts, {s9('m')} AS prediction FROM m{SETTINGS.trees}"
_NAMED = "CASE f " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(NAMES)) + " END"
IMPORTANCE = f"""{_BOOSTED}, sp0 AS ({" UNION ALL ".join(f"SELECT f, gain FROM s{t}_{d}" for t in range(1, SETTINGS.trees + 1) for d in range(SETTINGS.depth))}), q AS (SELECT {_NAMED} AS feature, sum(gain) AS gain, count(*) AS n FROM sp0 GROUP BY 1)
SELECT feature, {s9("coalesce(gain, 0) / (SELECT sum(gain) FROM sp0)")} AS importance, coalesce(n, 0) AS splits FROM (VALUES {", ".join(f"('{f}')" for f in NAMES)}) t(feature) LEFT JOIN q USING (feature)"""


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next bar's direction in the later fifth of each series, by a kernel machine of the bars before."""
    df = align.ratio_split(wide(spark, sf_dir).na.drop("any", subset=[*NAMES, "target"]))
    m = gradient.kernel_machine(df.where("is_train"), NAMES, "target", size=128, steps=6)
    out = gradient.kernel_scores(m, df.where("NOT is_train").select("series", "ts", *NAMES, "target"))
    return out.select("series", "ts", F.signum("target").cast("int").alias("direction"), F.signum("score").cast("int").alias("predicted"))


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of a perceptron by epoch: three fifths of each series to learn from, one to stop by."""
    rows = wide(spark, sf_dir).na.drop("any", subset=[*NAMES, "target"])
    df = align.ratio_split(align.ratio_split(rows).where("is_train").drop("is_train"), 0.25)
    m = gradient.perceptron(df.where("is_train"), df.where("NOT is_train"), NAMES, "target", training=gradient.Training(hidden=(16, 8), epochs=4, batches=2, rate=0.01))
    return spark.createDataFrame(m.losses, "epoch INT, loss DOUBLE, validation_loss DOUBLE, rate DOUBLE")


QUERIES: dict[str, Query] = {
    "kernel_machine": (signs, None),
    "perceptron_curve": (curve, None),
    "hist_boosting": (predictions, PREDICTIONS),
    "hist_boosting_importance": (importance, IMPORTANCE),
}
