"""Consensus of screening methods over features: rankings, votes, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("IC", "MI", "Lasso", "RF", "XGBoost")


def rankings(scores: DataFrame, top: int = 100) -> DataFrame:
    """method, feature, score, rank: each method's `top` largest scores, ties by name."""
    order = Window.partitionBy("method").orderBy(F.desc("score"), "feature")
    return scores.where(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def votes(ranked: DataFrame, n_methods: int) -> DataFrame:
    """feature, n_methods, methods, category: strong at 80 % of the methods (5 at least), medium at 3."""
    strong = max(5, int(0.8 * n_methods))
    n = F.col("n_methods")
    by_feature = ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("n_methods"), F.sort_array(F.collect_set("method")).alias("methods"))
    return by_feature.withColumn("category", F.when(n >= strong, "strong").when(n >= 3, "medium").otherwise("none"))


def checked(voted: DataFrame, available: tuple[str, ...] = METHODS) -> DataFrame:
    """Features of a category with checks_passed, checks_total and approved: enough votes, both tree methods, both dependence methods, and the linear one, as far as the methods are there."""
    has = lambda m: F.array_contains("methods", m)
    checks = [F.col("n_methods") >= F.when(F.col("category") == "strong", 5).otherwise(3)]
    if {"RF", "XGBoost"} <= set(available):
        checks.append(has("RF") & has("XGBoost"))
    if {"IC", "MI"} <= set(available):
        checks.append(has("IC") & has("MI"))
    if "Lasso" in available:
        checks.append(has("Lasso"))
    passed = sum((c.cast("int") for c in checks), F.lit(0))
    needed = F.when(F.col("category") == "strong", 0.75).otherwise(0.60)
    out = voted.where(F.col("category") != "none").withColumn("checks_passed", passed).withColumn("checks_total", F.lit(len(checks)))
    return out.withColumn("approved", F.col("checks_passed") / F.col("checks_total") >= needed)


def consensus_table(universe: DataFrame, ic: DataFrame, mi: DataFrame, lasso: DataFrame, rf: DataFrame, gb: DataFrame, least: float = 0.01, top: int = 50) -> DataFrame:
    """Every feature with its scores, which thresholds it passes, and the share of methods. One union and one aggregation instead of a join for each method."""
    parts = [s.select("feature", F.lit(m).alias("method"), F.col("score").cast("double").alias("score")) for m, s in (("ic", ic), ("mi", mi), ("lasso", lasso), ("rf", rf), ("gb", gb))]
    every = universe.select("feature", F.lit("none").alias("method"), F.lit(None).cast("double").alias("score"))
    for p in parts:
        every = every.unionByName(p)
    order = Window.partitionBy("method").orderBy(F.desc_nulls_last("score"))
    every = every.withColumn("rank", F.rank().over(order))
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = every.groupBy("feature").agg(*(pick(m, "score").alias(m) for m in ("ic", "mi", "lasso", "rf", "gb")), pick("rf", "rank").alias("rf_rank"), pick("gb", "rank").alias("gb_rank"), F.max((F.col("method") == "none").cast("int")).alias("_known"))
    passes = {"ic_pass": F.abs("ic") > least, "mi_pass": F.col("mi") > least, "lasso_pass": F.col("lasso") != 0, "rf_pass": F.col("rf_rank") <= top, "gb_pass": F.col("gb_rank") <= top}
    wide = wide.where(F.col("_known") == 1).drop("_known").withColumns({k: F.coalesce(v, F.lit(False)) for k, v in passes.items()})
    n = sum((F.col(k).cast("int") for k in passes), F.lit(0))
    share = F.col("n_pass") / len(passes) * 100
    return wide.withColumn("n_pass", n).withColumn("consensus_pct", share).withColumn("category", F.when(share >= 80, "very strong").when(share >= 60, "strong").when(share >= 40, "moderate").otherwise("weak"))


CATEGORIES = ("weak", "moderate", "strong", "very strong")


def at_least(table: DataFrame, category: str) -> DataFrame:
    levels = F.array(*(F.lit(c) for c in CATEGORIES))
    return table.where(F.array_position(levels, F.col("category")) > CATEGORIES.index(category))


def robust_selection(ic: DataFrame, mi: DataFrame, least_ic: float = 0.02, most_p: float = 0.001, most: int = 100, fallback_below: int = 20) -> DataFrame:
    """Features of a significant ic that are in the top decile by mi; of a significant ic alone where those are too few. The largest |ic| first."""
    good = ic.where((F.abs("ic") > least_ic) & (F.col("p_value") < most_p)).select("feature", F.abs("ic").alias("abs_ic"))
    cut = mi.agg(F.percentile("mi", F.lit(0.9)).alias("cut"))
    high = mi.join(F.broadcast(cut), F.col("mi") > F.col("cut")).select("feature")  # cut is one row
    both = good.join(high, "feature", "left_semi")
    n = both.agg(F.count(F.lit(1)).alias("n"))
    chosen = both.withColumn("kind", F.lit("both")).union(good.withColumn("kind", F.lit("ic"))).join(F.broadcast(n), F.when(F.col("n") >= fallback_below, F.col("kind") == "both").otherwise(F.col("kind") == "ic"))  # n is one row
    return chosen.select("feature", "abs_ic").orderBy(F.desc("abs_ic"), "feature").limit(most)


def cached_votes(universe: DataFrame, ic: DataFrame, mi: DataFrame, rf: DataFrame, mlp: DataFrame, least: float = 0.01, top: int = 100) -> DataFrame:
    """Votes from results at hand: |score| of ic and score of mi above `least`, among the `top` of rf, named by mlp. strong from three of four, medium at two."""
    best = rf.orderBy(F.desc("score"), "feature").limit(top)
    named = [ic.where(F.abs("score") > least).select("feature", F.lit("ic").alias("m")), mi.where(F.col("score") > least).select("feature", F.lit("mi").alias("m")), best.select("feature", F.lit("rf").alias("m")), mlp.select("feature", F.lit("mlp").alias("m"))]
    every = universe.select("feature", F.lit("").alias("m"))
    for x in named:
        every = every.union(x)
    has = lambda m: F.bool_or(F.col("m") == m)
    out = every.groupBy("feature").agg(has("").alias("_known"), *(has(m).alias(f"vote_{m}") for m in ("ic", "mi", "rf", "mlp"))).where("_known").drop("_known")
    out = out.withColumn("n_votes", sum((F.col(f"vote_{m}").cast("int") for m in ("ic", "mi", "rf", "mlp")), F.lit(0)))
    return out.withColumn("category", F.when(F.col("n_votes") >= 3, "strong").when(F.col("n_votes") == 2, "medium").otherwise("weak"))


def run(scores: DataFrame, top: int = 100) -> DataFrame:
    """From scores (method, feature, score) to votes, categories and checks of every ranked feature, in one pass."""
    methods = [r["method"] for r in scores.select("method").distinct().collect()]  # names of methods
    voted = votes(rankings(scores, top), len(methods))
    judged = checked(voted, tuple(m for m in METHODS if m in methods)).select("feature", "checks_passed", "checks_total", "approved")
    return voted.join(judged, "feature", "left").na.fill({"approved": False})
