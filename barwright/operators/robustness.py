"""How an information coefficient holds up over parameters, periods, series and regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parameter_variants(name: Column, share: float = 0.1, n: int = 5) -> Column:
    """Names with the first number moved by up to the share on either side in n steps, 2 at least."""
    first = F.regexp_extract(name, r"\d+", 0)
    p = first.try_cast("double")
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.greatest(F.lit(2), F.round(p * (1 - share + 2 * share * i / max(n - 1, 1))).cast("int")))
    return F.when(first != "", F.array_distinct(F.transform(steps, lambda v: F.regexp_replace(name, F.concat(F.lit("^(\\D*)\\d+"), F.lit("")), F.concat(F.lit("$1"), v.cast("string"))))))


def sensitivity(ic: DataFrame, share: float = 0.1, n: int = 5) -> DataFrame:
    """ic (feature, ic) judged against the features whose first parameter differs a little: their mean, deviation, extremes, coefficient of variation and a verdict."""
    names = ic.select(F.col("feature").alias("base"), F.explode(parameter_variants(F.col("feature"), share, n)).alias("feature"))
    met = names.join(ic, "feature").groupBy("base").agg(F.count("ic").alias("n_variants"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_sd"), F.min("ic").alias("ic_min"), F.max("ic").alias("ic_max"))
    cv = F.abs(F.try_divide("ic_sd", "ic_mean"))
    return met.withColumn("cv", cv).withColumn("verdict", F.when(cv < 0.2, "robust").when(cv < 0.5, "moderate").otherwise("sensitive"))


def temporal_class(ic: DataFrame, by: list[str]) -> DataFrame:
    """stable if four in five periods are positive, they vary by less than half their mean and none is clearly negative; moderate at three in five."""
    out = ic.groupBy(*by).agg(F.count("ic").alias("n_periods"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_sd"), F.min("ic").alias("ic_min"), F.avg((F.col("ic") > 0).cast("double")).alias("share_positive"))
    cv = F.abs(F.try_divide("ic_sd", "ic_mean"))
    stable = (F.col("share_positive") >= 0.8) & (F.coalesce(cv, F.lit(1.0)) < 0.5) & (F.col("ic_min") >= -0.02)
    return out.withColumn("stability", F.when(stable, "stable").when(F.col("share_positive") >= 0.6, "moderate").otherwise("unstable"))


def series_class(ic: DataFrame, by: list[str]) -> DataFrame:
    """Whether series agree on the sign of ic: universal from four in five, partial from three in five."""
    share = F.greatest(F.avg((F.col("ic") > 0).cast("double")), F.avg((F.col("ic") < 0).cast("double")))
    out = ic.groupBy(*by).agg(F.count("ic").alias("n_series"), F.avg("ic").alias("ic_mean"), share.alias("agreement"))
    return out.withColumn("consistency", F.when(F.col("agreement") >= 0.8, "universal").when(F.col("agreement") >= 0.6, "partial").otherwise("specific"))


def regime_gate(ic: DataFrame, by: list[str], least: float = 0.01) -> DataFrame:
    """Features that hold in every regime, and for the others the regimes in which they don't."""
    weak = F.abs("ic") < least
    return ic.groupBy(*by).agg(F.bool_and(~F.coalesce(weak, F.lit(True))).alias("is_robust"), F.array_join(F.sort_array(F.collect_list(F.when(F.coalesce(weak, F.lit(True)), F.col("regime")))), ",").alias("weak_in"))


def trade_consistency(trades: DataFrame, least: int = 10) -> DataFrame:
    """Return, win rate and verdict of each pair with trades enough."""
    out = trades.groupBy("pair").agg(F.count(F.lit(1)).alias("n_trades"), F.avg("return_pct").alias("mean_return"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate")).where(F.col("n_trades") >= least)
    return out.withColumn("is_profitable", F.col("mean_return") > 0)


def histogram(df: DataFrame, x: str, bins: int = 30) -> DataFrame:
    """bin (1 to bins), n over equal widths between the least and the largest value."""
    from barwright.operators.stats import width_bins

    ends = df.agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    binned = df.where(F.col(x).isNotNull()).join(F.broadcast(ends))  # one row
    return binned.groupBy(width_bins(F.col(x), F.col("_a"), F.col("_b"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def thirds_gate(ic: DataFrame, by: list[str], most: float = 0.01) -> DataFrame:
    """Whether the ic of the parts of a time span have one sign and a population deviation below `most`."""
    out = ic.groupBy(*by).agg(F.count("ic").alias("n_parts"), F.min("ic").alias("ic_min"), F.max("ic").alias("ic_max"), F.stddev_pop("ic").alias("ic_sd"))
    return out.withColumn("is_stable", F.coalesce((F.col("ic_min") * F.col("ic_max") > 0) & (F.col("ic_sd") < most), F.lit(False)))


def regime_significance(ic: DataFrame, most_p: float = 0.01, least: int = 30) -> DataFrame:
    """ic (feature, regime, n, ic) with its p-value and whether it is significant with rows enough."""
    from barwright.operators.stats import two_sided_p

    return ic.withColumn("p_value", F.coalesce(two_sided_p(F.col("ic"), F.col("n")), F.lit(1.0))).withColumn("is_significant", (F.col("p_value") < most_p) & (F.col("n") >= least))


def report(**parts: DataFrame) -> DataFrame:
    """Results of several analyses as one table: analysis, and the columns of all of them, NULL where one has none."""
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("analysis"), *part.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


#: The chances and deviations that the four gates ask for.
GATES = {"p_value": 0.01, "permutation_p": 0.001, "yearly_sd": 0.02}


def four_gates(found: DataFrame) -> DataFrame:
    """found (p_value, low, high, permutation_p, yearly_sd, yearly_min) with each gate, how many are passed, and whether three are: a significant prediction, an interval without 0, more than shuffled predictions give, and years that are steady and positive."""
    gates = {
        "passes_forward": F.col("p_value") < GATES["p_value"],
        "passes_interval": (F.col("low") > 0) | (F.col("high") < 0),
        "passes_permutation": F.col("permutation_p") < GATES["permutation_p"],
        "passes_years": (F.col("yearly_sd") < GATES["yearly_sd"]) & (F.col("yearly_min") > 0),
    }
    out = found.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in gates.items()})
    return out.withColumn("n_passed", sum((F.col(k).cast("int") for k in gates), F.lit(0))).withColumn("is_valid", F.col("n_passed") >= 3)


def degradation(windows: DataFrame, by: list[str], least: float = 0.01) -> DataFrame:
    """windows (by, window, ic): slope of ic over windows, mean of the last three, whether the last two are negative, and whether any of these tells of a decline. With fewer than three windows there is no verdict."""
    from pyspark.sql import Window

    last = Window.partitionBy(*by).orderBy(F.desc("window"))
    w = windows.withColumn("_n", F.row_number().over(last))
    out = w.groupBy(*by).agg(F.count("ic").alias("n_windows"), F.regr_slope("ic", "window").alias("slope"), F.avg(F.when(F.col("_n") <= 3, F.col("ic"))).alias("recent"), F.coalesce(F.bool_and(F.when(F.col("_n") <= 2, F.col("ic") < 0)), F.lit(False)).alias("last_two_negative"))
    enough = F.col("n_windows") >= 3
    return out.withColumn("is_declining", F.when(enough, (F.col("slope") < -0.001) | (F.col("recent") < least) | F.col("last_two_negative")))


def forward_verdict(windows: DataFrame, by: list[str]) -> DataFrame:
    """By the share of windows with a positive ic: real if all, unstable if some, overfitted if none."""
    out = windows.groupBy(*by).agg(F.count("ic").alias("n_windows"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_sd"), F.avg((F.col("ic") > 0).cast("double")).alias("share_positive"))
    return out.withColumn("verdict", F.when(F.col("share_positive") == 1, "real").when(F.col("share_positive") > 0, "unstable").otherwise("overfitted"))


def validated(df: DataFrame, predicted: str, actual: str, period: str, keys: list[str], order: list[str], n: int = 10_000, seed: int = 42, least: int = 11) -> DataFrame:
    """four_gates of predictions of each series: the rank correlation's p-value, its interval over resampled rows, its place among dealt predictions, and the correlations of the periods (a column) with `least` rows."""
    from barwright.operators import resampling
    from barwright.operators.stats import information_coefficient, two_sided_p

    rows = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    tests = resampling.rank_tests(resampling.rank_replicates(rows, predicted, actual, order, n, seed, keys), keys)
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    long = rows.select(*keys, F.col(period).alias("_period"), F.col(predicted).alias("value"), F.col(actual).alias("target"))
    by_period = information_coefficient(long, [*keys, "_period"], "spearman", least)
    years = by_period.groupBy(*keys).agg(F.stddev_pop("ic").alias("yearly_sd"), F.min("ic").alias("yearly_min"))
    found = tests.join(size, keys).join(years, keys, "left").withColumn("p_value", F.coalesce(two_sided_p(F.col("ic"), F.col("n")), F.lit(1.0)))
    return four_gates(found)


def top_feature(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, feature, value, target) of the feature with the largest correlation of each series, of equal ones the first by name."""
    from barwright.operators.stats import information_coefficient

    best = information_coefficient(rows, [*keys, "feature"]).where("ic IS NOT NULL").groupBy(*keys).agg(F.min_by("feature", F.struct(-F.abs("ic"), "feature")).alias("feature"))
    return rows.join(best, [*keys, "feature"])
