"""Stochastic-process fits and tests of a series, by series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_returns(df: DataFrame, x: str = "close", keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("r", F.ln(F.try_divide(F.col(x), F.lag(x, 1).over(w)))).where(F.col("r").isNotNull())


def ornstein_uhlenbeck(df: DataFrame, x: str = "close", dt: float = 1.0) -> DataFrame:
    """Mean reversion: dX regressed on X. theta, mu, sigma, half_life, r2."""
    w = Window.partitionBy("series").orderBy("ts")
    steps = df.select("series", F.col(x).alias("x"), (F.lead(x, 1).over(w) - F.col(x)).alias("dx")).where(F.col("dx").isNotNull())
    fit = steps.groupBy("series").agg(F.regr_slope("dx", "x").alias("b"), F.regr_intercept("dx", "x").alias("a"), F.regr_r2("dx", "x").alias("r2"), F.var_pop("dx").alias("v"))
    theta = -F.col("b") / dt
    return fit.select("series", theta.alias("theta"), F.try_divide(-F.col("a"), F.col("b")).alias("mu"), F.sqrt(F.col("v") * (1 - F.col("r2")) / dt).alias("sigma"), F.when(theta > 0, F.ln(F.lit(2.0)) / theta).alias("half_life"), "r2")


def geometric_brownian(df: DataFrame, x: str = "close", dt: float = 1.0) -> DataFrame:
    """Drift, volatility and the 95 % interval of the mean log return."""
    fit = log_returns(df, x).groupBy("series").agg(F.avg("r").alias("m"), F.var_pop("r").alias("v"), F.count("r").alias("n"))
    half = 1.96 * F.sqrt(F.col("v") / F.col("n"))
    return fit.select("series", ((F.col("m") + F.col("v") / 2) / dt).alias("drift"), F.sqrt(F.col("v") / dt).alias("volatility"), (F.col("m") - half).alias("low"), (F.col("m") + half).alias("high"))


def jumps(df: DataFrame, x: str = "close", threshold: float = 3.0) -> DataFrame:
    """Log returns further than threshold deviations from the mean: how many, up and down, their share and mean size."""
    r = log_returns(df, x)
    w = Window.partitionBy("series")
    far = r.withColumn("m", F.avg("r").over(w)).withColumn("s", F.stddev_pop("r").over(w)).withColumn("is_jump", F.abs(F.col("r") - F.col("m")) > threshold * F.col("s"))
    return far.groupBy("series").agg(F.count_if(F.col("is_jump")).alias("n_jumps"), F.count_if(F.col("is_jump") & (F.col("r") > 0)).alias("n_up"), F.count_if(F.col("is_jump") & (F.col("r") < 0)).alias("n_down"), (F.count_if(F.col("is_jump")) / F.count(F.lit(1))).alias("share"), F.avg(F.when(F.col("is_jump"), F.abs("r"))).alias("mean_size"))


def random_walk(df: DataFrame, x: str = "close", k: int = 5, lags: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Variance ratio of k-step to one-step differences, lag-1 autocorrelation, and Ljung-Box Q over the lags up to each of `lags` with its p-value."""
    w = Window.partitionBy("series").orderBy("ts")
    d = df.select("series", "ts", F.row_number().over(w).alias("i"), F.col(x).alias("x")).withColumn("d", F.col("x") - F.lag("x", 1).over(w)).withColumn("dk", F.col("x") - F.lag("x", k).over(w))
    one = d.where(F.col("d").isNotNull()).withColumn("m", F.avg("d").over(Window.partitionBy("series")))
    ratio = d.groupBy("series").agg((F.try_divide(F.var_pop(F.when((F.col("i") - 1) % k == 0, F.col("dk"))), k * F.var_pop("d"))).alias("variance_ratio"))
    top = max(lags)
    products = one.select("series", (F.col("d") - F.col("m")).alias("c"), *((F.lag(F.col("d") - F.col("m"), j).over(w)).alias(f"c{j}") for j in range(1, top + 1)))
    sums = products.groupBy("series").agg(F.count("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s0"), *(F.sum(F.col("c") * F.col(f"c{j}")).alias(f"s{j}") for j in range(1, top + 1)))
    n = F.col("n")
    q = lambda m: n * (n + 2) * sum((F.pow(F.col(f"s{j}") / F.col("s0"), F.lit(2)) / (n - j) for j in range(1, m + 1)), F.lit(0.0))
    found = sums.join(ratio, "series").select("series", "variance_ratio", (F.col("s1") / F.col("s0")).alias("autocorrelation"), *(q(m).alias(f"q_{m}") for m in lags))
    return found.withColumns({f"p_{m}": chi_square_tail(F.col(f"q_{m}"), m) for m in lags})


#: Steps of the quadrature in `chi_square_tail`, an even number.
STEPS = 400


def chi_square_tail(x: Column, k: int) -> Column:
    """Chance of a chi-square variable with k degrees of freedom above x: with half of it as u * u its density goes as u ** (k - 1) * exp(-u * u), which Simpson's rule sums over ten units, beyond which nothing is left."""
    a, h = F.sqrt(F.greatest(x, F.lit(0.0)) / 2), 10 / STEPS

    def term(i: Column) -> Column:
        u = a + i * h
        return F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * F.pow(u, F.lit(float(k - 1))) * F.exp(-u * u)

    return F.least(F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + term(i)) * (h / 3 * 2 / math.gamma(k / 2)), F.lit(1.0))


def hurst(df: DataFrame, x: str = "close", low: int = 2, high: int = 100) -> DataFrame:
    """Rescaled range over chunk lengths low .. high - 1 of log returns: the slope of ln(R / S) on ln(length)."""
    w = Window.partitionBy("series").orderBy("ts")
    r = log_returns(df, x).select("series", "ts", "r").withColumn("i", F.row_number().over(w) - 1)
    cut = r.select("series", "r", "i", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("lag")).withColumn("chunk", F.floor(F.col("i") / F.col("lag")))
    c = Window.partitionBy("series", "lag", "chunk")
    dev = cut.withColumn("m", F.avg("r").over(c)).withColumn("n", F.count(F.lit(1)).over(c)).where(F.col("n") == F.col("lag"))
    walk = dev.withColumn("y", F.sum(F.col("r") - F.col("m")).over(c.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    rs = walk.groupBy("series", "lag", "chunk").agg(F.try_divide(F.max("y") - F.min("y"), F.stddev_pop("r")).alias("rs"))
    by_lag = rs.where(F.col("rs") > 0).groupBy("series", "lag").agg(F.avg("rs").alias("rs"))
    return by_lag.groupBy("series").agg(F.regr_slope(F.ln("rs"), F.ln("lag")).alias("hurst"), F.regr_r2(F.ln("rs"), F.ln("lag")).alias("r2"))


#: The scaling filter of the Daubechies wavelet with four vanishing moments.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)


def wavelet_energy(df: DataFrame, x: str = "close", levels: int = 6) -> DataFrame:
    """series, level, energy, share: energy of the wavelet details (level 0: of what remains), edges mirrored. Every value gives its part to the few sums that it is in, so a level is one aggregation by place; a level that is shorter than the filter is not made."""
    size = len(DB4)
    low, high = list(reversed(DB4)), [v * (-1) ** (k + 1) for k, v in enumerate(DB4)]
    w = Window.partitionBy("series").orderBy("ts")
    # kind 0: values by place i; other kinds: what the details of a level add to its energy
    rest = df.where(F.col(x).isNotNull()).select("series", F.lit(0).alias("kind"), (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.col(x).cast("double").alias("v"))
    rest = rest.join(rest.groupBy("series").agg(F.count(F.lit(1)).alias("n")), "series")
    taps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(zip(low, high, strict=True))))
    for level in range(1, levels + 1):
        i, n, v = F.col("i"), F.col("n"), F.col("v")
        goes, half = (F.col("kind") == 0) & (n >= size), F.floor((n + size - 1) / 2)
        places = F.array_compact(F.array(i, F.when(i < size - 1, -i - 1), F.when(i >= n - size + 1, 2 * n - 1 - i)))  # itself and its images beyond the ends
        sums = F.flatten(F.transform(places, lambda p: F.transform(taps, lambda t: F.struct((p - 1 + t["k"]).alias("j"), (t["a"] * v).alias("v"), (t["b"] * v).alias("d")))))
        mine = F.transform(F.filter(sums, lambda s: (F.pmod(s["j"], F.lit(2)) == 0) & (s["j"] >= 0) & (s["j"] < half * 2)), lambda s: F.struct((s["j"] / 2).cast("bigint").alias("i"), s["v"].alias("v"), s["d"].alias("d")))
        same = F.array(F.struct(i.alias("i"), v.alias("v"), F.lit(None).cast("double").alias("d")))
        spread = rest.withColumn("x", F.when(goes, mine).otherwise(same)).withColumn("m", F.when(goes, half).otherwise(n)).select("series", "kind", F.col("m").alias("n"), F.explode("x").alias("x"))
        made = spread.groupBy("series", "kind", "n", "x.i").agg(F.sum("x.v").alias("v"), F.sum("x.d").alias("d"))
        value = F.struct("kind", "i", "v")
        detail = F.struct(F.lit(level).alias("kind"), F.lit(0).cast("bigint").alias("i"), (F.col("d") * F.col("d")).alias("v"))
        rest = made.withColumn("y", F.when(F.col("d").isNull(), F.array(value)).otherwise(F.array(value, detail))).select("series", "n", F.explode("y").alias("y")).select("series", "y.kind", "y.i", "y.v", "n")
    energy = F.sum(F.when(F.col("kind") == 0, F.col("v") * F.col("v")).otherwise(F.col("v")))
    out = rest.groupBy("series", F.col("kind").alias("level")).agg(energy.alias("energy"))
    total = F.sum("energy").over(Window.partitionBy("series"))  # a row for each level
    return out.withColumn("share", F.coalesce(F.try_divide("energy", total), F.lit(0.0)))


def lyapunov(df: DataFrame, x: str = "close", dimension: int = 3, delay: int = 1, probes: int = 50, ahead: int = 10) -> DataFrame:
    """series, exponent: mean growth of the logarithmic distance between a point of the delay embedding and its nearest other point that is not beside it, over `probes` points at even steps of each series. NULL where no distance can be told."""
    w = Window.partitionBy("series").orderBy("ts")
    values = df.where(F.col(x).isNotNull())
    names = [f"e{k}" for k in range(dimension)]
    point = [F.lead(F.col(x).cast("double"), k * delay).over(w).alias(e) for k, e in enumerate(names)]
    points = values.select("series", (F.row_number().over(w) - 1).alias("i"), *point, *(F.lead(F.col(x).cast("double"), k * delay + ahead).over(w).alias(f"later{k}") for k in range(dimension))).where(F.col(f"later{dimension - 1}").isNotNull())
    sizes = points.groupBy("series").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ahead)
    chosen = sizes.select("series", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda p: F.floor(p * F.col("n") / probes)))).alias("i"))
    asked = points.join(chosen, ["series", "i"]).select("series", F.col("i").alias("q"), *(F.col(c).alias(f"q_{c}") for c in (*names, *(f"later{k}" for k in range(dimension)))))
    apart = lambda of: F.sqrt(sum(((F.col(f"q_{of}{k}") - F.col(f"{of}{k}")) * (F.col(f"q_{of}{k}") - F.col(f"{of}{k}")) for k in range(dimension)), F.lit(0.0)))
    met = points.join(asked, "series").where(F.abs(F.col("i") - F.col("q")) > dimension).select("series", "q", "i", apart("e").alias("d"), apart("later").alias("later"))
    nearest = met.groupBy("series", "q").agg(F.min(F.struct("d", "i", "later")).alias("m"))
    rate = F.when((F.col("m.d") > 1e-12) & (F.col("m.later") > 1e-12), F.ln(F.col("m.later") / F.col("m.d")) / ahead)
    return values.select("series").distinct().join(nearest.groupBy("series").agg(F.avg(rate).alias("exponent")), "series", "left")
