"""Rules from validated features: entry conditions, weights, votes, sizes and exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(name: Column, cases: list[tuple[tuple[str, ...], object]], default: object) -> Column:
    """The value of the first case of which the name contains a part."""
    out = None
    for parts, value in cases:
        hit = name.contains(parts[0])
        for p in parts[1:]:
            hit = hit | name.contains(p)
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# The parts of names that component_type and threshold look for, in this order.
def component_type(name: Column) -> Column:
    return first_match(name, [(("Pos",), "position"), (("minus", "-"), "difference"), (("div", "/"), "ratio"), (("times", "*"), "product"), (("R_1",), "immediate momentum"), (("R",), "momentum"), (("sigma", "σ"), "volatility"), (("mu", "μ"), "mean")], "complex")


def threshold(name: Column, ic: Column) -> Column:
    up = ic > 0
    either = lambda a, b: F.when(up, F.lit(a)).otherwise(F.lit(b))
    ratio = F.when(name.contains("sigma"), either(1.2, 0.8)).otherwise(F.lit(1.0))
    return first_match(name, [(("Pos",), either(0.7, 0.3)), (("R_1",), 0.0), (("minus", "diff"), 0.0), (("div", "ratio"), ratio), (("sigma", "σ"), 0.0), (("Z",), either(1.0, -1.0))], 0.0)


def pattern(name: Column, ic: Column) -> Column:
    """What kind of effect a feature's name and sign suggest; the first that fits."""
    # Parts of names, and the sign of ic that an effect needs.
    kinds = [(("pos", "z", "rank"), ic <= 0, "mean reversion"), (("r", "delta"), ic > 0, "momentum"), (("sigma", "σ"), None, "volatility"), (("hour", "day", "month"), None, "seasonality"), (("minus", "-", "diff"), None, "difference of scales"), (("div", "/", "ratio"), None, "relative level")]
    out = None
    for parts, sign, kind in kinds:
        hit = F.lower(name).rlike("|".join(parts))
        hit = hit if sign is None else hit & sign
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("complex")


def period(name: Column) -> Column:
    """The first number in a name."""
    return F.nullif(F.regexp_extract(name, r"\d+", 0), F.lit("")).try_cast("int")


def parameters(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)")), lambda x: x.cast("int"))


def entry_rules(features: DataFrame) -> DataFrame:
    """feature, ic, signal and weight become rules: component, operator and threshold. A short signal turns the operator."""
    name, ic = F.col("feature"), F.col("ic")
    up = (ic > 0) == (F.col("signal") == "Long")
    rules = features.withColumn("component", component_type(name)).withColumn("operator", F.when(up, ">").otherwise("<")).withColumn("threshold", threshold(name, ic))
    return rules.withColumn("description", F.concat_ws(" ", F.replace(name, F.lit("_"), F.lit(" ")), F.col("operator"), F.format_number("threshold", 3)))


def weights(features: DataFrame) -> DataFrame:
    """weight: |ic| over their sum, or equal ones; signed_weight by the signal."""
    w = Window.partitionBy()  # a row for each feature
    total, n = F.sum(F.abs("ic")).over(w), F.count(F.lit(1)).over(w)
    out = features.withColumn("weight", F.when(total > 0, F.abs("ic") / total).otherwise(1 / n))
    return out.withColumn("signed_weight", F.when(F.col("signal") == "Short", -F.col("weight")).otherwise(F.col("weight")))


def rule_votes(values: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """values (by, feature, value) judged by the rules: long_score, short_score, decision. A side wins with more than half of its weights and more than the other side."""
    halves = rules.groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("signal") == s, F.col("weight"))) / 2, F.lit(0.5)).alias(f"_half_{s}") for s in ("Long", "Short")))
    met = values.join(F.broadcast(rules.select("feature", "signal", "operator", "threshold", "weight")), "feature")  # rules: a row for each feature
    holds = F.when(F.col("operator") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    scored = met.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(holds & (F.col("signal") == s), F.col("weight"))), F.lit(0.0)).alias(f"{s.lower()}_score") for s in ("Long", "Short")))
    a, b = F.col("long_score"), F.col("short_score")
    judged = scored.join(F.broadcast(halves))  # one row
    return judged.withColumn("decision", F.when((a > F.col("_half_Long")) & (a > b), "LONG").when((b > F.col("_half_Short")) & (b > a), "SHORT").otherwise("NEUTRAL")).drop("_half_Long", "_half_Short")


def rule_sql(rules: list[dict]) -> str:
    """A SQL expression of the difference of long and short scores of rules over a wide table."""
    terms = [f"CASE WHEN `{r['feature']}` {r['operator']} {float(r['threshold'])!r}D THEN {float(r['weight']) * (1 if r['signal'] == 'Long' else -1)!r}D ELSE 0.0D END" for r in rules]
    return " + ".join(terms) or "0.0D"


def position_size(capital: Column, strength: Column, atr: Column, price: Column, correlation: Column, base: float = 0.02, most: float = 0.10, risk: float = 0.01, stop: float = 2.0) -> Column:
    by_risk = F.when((atr * stop > 0) & ~F.isnan(atr), F.try_divide(F.try_divide(capital * risk, atr * stop), price)).otherwise(F.lit(base * 0.5))
    return F.least(F.least(base * strength, by_risk) * (1 - correlation * 0.5), F.lit(most))


def exits(entry: Column, direction: Column, atr: Column, stop: float = 2.0, take: float = 3.0) -> tuple[Column, Column]:
    side = F.when(direction == "LONG", 1).when(direction == "SHORT", -1).otherwise(0)
    return entry - side * stop * atr, entry + side * take * atr


#: Parts of feature names and the words that replace them, in this order; later ones also meet the words of earlier ones.
WORDS = (
    ("Pos", "relative position"),
    ("mu", "mean"),
    ("sigma", "volatility"),
    ("R", "return"),
    ("r", "log return"),
    ("Delta", "change"),
    ("Z", "z-score"),
    ("Rank", "ranking"),
    ("Max", "maximum"),
    ("Min", "minimum"),
    ("EMA", "exponential mean"),
    ("minus", "less"),
    ("plus", "more"),
    ("times", "by"),
    ("div", "divided"),
    ("C", "close"),
    ("H", "high"),
    ("L", "low"),
    ("O", "open"),
    ("V", "volume"),
)


def in_words(name: Column) -> Column:
    out = F.replace(name, F.lit("_"), F.lit(" "))
    for part, word in WORDS:
        out = F.replace(out, F.lit(part), F.lit(word))
    return out


def interpretation(name: Column, ic: Column) -> Column:
    """One sentence: the kind of effect, the feature in words, and the side that it speaks for."""
    return F.concat(pattern(name, ic), F.lit(": "), in_words(name), F.lit(" speaks for "), F.when(ic > 0, "higher").otherwise("lower"), F.lit(" prices"))


def strategy_summary(rules: DataFrame, base: float = 0.02, most: float = 0.10, risk: float = 0.01, stop: float = 2.0, take: float = 3.0, timeout: int = 50) -> DataFrame:
    """part, value: how many rules there are for each side, and what sizes and exits are."""
    count = lambda s: F.count_if(F.col("signal") == s).cast("double")
    parts = [("long rules", count("Long")), ("short rules", count("Short")), ("base size %", F.lit(base * 100)), ("largest size %", F.lit(most * 100)), ("risk a trade %", F.lit(risk * 100)), ("stop in ATR", F.lit(stop)), ("target in ATR", F.lit(take)), ("reward to risk", F.lit(take / stop) if stop > 0 else F.lit(None).cast("double")), ("timeout in bars", F.lit(float(timeout)))]
    one = rules.agg(*(v.alias(f"_{i}") for i, (_, v) in enumerate(parts)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("part"), F.col(f"_{i}").alias("value")) for i, (n, _) in enumerate(parts)))).alias("p")).select("p.*")
