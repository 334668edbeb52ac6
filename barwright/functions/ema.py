"""Exponential averages as a blocked linear recurrence, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.blocks import numbered

#: Rows of a block; (1 / 3) ** -BLOCK, the largest weight there is, is still a double.
BLOCK = 400
#: Blocks that are folded together.
GROUP = 400


def with_emas(df: DataFrame, specs: dict[str, tuple[str, int]], keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """df with, by name, the exponential average of a column x: y = a x + (1 - a) y', a = 2 / (n + 1), from the first value on; bars without an x repeat y'.

    Before the first value y' is that value, so that all rows are alike. Inside a block of rows the recurrence is a weighted running sum; blocks are carried on by folds in two levels: over the blocks of a group, and over the groups of a series, which is a number for BLOCK * GROUP rows. df is read three times however many averages there are, and no task sees a series as a whole."""
    specs = dict(specs)
    if not specs:
        return df
    values = {x: i for i, x in enumerate(dict.fromkeys(x for x, _ in specs.values()))}
    block = Window.partitionBy(*keys, "_b").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered(df, "_rn", keys, order[0]).withColumn("_b", F.floor(F.col("_rn") / BLOCK)).withColumn("_g", F.floor(F.col("_b") / GROUP))
    rows = rows.withColumns({f"_j{i}": F.count(x).over(block) for x, i in values.items()})
    keep = [1 - 2 / (n + 1) for _, n in specs.values()]
    of = [values[x] for x, _ in specs.values()]
    local = {}
    for k, (x, n) in enumerate(specs.values()):
        j = F.col(f"_j{of[k]}")
        sums = F.sum(F.lit(2 / (n + 1)) * F.col(x) * F.pow(F.lit(1 / keep[k]), j)).over(block) * F.pow(F.lit(keep[k]), j) if n > 1 else F.last(x, ignorenulls=True).over(block)
        local[f"_y{k}"] = F.coalesce(sums, F.lit(0.0))
    rows = rows.withColumns(local)
    ends = rows.groupBy(*keys, "_g", "_b").agg(F.max_by(F.array(*(F.col(f"_y{k}") for k in range(len(of)))), "_rn").alias("end"), F.max_by(F.array(*(F.col(f"_j{i}") for i in range(len(values)))), "_rn").alias("top"))
    groups = ends.groupBy(*keys, "_g").agg(F.sort_array(F.collect_list(F.struct("_b", "end", "top"))).alias("blocks"))
    firsts = df.groupBy(*keys).agg(*(F.min_by(F.when(F.col(x).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.struct(*order))).alias(f"_x{i}") for x, i in values.items()))
    zeros = lambda n, v: F.array(*(F.lit(v) for _ in range(n)))

    def pow_of(k: int, n) -> Column:
        return F.when(n > 0, F.lit(0.0)).otherwise(1.0) if keep[k] <= 0 else F.pow(F.lit(keep[k]), n)

    def after(b, y) -> Column:
        return F.array(*(b["end"][k] + pow_of(k, b["top"][i]) * y[k] for k, i in enumerate(of)))

    # a group as a whole: what it ends with if it starts with nothing, and how many values of each column it has
    whole = groups.select(*keys, "_g", F.aggregate("blocks", F.struct(zeros(len(of), 0.0).alias("end"), F.array(*(F.lit(0).cast("bigint") for _ in values)).alias("top")), lambda acc, b: F.struct(after(b, acc["end"]).alias("end"), F.zip_with(acc["top"], b["top"], lambda p, q: p + q).alias("top"))).alias("w"))
    lines = whole.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_g", F.col("w.end").alias("end"), F.col("w.top").alias("top")))).alias("groups")).join(firsts, list(keys))
    at_first = F.array(*(F.coalesce(F.col(f"_x{i}").cast("double"), F.lit(0.0)) for i in of))

    def carried(blocks: str, y: Column, seen: Column) -> Column:
        """What each of blocks starts with: the averages, and how many values came before."""
        start = F.struct(y.alias("y"), seen.alias("n"), F.array().cast("array<struct<y:array<double>,n:array<bigint>>>").alias("before"))
        step = lambda acc, b: F.struct(after(b, acc["y"]).alias("y"), F.zip_with(acc["n"], b["top"], lambda p, q: p + q).alias("n"), F.concat(acc["before"], F.array(F.struct(acc["y"].alias("y"), acc["n"].alias("n")))).alias("before"))
        return F.aggregate(blocks, start, step, lambda acc: acc["before"])

    starts = lines.select(*keys, F.posexplode(F.arrays_zip(F.transform("groups", lambda g: g["_g"]).alias("g"), carried("groups", at_first, F.array(*(F.lit(0).cast("bigint") for _ in values))).alias("s"))).alias("_p", "_z")).select(*keys, F.col("_z.g").alias("_g"), F.col("_z.s").alias("_s"))
    inner = groups.join(starts, [*keys, "_g"]).select(*keys, F.posexplode(F.arrays_zip(F.transform("blocks", lambda b: b["_b"]).alias("b"), carried("blocks", F.col("_s.y"), F.col("_s.n")).alias("s"))).alias("_p", "_z")).select(*keys, F.col("_z.b").alias("_b"), F.col("_z.s").alias("_carry"))
    joined = rows.join(inner, [*keys, "_b"])
    made = {out: F.when(F.col(f"_j{i}") + F.col("_carry.n")[i] > 0, F.col(f"_y{k}") + pow_of(k, F.col(f"_j{i}")) * F.col("_carry.y")[k]) for k, (out, i) in enumerate(zip(specs, of, strict=True))}
    return joined.select(*df.columns, *(v.alias(k) for k, v in made.items()))


def with_ema(df: DataFrame, x: str, n: int, out: str, keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    return with_emas(df, {out: (x, n)}, keys, order)
