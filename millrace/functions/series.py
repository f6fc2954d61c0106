"""Ordered-series primitives over (symbol, ts): windows, positions and discounted sums.

Exponential averages are linear recurrences, so they are computed in blocks: a discounted sum
inside each (symbol, block) by an ordinary running sum, then the end of the block before. Every
step is a built-in window over the partitioning by symbol; no series is collected, nothing is joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights below SCALE are nothing; a block's weights stay under LARGEST, far from overflow.
SCALE, LARGEST = 1e-40, 1e240


def by_symbol(*keys: str, order: str = "ts") -> Window:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def trailing(n: int, *keys: str, order: str = "ts") -> Window:
    return by_symbol(*keys, order=order).rowsBetween(-(n - 1), 0)


def running(*keys: str, order: str = "ts") -> Window:
    return by_symbol(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def full(x: Column, agg: Column, n: int, least: int | None = None, *keys: str, order: str = "ts") -> Column:
    """``agg`` over the last n rows, null until the frame holds ``least`` (n) values of x."""
    w = trailing(n, *keys, order=order)
    return F.when(F.count(x).over(w) >= (n if least is None else least), agg.over(w))


def with_pos(df: DataFrame, key: str = "symbol", order: str = "ts", name: str = "pos") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(by_symbol(key, order=order)) - 1).cast("long"))


def discounted(df: DataFrame, sums: dict[str, tuple[Column, float]], key: str = "symbol", pos: str = "pos", block: int | None = None) -> DataFrame:
    """Adds, for each name: (x, q), the sum over j <= i of q**(i - j) * x_j; null x count as 0.

    ``pos`` counts a key's rows from 0. Blocks hold ``block`` rows or more: so many that what lies two
    blocks back has lost its weight (q**rows is SCALE or less). A row needs its own block's running
    sum and the end of the block before. Both are windows in the order (block, pos)
    over one partitioning by key, so however many recurrences are chained, the input is read once.
    """
    decay = [-math.log(q) for _, q in sums.values() if 0 < q < 1]
    least = max([block or 1, *(math.ceil(-math.log(SCALE) / d) for d in decay)])
    if len(decay) > 1 and least * max(decay) > math.log(LARGEST):  # very unlike rates: each by itself
        for name, what in sums.items():
            df = discounted(df, {f"_own_{name}": what}, key, pos, block)
        return df.withColumns({name: F.col(f"_own_{name}") for name in sums}).drop(*[f"_own_{name}" for name in sums])
    at = F.col("_at")
    within = Window.partitionBy(key, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_blk", pos).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_blk", F.expr(f"{pos} div {least}")).withColumn("_at", F.pmod(F.col(pos), F.lit(least)).cast("double"))
    decays = {name: (F.coalesce(x.cast("double"), F.lit(0.0)), float(q)) for name, (x, q) in sums.items()}
    inside = {f"_in_{name}": F.sum(x * F.pow(F.lit(q), -at)).over(within) * F.pow(F.lit(q), at) if q else x for name, (x, q) in decays.items()}
    df = df.withColumns(inside)
    ends = {f"_end_{name}": F.last(F.when(at == least - 1, F.col(f"_in_{name}")), ignorenulls=True).over(before) for name in sums}
    df = df.withColumns(ends)
    df = df.withColumns({name: F.col(f"_in_{name}") + F.coalesce(F.col(f"_end_{name}"), F.lit(0.0)) * F.pow(F.lit(q), at + 1) for name, (_, q) in decays.items()})
    return df.drop("_blk", "_at", *inside, *ends)


def ema(df: DataFrame, columns: dict[str, tuple[Column, float]], key: str = "symbol", pos: str = "pos", first: int = 0) -> DataFrame:
    """Adds e_i = (1 - a) e_{i-1} + a x_i, seeded with the value at position ``first``; null before."""
    sums = {}
    for name, (x, a) in columns.items():
        seeded = F.when(F.col(pos) == first, x).when(F.col(pos) > first, x * a)
        sums[name] = (seeded, 1 - a)
    df = discounted(df, sums, key, pos)
    for name in columns:
        df = df.withColumn(name, F.when(F.col(pos) >= first, F.col(name)))
    return df


def span(n: float) -> float:
    return 2.0 / (n + 1.0)


def ewm_mean(df: DataFrame, name: str, x: Column, n: float, key: str = "symbol", pos: str = "pos") -> DataFrame:
    """Adjusted exponential mean: weights (1 - a)**age, normalised by their sum; no nulls inside."""
    a = span(n)
    df = discounted(df, {name: (x, 1 - a), "_den": (F.lit(1.0), 1 - a)}, key, pos)
    return df.withColumn(name, F.col(name) / F.col("_den")).drop("_den")


def ewm_std(df: DataFrame, name: str, x: Column, n: float, least: int, key: str = "symbol", pos: str = "pos") -> DataFrame:
    """Adjusted, bias-corrected exponential deviation; rows without a value still age the others."""
    a = span(n)
    has = x.isNotNull().cast("double")
    df = discounted(df, {"_s0": (has, 1 - a), "_s1": (x, 1 - a), "_s2": (x * x, 1 - a), "_q": (has, (1 - a) ** 2)}, key, pos)
    seen = F.count(x).over(running(key, order=pos))
    mean = F.col("_s1") / F.nullif(F.col("_s0"), F.lit(0.0))
    var = (F.col("_s2") / F.nullif(F.col("_s0"), F.lit(0.0)) - mean * mean) * F.try_divide(F.col("_s0") * F.col("_s0"), F.col("_s0") * F.col("_s0") - F.col("_q"))
    return df.withColumn(name, F.when(seen >= least, F.sqrt(F.greatest(var, F.lit(0.0))))).drop("_s0", "_s1", "_s2", "_q")
