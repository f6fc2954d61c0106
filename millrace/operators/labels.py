"""Labels for learning: volatility targets, forward returns, barriers, meta labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import series as S
from millrace.operators import bars as B


def ewm_volatility(bars: DataFrame, span: int = 100) -> DataFrame:
    """Exponential deviation of within-session returns; at least max(2, span // 4) of them."""
    x = S.with_pos(bars.withColumn("day", F.to_date("ts"))).withColumn("_r", B.session_return())
    return S.ewm_std(x, "ewm_volatility", F.col("_r"), span, max(2, span // 4)).drop("_r", "pos", "day")


def realised_volatility(bars: DataFrame, window: int = 100) -> DataFrame:
    x = bars.withColumn("day", F.to_date("ts")).withColumn("_r", B.session_return())
    return x.withColumn("realised", S.full(F.col("_r"), F.stddev_samp("_r"), window, max(2, window // 4))).drop("_r", "day")


def same_session_forward(h: int, daily: bool = False) -> Column:
    """Whether the bar h ahead exists and, unless bars are daily, lies in the same session."""
    ahead = F.lead("ts", h).over(S.by_symbol())
    return ahead.isNotNull() if daily else F.coalesce(F.to_date(ahead) == F.to_date("ts"), F.lit(False))


def forward_return(bars: DataFrame, h: int, log: bool = False, daily: bool = False) -> DataFrame:
    """forward_return: close h bars ahead over close, null across a session's end."""
    ratio = F.try_divide(F.lead("close", h).over(S.by_symbol()), F.col("close"))
    return bars.withColumn("forward_return", F.when(same_session_forward(h, daily), F.ln(ratio) if log else ratio - 1))


def fixed_horizon(x: Column, threshold: float = 0.0, ternary: bool = False) -> Column:
    """1 above the threshold, else 0; ternary: -1 below its negative, 0 between. Null stays null."""
    if ternary:
        return F.when(x > threshold, 1).when(x < -threshold, -1).when(x.isNotNull(), 0)
    return F.when(x.isNotNull(), (x > threshold).cast("int"))


def triple_barrier(
    bars: DataFrame, h: int, pt: float, sl: float, target: str, side: str | None = None, use_range: bool = False, vertical_zero: bool = False, across: bool = False
) -> DataFrame:
    """Adds touch_pos, ret, label: which barrier is reached first within h bars of the session, or of the
    series with ``across``.

    Barriers stand at pt and sl times ``target`` around the close (of the ``side`` taken); a tie is a
    profit. Without a touch the last bar in reach decides. Labels are signs, or 1/0 with a side.
    The forward window is an array of at most h bars, within (symbol, day).
    """
    x = B.with_session(bars)
    ahead = Window.partitionBy("symbol", *([] if across else ["day"])).orderBy("ts").rowsBetween(1, h)
    sgn = F.col(side) if side else F.lit(1)
    up = F.col("high") if use_range else F.col("close")
    down = F.col("low") if use_range else F.col("close")
    x = x.withColumn("_f", F.collect_list(F.struct(F.col("pos").alias("p"), up.alias("h"), down.alias("l"), F.col("close").alias("c"))).over(ahead))
    entry, t = F.col("close"), F.col(target)
    best = lambda b: F.when(sgn >= 0, b["h"] / entry - 1).otherwise(1 - b["l"] / entry)
    worst = lambda b: F.when(sgn >= 0, b["l"] / entry - 1).otherwise(1 - b["h"] / entry)
    first = lambda cond: F.get(F.filter("_f", cond), F.lit(0))["p"]
    x = x.withColumn("_up", first(lambda b: best(b) >= pt * t)).withColumn("_dn", first(lambda b: worst(b) <= -sl * t)).withColumn("_end", F.try_element_at("_f", F.lit(-1)))
    win = F.col("_up").isNotNull() & (F.col("_dn").isNull() | (F.col("_up") <= F.col("_dn")))
    valid = t.isNotNull() & (F.size("_f") > 0) & sgn.isNotNull()
    ret = F.when(win, pt * t).when(F.col("_dn").isNotNull(), -sl * t).otherwise(sgn * (F.col("_end")["c"] / entry - 1))
    x = x.withColumn("touch_pos", F.when(valid, F.coalesce(F.when(win, F.col("_up")).otherwise(F.col("_dn")), F.col("_end")["p"])))
    x = x.withColumn("ret", F.when(valid, ret))
    label = (F.col("ret") > 0).cast("int") if side else F.signum("ret").cast("int")
    if vertical_zero:
        label = F.when(F.col("_up").isNull() & F.col("_dn").isNull(), 0).otherwise(label)
    return x.withColumn("label", F.when(valid, label)).drop("_f", "_up", "_dn", "_end")


def meta_labels(bars: DataFrame, h: int, pt: float, sl: float, target: str, side: str) -> DataFrame:
    """Triple barrier for a given side; no position (0), no label."""
    return triple_barrier(bars.withColumn(side, F.nullif(F.col(side), F.lit(0))), h, pt, sl, target, side)


def next_up(bars: DataFrame) -> DataFrame:
    """target: whether the next close is higher; null on the last row (nothing is known of it)."""
    return bars.withColumn("target", (F.lead("close").over(S.by_symbol()) > F.col("close")).cast("int"))
