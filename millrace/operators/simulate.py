"""Backtests: fractional, exposure and whole-share simulators, cost and threshold sweeps.

Equity paths are products over windows. Whole-share trading depends on its own cash, so it is a
fold, but over a symbol's non-zero signals only, in a stream that keeps one position; bars between
take the last state. Sweeps explode
a literal grid onto the rows: one job, partitioned by (grid point, symbol).
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions import series as S
from millrace.functions.workers import on_workers


def _path(m: Column, *keys: str) -> Column:
    return F.product(m).over(S.running(*(keys or ("symbol",))))


def fractional(df: DataFrame, signal: str = "signal", capital: float = 10_000.0, commission: float = 0.001, slippage: float = 0.0005, shift: int = 1) -> DataFrame:
    """Long/flat with everything invested: signals act at the next open. Adds position, ret, equity."""
    acted = F.coalesce(F.lag(signal, shift).over(S.by_symbol()), F.lit(0)) if shift else F.col(signal)
    x = df.withColumn("_a", acted)
    state = F.last(F.when(F.col("_a") > 0, 1).when(F.col("_a") < 0, 0), ignorenulls=True).over(S.running())
    return _core(x.withColumn("position", F.coalesce(state, F.lit(0))).drop("_a"), capital, commission, slippage)


def desired(df: DataFrame, column: str, capital: float = 10_000.0, commission: float = 0.001, slippage: float = 0.0005, shift: int = 1) -> DataFrame:
    """As ``fractional``, for a desired position (clipped to 0..1; null is 0), held one bar later."""
    p = F.least(F.greatest(F.coalesce(F.lag(column, shift).over(S.by_symbol()), F.lit(0)), F.lit(0)), F.lit(1))
    return _core(df.withColumn("position", p), capital, commission, slippage)


def _core(x: DataFrame, capital: float, k: float, s: float) -> DataFrame:
    before = F.coalesce(F.lag("position").over(S.by_symbol()), F.lit(0))
    last = F.lag("close").over(S.by_symbol())
    m = (
        F.when((F.col("position") == 1) & (before != 1), F.try_divide(F.col("close"), F.col("open") * (1 + s) * (1 + k)))
        .when((F.col("position") == 1) & (before == 1), F.try_divide(F.col("close"), last))
        .when((F.col("position") != 1) & (before == 1), F.try_divide(F.col("open") * (1 - s) * (1 - k), last))
        .otherwise(F.lit(1.0))
    )
    x = x.withColumn("_m", F.coalesce(m, F.lit(1.0)))
    return x.withColumn("ret", F.col("_m") - 1).withColumn("equity", capital * _path(F.col("_m"))).drop("_m")


def exposure(
    df: DataFrame, column: str, capital: float = 10_000.0, commission: float = 0.001, slippage: float = 0.0005, risk_free: float = 0.0, periods: int = 252,
    clip: bool = True, keys: tuple[str, ...] = ("symbol",), cost: Column | None = None, price: str = "close",
) -> DataFrame:
    """Returns in proportion to an exposure set one bar before; cash earns the risk-free rate; changes
    cost commission + slippage (or ``cost``). clip=False allows shorts. Adds position, turnover, ret, equity."""
    w = S.by_symbol(*keys)
    e = F.coalesce(F.lag(column).over(w), F.lit(0.0))
    e = F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0)) if clip else e
    x = df.withColumn("position", e).withColumn("_r", F.coalesce(F.try_divide(F.col(price), F.lag(price).over(w)) - 1, F.lit(0.0)))
    x = x.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    fee = F.lit(commission + slippage) if cost is None else cost
    idle = (1 - F.abs("position")) if not clip else (1 - F.col("position"))
    x = x.withColumn("ret", F.col("position") * F.col("_r") + idle * (risk_free / periods) - fee * F.col("turnover"))
    return x.withColumn("equity", capital * _path(1 + F.col("ret"), *keys)).drop("_r")


def positions(p: Column, mode: str = "binary", threshold: float | Column = 0.5, short: bool = False, most: float = 1.0) -> Column:
    """Probabilities to positions: binary, proportional or confidence; null stays null."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    if mode == "binary":
        out = F.when(p > threshold, 1.0).when(F.lit(short) & (p < 1 - threshold), -1.0).otherwise(0.0)
    elif mode == "proportional":
        out = clip((p - threshold) / (1 - threshold)) - (clip((1 - threshold - p) / threshold) if short else F.lit(0.0))
    elif mode == "confidence":
        size = clip(2 * F.abs(p - 0.5))
        out = size * F.when(p > threshold, 1.0).when(F.lit(short) & (p < 1 - threshold), -1.0).otherwise(0.0)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(p.isNotNull(), out * most)


def whole_share(df: DataFrame, signal: str = "signal", capital: float = 10_000.0, commission: float = 0.001, slippage: float = 0.0005, shift: int = 1) -> tuple[DataFrame, DataFrame]:
    """(bars with cash, shares, equity; trades). A buy that can't afford one share leaves the state
    flat, so later buys are tried again; an open position at the end is no trade."""
    acted = F.coalesce(F.lag(signal, shift).over(S.by_symbol()), F.lit(0)) if shift else F.col(signal)
    x = S.with_pos(df).withColumn("_a", acted.cast("int"))
    price = F.col("open") if shift else F.col("close")
    orders = x.where("_a != 0").select("symbol", "pos", F.col("_a").alias("a"), price.cast("double").alias("o"), "ts")
    on_workers(df.sparkSession)
    kinds = {"symbol": df.schema["symbol"].dataType, "ts": df.schema["ts"].dataType}
    schema = T.StructType([
        T.StructField("symbol", kinds["symbol"]), *[T.StructField(c, t) for c, t in (("pos", T.LongType()), ("cash", T.DoubleType()), ("sh", T.LongType()))],
        *[T.StructField(c, t) for c, t in (("entry_ts", kinds["ts"]), ("exit_ts", kinds["ts"]), ("entry_price", T.DoubleType()), ("exit_price", T.DoubleType()), ("shares", T.LongType()), ("holding_period", T.LongType()))],
    ])

    def run(batches):
        """A stream over ordered orders; the state is one position, and each change of it is a row."""
        now, cash, sh, entry = object(), capital, 0, None
        for b in batches:
            changes = []
            for i, (symbol, pos, a, o) in enumerate(zip(*[b.column(c).to_pylist() for c in ("symbol", "pos", "a", "o")], strict=True)):
                if symbol != now:
                    now, cash, sh, entry = symbol, capital, 0, None
                if o is None:
                    continue
                buy, sell = o * (1 + slippage), o * (1 - slippage)
                if a > 0 and sh == 0 and cash >= buy * (1 + commission):
                    sh = math.floor(cash / (buy * (1 + commission)))
                    cash -= sh * (buy * (1 + commission))
                    entry = (b.column("ts")[i].as_py(), buy, pos)
                    changes.append((symbol, pos, cash, sh, None, None, None, None, None, None))
                elif a < 0 and sh > 0:
                    cash += sh * o * (1 - slippage) * (1 - commission)
                    changes.append((symbol, pos, cash, 0, entry[0], b.column("ts")[i].as_py(), entry[1], sell, sh, pos - entry[2]))
                    sh, entry = 0, None
            fields = to_arrow_schema(schema)
            cols = zip(*changes, strict=True) if changes else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=fields)

    done = orders.repartition("symbol").sortWithinPartitions("symbol", "pos").mapInArrow(run, schema)
    log = done.select("symbol", "pos", "cash", "sh")
    bars = x.drop("_a").join(log, ["symbol", "pos"], "left")
    cash = F.coalesce(F.last("cash", ignorenulls=True).over(S.running()), F.lit(float(capital)))
    shares = F.coalesce(F.last("sh", ignorenulls=True).over(S.running()), F.lit(0))
    bars = bars.withColumn("cash", cash).withColumn("shares", shares.cast("long")).drop("sh", "pos").withColumn("equity", F.col("cash") + F.col("shares") * F.col("close"))
    fees = (F.col("entry_price") + F.col("exit_price")) * F.col("shares") * commission
    trades = done.where("exit_ts IS NOT NULL").select(
        "symbol", "entry_ts", "exit_ts", "entry_price", "exit_price", "shares", F.round((F.col("exit_price") - F.col("entry_price")) * F.col("shares") - fees, 2).alias("pnl"),
        F.round(F.col("exit_price") / F.col("entry_price") - 1, 6).alias("return_pct"), "holding_period",
    )
    return bars, trades


def grid(df: DataFrame, points: list[dict[str, float]]) -> DataFrame:
    """Each row once for every grid point, its values as columns, numbered by grid_id."""
    rows = F.array(*[F.struct(F.lit(i).alias("grid_id"), *[F.lit(float(v)).alias(k) for k, v in p.items()]) for i, p in enumerate(points)])
    return df.withColumn("_g", F.explode(rows)).select("*", "_g.*").drop("_g")


def cost_sweep(df: DataFrame, probability: str, thresholds: list[float], costs: list[float], periods: int = 252, capital: float = 10_000.0) -> DataFrame:
    """Sharpe ratio, final equity and turnover of thresholded positions at each (threshold, cost)."""
    points = [{"threshold": t, "cost": c} for t in thresholds for c in costs]
    keys = ("grid_id", "symbol")
    x = grid(df, points).withColumn("_e", F.when(F.col(probability) > F.col("threshold"), 1.0).otherwise(0.0))
    x = exposure(x, "_e", capital, periods=periods, keys=keys, cost=F.col("cost"))
    sd = F.stddev_samp("ret")
    return x.groupBy(*keys, "threshold", "cost").agg(
        F.when(sd > 0, F.avg("ret") / sd * periods**0.5).otherwise(0.0).alias("sharpe"), F.max_by("equity", "ts").alias("final_equity"), F.sum("turnover").alias("turnover")
    )


def best_threshold(sweep: DataFrame, metric: str = "sharpe") -> DataFrame:
    """Per symbol: the threshold of the greatest metric (to nine digits), the lower one of equals."""
    mean = sweep.groupBy("symbol", "threshold").agg(F.avg(metric).alias(metric))
    return mean.groupBy("symbol").agg(F.max_by("threshold", F.struct(F.round(metric, 9), -F.col("threshold"))).alias("threshold"), F.max(metric).alias(metric))


def versus(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Metrics rows (symbol, sharpe, max_drawdown ...) against a benchmark's, with edge and beats."""
    b = benchmark.select("symbol", F.col("sharpe").alias("bench_sharpe"), F.col("max_drawdown").alias("bench_drawdown"))
    x = strategy.join(b, "symbol").withColumn("sharpe_edge", F.col("sharpe") - F.col("bench_sharpe"))
    return x.withColumn("beats", (F.col("sharpe_edge") > 0) & (F.col("max_drawdown") <= F.col("bench_drawdown") + 1e-12))


