"""Trading signals on bars: 1 buy, -1 sell, 0 hold. State machines are last-known-state windows."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import series as S
from millrace.operators import bars as B


class Strategy(ABC):
    """A strategy adds ``signal`` to bars; ``needs`` names the columns that it reads."""

    needs: tuple[str, ...] = ("symbol", "ts", "close")

    def signals(self, bars: DataFrame) -> DataFrame:
        missing = [c for c in self.needs if c not in bars.columns]
        if missing:
            raise ValueError(f"{type(self).__name__} needs columns: {', '.join(missing)}")
        return self._signals(bars)

    @abstractmethod
    def _signals(self, bars: DataFrame) -> DataFrame: ...

    @property
    def parameters(self) -> dict:
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}


class EMACrossover(Strategy):
    """Sign changes of fast minus slow exponential average, the first move included."""

    def __init__(self, fast: int = 12, slow: int = 26):
        if not 0 < fast < slow:
            raise ValueError("0 < fast < slow")
        self.fast, self.slow = fast, slow

    def _signals(self, bars: DataFrame) -> DataFrame:
        x = S.ema(S.with_pos(bars), {"_f": (F.col("close"), S.span(self.fast)), "_s": (F.col("close"), S.span(self.slow))})
        x = x.withColumn("_p", F.signum(F.col("_f") - F.col("_s")))
        move = F.signum(F.col("_p") - F.lag("_p").over(S.by_symbol()))
        return x.withColumn("signal", F.coalesce(move, F.lit(0.0)).cast("int")).drop("_f", "_s", "_p", "pos")


class MeanReversion(Strategy):
    """Enter below mean - entry x deviation, leave above mean - exit x deviation, from row ``lookback`` on."""

    def __init__(self, lookback: int = 20, entry: float = 2.0, exit: float = 0.5):
        if lookback < 2 or entry <= exit:
            raise ValueError("lookback >= 2 and entry > exit")
        self.lookback, self.entry, self.exit = lookback, entry, exit

    def _signals(self, bars: DataFrame) -> DataFrame:
        w = S.trailing(self.lookback)
        mean, sd = F.avg("close").over(w), F.stddev_samp("close").over(w)
        state = F.when(F.col("pos") >= self.lookback, F.when(F.col("close") < mean - self.entry * sd, 1).when(F.col("close") > mean - self.exit * sd, 0))
        x = S.with_pos(bars).withColumn("_s", state)
        x = x.withColumn("_s", F.coalesce(F.last("_s", ignorenulls=True).over(S.running()), F.lit(0)))
        return x.withColumn("signal", F.col("_s") - F.lag("_s", 1, 0).over(S.by_symbol())).drop("_s", "pos")


def expanding_quantile(df: DataFrame, column: str, q: float, name: str, least: int = 1) -> DataFrame:
    """Exact linear quantile of all values so far in (symbol, ts) order, once there are ``least``.

    A stream over the partition's ordered rows with two heaps, one of the values below the quantile and
    one of those above: a row costs the logarithm of those before it. Memory holds one symbol's values;
    a symbol is one task, since each row depends on all before it. Nulls are skipped.
    """
    import pyarrow as pa

    from millrace.functions.workers import on_workers

    on_workers(df.sparkSession)
    names = df.columns

    def run(batches):
        from heapq import heappop, heappush, heappushpop

        now, low, high = object(), [], []  # low: negated, its top is the value at the quantile's rank
        for b in batches:
            out = []
            for s, x in zip(b.column("symbol").to_pylist(), b.column(column).to_pylist(), strict=True):
                if s != now:
                    now, low, high = s, [], []
                if x is not None:
                    heappush(high, -heappushpop(low, -x))
                n = len(low) + len(high)
                if n < max(least, 1):
                    out.append(None)
                    continue
                at = q * (n - 1)
                while len(low) < int(at) + 1:
                    heappush(low, -heappop(high))
                while len(low) > int(at) + 1:
                    heappush(high, -heappop(low))
                a = -low[0]
                out.append(a + (high[0] - a) * (at - int(at)) if high else a)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*names, name])

    from pyspark.sql import types as T

    ordered = df.repartition("symbol").sortWithinPartitions("symbol", "ts")
    return ordered.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


class Momentum(Strategy):
    """Buy when the lookback return reaches the expanding quantile (itself included), sell when it is negative."""

    def __init__(self, lookback: int = 20, top: float = 0.2):
        if lookback < 1 or not 0 < top < 1:
            raise ValueError("lookback >= 1 and 0 < top < 1")
        self.lookback, self.top = lookback, top

    def _signals(self, bars: DataFrame) -> DataFrame:
        x = bars.withColumn("_r", F.try_divide(F.col("close"), F.lag("close", self.lookback).over(S.by_symbol())) - 1)
        x = expanding_quantile(x, "_r", 1 - self.top, "_t")
        return x.withColumn("signal", F.when(F.col("_r") < 0, -1).when(F.col("_r") >= F.col("_t"), 1).otherwise(0)).drop("_r", "_t")


def voltarget_exposure(bars: DataFrame, span: int = 22, q: float = 0.5, least: int = 60) -> DataFrame:
    """Adds exposure: yesterday's forecast of daily volatility against its expanding quantile, 0 to 1;
    1 until there are ``least`` forecasts. One row a day is forecast, then joined to the bars."""
    daily = B.realised_volatility(bars).withColumnRenamed("day", "ts")
    x = S.ewm_mean(S.with_pos(daily.withColumn("rv", F.coalesce("rv", F.lit(0.0)))), "_e", F.col("rv"), span)
    x = x.withColumn("_p", F.lag("_e").over(S.by_symbol())).select("symbol", "ts", "_p")
    x = expanding_quantile(x, "_p", q, "_t", least)
    ratio = F.try_divide(F.col("_t"), F.col("_p"))  # greatest() and least() skip nulls
    e = F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    return bars.withColumn("day", F.to_date("ts")).join(x.select("symbol", F.col("ts").alias("day"), e.alias("exposure")), ["symbol", "day"], "left").drop("day")


class VolatilityTarget(Strategy):
    """Buys when the exposure reaches one half, sells when it falls below."""

    def __init__(self, span: int = 22, q: float = 0.5, least: int = 60):
        self.span, self.q, self.least = span, q, least

    def _signals(self, bars: DataFrame) -> DataFrame:
        x = voltarget_exposure(bars, self.span, self.q, self.least).withColumn("_l", (F.col("exposure") >= 0.5).cast("int"))
        return x.withColumn("signal", F.col("_l") - F.lag("_l", 1, 0).over(S.by_symbol())).drop("_l", "exposure")


class BuyAndHold(Strategy):
    def _signals(self, bars: DataFrame) -> DataFrame:
        return S.with_pos(bars).withColumn("signal", F.when(F.col("pos") == 0, 1).otherwise(0)).drop("pos")


def naive_positions(bars: DataFrame) -> DataFrame:
    """Desired positions 0/1: reversal and momentum by the session return's sign, trend by two averages."""
    r = B.session_return()
    fast, slow = S.full(F.col("close"), F.avg("close"), 5), S.full(F.col("close"), F.avg("close"), 30)
    x = bars.withColumn("day", F.to_date("ts")).withColumn("_r", F.coalesce(r, F.lit(0.0)))
    return x.select(
        *bars.columns, (F.col("_r") < 0).cast("int").alias("reversal"), (F.col("_r") > 0).cast("int").alias("momentum"), F.coalesce((fast > slow).cast("int"), F.lit(0)).alias("trend")
    )


def global_quantile_exposure(daily: DataFrame, column: str, q: float) -> DataFrame:
    """Exposure against the quantile of the whole history: it looks ahead, kept for contrast."""
    target = daily.groupBy("symbol").agg(F.percentile(column, F.lit(q)).alias("_t"))
    ratio = F.try_divide(F.col("_t"), F.col(column))
    e = F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))
    return daily.join(target, "symbol").withColumn("exposure", e).drop("_t")


def held(signal: str = "signal") -> Column:
    """The position after each signal: 1 after a buy, 0 after a sell."""
    return F.coalesce(F.last(F.when(F.col(signal) > 0, 1).when(F.col(signal) < 0, 0), ignorenulls=True).over(S.running()), F.lit(0))


def runs(df: DataFrame, position: str) -> DataFrame:
    """(symbol, run, length) of each unbroken time in the market."""
    on = F.col(position) > 0
    start = (on & ~F.coalesce(F.lag(on).over(S.by_symbol()), F.lit(False))).cast("int")
    x = df.withColumn("_on", on).withColumn("_start", start).withColumn("run", F.sum("_start").over(S.running()))
    return x.where("_on").groupBy("symbol", "run").agg(F.count(F.lit(1)).alias("length"))

