"""Technical indicators on bars (symbol, ts, open, high, low, close, volume): 15 features, 26 columns.

All are windows over (symbol, ts) or block-wise recurrences (functions.series); frames that aren't
full give null. ``FEATURES`` names them; ``register`` adds a feature of one's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import series as S


def change(p: int = 1, c: str = "close") -> Column:
    return F.try_divide(F.col(c), F.lag(c, p).over(S.by_symbol())) - 1


def returns(df: DataFrame, periods: int = 1) -> DataFrame:
    return df.withColumn("returns", change(periods))


def log_returns(df: DataFrame, periods: int = 1) -> DataFrame:
    return df.withColumn("log_returns", F.ln(F.try_divide(F.col("close"), F.lag("close", periods).over(S.by_symbol()))))


def sma(df: DataFrame, window: int = 20) -> DataFrame:
    return df.withColumn("sma", S.full(F.col("close"), F.avg("close"), window))


def _with(df: DataFrame, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return add(S.with_pos(df)).drop("pos")


def ema(df: DataFrame, span: int = 20) -> DataFrame:
    return _with(df, lambda d: S.ema(d, {"ema": (F.col("close"), S.span(span))}))


def weighted(c: str, n: int) -> Column:
    """Linear weights, the newest heaviest; null until n rows."""
    total = F.lit(0.0)
    for j in range(n):
        total = total + F.lag(c, j).over(S.by_symbol()) * (n - j)
    return total / (n * (n + 1) / 2)


def wma(df: DataFrame, window: int = 20) -> DataFrame:
    return df.withColumn("wma", weighted("close", window))


def hma(df: DataFrame, window: int = 20) -> DataFrame:
    half, root = max(window // 2, 1), max(int(math.sqrt(window)), 1)
    return df.withColumn("_raw", 2 * weighted("close", half) - weighted("close", window)).withColumn("hma", weighted("_raw", root)).drop("_raw")


def rsi(df: DataFrame, period: int = 14) -> DataFrame:
    d = F.col("close") - F.lag("close").over(S.by_symbol())
    df = S.with_pos(df).withColumn("_d", d).withColumn("_up", F.greatest("_d", F.lit(0.0))).withColumn("_down", F.greatest(-F.col("_d"), F.lit(0.0)))
    df = df.withColumn("_up", F.when(F.col("_d").isNotNull(), F.col("_up"))).withColumn("_down", F.when(F.col("_d").isNotNull(), F.col("_down")))
    df = S.ema(df, {"_g": (F.col("_up"), 1 / period), "_l": (F.col("_down"), 1 / period)}, first=1)
    value = F.when(F.col("_l") == 0, F.when(F.col("_g") > 0, 100.0)).otherwise(100 - 100 / (1 + F.try_divide(F.col("_g"), F.col("_l"))))
    return df.withColumn("rsi", F.when(F.col("pos") >= period, value)).drop("pos", "_d", "_up", "_down", "_g", "_l")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = S.ema(S.with_pos(df), {"_f": (F.col("close"), S.span(fast)), "_s": (F.col("close"), S.span(slow))})
    df = S.ema(df.withColumn("macd_macd", F.col("_f") - F.col("_s")), {"macd_signal": (F.col("macd_macd"), S.span(signal))})
    return df.withColumn("macd_histogram", F.col("macd_macd") - F.col("macd_signal")).drop("pos", "_f", "_s")


def bollinger_bands(df: DataFrame, window: int = 20, n_std: float = 2.0) -> DataFrame:
    mid, sd = S.full(F.col("close"), F.avg("close"), window), S.full(F.col("close"), F.stddev_samp("close"), window)
    return df.withColumn("bollinger_bands_middle", mid).withColumn("bollinger_bands_upper", mid + n_std * sd).withColumn("bollinger_bands_lower", mid - n_std * sd)


def true_range() -> Column:
    before = F.lag("close").over(S.by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(df: DataFrame, period: int = 14) -> DataFrame:
    df = S.ema(S.with_pos(df).withColumn("_tr", true_range()), {"atr": (F.col("_tr"), 1 / period)})
    return df.withColumn("atr", F.when(F.col("pos") >= period - 1, F.col("atr"))).drop("pos", "_tr")


def volatility(df: DataFrame, window: int = 20) -> DataFrame:
    df = df.withColumn("_r", change())
    return df.withColumn("volatility", S.full(F.col("_r"), F.stddev_samp("_r"), window)).drop("_r")


def rolling_stats(df: DataFrame, window: int = 20) -> DataFrame:
    """Mean, deviation and bias-corrected skewness and excess kurtosis of the returns."""
    n = window
    df = df.withColumn("_r", change())
    g1, g2 = S.full(F.col("_r"), F.skewness("_r"), n), S.full(F.col("_r"), F.kurtosis("_r"), n)
    return (
        df.withColumn("rolling_stats_rolling_mean", S.full(F.col("_r"), F.avg("_r"), n))
        .withColumn("rolling_stats_rolling_std", S.full(F.col("_r"), F.stddev_samp("_r"), n))
        .withColumn("rolling_stats_rolling_skew", g1 * math.sqrt(n * (n - 1)) / (n - 2))
        .withColumn("rolling_stats_rolling_kurtosis", (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
        .drop("_r")
    )


def volume_features(df: DataFrame, window: int = 20) -> DataFrame:
    avg = S.full(F.col("volume"), F.avg("volume"), window)
    flow = F.coalesce(F.signum(F.col("close") - F.lag("close").over(S.by_symbol())) * F.col("volume"), F.lit(0.0))
    df = df.withColumn("_flow", flow).withColumn("volume_features_volume_sma", avg)
    return df.withColumn("volume_features_volume_ratio", F.try_divide(F.col("volume"), F.col("volume_features_volume_sma"))).withColumn("volume_features_obv", F.sum("_flow").over(S.running())).drop("_flow")


def price_direction(df: DataFrame) -> DataFrame:
    """1 if the close rose, else 0; 0 also on a series' first row."""
    return df.withColumn("price_direction", F.coalesce((F.col("close") > F.lag("close").over(S.by_symbol())).cast("tinyint"), F.lit(0).cast("tinyint")))


def price_features(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("price_features_high_low_range", F.col("high") - F.col("low"))
        .withColumn("price_features_close_open_range", F.col("close") - F.col("open"))
        .withColumn("price_features_gap", F.col("open") - F.lag("close").over(S.by_symbol()))
    )


@dataclass(frozen=True)
class Feature:
    """A named DataFrame -> DataFrame step with parameters; ``with_params`` leaves the registry alone."""

    name: str
    add: Callable[..., DataFrame]
    outputs: tuple[str, ...]
    params: dict = field(default_factory=dict)

    def with_params(self, **params) -> Feature:
        return replace(self, params={**self.params, **params})

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.add(df, **self.params)


def _subs(name: str, *subs: str) -> tuple[str, ...]:
    return tuple(f"{name}_{s}" for s in subs) or (name,)


FEATURES: dict[str, Feature] = {
    f.__name__: Feature(f.__name__, f, outs)
    for f, outs in (
        (returns, ("returns",)), (log_returns, ("log_returns",)), (sma, ("sma",)), (ema, ("ema",)), (wma, ("wma",)), (hma, ("hma",)), (rsi, ("rsi",)),
        (macd, _subs("macd", "macd", "signal", "histogram")), (bollinger_bands, _subs("bollinger_bands", "upper", "middle", "lower")), (atr, ("atr",)),
        (volatility, ("volatility",)), (rolling_stats, _subs("rolling_stats", "rolling_mean", "rolling_std", "rolling_skew", "rolling_kurtosis")),
        (volume_features, _subs("volume_features", "volume_sma", "volume_ratio", "obv")), (price_direction, ("price_direction",)),
        (price_features, _subs("price_features", "high_low_range", "close_open_range", "gap")),
    )
}


def register(name: str, outputs: tuple[str, ...] | None = None, **params):
    """Decorator: adds fn(df, **params) -> df to FEATURES."""

    def add(fn: Callable[..., DataFrame]):
        FEATURES[name] = Feature(name, fn, outputs or (name,), params)
        return fn

    return add


REQUIRED = ("symbol", "ts", "open", "high", "low", "close", "volume")


def compute(bars: DataFrame, features: list[str | Feature] | None = None, drop_incomplete: bool = False) -> DataFrame:
    """Adds the named features (all by default)."""
    missing = [c for c in REQUIRED if c not in bars.columns]
    if missing:
        raise ValueError(f"bars lack columns: {', '.join(missing)}")
    outputs: list[str] = []
    for f in features or list(FEATURES):
        f = FEATURES[f] if isinstance(f, str) else f
        bars = f(bars)
        outputs += f.outputs
    return bars.dropna(subset=outputs) if drop_incomplete else bars
