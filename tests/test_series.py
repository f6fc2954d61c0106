"""Recurrences and indicators against pandas."""

import numpy as np
import pandas as pd
import pytest

from millrace.functions import series as S
from millrace.operators import indicators as I


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(5)
    out = []
    for s in ("a", "b"):
        c = 100 + np.cumsum(rng.normal(0, 1, 900))
        out.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=900, freq="min"), "open": c - 0.1, "high": c + 0.5, "low": c - 0.5, "close": c, "volume": rng.integers(1, 90, 900).astype(float)}))
    return pd.concat(out)


def series(df, column, symbol="a"):
    return df.where(f"symbol = '{symbol}'").orderBy("ts").toPandas()[column].astype(float).to_numpy()


def test_ema_over_many_blocks(spark, walk):
    df = S.with_pos(spark.createDataFrame(walk))
    from pyspark.sql import functions as F

    for block in (7, 64, 256):
        got = S.discounted(df, {"x": (F.col("close"), 0.9)}, block=block)
        want = walk[walk.symbol == "a"].close.ewm(alpha=0.1, adjust=True).mean().to_numpy() * ((1 - 0.9 ** np.arange(1, 901)) / 0.1)
        np.testing.assert_allclose(series(got, "x"), want, rtol=1e-12)


def test_indicators_equal_pandas(spark, walk):
    df = I.compute(spark.createDataFrame(walk), ["ema", "rsi", "atr", "macd", "rolling_stats"]).cache()
    p = walk[walk.symbol == "b"].reset_index(drop=True)
    np.testing.assert_allclose(series(df, "ema", "b"), p.close.ewm(span=20, adjust=False).mean(), rtol=1e-12)
    d = p.close.diff()
    up, down = (x.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for x in (d.clip(lower=0), (-d).clip(lower=0)))
    np.testing.assert_allclose(series(df, "rsi", "b"), 100 - 100 / (1 + up / down), rtol=1e-9)
    r = p.close.pct_change()
    np.testing.assert_allclose(series(df, "rolling_stats_rolling_skew", "b"), r.rolling(20).skew(), rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(series(df, "rolling_stats_rolling_kurtosis", "b"), r.rolling(20).kurt(), rtol=1e-6, atol=1e-8)


def test_ewm_deviation_skips_gaps(spark, walk):
    from pyspark.sql import functions as F

    df = S.with_pos(spark.createDataFrame(walk)).withColumn("x", F.when(F.col("pos") % 9 != 0, F.col("close")))
    got = series(S.ewm_std(df, "sd", F.col("x"), 50, 10), "sd")
    x = walk[walk.symbol == "a"].close.where(np.arange(900) % 9 != 0)
    np.testing.assert_allclose(got, x.ewm(span=50, min_periods=10).std(), rtol=1e-7)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="close"):
        I.compute(spark.createDataFrame([("a", 1)], "symbol string, ts int"))


def test_all_features_read_the_bars_once(spark, walk, tmp_path):
    spark.createDataFrame(walk).write.parquet(str(tmp_path / "bars"))
    plan = I.compute(spark.read.parquet(str(tmp_path / "bars")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_unlike_rates_in_one_call(spark, walk):
    from pyspark.sql import functions as F

    df = S.discounted(S.with_pos(spark.createDataFrame(walk)), {"x": (F.col("close"), 0.999), "y": (F.col("close"), 0.01), "z": (F.col("close"), 0.0)})
    c = walk[walk.symbol == "a"].close
    np.testing.assert_allclose(series(df, "z"), c, rtol=1e-12)
    for name, q in (("x", 0.999), ("y", 0.01)):
        np.testing.assert_allclose(series(df, name), c.ewm(alpha=1 - q, adjust=True).mean().to_numpy() * ((1 - q ** np.arange(1, 901)) / (1 - q)), rtol=1e-10)
