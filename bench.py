"""Times headline queries: one JSON line {"metric", "value", "unit", "queries", "sf"}.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query is written to a no-op sink, so that all its rows are made. Besides the registered queries, some
run at the published sizes of the baseline: a fractional and a whole-share backtest, and the feature
set, over 503,363 one-minute bars; features, labels, weights and folds of one horizon over 406,535.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from millrace.operators import indicators, runs, simulate
from millrace.plans import registry
from millrace.session import session

HEADLINE = [
    "ohlcv_resample", "sma_wma_hma", "ema_macd", "rsi_wilder", "rolling_moments", "session_resample", "sig_ema_cross", "sim_fractional", "sim_whole_share", "metrics_report", "cost_sweep",
    "flight_turnaround", "flight_peak", "trading_day_join", "asof_next_event", "triple_barrier", "uniqueness", "purged_kfold", "pbo", "upsert_keep_last",
]
MINUTES, HORIZON = 503_363, 406_535
FIRST = 1_700_000_000 // 86400 * 86400


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(
        "bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(df) -> float:
        began = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    timed(lambda: registry.QUERIES["ohlcv_resample"](spark, sf))  # starts the executor and reads the files once
    took = {name: timed(lambda name=name: registry.QUERIES[name](spark, sf)) for name in HEADLINE}

    day = F.expr("id div 390")
    at = F.timestamp_seconds(FIRST + 52_200 + day * 86400 + F.pmod("id", F.lit(390)) * 60)
    close = 100 + 20 * F.sin(F.col("id") / 5000) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    bars = spark.range(MINUTES).select(F.lit("x").alias("symbol"), at.alias("ts"), close.alias("open"), (close + 0.5).alias("high"), (close - 0.5).alias("low"), close.alias("close"), F.lit(100.0).alias("volume"), F.when(F.col("id") % 97 == 0, 1).when(F.col("id") % 97 == 50, -1).otherwise(0).alias("signal"))
    bars = bars.cache()
    bars.count()
    took["backtest_503k_bars"] = timed(lambda: simulate.fractional(bars))
    took["whole_share_503k_bars"] = timed(lambda: simulate.whole_share(bars)[0])
    took["horizon_406k_bars"] = timed(lambda: runs.multi_horizon(bars.where(F.col("ts") < F.timestamp_seconds(F.lit(FIRST + HORIZON // 390 * 86400 + 52_200 + HORIZON % 390 * 60))), ("1min",)))
    took["features_503k_bars"] = timed(lambda: indicators.compute(bars))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
