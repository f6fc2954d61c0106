"""Whole runs over many symbols at once: backtests, prediction backtests, joined data, horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import series as S
from millrace.operators import align as A
from millrace.operators import bars as B
from millrace.operators import indicators as I
from millrace.operators import labels as L
from millrace.operators import metrics as M
from millrace.operators import research as R
from millrace.operators import simulate as X
from millrace.operators.strategies import Strategy


def backtest(strategy: Strategy, bars: DataFrame, periods: int | None = None, interval: str | None = None, risk_free: float = 0.0, **costs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars with equity, trades, one row of metrics a symbol): signals act at the next open in whole
    shares; alpha and beta are against holding the symbol itself."""
    periods = B.resolve_periods(periods, interval, bars)
    out, trades = X.whole_share(strategy.signals(bars), **costs)
    change = lambda c: F.try_divide(F.col(c), F.lag(c).over(S.by_symbol())) - 1
    out = out.withColumn("ret", F.coalesce(change("equity"), F.lit(0.0))).withColumn("bench_ret", change("close"))
    metrics = M.performance(out, periods, risk_free, benchmark="bench_ret", skip_first=True)
    final = out.groupBy("symbol").agg(F.max_by("equity", "ts").alias("final_capital"))
    return out, trades, metrics.join(final, "symbol").join(M.trade_report(trades), "symbol", "left").na.fill(0, ["n_trades"])


def backtest_predictions(
    df: DataFrame, probability: str, periods: int, threshold: float | Column = 0.5, mode: str = "binary", short: bool = False, most: float = 1.0, commission: float = 0.001,
    slippage: float = 0.0005, capital: float = 100_000.0, risk_free: float = 0.04, keys: tuple[str, ...] = ("symbol",), price: str = "close",
) -> DataFrame:
    """Per key: strat_ and bench_ metrics, sharpe_edge, beats. Null probabilities are flat; the benchmark
    is fully invested throughout and goes through the same simulator, in the same job."""
    p = F.coalesce(X.positions(F.col(probability), mode, threshold, short, most), F.lit(0.0))
    x = df.withColumn("_p", p).withColumn("run", F.explode(F.array(F.lit("strat"), F.lit("bench"))))
    x = x.withColumn("_p", F.when(F.col("run") == "bench", 1.0).otherwise(F.col("_p")))
    by = ("run", *keys)
    x = X.exposure(x, "_p", capital, commission, slippage, risk_free, periods, clip=False, keys=by, price=price)
    w = Window.partitionBy(*by).orderBy("ts")
    # returns of the equity itself, from the second bar on, as of any equity curve
    x = x.withColumn("ret", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1)
    m = M.performance(x, periods, risk_free, keys=by, skip_first=True).join(M.position_stats(x, keys=by), list(by))
    values = ["total_return", "cagr", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar", "exposure", "entries", "turnover_per_day", "entries_per_day"]
    of = lambda run, v: F.max(F.when(F.col("run") == run, F.col(v))).alias(f"{run}_{v}")
    out = m.groupBy(*keys).agg(*[of(run, v) for run in ("strat", "bench") for v in values])
    out = out.withColumn("sharpe_edge", F.col("strat_sharpe") - F.col("bench_sharpe"))
    return out.withColumn("beats", (F.col("sharpe_edge") > 0) & (F.col("strat_max_drawdown") <= F.col("bench_max_drawdown") + 1e-12))


def tune_threshold(df: DataFrame, probability: str, periods: int, candidates: tuple[float, ...] = (0.50, 0.52, 0.55, 0.58, 0.60), objective: str = "sharpe_edge", **options) -> tuple[DataFrame, DataFrame]:
    """(best threshold a symbol, all candidates' rows): the greatest edge over the benchmark, or Sharpe
    ratio, to nine digits; of equals the lower threshold. One job over the grid."""
    if objective not in ("sharpe_edge", "sharpe") or not candidates:
        raise ValueError("objective is sharpe_edge or sharpe, and there must be candidates")
    grid = X.grid(df, [{"threshold": t} for t in candidates])
    table = backtest_predictions(grid, probability, periods, threshold=F.col("threshold"), keys=("threshold", "symbol"), **options)
    value = F.col("sharpe_edge" if objective == "sharpe_edge" else "strat_sharpe")
    best = table.groupBy("symbol").agg(F.max_by("threshold", F.struct(F.round(value, 9), -F.col("threshold"))).alias("threshold"), F.max(F.round(value, 9)).alias(objective))
    return best, table


def cost_points(df: DataFrame, probability: str, periods: int, costs: dict[str, tuple[float, float]], **options) -> DataFrame:
    """Per cost point (commission, slippage): means over the symbols, and how many beat the benchmark."""
    one = lambda name, cost: backtest_predictions(df, probability, periods, commission=cost[0], slippage=cost[1], **options).select(F.lit(name).alias("cost"), F.lit(2e4 * (cost[0] + cost[1])).alias("round_trip_bps"), "*")
    table = None
    for name, cost in costs.items():
        table = one(name, cost) if table is None else table.unionByName(one(name, cost))
    means = {"strat_sharpe": "strat_sharpe", "bench_sharpe": "bench_sharpe", "sharpe_edge": "sharpe_edge", "max_drawdown": "strat_max_drawdown", "trades_per_day": "strat_entries_per_day", "exposure": "strat_exposure"}
    return table.groupBy("cost", "round_trip_bps").agg(*[F.avg(c).alias(n) for n, c in means.items()], F.count_if("beats").alias("beats"))


def evaluate_slices(df: DataFrame, slices: dict[str, tuple[str, str]], periods: int, risk_free: float = 0.0, ret: str = "ret", asset: str = "asset_ret", position: str = "position") -> DataFrame:
    """Per (slice, symbol): metrics of a finished simulation between two days, inclusive; a bar lies in
    every slice that holds it."""
    within = [F.when(F.to_date("ts").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, (a, b) in slices.items()]
    x = df.withColumn("slice", F.explode(F.filter(F.array(*within), lambda n: n.isNotNull())))
    keys = ["slice", "symbol"]
    before = F.coalesce(F.lag(position).over(Window.partitionBy(*keys).orderBy("ts")), F.col(position))
    x = x.withColumn("_t", F.abs(F.col(position) - before))
    beta = F.when(F.var_samp(asset) > 0, F.covar_samp(ret, asset) / F.var_samp(asset)).otherwise(0.0)
    more = x.groupBy(*keys).agg(
        F.avg(position).cast("double").alias("exposure"), (F.sum("_t") / F.count_distinct(F.to_date("ts"))).alias("turnover_per_day"), (F.stddev_samp(ret) * periods**0.5).alias("ann_vol"),
        beta.alias("beta"), F.when(F.var_samp(asset) > 0, (F.avg(ret) - beta * F.avg(asset)) * periods).otherwise(0.0).alias("alpha"),
    )
    out = M.summarize_returns(x, periods, risk_free, tuple(keys), ret).join(more, keys)
    return out.withColumn("cagr", M.cagr(1 + F.col("total_return"), F.lit(1.0), F.col("n"), periods))


def daily_rollup(flights: DataFrame) -> DataFrame:
    """day, arrival, departure, total of every UTC day with flights."""
    count = lambda d: F.count_if(F.col("direction") == d).alias(d)
    return flights.groupBy(F.to_date("first_seen").alias("day")).agg(count("arrival"), count("departure"), F.count("direction").alias("total"))


def joined_data(flights: DataFrame, bars: DataFrame, airport: str, ticker: str | None = None, start: str | None = None, end: str | None = None, shift_days: int = 0, how: str = "inner", mapper: A.AssetMap | None = None) -> DataFrame:
    """An airport's daily flights beside a ticker's daily bars, the flights moved by shift_days. Without a
    ticker the airport's first mapped one is taken."""
    tickers = (mapper or A.AssetMap()).airports.get(airport.upper(), [])
    if not ticker and not tickers:
        raise ValueError(f"no ticker given, and none is mapped to {airport!r}")
    ticker = (ticker or tickers[0]).upper()
    inside = lambda c: F.lit(True) if not (start or end) else F.to_date(c).between(F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date"))
    left = daily_rollup(flights.where((F.col("airport") == airport.upper()) & inside("first_seen")))
    right = bars.where((F.upper("symbol") == ticker) & inside("ts")).withColumn("day", F.to_date("ts")).drop("ts")
    return A.trading_day_join(left, right, how, shift_days)


def next_up_or_flat(bars: DataFrame) -> DataFrame:
    """target: 1 if the next bar of the same day closes higher, else 0, also at a day's or series' end."""
    ahead = F.lead("close").over(S.by_symbol())
    return bars.withColumn("target", F.coalesce((L.same_session_forward(1) & (ahead > F.col("close"))).cast("int"), F.lit(0)))


def touch_positions(df: DataFrame, touch: str) -> DataFrame:
    """Adds own_pos and touch_pos: the place, among the rows given, of the first row at or after the touch
    time, from the row's own place to the last; without a touch its own. A union and a window, no range join."""
    x = S.with_pos(df, name="own_pos").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    at = x.select("symbol", F.col("ts").alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("own_pos"))
    asked = x.select("symbol", F.col(touch).alias("_at"), F.lit(0).alias("_k"), "own_pos").where("_at IS NOT NULL")
    w = Window.partitionBy("symbol").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, -1)
    found = at.unionByName(asked).withColumn("_p", F.coalesce(F.sum("_k").over(w), F.lit(0))).where("_k = 0").select("symbol", "own_pos", "_p")
    x = x.join(found, ["symbol", "own_pos"], "left")
    return x.withColumn("touch_pos", F.greatest(F.least(F.coalesce("_p", "own_pos"), F.col("_n") - 1), F.col("own_pos"))).drop("_p", "_n")


def load_resampled(bars: DataFrame, target: str, source: str = "1min", features: list[str] | None = None, drop_partial: bool = False, drop_incomplete: bool = False) -> DataFrame:
    """Bars of a longer interval with indicators computed on them anew (an empty list: none)."""
    x = B.resample_to(bars, target, source, drop_partial=drop_partial)
    return x if features == [] else I.compute(x, features, drop_incomplete)


def horizon_labels(bars: DataFrame, target: str, source: str = "1min", features: list[str] | None = None, ahead: int = 20, wide: float = 2.0, span: int = 100) -> DataFrame:
    """Bars of an interval with features, and barrier labels at ``wide`` deviations."""
    daily = B.interval(target) == "1d"
    x = load_resampled(bars, target, source, features)
    r = F.try_divide(F.col("close"), F.lag("close").over(S.by_symbol())) - 1
    if daily:  # a session is one bar: its barriers reach over days
        x = S.ewm_std(S.with_pos(x).withColumn("_r", r), "ewm_volatility", F.col("_r"), span, max(2, span // 4)).drop("_r", "pos")
        x = L.triple_barrier(x, ahead, wide, wide, "ewm_volatility", across=True)
    else:
        x = L.triple_barrier(L.ewm_volatility(x, span), ahead, wide, wide, "ewm_volatility")
    return x


def horizon_rows(bars: DataFrame, target: str, source: str = "1min", **options) -> DataFrame:
    """The rows of ``horizon_labels`` with sample weights."""
    return R.combined_weights(horizon_labels(bars, target, source, **options))


def multi_horizon(bars: DataFrame, targets: tuple[str, ...] = ("1min", "5min", "15min", "1h", "1d"), source: str = "1min", folds: int = 6, embargo: float = 0.01, **options) -> DataFrame:
    """Per (interval, symbol): bars, labels and their balance, mean concurrency and uniqueness, effective
    size, and the rows that train and test in purged folds. One plan; the interval is a column."""
    out = None
    for t in targets:
        spans = horizon_labels(bars, t, source, **options).select("symbol", "pos", "close", "touch_pos", "label")  # what weights and folds need
        x = R.with_fold_counts(R.combined_weights(spans), folds, embargo)
        one = x.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n_bars"), F.count("label").alias("n_labels"), F.avg((F.col("label") > 0).cast("double")).alias("share_up"), F.avg("concurrency").alias("concurrency"),
            F.avg("uniqueness").alias("uniqueness"), F.sum("uniqueness").alias("effective_size"), F.sum("combined").alias("weight"), F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"),
        ).select(F.lit(B.interval(t)).alias("interval"), "*")
        out = one if out is None else out.unionByName(one)
    return out
