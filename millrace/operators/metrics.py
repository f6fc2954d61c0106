"""Risk and performance metrics: one aggregation per (run, symbol)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sharpe(r: Column, periods: int, risk_free: float = 0.0) -> Column:
    x = r - risk_free / periods
    sd = F.stddev_samp(x)
    return F.when((F.count(r) >= 2) & (sd > 0), F.avg(x) / sd * periods**0.5).otherwise(0.0)


def sortino(r: Column, periods: int, risk_free: float = 0.0) -> Column:
    x = r - risk_free / periods
    down = F.sqrt(F.avg(F.when(x < 0, x * x)))
    return F.when(down > 0, F.avg(x) / down * periods**0.5).otherwise(0.0)


def cagr(last: Column, first: Column, n: Column, periods: int) -> Column:
    years = n / periods
    return F.when((first > 0) & (last > 0) & (years > 0), F.pow(last / first, 1 / years) - 1).otherwise(0.0)


def with_drawdown(df: DataFrame, equity: str = "equity", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    top = F.max(equity).over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    base = F.when(top == 0, 1.0).otherwise(top)
    return df.withColumn("drawdown", (top - F.col(equity)) / base)


def performance(df: DataFrame, periods: int, risk_free: float = 0.0, keys: tuple[str, ...] = ("symbol",), benchmark: str | None = None, skip_first: bool = False) -> DataFrame:
    """Per key: return, CAGR, volatility, Sharpe, Sortino, drawdown, Calmar (and alpha, beta) of
    bars with ts, equity and ret. skip_first leaves out each series' first return."""
    x = with_drawdown(df, keys=keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    r = F.col("_r")
    x = x.withColumn("_r", F.when(F.row_number().over(w) > 1, F.col("ret")) if skip_first else F.col("ret"))
    first, last = F.min_by("equity", "ts"), F.max_by("equity", "ts")
    aggs = [
        F.count(F.lit(1)).alias("n_bars"), (last / first - 1).alias("total_return"), cagr(last, first, F.count(F.lit(1)), periods).alias("cagr"),
        F.coalesce(F.stddev_samp(r) * periods**0.5, F.lit(0.0)).alias("ann_vol"), sharpe(r, periods, risk_free).alias("sharpe"), sortino(r, periods, risk_free).alias("sortino"),
        F.max("drawdown").alias("max_drawdown"),
    ]
    if benchmark:
        both = F.col(benchmark).isNotNull() & r.isNotNull()
        a, b = F.when(both, r), F.when(both, F.col(benchmark))
        beta = F.when(F.var_samp(b) > 0, F.covar_samp(a, b) / F.var_samp(b)).otherwise(0.0)
        aggs += [F.when(F.var_samp(b) > 0, (F.avg(a) - beta * F.avg(b)) * periods).otherwise(0.0).alias("alpha"), beta.alias("beta")]
    out = x.groupBy(*keys).agg(*aggs)
    return out.withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("cagr") / F.col("max_drawdown")).otherwise(0.0))


def trade_report(trades: DataFrame) -> DataFrame:
    """Per symbol: trades, win rate, profit factor (infinite without losses), average, best and worst."""
    win, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.abs(F.sum(F.when(F.col("pnl") < 0, F.col("pnl")).otherwise(0.0)))
    return trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.when(loss > 0, win / loss).when(win > 0, F.lit(float("inf"))).otherwise(0.0).alias("profit_factor"),
        F.avg("pnl").alias("avg_pnl"), F.max("pnl").alias("best_pnl"), F.min("pnl").alias("worst_pnl"), F.avg("holding_period").alias("avg_holding"),
    )


def position_stats(df: DataFrame, position: str = "position", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Exposure, entries, mean run and turnover a day of a position."""
    w = Window.partitionBy(*keys).orderBy("ts")
    before = F.coalesce(F.lag(position).over(w), F.lit(0))
    x = df.withColumn("_in", ((before == 0) & (F.col(position) != 0)).cast("long")).withColumn("_t", F.abs(F.col(position) - before))
    days = F.count_distinct(F.to_date("ts"))
    on = F.sum((F.col(position) != 0).cast("long"))
    return x.groupBy(*keys).agg(
        F.avg(F.abs(F.col(position)).cast("double")).alias("exposure"), F.sum("_in").alias("entries"), F.coalesce(F.try_divide(on, F.sum("_in")), F.lit(0.0)).alias("mean_run"),
        (F.sum("_t") / days).cast("double").alias("turnover_per_day"), (F.sum("_in") / days).alias("entries_per_day"),
    )


CELLS = 4096


def classification(df: DataFrame, label: str, prediction: str, score: str | None = None) -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall, F1 and (with a score) rank AUC of 0/1 labels."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = {"tp": y & p, "fp": ~y & p, "tn": ~y & ~p, "fn": y & ~p}
    if score:
        # scores are counted first, then ranked inside cells of equal width and over the cells' totals
        lo, hi = df.agg(F.min(score), F.max(score)).first()
        cell = F.coalesce(F.floor((F.col(score) - F.lit(lo)) * (CELLS / ((hi - lo) or 1))), F.lit(-1)) if lo is not None else F.lit(-1)
        by = df.groupBy(F.col(score).alias("_s"), cell.alias("_c")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.count_if(y).alias("_p"), F.count_if(~y).alias("_n"))
        cells = by.groupBy("_c").agg(F.sum("_n").alias("_t"))
        start = F.sum("_t").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
        by = by.join(cells.select("_c", F.coalesce(start, F.lit(0)).alias("_b")), "_c")
        below = F.col("_b") + F.coalesce(F.sum("_n").over(Window.partitionBy("_c").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        by = by.withColumn("_u", F.col("_p") * (below + F.col("_n") / 2))
        out = by.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts], F.try_divide(F.sum("_u"), F.sum("_p") * F.sum("_n")).alias("auc"))
    else:
        out = df.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    tp, fp, tn, fn = (F.col(n) for n in counts)
    ratios = {"accuracy": F.try_divide(tp + tn, tp + fp + tn + fn), "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), "recall": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)), "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))}
    return out.select(*counts, *[c.alias(n) for n, c in ratios.items()], *(["auc"] if score else []))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n) of any number of classes."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_weighted(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row for any number of classes: accuracy, and precision, recall and F1 averaged with the
    classes' frequencies among the labels as weights; a class that is never predicted has precision 0."""
    cells = confusion(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    true = cells.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    guessed = cells.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("guessed"))
    x = true.join(guessed, "c", "left")
    precision, recall = F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0)), F.col("tp") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    mean = lambda v: F.try_divide(F.sum(v * F.col("support")), F.sum("support"))
    return x.agg(F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"), mean(precision).alias("precision"), mean(recall).alias("recall"), mean(f1).alias("f1"))


def summarize_returns(df: DataFrame, periods: int, risk_free: float = 0.0, keys: tuple[str, ...] = ("symbol",), ret: str = "ret") -> DataFrame:
    """Per key: Sharpe, Sortino, drawdown, total and annual return of the non-null returns of a slice;
    zeros with fewer than two. Equity starts at 1 before the slice's first return."""
    x = df.where(F.col(ret).isNotNull()).withColumn("_r", F.col(ret)).withColumn("equity", F.product(1 + F.col(ret)).over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    r, n = F.col("_r"), F.count(F.lit(1))
    two = lambda c: F.when(n >= 2, c).otherwise(0.0)
    return with_drawdown(x, keys=keys).groupBy(*keys).agg(
        two(sharpe(r, periods, risk_free)).alias("sharpe"), two(sortino(r, periods, risk_free)).alias("sortino"), two(F.max("drawdown")).alias("max_drawdown"),
        two(F.max_by("equity", "ts") - 1).alias("total_return"), two(F.avg(r) * periods).alias("ann_return"), n.alias("n"),
    )


def regression(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: RMSE, MAE, R squared, and how often the signs agree."""
    d = F.col(label) - F.col(prediction)
    return df.agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), (1 - F.try_divide(F.sum(d * d), F.var_pop(label) * F.count(label))).alias("r2"),
        F.avg((F.signum(label) == F.signum(prediction)).cast("double")).alias("directional_accuracy"),
    )


def report(metrics: dict[str, float], title: str = "Backtest") -> str:
    """A text report of one row of metrics."""
    width = max(map(len, metrics), default=0)
    return "\n".join([title, "-" * len(title), *[f"{k:<{width}}  {v:,.4f}" if isinstance(v, float) else f"{k:<{width}}  {v}" for k, v in metrics.items()]])
