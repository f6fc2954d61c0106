"""Registered queries on signals, backtests and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import series as S
from millrace.operators import metrics as M
from millrace.operators import simulate as X
from millrace.operators import strategies as ST
from millrace.plans import sql as Q
from millrace.plans.registered import query, shown
from millrace.sources import tables as T

KEYS = ["symbol", "ts"]
_TS = "symbol, epoch_us(ts) // 1000000 AS ts"
_W = "PARTITION BY symbol ORDER BY ts"
_POS = f"p AS (SELECT *, row_number() OVER ({_W}) - 1 AS pos FROM b)"

_EMA = f"""{_POS}, m AS (SELECT *, sign({Q.ema('close', 2 / 13)} - ({Q.ema('close', 2 / 27)})) AS side FROM p),
sg AS (SELECT symbol, ts, pos, open, high, low, close, volume, coalesce(sign(side - lag(side) OVER ({_W})), 0)::INT AS signal FROM m)"""


@query(f"WITH {Q.B1H}, {_EMA} SELECT {_TS}, signal FROM sg")
def sig_ema_cross(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ST.EMACrossover().signals(T.bars_1h(spark, sf)), KEYS, ["signal"])


_W20 = f"({_W} ROWS 19 PRECEDING)"
_MR = f"""{_POS}, c AS (SELECT *, avg(close) OVER {_W20} AS mean, stddev_samp(close) OVER {_W20} AS sd FROM p),
t AS (SELECT *, CASE WHEN pos >= 20 THEN CASE WHEN close < mean - 1.25 * sd THEN 1 WHEN close > mean - 0.5 * sd THEN 0 END END AS x FROM c),
u AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER ({_W}), 0) AS x2 FROM t),
sg AS (SELECT symbol, ts, pos, open, high, low, close, volume, (x2 - lag(x2, 1, 0) OVER ({_W}))::INT AS signal FROM u)"""


@query(f"WITH {Q.B1H}, {_MR} SELECT {_TS}, signal FROM sg")
def sig_mean_reversion(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ST.MeanReversion(entry=1.25).signals(T.bars_1h(spark, sf)), KEYS, ["signal"])


@query(f"""WITH {Q.B1H}, r AS (SELECT *, close / lag(close, 20) OVER ({_W}) - 1 AS r FROM b),
q AS (SELECT *, quantile_cont(r, 0.8) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS t FROM r)
SELECT {_TS}, CASE WHEN r < 0 THEN -1 WHEN r >= t THEN 1 ELSE 0 END AS signal FROM q""")
def sig_momentum(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ST.Momentum().signals(T.bars_1h(spark, sf)), KEYS, ["signal"])


@query(f"""WITH {Q.B1H}, r AS (SELECT symbol, ts, close / lag(close) OVER ({_W}) - 1 AS r FROM b)
SELECT {_TS}, round(CASE WHEN count(r) OVER w >= 5 THEN quantile_cont(r, 0.75) OVER w END, 6) AS q FROM r WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)""")
def expanding_quantile(spark: SparkSession, sf: str) -> DataFrame:
    x = T.bars_1h(spark, sf).withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(S.by_symbol())) - 1)
    return shown(ST.expanding_quantile(x, "r", 0.75, "q", 5), KEYS, ["q"])


_A = repr(21 / 23)
_EXPO = f"""rr AS (SELECT symbol, ts::DATE AS day, close / lag(close) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) - 1 AS r FROM b),
dv AS (SELECT symbol, day, coalesce(sqrt(sum(r * r)), 0) AS rv, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i FROM rr GROUP BY symbol, day),
ew AS (SELECT *, sum(rv * pow({_A}::DOUBLE, -i)) OVER v / sum(pow({_A}::DOUBLE, -i)) OVER v AS e FROM dv WINDOW v AS (PARTITION BY symbol ORDER BY day)),
lg AS (SELECT symbol, day, lag(e) OVER (PARTITION BY symbol ORDER BY day) AS p FROM ew),
tq AS (SELECT *, CASE WHEN count(p) OVER v >= 10 THEN quantile_cont(p, 0.5) OVER v END AS t FROM lg WINDOW v AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)),
ex AS (SELECT b.*, CASE WHEN t IS NULL OR p IS NULL OR p = 0 THEN 1.0::DOUBLE ELSE least(greatest(t / p, 0), 1) END AS exposure FROM b LEFT JOIN tq ON tq.symbol = b.symbol AND tq.day = b.ts::DATE)"""


@query(f"WITH {Q.B1H}, {_EXPO} SELECT {_TS}, round(exposure, 6) AS exposure FROM ex")
def voltarget_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ST.voltarget_exposure(T.bars_1h(spark, sf), least=10), KEYS, ["exposure"])


@query(f"""WITH {Q.B1H}, {_EXPO}, l AS (SELECT *, (exposure >= 0.5)::INT AS l FROM ex) SELECT {_TS}, l - lag(l, 1, 0) OVER ({_W}) AS signal FROM l""")
def sig_vol_target(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ST.VolatilityTarget(least=10).signals(T.bars_1h(spark, sf)), KEYS, ["signal"])


@query(f"WITH {Q.B1H} SELECT {_TS}, (row_number() OVER ({_W}) = 1)::INT AS signal FROM b")
def sig_buy_hold(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ST.BuyAndHold().signals(T.bars_1h(spark, sf)), KEYS, ["signal"])


@query(f"""WITH {Q.B1H}, r AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) - 1, 0) AS r FROM b)
SELECT {_TS}, (r < 0)::INT AS reversal, (r > 0)::INT AS momentum,
coalesce((CASE WHEN count(close) OVER (w ROWS 4 PRECEDING) = 5 THEN avg(close) OVER (w ROWS 4 PRECEDING) END > CASE WHEN count(close) OVER (w ROWS 29 PRECEDING) = 30 THEN avg(close) OVER (w ROWS 29 PRECEDING) END)::INT, 0) AS trend
FROM r WINDOW w AS ({_W})""")
def naive_positions(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ST.naive_positions(T.bars_1h(spark, sf)), KEYS, ["reversal", "momentum", "trend"])


_FRAC = f"""a AS (SELECT *, coalesce(lag(signal) OVER ({_W}), 0) AS act FROM sg),
po AS (SELECT *, coalesce(last_value(CASE WHEN act > 0 THEN 1 WHEN act < 0 THEN 0 END IGNORE NULLS) OVER ({_W}), 0) AS position FROM a),
pv AS (SELECT *, coalesce(lag(position) OVER ({_W}), 0) AS b4, lag(close) OVER ({_W}) AS c0 FROM po),
mm AS (SELECT *, coalesce(CASE WHEN position = 1 AND b4 <> 1 THEN close / (open * 1.0005::DOUBLE * 1.001::DOUBLE) WHEN position = 1 THEN close / c0
    WHEN b4 = 1 THEN open * 0.9995::DOUBLE * 0.999::DOUBLE / c0 ELSE 1 END, 1)::DOUBLE AS m FROM pv),
fr AS (SELECT *, m - 1 AS ret, 10000 * product(m) OVER ({_W}) AS equity FROM mm)"""


def _fractional(spark: SparkSession, sf: str) -> DataFrame:
    return X.fractional(ST.EMACrossover().signals(T.bars_1h(spark, sf)))


@query(f"WITH {Q.B1H}, {_EMA}, {_FRAC} SELECT {_TS}, position, {Q.columns('ret')}, round(ln(equity), 6) AS log_equity FROM fr")
def sim_fractional(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_fractional(spark, sf).withColumn("log_equity", F.ln("equity")), KEYS, ["position", "ret", "log_equity"])


_EX = f"""ev AS (SELECT *, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5::DOUBLE END AS e FROM b),
el AS (SELECT *, least(greatest(coalesce(lag(e) OVER ({_W}), 0), 0), 1) AS position, coalesce(close / lag(close) OVER ({_W}) - 1, 0) AS r FROM ev),
et AS (SELECT *, abs(position - coalesce(lag(position) OVER ({_W}), 0)) AS turnover FROM el),
er AS (SELECT *, position * r + (1 - position) * (0.02::DOUBLE / 1638) - 0.0015::DOUBLE * turnover AS ret FROM et),
fr AS (SELECT *, 10000 * product(1 + ret) OVER ({_W}) AS equity FROM er)"""


def _exposed(spark: SparkSession, sf: str) -> DataFrame:
    e = F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    return X.exposure(T.bars_1h(spark, sf).withColumn("e", e), "e", risk_free=0.02, periods=1638)


@query(f"WITH {Q.B1H}, {_EX} SELECT {_TS}, {Q.columns('position', 'turnover', 'ret')}, round(ln(equity), 6) AS log_equity FROM fr")
def sim_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_exposed(spark, sf).withColumn("log_equity", F.ln("equity")), KEYS, ["position", "turnover", "ret", "log_equity"])


_SHARE = f"""WITH RECURSIVE {Q.B1H}, {_EMA}, a AS (SELECT *, coalesce(lag(signal) OVER ({_W}), 0) AS act FROM sg),
od AS (SELECT symbol, pos, act, open AS o, ts, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS i FROM a WHERE act <> 0),
st AS (SELECT symbol, 0::BIGINT AS i, -1::BIGINT AS pos, 10000.0::DOUBLE AS cash, 0::BIGINT AS sh, 0.0::DOUBLE AS ep, 0::BIGINT AS epos, NULL::TIMESTAMP AS ets, 0.0::DOUBLE AS xp, NULL::TIMESTAMP AS xts, 0::BIGINT AS xs, 0::BIGINT AS hp, 0.0::DOUBLE AS xe, NULL::TIMESTAMP AS xets FROM (SELECT DISTINCT symbol FROM b)
  UNION ALL SELECT st.symbol, od.i, od.pos,
    CASE WHEN act > 0 AND sh = 0 AND cash >= o * 1.0005::DOUBLE * 1.001::DOUBLE THEN cash - floor(cash / (o * 1.0005::DOUBLE * 1.001::DOUBLE)) * (o * 1.0005::DOUBLE * 1.001::DOUBLE)
      WHEN act < 0 AND sh > 0 THEN cash + sh * o * 0.9995::DOUBLE * 0.999::DOUBLE ELSE cash END,
    CASE WHEN act > 0 AND sh = 0 AND cash >= o * 1.0005::DOUBLE * 1.001::DOUBLE THEN floor(cash / (o * 1.0005::DOUBLE * 1.001::DOUBLE))::BIGINT WHEN act < 0 AND sh > 0 THEN 0 ELSE sh END,
    CASE WHEN act > 0 AND sh = 0 AND cash >= o * 1.0005::DOUBLE * 1.001::DOUBLE THEN o * 1.0005::DOUBLE WHEN act < 0 AND sh > 0 THEN 0 ELSE ep END,
    CASE WHEN act > 0 AND sh = 0 AND cash >= o * 1.0005::DOUBLE * 1.001::DOUBLE THEN od.pos WHEN act < 0 AND sh > 0 THEN 0 ELSE epos END,
    CASE WHEN act > 0 AND sh = 0 AND cash >= o * 1.0005::DOUBLE * 1.001::DOUBLE THEN od.ts WHEN act < 0 AND sh > 0 THEN NULL ELSE ets END,
    CASE WHEN act < 0 AND sh > 0 THEN o * 0.9995::DOUBLE ELSE 0 END, CASE WHEN act < 0 AND sh > 0 THEN od.ts END, CASE WHEN act < 0 AND sh > 0 THEN sh ELSE 0 END,
    CASE WHEN act < 0 AND sh > 0 THEN od.pos - epos ELSE 0 END, CASE WHEN act < 0 AND sh > 0 THEN ep ELSE 0 END, CASE WHEN act < 0 AND sh > 0 THEN ets END
  FROM st JOIN od ON od.symbol = st.symbol AND od.i = st.i + 1)"""


@query(f"""{_SHARE}, j AS (SELECT a.symbol, a.ts, a.pos, a.close, st.cash, st.sh FROM a LEFT JOIN st ON st.symbol = a.symbol AND st.pos = a.pos),
k AS (SELECT *, coalesce(last_value(cash IGNORE NULLS) OVER ({_W}), 10000) AS c, coalesce(last_value(sh IGNORE NULLS) OVER ({_W}), 0) AS shares FROM j)
SELECT {_TS}, shares, round(ln(c + shares * close), 6) AS log_equity FROM k""")
def sim_whole_share(spark: SparkSession, sf: str) -> DataFrame:
    bars, _ = X.whole_share(ST.EMACrossover().signals(T.bars_1h(spark, sf)))
    return shown(bars.withColumn("log_equity", F.ln("equity")), KEYS, ["shares", "log_equity"])


@query(f"""{_SHARE} SELECT symbol, epoch_us(xets) // 1000000 AS entry_ts, epoch_us(xts) // 1000000 AS exit_ts, round(xe, 6) AS entry_price, round(xp, 6) AS exit_price, xs AS shares,
round((xp - xe) * xs - (xe + xp) * xs * 0.001::DOUBLE, 2) AS pnl, round(xp / xe - 1, 6) AS return_pct, hp AS holding_period FROM st WHERE xts IS NOT NULL""")
def trade_log(spark: SparkSession, sf: str) -> DataFrame:
    _, trades = X.whole_share(ST.EMACrossover().signals(T.bars_1h(spark, sf)))
    return shown(trades, ["symbol", "entry_ts", "exit_ts"], ["entry_price", "exit_price", "shares", "pnl", "return_pct", "holding_period"])


@query(f"""{_SHARE}, tr AS (SELECT symbol, round((xp - xe) * xs - (xe + xp) * xs * 0.001::DOUBLE, 2) AS pnl, hp FROM st WHERE xts IS NOT NULL)
SELECT symbol, count(*) AS n_trades, round(avg((pnl > 0)::INT), 6) AS win_rate, round(CASE WHEN coalesce(sum(pnl) FILTER (pnl < 0), 0) < 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl < 0)
WHEN sum(pnl) FILTER (pnl > 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS profit_factor, round(avg(pnl), 6) AS avg_pnl, round(max(pnl), 6) AS best_pnl, round(min(pnl), 6) AS worst_pnl, round(avg(hp), 6) AS avg_holding FROM tr GROUP BY symbol""")
def trade_report(spark: SparkSession, sf: str) -> DataFrame:
    _, trades = X.whole_share(ST.EMACrossover().signals(T.bars_1h(spark, sf)))
    return shown(M.trade_report(trades), ["symbol"], ["n_trades", "win_rate", "profit_factor", "avg_pnl", "best_pnl", "worst_pnl", "avg_holding"])


_PERF = """dd AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY ts) AS top, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM fr),
rr2 AS (SELECT *, CASE WHEN i > 1 THEN ret END AS r, (top - equity) / CASE WHEN top = 0 THEN 1 ELSE top END AS drawdown FROM dd)"""


@query(f"""WITH {Q.B1H}, {_EMA}, {_FRAC}, {_PERF}, g AS (SELECT symbol, count(*) AS n_bars, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return,
pow(arg_max(equity, ts) / arg_min(equity, ts), 1638 / count(*)::DOUBLE) - 1 AS cagr, stddev_samp(r) * sqrt(1638) AS ann_vol,
CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(1638) ELSE 0 END AS sharpe, coalesce(avg(r) / sqrt(avg(r * r) FILTER (r < 0)) * sqrt(1638), 0) AS sortino, max(drawdown) AS max_drawdown
FROM rr2 GROUP BY symbol) SELECT symbol, n_bars, round(ln(1 + total_return), 6) AS log_return, round(CASE WHEN cagr > -1 THEN ln(1 + cagr) END, 6) AS log_cagr, {Q.columns('ann_vol', 'sharpe', 'sortino', 'max_drawdown')}, round(sign(cagr) * ln(1 + abs(CASE WHEN max_drawdown > 0 THEN cagr / max_drawdown ELSE 0 END)), 6) AS log_calmar FROM g""")
def metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    x = M.performance(_fractional(spark, sf), 1638, skip_first=True)
    x = x.withColumn("log_return", F.log1p("total_return")).withColumn("log_cagr", F.log1p("cagr")).withColumn("log_calmar", F.signum("cagr") * F.log1p(F.abs("calmar")))
    return shown(x, ["symbol"], ["n_bars", "log_return", "log_cagr", "ann_vol", "sharpe", "sortino", "max_drawdown", "log_calmar"])


@query(f"""WITH {Q.B1H}, {_EX}, h AS (SELECT *, close / lag(close) OVER ({_W}) - 1 AS bench FROM fr)
SELECT symbol, round((avg(ret) - covar_samp(ret, bench) / var_samp(bench) * avg(bench)) * 1638, 4) AS alpha, round(covar_samp(ret, bench) / var_samp(bench), 6) AS beta FROM h WHERE bench IS NOT NULL GROUP BY symbol""")
def alpha_beta(spark: SparkSession, sf: str) -> DataFrame:
    x = _exposed(spark, sf).withColumn("bench", F.try_divide(F.col("close"), F.lag("close").over(S.by_symbol())) - 1)
    x = M.performance(x, 1638, benchmark="bench")
    return shown(x, ["symbol"], ["alpha", "beta"]).withColumn("alpha", F.round("alpha", 4))


@query(f"""WITH {Q.B1H}, {_EMA}, {_FRAC}, q AS (SELECT *, coalesce(lag(position) OVER ({_W}), 0) AS bf FROM fr)
SELECT symbol, round(avg(position), 6) AS exposure, sum((bf = 0 AND position <> 0)::INT)::BIGINT AS entries, round(coalesce(sum(position) / nullif(sum((bf = 0 AND position <> 0)::INT), 0), 0), 6) AS mean_run,
round(sum(abs(position - bf)) / count(DISTINCT ts::DATE), 6) AS turnover_per_day, round(sum((bf = 0 AND position <> 0)::INT) / count(DISTINCT ts::DATE), 6) AS entries_per_day FROM q GROUP BY symbol""")
def position_stats(spark: SparkSession, sf: str) -> DataFrame:
    x = M.position_stats(_fractional(spark, sf))
    return shown(x, ["symbol"], ["exposure", "entries", "mean_run", "turnover_per_day", "entries_per_day"])


@query(f"""WITH {Q.B1H}, {_EMA}, {_FRAC}, q AS (SELECT *, (position > 0 AND NOT coalesce(lag(position > 0) OVER ({_W}), false))::INT AS s FROM fr),
g AS (SELECT *, sum(s) OVER ({_W}) AS run FROM q) SELECT symbol, run::BIGINT AS run, count(*) AS length FROM g WHERE position > 0 GROUP BY ALL""")
def run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return ST.runs(_fractional(spark, sf), "position")


#: A probability that both engines read off a bar: where the close lies in its range.
_PROBA = "pr AS (SELECT *, CASE WHEN high > low THEN (close - low) / (high - low) END AS p FROM b)"


def _proba(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars_1h(spark, sf).withColumn("p", F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))))


@query(f"""WITH {Q.B1H}, {_PROBA} SELECT {_TS}, CASE WHEN p IS NOT NULL THEN CASE WHEN p > 0.6 THEN 1.0::DOUBLE WHEN p < 0.4 THEN -1 ELSE 0 END END AS binary_pos,
round(CASE WHEN p IS NOT NULL THEN least(greatest((p - 0.6) / 0.4::DOUBLE, 0), 1) - least(greatest((0.4::DOUBLE - p) / 0.6::DOUBLE, 0), 1) END, 6) AS proportional_pos,
round(CASE WHEN p IS NOT NULL THEN least(2 * abs(p - 0.5), 1) * CASE WHEN p > 0.6 THEN 1.0::DOUBLE ELSE 0 END END * 0.5, 6) AS confidence_pos FROM pr""")
def positions_from_proba(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    x = _proba(spark, sf).withColumns({
        "binary_pos": X.positions(p, "binary", 0.6, short=True), "proportional_pos": X.positions(p, "proportional", 0.6, short=True), "confidence_pos": X.positions(p, "confidence", 0.6, most=0.5),
    })
    return shown(x, KEYS, ["binary_pos", "proportional_pos", "confidence_pos"])


_T, _C = [0.4, 0.5, 0.6, 0.7], [0.0, 0.0005, 0.001]
_SWEEP = f"""{_PROBA}, gr AS (SELECT t.threshold::DOUBLE AS threshold, c.cost::DOUBLE AS cost FROM (VALUES {', '.join(f'({t})' for t in _T)}) t(threshold), (VALUES {', '.join(f'({c})' for c in _C)}) c(cost)),
x AS (SELECT *, CASE WHEN p > threshold THEN 1.0::DOUBLE ELSE 0 END AS e FROM pr, gr),
y AS (SELECT *, coalesce(lag(e) OVER w, 0) AS position, coalesce(close / lag(close) OVER w - 1, 0) AS r FROM x WINDOW w AS (PARTITION BY symbol, threshold, cost ORDER BY ts)),
z AS (SELECT *, abs(position - coalesce(lag(position) OVER w, 0)) AS turnover FROM y WINDOW w AS (PARTITION BY symbol, threshold, cost ORDER BY ts)),
v AS (SELECT *, position * r - cost * turnover AS ret FROM z),
sw AS (SELECT symbol, threshold, cost, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(1638) ELSE 0 END AS sharpe, ln(product(1 + ret)) AS log_growth, sum(turnover) AS turnover FROM v GROUP BY ALL)"""


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    return X.cost_sweep(_proba(spark, sf), "p", _T, _C, periods=1638)


@query(f"WITH {Q.B1H}, {_SWEEP} SELECT symbol, threshold, cost, {Q.columns('sharpe', 'turnover')}, round(log_growth, 5) AS log_growth FROM sw")
def cost_sweep(spark: SparkSession, sf: str) -> DataFrame:
    x = _sweep(spark, sf).withColumn("log_growth", F.round(F.ln(F.col("final_equity") / 10_000), 5))
    return shown(x, ["symbol", "threshold", "cost"], ["sharpe", "turnover", "log_growth"])


@query(f"""WITH {Q.B1H}, {_SWEEP}, a AS (SELECT symbol, threshold, avg(sharpe) AS sharpe FROM sw GROUP BY ALL)
SELECT symbol, threshold, round(sharpe, 6) AS sharpe FROM a QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe, 9) DESC, threshold) = 1""")
def threshold_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return shown(X.best_threshold(_sweep(spark, sf)), ["symbol"], ["threshold", "sharpe"])


@query(f"""WITH {Q.B1H}, {_SWEEP}, m AS (SELECT cost, threshold, avg(sharpe) AS s FROM sw GROUP BY ALL)
SELECT threshold, round(max(s) FILTER (cost = 0), 6) AS cost_0, round(max(s) FILTER (cost = 0.0005), 6) AS cost_5, round(max(s) FILTER (cost = 0.001), 6) AS cost_10 FROM m GROUP BY threshold""")
def result_pivot(spark: SparkSession, sf: str) -> DataFrame:
    x = _sweep(spark, sf).groupBy("threshold").pivot("cost", _C).avg("sharpe").toDF("threshold", "cost_0", "cost_5", "cost_10")
    return shown(x, ["threshold"], ["cost_0", "cost_5", "cost_10"])


@query(f"""WITH {Q.B1H}, {_PROBA}, c AS (SELECT (close > open)::INT AS y, (p > 0.5)::INT AS z, p FROM pr WHERE p IS NOT NULL),
k AS (SELECT count(*) FILTER (y = 1 AND z = 1) AS tp, count(*) FILTER (y = 0 AND z = 1) AS fp, count(*) FILTER (y = 0 AND z = 0) AS tn, count(*) FILTER (y = 1 AND z = 0) AS fn FROM c),
r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM c),
u AS (SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(auc, 6) AS auc FROM k, u""")
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    x = _proba(spark, sf).where("p IS NOT NULL").select((F.col("close") > F.col("open")).cast("int").alias("y"), (F.col("p") > 0.5).cast("int").alias("z"), "p")
    return shown(M.classification(x, "y", "z", "p"), ["tp", "fp", "tn", "fn"], ["accuracy", "precision", "recall", "f1", "auc"])

