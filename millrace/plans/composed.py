"""Registered queries on whole runs: backtests, predictions, joins across datasets, horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import series as S
from millrace.operators import bars as B
from millrace.operators import metrics as M
from millrace.operators import reshape as R
from millrace.operators import runs
from millrace.operators import simulate as X
from millrace.operators import strategies as ST
from millrace.operators.align import AssetMap
from millrace.plans import sql as Q
from millrace.plans.registered import query, shown
from millrace.plans.trading import _EX, _PROBA, _SHARE, _exposed, _proba
from millrace.sources import tables as T

KEYS = ["symbol", "ts"]
_TS = "symbol, epoch_us(ts) // 1000000 AS ts"
_W = "PARTITION BY symbol ORDER BY ts"


@query(f"""{_SHARE}, j AS (SELECT a.symbol, a.ts, a.pos, a.close, st.cash, st.sh FROM a LEFT JOIN st ON st.symbol = a.symbol AND st.pos = a.pos),
k AS (SELECT *, coalesce(last_value(cash IGNORE NULLS) OVER ({_W}), 10000) + coalesce(last_value(sh IGNORE NULLS) OVER ({_W}), 0) * close AS eq FROM j),
r AS (SELECT *, eq / lag(eq) OVER ({_W}) - 1 AS r, close / lag(close) OVER ({_W}) - 1 AS br, (max(eq) OVER ({_W}) - eq) / max(eq) OVER ({_W}) AS dd FROM k),
n AS (SELECT symbol, count(*) FILTER (xts IS NOT NULL) AS n_trades FROM st GROUP BY symbol)
SELECT r.symbol, count(*) AS n_bars, round(ln(arg_max(eq, ts)), 6) AS log_final, round(CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(1638) ELSE 0 END, 6) AS sharpe, round(max(dd), 6) AS max_drawdown,
round(covar_samp(r, br) / var_samp(br) FILTER (r IS NOT NULL), 6) AS beta, any_value(n.n_trades) AS n_trades FROM r JOIN n ON n.symbol = r.symbol GROUP BY r.symbol""")
def backtest_run(spark: SparkSession, sf: str) -> DataFrame:
    _, _, m = runs.backtest(ST.EMACrossover(), T.bars_1h(spark, sf), interval="1h")
    return shown(m.withColumn("log_final", F.ln("final_capital")), ["symbol"], ["n_bars", "log_final", "sharpe", "max_drawdown", "beta", "n_trades"])


def _predicted(grid: str) -> str:
    """Strategy and benchmark through one simulator, for rows ``g`` of a grid (threshold, commission + slippage)."""
    return f"""{_PROBA}, g AS ({grid}), x AS (SELECT pr.*, g.*, run, CASE WHEN run = 'bench' THEN 1.0::DOUBLE WHEN p > threshold THEN 1.0::DOUBLE ELSE 0 END AS e FROM pr, g, (VALUES ('strat'), ('bench')) v(run)),
y AS (SELECT *, coalesce(lag(e) OVER w, 0) AS position, coalesce(close / lag(close) OVER w - 1, 0) AS r FROM x WINDOW w AS (PARTITION BY symbol, threshold, fee, run ORDER BY ts)),
z AS (SELECT *, abs(position - coalesce(lag(position) OVER w, 0)) AS turnover FROM y WINDOW w AS (PARTITION BY symbol, threshold, fee, run ORDER BY ts)),
q AS (SELECT *, position * r + (1 - abs(position)) * (0.04::DOUBLE / 1638) - fee * turnover AS ret FROM z),
eq AS (SELECT *, product(1 + ret) OVER w AS equity, row_number() OVER w AS i FROM q WINDOW w AS (PARTITION BY symbol, threshold, fee, run ORDER BY ts)),
dd AS (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY symbol, threshold, fee, run ORDER BY ts) AS drawdown, CASE WHEN i > 1 THEN ret END AS xr FROM eq),
ms AS (SELECT symbol, threshold, fee, run, CASE WHEN stddev_samp(xr) > 0 THEN (avg(xr) - 0.04::DOUBLE / 1638) / stddev_samp(xr) * sqrt(1638) ELSE 0 END AS sharpe, max(drawdown) AS dd, avg(abs(position)) AS exposure FROM dd GROUP BY ALL),
pv AS (SELECT symbol, threshold, fee, max(sharpe) FILTER (run = 'strat') AS ss, max(sharpe) FILTER (run = 'bench') AS bs, max(dd) FILTER (run = 'strat') AS sd, max(dd) FILTER (run = 'bench') AS bd,
  max(exposure) FILTER (run = 'strat') AS se FROM ms GROUP BY ALL)"""


@query(f"""WITH {Q.B1H}, {_predicted('SELECT 0.6::DOUBLE AS threshold, 0.0015::DOUBLE AS fee')}
SELECT symbol, round(ss, 6) AS strat_sharpe, round(bs, 6) AS bench_sharpe, round(ss - bs, 6) AS sharpe_edge, round(sd, 6) AS strat_max_drawdown, round(se, 6) AS strat_exposure, ss - bs > 0 AND sd <= bd + 1e-12 AS beats FROM pv""")
def backtest_predictions(spark: SparkSession, sf: str) -> DataFrame:
    x = runs.backtest_predictions(_proba(spark, sf), "p", 1638, threshold=0.6)
    return shown(x, ["symbol"], ["strat_sharpe", "bench_sharpe", "sharpe_edge", "strat_max_drawdown", "strat_exposure", "beats"])


@query(f"""WITH {Q.B1H}, {_predicted('SELECT t::DOUBLE AS threshold, 0.0015::DOUBLE AS fee FROM (VALUES (0.5), (0.52), (0.55), (0.58), (0.6)) v(t)')}
SELECT symbol, threshold, round(ss - bs, 6) AS sharpe_edge FROM pv QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(ss - bs, 9) DESC, threshold) = 1""")
def tune_threshold_edge(spark: SparkSession, sf: str) -> DataFrame:
    best, _ = runs.tune_threshold(_proba(spark, sf), "p", 1638)
    return shown(best, ["symbol"], ["threshold", "sharpe_edge"])


@query(f"""WITH {Q.B1H}, {_predicted('SELECT 0.6::DOUBLE AS threshold, f::DOUBLE AS fee FROM (VALUES (0.0), (0.0005), (0.0015)) v(f)')}
SELECT CASE fee WHEN 0 THEN 'none' WHEN 0.0005 THEN 'low' ELSE 'retail' END AS cost, round(2e4 * fee, 6) AS round_trip_bps, round(avg(ss), 6) AS strat_sharpe, round(avg(bs), 6) AS bench_sharpe, round(avg(ss - bs), 6) AS sharpe_edge,
round(avg(sd), 6) AS max_drawdown, round(avg(se), 6) AS exposure, count(*) FILTER (ss - bs > 0 AND sd <= bd + 1e-12) AS beats FROM pv GROUP BY fee""")
def cost_points(spark: SparkSession, sf: str) -> DataFrame:
    x = runs.cost_points(_proba(spark, sf), "p", 1638, {"none": (0.0, 0.0), "low": (0.0003, 0.0002), "retail": (0.001, 0.0005)}, threshold=0.6)
    return shown(x, ["cost"], ["round_trip_bps", "strat_sharpe", "bench_sharpe", "sharpe_edge", "max_drawdown", "exposure", "beats"])


_CLASSES = """c AS (SELECT CASE WHEN close > open * 1.2 THEN 'up' WHEN close < open * 0.8 THEN 'down' ELSE 'flat' END AS y, CASE WHEN p > 0.7 THEN 'up' WHEN p < 0.3 THEN 'down' ELSE 'flat' END AS z FROM pr WHERE p IS NOT NULL)"""


@query(f"""WITH {Q.B1H}, {_PROBA}, {_CLASSES}, s AS (SELECT y AS k, count(*) AS n, count(*) FILTER (y = z) AS tp FROM c GROUP BY y), g AS (SELECT z AS k, count(*) AS m FROM c GROUP BY z),
m AS (SELECT n, tp, coalesce(tp / m, 0) AS pr, tp / n AS rc FROM s LEFT JOIN g USING (k))
SELECT round(sum(tp) / sum(n), 6) AS accuracy, round(sum(pr * n) / sum(n), 6) AS "precision", round(sum(rc * n) / sum(n), 6) AS recall, round(sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * n) / sum(n), 6) AS f1 FROM m""")
def classification_weighted(spark: SparkSession, sf: str) -> DataFrame:
    p, c, o = F.col("p"), F.col("close"), F.col("open")
    x = _proba(spark, sf).where("p IS NOT NULL").select(F.when(c > o * 1.2, "up").when(c < o * 0.8, "down").otherwise("flat").alias("y"), F.when(p > 0.7, "up").when(p < 0.3, "down").otherwise("flat").alias("z"))
    return shown(M.classification_weighted(x, "y", "z"), [], ["accuracy", "precision", "recall", "f1"])


@query(f"""WITH {Q.B1H}, c AS (SELECT ln(close) AS y, ln((open + high + low) / 3) AS z FROM b WHERE close > 0 AND open + high + low > 0), m AS (SELECT avg(y) AS mean FROM c)
SELECT round(sqrt(avg((y - z) * (y - z))), 6) AS rmse, round(avg(abs(y - z)), 6) AS mae, round(1 - sum((y - z) * (y - z)) / sum((y - mean) * (y - mean)), 6) AS r2, round(avg((sign(y) = sign(z))::INT), 6) AS directional_accuracy FROM c, m""")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    x = T.bars_1h(spark, sf).where("close > 0 AND open + high + low > 0").select(F.ln("close").alias("y"), F.ln((F.col("open") + F.col("high") + F.col("low")) / 3).alias("z"))
    return shown(M.regression(x, "y", "z"), [], ["rmse", "mae", "r2", "directional_accuracy"])


@query(f"WITH {Q.FLIGHTS} SELECT first_seen::DATE::VARCHAR AS day, count(*) FILTER (direction = 'arrival') AS arrival, count(*) FILTER (direction = 'departure') AS departure, count(*) AS total FROM f GROUP BY 1")
def daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return shown(runs.daily_rollup(T.flights(spark, sf)), ["day"], ["arrival", "departure", "total"])


@query(f"""WITH {Q.FLIGHTS}, {Q.B1H}, d AS (SELECT first_seen::DATE AS day, count(*) FILTER (direction = 'arrival') AS arrival, count(*) FILTER (direction = 'departure') AS departure, count(*) AS total FROM f WHERE airport = 'K3' GROUP BY 1),
c AS (SELECT ts::DATE AS day, arg_max(close, ts) AS close, sum(volume) AS volume FROM b WHERE symbol = 'view' GROUP BY 1)
SELECT c.day::VARCHAR AS day, arrival, departure, total, round(close, 6) AS close, volume FROM c LEFT JOIN d ON d.day + 1 = c.day""")
def joined_data(spark: SparkSession, sf: str) -> DataFrame:
    daily = B.resample(T.bars_1h(spark, sf), B.SESSION_MINUTES)
    x = runs.joined_data(T.flights(spark, sf), daily, "k3", shift_days=1, how="right", mapper=AssetMap({"K3": ["VIEW", "CLICK"]}, {}, {}))
    return shown(x, ["day"], ["arrival", "departure", "total", "close", "volume"])


_SLICE = f"""WITH {Q.B1H}, {_EX}, h AS (SELECT *, close / lag(close) OVER ({_W}) - 1 AS bench FROM fr),
v AS (SELECT h.*, s.name FROM h JOIN (VALUES ('first', DATE '2024-01-01', DATE '2024-01-10'), ('second', DATE '2024-01-08', DATE '2024-01-25')) s(name, a, z) ON ts::DATE BETWEEN a AND z WHERE bench IS NOT NULL),
w AS (SELECT *, product(1 + ret) OVER (PARTITION BY name, symbol ORDER BY ts) AS eq, abs(position - coalesce(lag(position) OVER (PARTITION BY name, symbol ORDER BY ts), position)) AS turn FROM v),
u AS (SELECT *, 1 - eq / max(eq) OVER (PARTITION BY name, symbol ORDER BY ts) AS dd FROM w)"""


@query(f"""{_SLICE} SELECT name AS slice, symbol, count(*) AS n, round(avg(ret) / stddev_samp(ret) * sqrt(1638), 6) AS sharpe, round(avg(ret) / sqrt(avg(ret * ret) FILTER (ret < 0)) * sqrt(1638), 6) AS sortino, round(max(dd), 6) AS max_drawdown,
round(avg(ret) * 1638, 4) AS ann_return, round(avg(position), 6) AS exposure, round(sum(turn) / count(DISTINCT ts::DATE), 6) AS turnover_per_day,
round(covar_samp(ret, bench) / var_samp(bench), 6) AS beta FROM u GROUP BY ALL""")
def evaluate_slices(spark: SparkSession, sf: str) -> DataFrame:
    x = _exposed(spark, sf).withColumn("asset_ret", F.try_divide(F.col("close"), F.lag("close").over(S.by_symbol())) - 1)
    x = runs.evaluate_slices(x.where("asset_ret IS NOT NULL"), {"first": ("2024-01-01", "2024-01-10"), "second": ("2024-01-08", "2024-01-25")}, 1638)
    x = x.withColumn("ann_return", F.round("ann_return", 4))
    return shown(x, ["slice", "symbol"], ["n", "sharpe", "sortino", "max_drawdown", "ann_return", "exposure", "turnover_per_day", "beta"])


@query(f"WITH {Q.B1H} SELECT {_TS}, coalesce(((lead(ts) OVER ({_W}))::DATE = ts::DATE AND lead(close) OVER ({_W}) > close)::INT, 0) AS target FROM b")
def next_up_or_flat(spark: SparkSession, sf: str) -> DataFrame:
    return shown(runs.next_up_or_flat(T.bars_1h(spark, sf)), KEYS, ["target"])


@query(f"""WITH {Q.B1H}, f AS (SELECT *, row_number() OVER ({_W}) - 1 AS own_pos, count(*) OVER (PARTITION BY symbol) AS n, CASE WHEN hour(ts) <> 5 THEN ts + INTERVAL 150 MINUTE END AS t FROM b WHERE hour(ts) <> 7)
SELECT f.symbol, epoch_us(f.ts) // 1000000 AS ts, f.own_pos, CASE WHEN any_value(f.t) IS NULL THEN f.own_pos ELSE greatest(f.own_pos, least(any_value(f.n) - 1, count(g.ts))) END AS touch_pos
FROM f LEFT JOIN b g ON g.symbol = f.symbol AND hour(g.ts) <> 7 AND g.ts < f.t GROUP BY f.symbol, f.ts, f.own_pos""")
def touch_positions(spark: SparkSession, sf: str) -> DataFrame:
    x = T.bars_1h(spark, sf).where(F.hour("ts") != 7).withColumn("t", F.when(F.hour("ts") != 5, F.timestamp_micros(F.unix_micros("ts") + 150 * 60_000_000)))
    return shown(runs.touch_positions(x, "t"), KEYS, ["own_pos", "touch_pos"])


_FIRST = "a AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, value AS close, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY event_id) AS k FROM events)"


@query(f"WITH {_FIRST}, l AS (SELECT *, max(ts::DATE) OVER (PARTITION BY symbol) AS last FROM a) SELECT {_TS}, round(close, 6) AS close FROM l WHERE k = 1 AND (last < DATE '2024-01-25' OR ts::DATE < last)")
def research_load(spark: SparkSession, sf: str) -> DataFrame:
    x = T.ticks(spark, sf).select("symbol", F.date_trunc("minute", "ts").alias("ts"), F.col("price").alias("close"), "tie")
    return shown(R.research_load(x, "tie", "2024-01-25"), KEYS, ["close"])


@query(f"""WITH {Q.B1H}, c AS (SELECT symbol, ts::DATE AS day, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, arg_max(close * 2, ts) AS adjusted_close, sum(volume) AS volume, count(*) AS n, min(ts) AS ts FROM b GROUP BY symbol, ts::DATE)
SELECT {_TS}, {Q.columns('open', 'high', 'low', 'close', 'adjusted_close', 'volume')}, n AS n_bars FROM c WHERE n >= 6""")
def resample_full_days(spark: SparkSession, sf: str) -> DataFrame:
    x = B.resample_to(T.bars_1h(spark, sf).withColumn("adjusted_close", F.col("close") * 2), "day", "hourly", drop_partial=True)
    return shown(x, KEYS, ["open", "high", "low", "close", "adjusted_close", "volume", "n_bars"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_totalprice > 200000 THEN 'new' ELSE 'old' END AS state, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS priority FROM orders""")
def upsert_some_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Target: unfinished orders; source: finished and large ones. Of a conflict only the state is updated."""
    o = T.read(spark, sf, "orders")
    as_of = lambda x, v: x.select("o_orderkey", F.lit(v).alias("state"), F.lit(v).alias("priority"))
    return R.upsert_some(as_of(o.where("o_orderstatus <> 'F'"), "old"), as_of(o.where("o_orderstatus = 'F' OR o_totalprice > 200000"), "new"), ["o_orderkey"], ["state"])


@query(f"""WITH {Q.B1H}, v AS (SELECT *, close / lag(close) OVER ({_W}) - 1 AS returns FROM b) SELECT 'returns' AS feature, round(avg((returns IS NULL)::INT), 6) AS null_share FROM v UNION ALL SELECT 'close', round(avg((close IS NULL)::INT), 6) FROM v""")
def feature_check(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.operators import indicators as I

    return shown(B.check_features(I.compute(T.bars_1h(spark, sf), ["returns"]), ["returns", "close"]), ["feature"], ["null_share"])


@query(f"""WITH {Q.B1H} SELECT symbol, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, round(min(value), 6) AS low, round(max(value), 6) AS high FROM (SELECT event_type AS symbol, value FROM events) GROUP BY symbol""")
def describe(spark: SparkSession, sf: str) -> DataFrame:
    x = T.ticks(spark, sf).groupBy("symbol").agg(F.count("price").alias("n"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("stddev"), F.min("price").alias("low"), F.max("price").alias("high"))
    return shown(x, ["symbol"], ["n", "mean", "stddev", "low", "high"])


#: Both horizons at once: deviations, barriers, spans and folds by self joins of positions.
_HS = "q.interval = p.interval AND q.symbol = p.symbol"
_HW = "PARTITION BY interval, symbol ORDER BY ts"
_HORIZONS = f"""iv AS (SELECT '1h' AS interval, symbol, ts, close, ts::DATE AS day FROM b UNION ALL SELECT '1d', symbol, min(ts), arg_max(close, ts), DATE '2000-01-01' FROM b GROUP BY symbol, ts::DATE),
p AS (SELECT *, row_number() OVER ({_HW}) - 1 AS pos, count(*) OVER (PARTITION BY interval, symbol) AS n, CASE WHEN lag(day) OVER ({_HW}) = day THEN close / lag(close) OVER ({_HW}) - 1 END AS r, ln(close / lag(close) OVER ({_HW})) AS lr FROM iv),
s AS (SELECT p.interval, p.symbol, p.pos, count(*) AS m, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * w) AS q FROM p JOIN LATERAL (SELECT pow(1 - 2::DOUBLE / 101, p.pos - q.pos) AS w, q.r AS x FROM p q WHERE {_HS} AND q.pos <= p.pos AND q.r IS NOT NULL) ON true GROUP BY ALL),
v AS (SELECT interval, symbol, pos, 2 * sqrt(greatest((s2 / s0 - (s1 / s0) * (s1 / s0)) * s0 * s0 / (s0 * s0 - q), 0)) AS t FROM s WHERE m >= 25),
j AS (SELECT p.interval, p.symbol, p.pos, v.t, q.pos AS qp, q.close / p.close - 1 AS g FROM p JOIN v USING (interval, symbol, pos) JOIN p q ON {_HS} AND q.day = p.day AND q.pos > p.pos AND q.pos <= p.pos + 20),
h AS (SELECT interval, symbol, pos, any_value(t) AS t, min(qp) FILTER (g >= t) AS u, min(qp) FILTER (g <= -t) AS d, max(qp) AS last, arg_max(g, qp) AS g FROM j GROUP BY ALL),
o AS (SELECT interval, symbol, pos, CASE WHEN u IS NOT NULL AND (d IS NULL OR u <= d) THEN u ELSE coalesce(d, last) END AS tp, CASE WHEN u IS NOT NULL AND (d IS NULL OR u <= d) THEN t WHEN d IS NOT NULL THEN -t ELSE g END AS ret FROM h),
c AS (SELECT p.interval, p.symbol, p.pos, any_value(p.n) AS n, any_value(p.lr) AS lr, count(q.pos) AS c FROM p LEFT JOIN o q ON {_HS} AND q.pos <= p.pos AND q.tp >= p.pos GROUP BY ALL),
un AS (SELECT p.interval, p.symbol, p.pos, avg(1.0::DOUBLE / q.c) AS u, abs(coalesce(sum(q.lr / q.c) FILTER (q.pos > p.pos), 0)) AS w FROM o p JOIN c q ON {_HS} AND q.pos BETWEEN p.pos AND p.tp GROUP BY ALL),
cu AS (SELECT *, sum(u) OVER (PARTITION BY interval, symbol ORDER BY pos) AS k, sum(u) OVER (PARTITION BY interval, symbol) AS total FROM un),
cw AS (SELECT *, w * greatest(0, 1 - 0.5::DOUBLE / total * (total - k)) AS x FROM cu),
we AS (SELECT interval, symbol, count(*) AS n_labels, avg(u) AS uniqueness, sum(u) AS effective_size, sum(x) / avg(x) AS weight FROM cw GROUP BY ALL),
bd AS (SELECT *, floor(n * f / 6::DOUBLE)::BIGINT AS lo, floor(n * (f + 1) / 6::DOUBLE)::BIGINT AS hi FROM c LEFT JOIN o USING (interval, symbol, pos), range(6) r(f)),
fo AS (SELECT interval, symbol, count(*) FILTER (pos >= lo AND pos < hi) AS n_test, count(*) FILTER (NOT (pos >= lo AND pos < hi + floor(n * 0.01::DOUBLE)) AND NOT (pos < hi AND coalesce(tp, -1) >= lo)) AS n_train FROM bd GROUP BY ALL),
al AS (SELECT interval, symbol, count(*) AS n_bars, avg((ret > 0)::INT) AS share_up, avg(c) AS concurrency FROM c LEFT JOIN o USING (interval, symbol, pos) GROUP BY ALL)"""


@query(f"""WITH {Q.B1H}, {_HORIZONS} SELECT interval, symbol, n_bars, coalesce(n_labels, 0) AS n_labels, n_train, n_test, {Q.columns('share_up', 'concurrency', 'uniqueness', 'effective_size', 'weight')}
FROM al JOIN fo USING (interval, symbol) LEFT JOIN we USING (interval, symbol)""")
def multi_horizon(spark: SparkSession, sf: str) -> DataFrame:
    x = runs.multi_horizon(T.bars_1h(spark, sf), ("1h", "1d"), "1h", features=["returns", "rsi", "macd", "atr"])
    return shown(x, ["interval", "symbol"], ["n_bars", "n_labels", "share_up", "concurrency", "uniqueness", "effective_size", "weight", "n_train", "n_test"])
