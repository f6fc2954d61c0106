"""Registered queries on labels, sample weights, cross-validation and overfitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import series as S
from millrace.operators import bars as B
from millrace.operators import labels as L
from millrace.operators import research as R
from millrace.plans import sql as Q
from millrace.plans.registered import query, shown
from millrace.sources import tables as T

KEYS = ["symbol", "ts"]
_TS = "symbol, epoch_us(ts) // 1000000 AS ts"
_W = "PARTITION BY symbol ORDER BY ts"


@query(f"""WITH {Q.B1H}, x AS (SELECT *, CASE WHEN (lead(ts, 3) OVER ({_W}))::DATE = ts::DATE THEN lead(close, 3) OVER ({_W}) / close - 1 END AS f FROM b)
SELECT {_TS}, round(f, 6) AS forward_return, (f > 0)::INT AS binary_label, CASE WHEN f > 0.05 THEN 1 WHEN f < -0.05 THEN -1 WHEN f IS NOT NULL THEN 0 END AS ternary_label FROM x""")
def fwd_return_labels(spark: SparkSession, sf: str) -> DataFrame:
    x = L.forward_return(T.bars_1h(spark, sf), 3)
    f = F.col("forward_return")
    return shown(x.withColumn("binary_label", L.fixed_horizon(f)).withColumn("ternary_label", L.fixed_horizon(f, 0.05, True)), KEYS, ["forward_return", "binary_label", "ternary_label"])


@query(f"WITH {Q.B1H}, x AS (SELECT symbol, ts::DATE AS d, lag(ts::DATE) OVER ({_W}) AS e FROM b) SELECT symbol, coalesce(bool_or(d = e), false) AS intraday FROM x GROUP BY symbol")
def is_intraday(spark: SparkSession, sf: str) -> DataFrame:
    return B.is_intraday(T.bars_1h(spark, sf))


@query(f"WITH {Q.B1H} SELECT {_TS}, (lead(close) OVER ({_W}) > close)::INT AS target FROM b")
def next_up_target(spark: SparkSession, sf: str) -> DataFrame:
    return shown(L.next_up(T.bars_1h(spark, sf)), KEYS, ["target"])


#: Barriers by a self join of positions within the session; the target is the range of the bar.
_TB = f"""p AS (SELECT *, row_number() OVER ({_W}) - 1 AS pos, ts::DATE AS day, (high - low) / close AS t, CASE WHEN close >= open THEN 1 ELSE -1 END AS s FROM b),
j AS (SELECT p.symbol, p.pos, p.ts, p.close AS e, p.t, p.s, q.pos AS qp, q.close AS c, (q.close / p.close - 1) AS up1 FROM p JOIN p q ON q.symbol = p.symbol AND q.day = p.day AND q.pos > p.pos AND q.pos <= p.pos + 6)"""


def _barrier(s: str) -> str:
    return f"""g AS (SELECT symbol, pos, ts, any_value(t) AS t, any_value({s}) AS s, min(qp) FILTER (({s}) * up1 >= t) AS u, min(qp) FILTER (({s}) * up1 <= -t) AS d, max(qp) AS last, arg_max(up1, qp) AS r FROM j GROUP BY ALL),
h AS (SELECT *, u IS NOT NULL AND (d IS NULL OR u <= d) AS win FROM g),
o AS (SELECT symbol, ts, pos, coalesce(CASE WHEN win THEN u ELSE d END, last) AS touch_pos, CASE WHEN win THEN t WHEN d IS NOT NULL THEN -t ELSE s * r END AS ret FROM h)"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    x = T.bars_1h(spark, sf).withColumn("t", (F.col("high") - F.col("low")) / F.col("close")).withColumn("s", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1))
    return L.triple_barrier(x, 6, 1.0, 1.0, "t")


@query(f"""WITH {Q.B1H}, {_TB}, {_barrier('1')} SELECT p.symbol, epoch_us(p.ts) // 1000000 AS ts, o.touch_pos, round(o.ret, 6) AS ret, sign(o.ret)::INT AS label FROM p LEFT JOIN o ON o.symbol = p.symbol AND o.pos = p.pos""")
def triple_barrier(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_labelled(spark, sf), KEYS, ["touch_pos", "ret", "label"])


@query(f"""WITH {Q.B1H}, {_TB}, {_barrier('s')} SELECT p.symbol, epoch_us(p.ts) // 1000000 AS ts, o.touch_pos, round(o.ret, 6) AS ret, (o.ret > 0)::INT AS label FROM p LEFT JOIN o ON o.symbol = p.symbol AND o.pos = p.pos""")
def meta_labels(spark: SparkSession, sf: str) -> DataFrame:
    x = T.bars_1h(spark, sf).withColumn("t", (F.col("high") - F.col("low")) / F.col("close")).withColumn("s", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1))
    return shown(L.meta_labels(x, 6, 1.0, 1.0, "t", "s"), KEYS, ["touch_pos", "ret", "label"])


#: Spans that both engines read off the position: every fourth row has none.
_SP = f"""sp AS (SELECT symbol, ts, close, row_number() OVER ({_W}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM b),
t AS (SELECT symbol, ts, close, pos, CASE WHEN pos % 4 = 3 THEN NULL ELSE least(pos + 1 + pos % 7, n - 1) END AS tp FROM sp),
cc AS (SELECT a.symbol, a.pos, count(q.pos) AS c FROM t a LEFT JOIN t q ON q.symbol = a.symbol AND q.tp IS NOT NULL AND q.pos <= a.pos AND q.tp >= a.pos GROUP BY ALL)"""


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    x = S.with_pos(T.bars_1h(spark, sf)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return x.withColumn("touch_pos", F.when(F.col("pos") % 4 != 3, F.least(F.col("pos") + 1 + F.col("pos") % 7, F.col("_n") - 1))).drop("_n")


@query(f"WITH {Q.B1H}, {_SP} SELECT symbol, pos, c AS concurrency FROM cc")
def concurrency(spark: SparkSession, sf: str) -> DataFrame:
    return shown(R.concurrency(_spans(spark, sf)), ["symbol", "pos"], ["concurrency"])


_UN = "un AS (SELECT t.symbol, t.pos, any_value(t.tp) AS tp, CASE WHEN any_value(t.tp) IS NOT NULL THEN avg(1.0::DOUBLE / c) END AS u FROM t JOIN cc ON cc.symbol = t.symbol AND cc.pos BETWEEN t.pos AND coalesce(t.tp, t.pos) AND (t.tp IS NULL OR c > 0) GROUP BY ALL)"


@query(f"WITH {Q.B1H}, {_SP}, {_UN} SELECT symbol, pos, round(u, 6) AS uniqueness FROM un")
def uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return shown(R.uniqueness(_spans(spark, sf)), ["symbol", "pos"], ["uniqueness"])


_RW = f"""lr AS (SELECT t.symbol, t.pos, ln(close / lag(close) OVER (PARTITION BY t.symbol ORDER BY t.pos)) / nullif(c, 0) AS r FROM t JOIN cc ON cc.symbol = t.symbol AND cc.pos = t.pos),
rw AS (SELECT t.symbol, t.pos, CASE WHEN any_value(t.tp) IS NOT NULL THEN abs(coalesce(sum(lr.r), 0)) END AS w FROM t LEFT JOIN lr ON lr.symbol = t.symbol AND lr.pos > t.pos AND lr.pos <= t.tp GROUP BY ALL),
wn AS (SELECT symbol, pos, w / avg(w) OVER (PARTITION BY symbol) AS weight FROM rw)"""


@query(f"WITH {Q.B1H}, {_SP}, {_RW} SELECT symbol, pos, round(weight, 6) AS weight FROM wn")
def return_weights(spark: SparkSession, sf: str) -> DataFrame:
    return shown(R.return_weights(_spans(spark, sf)), ["symbol", "pos"], ["weight"])


_DC = f"""cu AS (SELECT symbol, pos, u, sum(coalesce(u, 0)) OVER (PARTITION BY symbol ORDER BY pos) AS c FROM un),
dc AS (SELECT symbol, pos, u, greatest(0, 1 - 0.5::DOUBLE / max(c) OVER (PARTITION BY symbol) * (max(c) OVER (PARTITION BY symbol) - c)) AS decay FROM cu)"""


@query(f"WITH {Q.B1H}, {_SP}, {_UN}, {_DC} SELECT symbol, pos, round(decay, 6) AS decay FROM dc")
def time_decay(spark: SparkSession, sf: str) -> DataFrame:
    return shown(R.time_decay(_spans(spark, sf)), ["symbol", "pos"], ["decay"])


@query(f"WITH {Q.B1H}, {_SP}, {_UN}, {_DC}, {_RW}, x AS (SELECT symbol, pos, weight * decay AS v FROM wn JOIN dc USING (symbol, pos)) SELECT symbol, pos, round(v / avg(v) OVER (PARTITION BY symbol), 6) AS combined FROM x")
def combined_weights(spark: SparkSession, sf: str) -> DataFrame:
    return shown(R.combined_weights(_spans(spark, sf)), ["symbol", "pos"], ["combined"])


@query(f"WITH {Q.B1H}, {_SP}, {_UN} SELECT symbol, round(sum(u), 6) AS effective_size FROM un GROUP BY symbol")
def effective_size(spark: SparkSession, sf: str) -> DataFrame:
    return shown(R.effective_size(R.uniqueness(_spans(spark, sf))), ["symbol"], ["effective_size"])


def _folds(k: int) -> str:
    return f"bd AS (SELECT symbol, any_value(n) AS n, f AS fold, floor(any_value(n) * f / {k}::DOUBLE)::BIGINT AS lo, floor(any_value(n) * (f + 1) / {k}::DOUBLE)::BIGINT AS hi FROM sp, range({k}) r(f) GROUP BY symbol, f)"


_CLEAR = "NOT (pos >= lo AND pos < hi + floor(n * {e})) AND NOT (pos < hi AND coalesce(tp, -1) >= lo)"


@query(f"""WITH {Q.B1H}, {_SP}, {_folds(5)}, x AS (SELECT t.symbol, pos, fold::INT AS fold, CASE WHEN pos >= lo AND pos < hi THEN 'test' WHEN {_CLEAR.format(e=0.02)} THEN 'train' END AS role FROM t JOIN bd ON bd.symbol = t.symbol)
SELECT * FROM x WHERE role IS NOT NULL""")
def purged_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return R.purged_kfold(_spans(spark, sf), 5, 0.02)


@query(f"""WITH {Q.B1H}, {_SP}, {_folds(4)}, co AS (SELECT (row_number() OVER (ORDER BY a.i, b2.i) - 1)::INT AS split, a.i AS g1, b2.i AS g2 FROM range(4) a(i), range(4) b2(i) WHERE a.i < b2.i),
x AS (SELECT t.symbol, pos, split, bool_or(pos >= lo AND pos < hi) AS test, bool_and({_CLEAR.format(e=0)}) AS clear FROM t JOIN bd ON bd.symbol = t.symbol JOIN co ON fold IN (g1, g2) GROUP BY ALL)
SELECT symbol, pos, split, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM x WHERE test OR clear""")
def cpcv_splits(spark: SparkSession, sf: str) -> DataFrame:
    return R.combinatorial_splits(_spans(spark, sf), 4, 2)


@query(f"""WITH {Q.B1H}, {_SP}, x AS (SELECT symbol, pos, f::INT AS fold, n - (n // 4) * (3 - f) AS lo, n - (n // 4) * (2 - f) AS hi FROM sp, range(3) r(f))
SELECT symbol, pos, fold, CASE WHEN pos >= lo THEN 'test' ELSE 'train' END AS role FROM x WHERE pos < hi""")
def time_series_split(spark: SparkSession, sf: str) -> DataFrame:
    return R.time_series_split(_spans(spark, sf), 3)


@query(f"WITH {Q.B1H}, {_SP} SELECT symbol, pos, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS role FROM sp")
def chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    return R.chronological_split(_spans(spark, sf)).select("symbol", "pos", "role")


@query("""WITH p AS (SELECT ts::DATE AS period, hour(ts)::INT AS config, avg(value) - 50 AS perf FROM events GROUP BY ALL), o AS (SELECT period, ((row_number() OVER (ORDER BY period) - 1) * 6 // count(*) OVER ())::INT AS block FROM (SELECT DISTINCT period FROM p)),
c AS (SELECT block, config, perf FROM p JOIN o USING (period)),
h AS (SELECT row_number() OVER (ORDER BY a.i, b.i, d.i) - 1 AS split, [a.i, b.i, d.i] AS g FROM range(6) a(i), range(6) b(i), range(6) d(i) WHERE a.i < b.i AND b.i < d.i),
s AS (SELECT split, config, coalesce(avg(perf) FILTER (list_contains(g, block)) / nullif(stddev_samp(perf) FILTER (list_contains(g, block)), 0), 0) AS i, coalesce(avg(perf) FILTER (NOT list_contains(g, block)) / nullif(stddev_samp(perf) FILTER (NOT list_contains(g, block)), 0), 0) AS u FROM c, h GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY u) AS rank, count(*) OVER (PARTITION BY split) AS m FROM s),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY split ORDER BY i DESC, config) = 1)
SELECT split::INT AS split, config AS best, rank::INT AS rank, round(ln((rank / (m + 1)::DOUBLE) / (1 - rank / (m + 1)::DOUBLE)), 6) AS logit FROM b""")
def pbo(spark: SparkSession, sf: str) -> DataFrame:
    p = T.read(spark, sf, "events").groupBy(F.to_date("ts").alias("period"), F.hour("ts").alias("config")).agg((F.avg("value") - 50).alias("perf"))
    return shown(R.backtest_overfitting(p, 6), ["split"], ["best", "rank", "logit"])


@query()
def ml_random_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-sample scores of a forest on lagged features, trained on the first 80 % of each symbol."""
    from millrace.operators import indicators as I
    from millrace.operators import metrics as M
    from millrace.operators import models

    features = ["rsi", "volatility", "volume_features_volume_ratio", "atr"]
    x = I.compute(T.bars_1h(spark, sf), ["rsi", "volatility", "volume_features", "atr"])
    x = R.chronological_split(S.with_pos(L.next_up(x)))
    fitted = models.train(x.where("role = 'train'"), features, "target")
    out = models.predict(fitted, x.where("role = 'test' AND target IS NOT NULL"), features)
    return shown(M.classification(out, "target", "prediction", "p"), ["tp", "fp", "tn", "fn"], ["accuracy", "precision", "recall", "f1", "auc"])
