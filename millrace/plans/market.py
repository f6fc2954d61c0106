"""Registered queries on bars: preparation, indicators, exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import bars as B
from millrace.operators import indicators as I
from millrace.plans import sql as Q
from millrace.plans.registered import query, shown
from millrace.sources import tables as T

KEYS = ["symbol", "ts"]
_TS = "symbol, epoch_us(ts) // 1000000 AS ts"
_W = "PARTITION BY symbol ORDER BY ts"
_W20 = f"({_W} ROWS 19 PRECEDING)"


def _ind(spark, sf, names: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    return shown(I.compute(T.bars_1h(spark, sf), names), KEYS, columns, digits)


@query(f"WITH {Q.B1H} SELECT {_TS}, {Q.columns('open', 'high', 'low', 'close', 'volume')} FROM b")
def ohlcv_resample(spark: SparkSession, sf: str) -> DataFrame:
    return shown(T.bars_1h(spark, sf), KEYS, ["open", "high", "low", "close", "volume"])


@query(f"""WITH {Q.B1H}, n AS (SELECT *, row_number() OVER ({_W}) AS r FROM b),
d AS (SELECT symbol, ts, open, CASE WHEN r % 11 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN r % 7 = 0 THEN NULL ELSE close END AS close, volume, 1 AS seq FROM n
    UNION ALL SELECT symbol, ts, open, high, low, close * 1.01::DOUBLE, volume, 2 FROM n WHERE r % 5 = 0),
o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) = 1),
f AS (SELECT symbol, ts, last_value(open IGNORE NULLS) OVER ({_W}) AS open, last_value(high IGNORE NULLS) OVER ({_W}) AS high,
    last_value(low IGNORE NULLS) OVER ({_W}) AS low, last_value(close IGNORE NULLS) OVER ({_W}) AS close, last_value(volume IGNORE NULLS) OVER ({_W}) AS volume FROM o)
SELECT {_TS}, {Q.columns('open', 'high', 'low', 'close', 'volume')} FROM f WHERE close IS NOT NULL AND high >= low AND volume >= 0""")
def clean_dedup_ffill(spark: SparkSession, sf: str) -> DataFrame:
    """Cleans bars with repeats, gaps and broken ranges put in by rule."""
    from millrace.functions import series as S

    n = S.with_pos(T.bars_1h(spark, sf)).withColumn("r", F.col("pos") + 1)
    first = n.select(*KEYS, "open", F.when(F.col("r") % 11 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", F.when(F.col("r") % 7 == 0, None).otherwise(F.col("close")).alias("close"), "volume", F.lit(1).alias("seq"))
    again = n.where("r % 5 = 0").select(*KEYS, "open", "high", "low", (F.col("close") * 1.01).alias("close"), "volume", F.lit(2).alias("seq"))
    return shown(B.clean(first.unionByName(again), "seq"), KEYS, list(B.PRICES))


@query(f"WITH {Q.B1H} SELECT {_TS}, abs(close - avg(close) OVER {_W20}) > 3 * coalesce(stddev_samp(close) OVER {_W20}, 0) AS is_outlier FROM b")
def outlier_flags(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.outliers(T.bars_1h(spark, sf)), KEYS, ["is_outlier"])


@query(f"""WITH {Q.B1H}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER ({_W}) > 0.1 * 86400000000 THEN 1 ELSE 0 END AS cut FROM b),
s AS (SELECT *, sum(cut) OVER ({_W}) AS seg FROM g), c AS (SELECT symbol, seg, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT symbol, seg FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, seg) = 1)
SELECT {_TS}, {Q.columns('close')} FROM s SEMI JOIN p USING (symbol, seg)""")
def largest_segment(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.largest_segment(T.bars_1h(spark, sf), 0.1), KEYS, ["close"])


@query(f"""WITH {Q.B1D} SELECT symbol, count(*) AS n_rows, count_if(NOT close > 0) AS bad_close, count_if(NOT high >= low) AS bad_range, count_if(NOT volume >= 0) AS bad_volume,
count(*) - count(DISTINCT ts) AS repeated_ts FROM b GROUP BY symbol""")
def bar_validation(spark: SparkSession, sf: str) -> DataFrame:
    return B.validation(T.bars_1d(spark, sf))


@query(f"WITH {Q.B1H}, r AS (SELECT *, close / lag(close) OVER ({_W}) - 1 AS returns, ln(close / lag(close) OVER ({_W})) AS log_returns FROM b) SELECT {_TS}, {Q.columns('returns', 'log_returns')} FROM r")
def returns_log(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, ["returns", "log_returns"], ["returns", "log_returns"])


def _wma(x: str, n: int) -> str:
    return "(" + " + ".join(f"lag({x}, {j}) OVER w * {n - j}" for j in range(n)) + f") / {n * (n + 1) / 2}::DOUBLE"


@query(f"""WITH {Q.B1H}, r AS (SELECT *, CASE WHEN count(close) OVER {_W20} = 20 THEN avg(close) OVER {_W20} END AS sma, {_wma('close', 20)} AS wma,
2 * ({_wma('close', 10)}) - ({_wma('close', 20)}) AS raw FROM b WINDOW w AS ({_W})), h AS (SELECT *, {_wma('raw', 4)} AS hma FROM r WINDOW w AS ({_W}))
SELECT {_TS}, {Q.columns('sma', 'wma', 'hma')} FROM h""")
def sma_wma_hma(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, ["sma", "wma", "hma"], ["sma", "wma", "hma"])


_POS = f"p AS (SELECT *, row_number() OVER ({_W}) - 1 AS pos FROM b)"


@query(f"""WITH {Q.B1H}, {_POS}, m AS (SELECT *, {Q.ema('close', 2 / 21)} AS ema, {Q.ema('close', 2 / 13)} - ({Q.ema('close', 2 / 27)}) AS macd_macd FROM p),
s AS (SELECT *, {Q.ema('macd_macd', 0.2)} AS macd_signal FROM m), h AS (SELECT *, macd_macd - macd_signal AS macd_histogram FROM s)
SELECT {_TS}, {Q.columns('ema', 'macd_macd', 'macd_signal', 'macd_histogram')} FROM h""")
def ema_macd(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, ["ema", "macd"], ["ema", "macd_macd", "macd_signal", "macd_histogram"])


@query(f"""WITH {Q.B1H}, {_POS}, d AS (SELECT *, close - lag(close) OVER ({_W}) AS d FROM p),
u AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS down FROM d),
g AS (SELECT *, {Q.ema('up', 1 / 14, 1)} AS g, {Q.ema('down', 1 / 14, 1)} AS l FROM u),
r AS (SELECT *, CASE WHEN pos >= 14 THEN CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0::DOUBLE END ELSE 100 - 100 / (1 + g / l) END END AS rsi FROM g)
SELECT {_TS}, {Q.columns('rsi')} FROM r""")
def rsi_wilder(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, ["rsi"], ["rsi"])


@query(f"""WITH {Q.B1H}, {_POS}, d AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({_W})), abs(low - lag(close) OVER ({_W}))) AS tr FROM p),
r AS (SELECT *, CASE WHEN pos >= 13 THEN {Q.ema('tr', 1 / 14)} END AS atr FROM d) SELECT {_TS}, {Q.columns('atr')} FROM r""")
def atr_wilder(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, ["atr"], ["atr"])


@query(f"""WITH {Q.B1H}, r AS (SELECT *, CASE WHEN count(close) OVER {_W20} = 20 THEN avg(close) OVER {_W20} END AS bollinger_bands_middle,
CASE WHEN count(close) OVER {_W20} = 20 THEN stddev_samp(close) OVER {_W20} END AS sd FROM b),
h AS (SELECT *, bollinger_bands_middle + 2 * sd AS bollinger_bands_upper, bollinger_bands_middle - 2 * sd AS bollinger_bands_lower FROM r)
SELECT {_TS}, {Q.columns('bollinger_bands_lower', 'bollinger_bands_middle', 'bollinger_bands_upper')} FROM h""")
def bollinger(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, ["bollinger_bands"], ["bollinger_bands_lower", "bollinger_bands_middle", "bollinger_bands_upper"])


def _full(agg: str, n: int = 20) -> str:
    return f"CASE WHEN count(r) OVER {_W20} = {n} THEN {agg}(r) OVER {_W20} END"


@query(f"""WITH {Q.B1H}, r AS (SELECT *, close / lag(close) OVER ({_W}) - 1 AS r FROM b),
h AS (SELECT *, {_full('stddev_samp')} AS volatility, {_full('avg')} AS rolling_stats_rolling_mean, {_full('stddev_samp')} AS rolling_stats_rolling_std,
{_full('skewness')} AS rolling_stats_rolling_skew, {_full('kurtosis')} AS rolling_stats_rolling_kurtosis FROM r)
SELECT {_TS}, {Q.columns('volatility', 'rolling_stats_rolling_mean', 'rolling_stats_rolling_std', 'rolling_stats_rolling_skew', 'rolling_stats_rolling_kurtosis')} FROM h""")
def rolling_moments(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, ["volatility", "rolling_stats"], ["volatility", *I.FEATURES["rolling_stats"].outputs])


@query(f"""WITH {Q.B1H}, f AS (SELECT *, coalesce(sign(close - lag(close) OVER ({_W})) * volume, 0) AS flow, CASE WHEN count(volume) OVER {_W20} = 20 THEN avg(volume) OVER {_W20} END AS volume_features_volume_sma FROM b),
h AS (SELECT *, volume / nullif(volume_features_volume_sma, 0) AS volume_features_volume_ratio, sum(flow) OVER ({_W}) AS volume_features_obv FROM f)
SELECT {_TS}, {Q.columns('volume_features_volume_sma', 'volume_features_volume_ratio', 'volume_features_obv')} FROM h""")
def volume_obv(spark: SparkSession, sf: str) -> DataFrame:
    return _ind(spark, sf, ["volume_features"], list(I.FEATURES["volume_features"].outputs))


@query(f"""WITH {Q.B1H}, h AS (SELECT *, coalesce((close > lag(close) OVER ({_W}))::INT, 0) AS price_direction, high - low AS price_features_high_low_range,
close - open AS price_features_close_open_range, open - lag(close) OVER ({_W}) AS price_features_gap FROM b)
SELECT {_TS}, price_direction, {Q.columns('price_features_high_low_range', 'price_features_close_open_range', 'price_features_gap')} FROM h""")
def price_features(spark: SparkSession, sf: str) -> DataFrame:
    df = I.compute(T.bars_1h(spark, sf), ["price_direction", "price_features"]).withColumn("price_direction", F.col("price_direction").cast("int"))
    return shown(df, KEYS, ["price_direction", *I.FEATURES["price_features"].outputs])


_R = f"r AS (SELECT *, row_number() OVER ({_W}) - 1 AS pos, close / lag(close) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) - 1 AS r FROM b)"
_Q100 = repr(99 / 101)


def _disc(x: str, q: str) -> str:
    return f"sum(coalesce({x}, 0) * pow({q}::DOUBLE, -pos)) OVER ({_W}) * pow({q}::DOUBLE, pos)"


@query(f"""WITH {Q.B1H}, {_R}, s AS (SELECT *, {_disc('(r IS NOT NULL)::INT', _Q100)} AS s0, {_disc('r', _Q100)} AS s1, {_disc('r * r', _Q100)} AS s2, {_disc('(r IS NOT NULL)::INT', repr((99 / 101) ** 2))} AS q,
count(r) OVER ({_W}) AS n FROM r), v AS (SELECT *, CASE WHEN n >= 25 THEN sqrt(greatest((s2 / s0 - (s1 / s0) * (s1 / s0)) * s0 * s0 / (s0 * s0 - q), 0)) END AS ewm_volatility FROM s)
SELECT {_TS}, {Q.columns('ewm_volatility')} FROM v""")
def ewm_std(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.operators import labels as L

    return shown(L.ewm_volatility(T.bars_1h(spark, sf), 100), KEYS, ["ewm_volatility"])


@query(f"""WITH {Q.B1H}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) - 1 AS r FROM b)
SELECT {_TS}, round(CASE WHEN count(r) OVER (w ROWS 99 PRECEDING) >= 25 THEN stddev_samp(r) OVER (w ROWS 99 PRECEDING) END, 6) AS realised FROM r WINDOW w AS ({_W})""")
def realised_volatility(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.operators import labels as L

    return shown(L.realised_volatility(T.bars_1h(spark, sf), 100), KEYS, ["realised"])


@query(f"""WITH {Q.B1H}, m AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER (PARTITION BY symbol, ts::DATE) AS f FROM b),
k AS (SELECT *, f + ((us - f) // 14400000000) * 14400000000 AS bin FROM m)
SELECT symbol, bin // 1000000 AS ts, {Q.columns('open', 'high', 'low', 'close', 'volume')}, n_bars FROM (SELECT symbol, bin, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_bars FROM k GROUP BY ALL)""")
def session_resample(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.resample(T.bars_1h(spark, sf), 240), KEYS, [*B.PRICES, "n_bars"])


@query("SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, epoch_us(min(ts)) // 1000000 AS first_ts, epoch_us(max(ts)) // 1000000 AS last_ts FROM events GROUP BY event_type")
def coverage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.coverage(T.read(spark, sf, "events"), "event_type"), ["event_type"], ["n_rows", "n_users", "first_ts", "last_ts"])


@query("SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def hour_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return B.hour_histogram(T.read(spark, sf, "events"))


@query(f"""WITH {Q.B1H}, d AS (SELECT symbol, ts::DATE AS day, count(*) AS n FROM b GROUP BY ALL)
SELECT symbol, count(*) AS n_days, min(n) AS min_bars, max(n) AS max_bars, round(avg(n), 6) AS avg_bars, round(quantile_cont(n, 0.5), 6) AS median_bars FROM d GROUP BY symbol""")
def bars_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.bars_per_day(T.bars_1h(spark, sf)), ["symbol"], ["n_days", "min_bars", "max_bars", "avg_bars", "median_bars"])


_LAGS = [1, 2, 5, 10]


@query(f"""WITH {Q.B1H}, {_R}, d AS (SELECT symbol, ts, r - avg(r) OVER (PARTITION BY symbol) AS d FROM r WHERE r IS NOT NULL),
""" + ", ".join(f"l{k} AS (SELECT symbol, {k} AS lag, sum(d * x) / sum(d * d) AS a FROM (SELECT symbol, d, lead(d, {k}) OVER ({_W}) AS x FROM d) GROUP BY symbol)" for k in _LAGS)
    + " " + " UNION ALL ".join(f"SELECT symbol, lag, round(a, 6) AS autocorr FROM l{k}" for k in _LAGS))
def autocorr(spark: SparkSession, sf: str) -> DataFrame:
    x = T.bars_1h(spark, sf).withColumn("day", F.to_date("ts")).withColumn("r", B.session_return())
    return shown(B.autocorrelation(x, "r", _LAGS), ["symbol", "lag"], ["autocorr"])


@query(f"""WITH {Q.B1H}, {_R}, x AS (SELECT symbol, r, row_number() OVER ({_W}) - 1 AS p, sum(r) OVER ({_W} ROWS 4 PRECEDING) AS q FROM r WHERE r IS NOT NULL)
SELECT symbol, round(var_samp(q) FILTER (p >= 5) / (5 * var_samp(r)), 6) AS variance_ratio FROM x GROUP BY symbol""")
def variance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    x = T.bars_1h(spark, sf).withColumn("day", F.to_date("ts")).withColumn("r", B.session_return())
    return shown(B.variance_ratio(x, "r", 5), ["symbol"], ["variance_ratio"])


@query(f"""WITH {Q.B1H}, d AS (SELECT symbol, ts::DATE AS day, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM b GROUP BY ALL),
x AS (SELECT symbol, day, c / lag(c) OVER w - 1 AS total, o / lag(c) OVER w - 1 AS overnight, c / o - 1 AS intraday FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, day::VARCHAR AS day, {Q.columns('total', 'overnight', 'intraday')} FROM x""")
def overnight_intraday(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.overnight_intraday(T.bars_1h(spark, sf)), ["symbol", "day"], ["total", "overnight", "intraday"])


@query(f"""WITH {Q.B1H}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) - 1 AS bar, close / lag(close) OVER ({_W}) - 1 AS r FROM b)
SELECT symbol, bar, round(avg(r) * 10000, 4) AS mean_ret_bps, round(avg(abs(r)) * 10000, 4) AS mean_abs_ret_bps, round(avg(volume), 4) AS mean_volume FROM x GROUP BY ALL""")
def intraday_profile(spark: SparkSession, sf: str) -> DataFrame:
    return shown(B.intraday_profile(T.bars_1h(spark, sf)), ["symbol", "bar"], ["mean_ret_bps", "mean_abs_ret_bps", "mean_volume"], 4)
