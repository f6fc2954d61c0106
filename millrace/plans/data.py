"""Registered queries on alignment, reshaping, upserts and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import series as S
from millrace.operators import align as A
from millrace.operators import indicators as I
from millrace.operators import reshape as R
from millrace.plans import sql as Q
from millrace.plans.registered import query, shown
from millrace.sources import tables as T

KEYS = ["symbol", "ts"]
_TS = "symbol, epoch_us(ts) // 1000000 AS ts"
_W = "PARTITION BY symbol ORDER BY ts"


@query("""WITH d AS (SELECT event_type AS symbol, ts::DATE AS day, sum(value) AS value FROM events GROUP BY ALL),
s AS (SELECT symbol, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY symbol)
SELECT s.symbol, s.day::VARCHAR AS day, round(coalesce(d.value, 0), 4) AS value FROM s LEFT JOIN d ON d.symbol = s.symbol AND d.day = s.day""")
def daily_spine(spark: SparkSession, sf: str) -> DataFrame:
    x = T.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", "value")
    return shown(A.daily_spine(x, "value"), ["symbol", "day"], ["value"], 4)


_NET = "n AS (SELECT o_orderdate::DATE AS day, count(*) FILTER (o_orderpriority LIKE '1%') - count(*) FILTER (o_orderpriority LIKE '2%') AS net FROM orders GROUP BY 1)"


def _net(spark: SparkSession, sf: str) -> DataFrame:
    o = T.read(spark, sf, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg((F.count_if(F.col("o_orderpriority").startswith("1")) - F.count_if(F.col("o_orderpriority").startswith("2"))).alias("net"))


def _closes(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars_1d(spark, sf).select("symbol", F.to_date("ts").alias("day"), "close", "volume")  # one bar a day already


@query(f"""WITH {Q.B1D}, {_NET} SELECT symbol, (n.day + 1)::VARCHAR AS day, net, round(close, 8) AS close FROM n JOIN b ON b.ts::DATE = n.day + 1""")
def trading_day_join(spark: SparkSession, sf: str) -> DataFrame:
    return shown(A.trading_day_join(_net(spark, sf), _closes(spark, sf), "inner", 1), ["symbol", "day"], ["net", "close"], 8)


@query(f"""WITH {Q.B1D}, {_NET}, r AS (SELECT symbol, ts::DATE AS day, close / lag(close) OVER ({_W}) - 1 AS ret FROM b)
SELECT symbol, round(corr(net, ret), 6) AS correlation FROM n JOIN r USING (day) WHERE ret IS NOT NULL GROUP BY symbol""")
def flow_return_corr(spark: SparkSession, sf: str) -> DataFrame:
    r = T.bars_1d(spark, sf).withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(S.by_symbol())) - 1).select("symbol", F.to_date("ts").alias("day"), "ret")
    x = A.trading_day_join(_net(spark, sf), r.where("ret IS NOT NULL")).groupBy("symbol").agg(F.corr("net", "ret").alias("correlation"))
    return shown(x, ["symbol"], ["correlation"])


@query(f"""WITH {Q.B1D}, {_NET}, c AS (SELECT ts::DATE AS day, round(max(close) FILTER (symbol = 'AF'), 8) AS "AF_close", round(max(close) FILTER (symbol = 'NO'), 8) AS "NO_close" FROM b GROUP BY 1)
SELECT coalesce(n.day, c.day)::VARCHAR AS day, net, "AF_close", "NO_close" FROM n FULL JOIN c ON n.day = c.day""")
def basket_pivot(spark: SparkSession, sf: str) -> DataFrame:
    closes = T.bars_1d(spark, sf).withColumn("day", F.to_date("ts"))
    return shown(A.basket(_net(spark, sf), closes, ["AF", "NO"]), ["day"], ["net", "AF_close", "NO_close"], 8)


_MAP = {"K0": ["DAL", "UAL"], "K1": ["AAL"], "K2": ["LUV", "DAL"], "K3": []}


@query(f"""WITH {Q.FLIGHTS}, m(airport, t) AS (VALUES ('K0', 'DAL'), ('K0', 'UAL'), ('K1', 'AAL'), ('K2', 'LUV'), ('K2', 'DAL'))
SELECT m.t AS ticker, f.direction, count(*) AS flights FROM f JOIN m USING (airport) GROUP BY ALL""")
def asset_mapper(spark: SparkSession, sf: str) -> DataFrame:
    m = A.AssetMap(_MAP, {}, {})
    x = T.flights(spark, sf).withColumn("ticker", F.explode(m.tickers(F.col("airport"))))
    return x.groupBy("ticker", "direction").agg(F.count(F.lit(1)).alias("flights"))


@query("""SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE s.s_acctbal BETWEEN 0 AND 5000 AND r.r_name IN ('ASIA', 'EUROPE')""")
def dimension_join(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (T.read(spark, sf, t) for t in ("supplier", "nation", "region"))
    x = s.where(F.col("s_acctbal").between(0, 5000)).join(n, s["s_nationkey"] == n["n_nationkey"]).join(r.where(F.col("r_name").isin("ASIA", "EUROPE")), n["n_regionkey"] == r["r_regionkey"])
    return x.select("s_suppkey", "s_name", "n_name", "r_name")


@query("""WITH a AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT a.event_id, epoch_us(min(p.ts)) // 1000000 AS next_purchase FROM a LEFT JOIN p ON p.user_id = a.user_id AND p.ts > a.ts GROUP BY a.event_id""")
def asof_next_event(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events")
    x = A.next_after(e.where("event_type = 'view'").select("user_id", "event_id", "ts"), e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("p")), ["user_id"], "ts", "p", "next_purchase")
    return shown(x, ["event_id"], ["next_purchase"])


_FEATS = f"""w AS (SELECT symbol, ts, close / lag(close) OVER ({_W}) - 1 AS returns, high - low AS price_features_high_low_range, open - lag(close) OVER ({_W}) AS price_features_gap FROM b)"""
_NAMES = ["returns", "price_features_high_low_range", "price_features_gap"]


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return R.to_long(I.compute(T.bars_1h(spark, sf), ["returns", "price_features"]), _NAMES)


@query(f"""WITH {Q.B1H}, {_FEATS} SELECT {_TS}, feature_name, round(feature_value, 6) AS feature_value FROM (UNPIVOT w ON {', '.join(_NAMES)} INTO NAME feature_name VALUE feature_value)""")
def feature_long(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_long(spark, sf), [*KEYS, "feature_name"], ["feature_value"])


@query(f"WITH {Q.B1H}, {_FEATS} SELECT {_TS}, {Q.columns(*_NAMES)} FROM w")
def feature_wide(spark: SparkSession, sf: str) -> DataFrame:
    return shown(R.to_wide(_long(spark, sf), _NAMES), KEYS, _NAMES)


@query("""SELECT o_orderkey, max(o_orderstatus) FILTER (k = 2) AS o_orderstatus, round(CASE WHEN max(k) = 2 THEN max(o_totalprice) FILTER (k = 2) ELSE max(o_totalprice) END, 6) AS o_totalprice FROM (
SELECT o_orderkey, NULL AS o_orderstatus, o_totalprice, 1 AS k FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice * 2, 2 FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000) GROUP BY o_orderkey""")
def upsert_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    o = T.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    target = o.where("o_orderstatus <> 'F'").withColumn("o_orderstatus", F.lit(None).cast("string"))
    x = R.upsert(target, o.where("o_orderstatus = 'F' OR o_totalprice > 200000").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"])
    return shown(x, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("SELECT o_orderkey, round(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE -o_totalprice END, 6) AS o_totalprice FROM orders")
def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    o = T.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    target, source = o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F' OR o_totalprice > 200000").withColumn("o_totalprice", -F.col("o_totalprice"))
    return shown(R.insert_absent(target.drop("o_orderstatus"), source.drop("o_orderstatus"), ["o_orderkey"]), ["o_orderkey"], ["o_totalprice"])


@query(f"WITH {Q.B1H}, hw AS (SELECT symbol, max(ts) AS h FROM b WHERE ts < TIMESTAMP '2024-01-20' AND symbol <> 'view' GROUP BY symbol) SELECT {_TS.replace('symbol', 'b.symbol', 1)}, round(close, 6) AS close FROM b LEFT JOIN hw ON hw.symbol = b.symbol WHERE h IS NULL OR ts > h")
def incremental_merge(spark: SparkSession, sf: str) -> DataFrame:
    b = T.bars_1h(spark, sf)
    hw = R.high_water(b.where("ts < TIMESTAMP '2024-01-20' AND symbol <> 'view'"))
    return shown(R.incremental(b, hw), KEYS, ["close"])


@query(f"""WITH {Q.B1H}, hw AS (SELECT symbol, max(ts) AS h FROM b WHERE ts < TIMESTAMP '2024-01-20' GROUP BY symbol),
x AS (SELECT b.*, ts > h AS is_new, row_number() OVER (PARTITION BY b.symbol, ts > h ORDER BY ts DESC) AS k FROM b JOIN hw ON hw.symbol = b.symbol) SELECT {_TS}, is_new FROM x WHERE is_new OR k <= 20""")
def warm_up_overlap(spark: SparkSession, sf: str) -> DataFrame:
    b = T.bars_1h(spark, sf)
    return shown(R.with_warm_up(b, R.high_water(b.where("ts < TIMESTAMP '2024-01-20'")), 20), KEYS, ["is_new"])


@query(f"""WITH {Q.B1H}, p AS (SELECT *, row_number() OVER ({_W}) - 1 AS pos FROM b), w AS (SELECT symbol, ts, pos, list([close::FLOAT, volume::FLOAT]) OVER ({_W} ROWS 7 PRECEDING) AS w FROM p)
SELECT {_TS}, pos, len(w) AS n, round(w[1][1]::DOUBLE, 4) AS first_close, round(w[8][1]::DOUBLE, 4) AS last_close, round(list_sum(list_transform(w, lambda x: x[2]::DOUBLE)), 4) AS volume FROM w WHERE pos >= 7 AND (pos - 7) % 3 = 0""")
def sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    x = R.sequences(T.bars_1h(spark, sf), ["close", "volume"], 8, 3)
    x = x.withColumn("n", F.size("window").cast("long")).withColumn("first_close", F.col("window")[0][0].cast("double")).withColumn("last_close", F.col("window")[7][0].cast("double"))
    x = x.withColumn("volume", F.aggregate("window", F.lit(0.0), lambda a, v: a + v[1].cast("double")))
    return shown(x, [*KEYS, "pos"], ["n", "first_close", "last_close", "volume"], 4)


@query("""SELECT p_brand AS name, p_partkey AS version, p_name AS params FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1""")
def registry_latest(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(T.read(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("version"), F.col("p_name").alias("params")))


@query("SELECT symbol, epoch_us(max(ts)) // 1000000 AS high_water, count(*) AS n_rows FROM (SELECT event_type AS symbol, ts FROM events) GROUP BY symbol")
def high_water_marks(spark: SparkSession, sf: str) -> DataFrame:
    return shown(R.high_water(T.ticks(spark, sf)), ["symbol"], ["high_water", "n_rows"])
