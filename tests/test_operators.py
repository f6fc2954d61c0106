"""Operators without a SQL twin, and rules that SQL twins don't show."""

import math
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import align, bars, labels, metrics, research, simulate, strategies
from millrace.operators.reshape import check_target, insert_absent, sequences, to_wide, upsert
from millrace.sources import feeds, store, tables


def frame(spark, closes, symbol="x", opens=None):
    rows = [(symbol, datetime(2024, 1, 2, 14, 30 + i % 30, tzinfo=UTC) if len(closes) <= 30 else datetime.fromtimestamp(1_700_000_000 + 60 * i, UTC), float((opens or closes)[i]), c * 1.01, c * 0.99, float(c), 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def test_intervals():
    assert bars.interval("1M".lower()) == "1min" and bars.interval("m") == "1mo" and bars.bars_per_period("1min", "1h") == 60
    with pytest.raises(ValueError):
        bars.interval("2y")
    with pytest.raises(ValueError):
        bars.bars_per_period("1d", "1h")
    with pytest.raises(ValueError):
        bars.resolve_periods()


def test_interval_is_inferred(spark):
    assert bars.infer_interval(frame(spark, list(range(1, 20)))) == "1min"


def test_whole_shares_retry_an_unaffordable_buy(spark):
    df = frame(spark, [50, 500, 500, 40, 40, 60, 60]).withColumn("signal", F.when(F.second("ts") == 0, F.array(*map(F.lit, [0, 1, 0, 1, 0, -1, 0]))[F.minute("ts") - 30]))
    out, trades = simulate.whole_share(df, capital=100.0, commission=0.0, slippage=0.0)
    assert [r.shares for r in out.orderBy("ts").collect()] == [0, 0, 0, 0, 2, 2, 0]
    t = trades.collect()
    assert len(t) == 1 and t[0].shares == 2 and t[0].pnl == 40.0 and t[0].holding_period == 2


def test_costs_only_lower_equity(spark):
    s = strategies.EMACrossover(2, 4).signals(frame(spark, [100 + 5 * math.sin(i / 3) for i in range(60)]))
    last = [simulate.fractional(s, commission=c).orderBy(F.desc("ts")).first().equity for c in (0.0, 0.001, 0.01)]
    assert last == sorted(last, reverse=True)


def test_drawdown_and_profit_factor(spark):
    df = spark.createDataFrame([("x", i, float(e), 0.0) for i, e in enumerate([100, 110, 90, 95, 100])], "symbol string, ts int, equity double, ret double")
    assert metrics.performance(df, 252).first().max_drawdown == pytest.approx(20 / 110)
    t = spark.createDataFrame([("x", 5.0, 1)], "symbol string, pnl double, holding_period int")
    assert metrics.trade_report(t).first().profit_factor == math.inf


def test_overfitting_statistics():
    assert research.probabilistic_sharpe(0.1, 1) != research.probabilistic_sharpe(0.1, 1)
    assert 0.5 < research.probabilistic_sharpe(0.1, 100) < 1
    assert research.deflated_sharpe(0.1, 100, 0.01, 50) < research.probabilistic_sharpe(0.1, 100)
    assert research.minimum_track_record(0.0) == math.inf and research.n_paths(6, 2) == 5
    with pytest.raises(ValueError):
        research.time_decay(None, -1)


def test_concurrency_vector(spark):
    touch = [2, 3, 4, 5, 5, -1]
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(touch)], "symbol string, pos long, touch_pos long")
    assert [r.concurrency for r in research.concurrency(df).orderBy("pos").collect()] == [1, 2, 3, 3, 3, 2]


def test_expanding_quantile_without_values(spark):
    df = frame(spark, [1, 2, 3]).withColumn("v", F.when(F.col("close") > 1, F.col("close")))
    assert [r.q for r in strategies.expanding_quantile(df, "v", 0.5, "q").orderBy("ts").collect()] == [None, 2.0, 2.5]


def test_barriers_stop_at_the_session(spark):
    df = frame(spark, [100, 101, 103, 90]).withColumn("t", F.lit(0.02))
    got = [(r.touch_pos, r.label) for r in labels.triple_barrier(df, 3, 1, 1, "t").orderBy("ts").collect()]
    assert got == [(2, 1), (3, -1), (3, -1), (None, None)]


def test_leaky_targets_are_refused():
    for bad in ("open", "high", "low", "close", "volume", "adjusted_close", "returns", "log_returns", "price_direction", "price_features_gap"):
        with pytest.raises(ValueError):
            check_target(bad, ["rsi"])
    check_target("label", ["rsi"])


def test_last_window_is_emitted(spark):
    assert [r.pos for r in sequences(frame(spark, [1, 2, 3, 4, 5]), ["close"], 3).orderBy("pos").collect()] == [2, 3, 4]


def test_strict_pivot_refuses_repeats(spark):
    long = spark.createDataFrame([("x", 1, "a", 1.0), ("x", 1, "a", 2.0)], "symbol string, ts int, feature_name string, feature_value double")
    with pytest.raises(Exception, match="repeated feature key"):
        to_wide(long, ["a"]).collect()


def test_upsert_and_insert(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, upsert(a, b, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, insert_absent(a, b, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_store_is_idempotent_and_prunes(spark, tmp_path):
    df = frame(spark, [1, 2, 3])
    root = str(tmp_path / "store")
    for _ in range(2):
        store.write_features(df, root)
    got = store.read_features(spark, root, ["x"], "2024-01-02", "2024-01-02")
    assert got.count() == 3 and "PartitionFilters: [" in got._jdf.queryExecution().toString()
    assert store.available(spark, root).count() == 1
    path = str(tmp_path / "marks")
    store.update_manifest(df, path)
    assert store.update_manifest(df, path).count() == 1
    reg = str(tmp_path / "registry")
    assert [store.register_version(spark, reg, "m", "{}") for _ in range(2)] == [1, 2]
    assert store.registered(spark, reg).first().version == 2


def test_asset_map(spark):
    m = align.AssetMap()
    row = spark.range(1).select(m.tickers(F.lit("kjfk")).alias("t"), m.region(F.lit("EGLL")).alias("r"), m.route_tickers(F.lit("KJFK"), F.lit("EGLL")).alias("p"), m.airports_of(F.lit("AF.PA")).alias("a"), m.tickers(F.lit("??")).alias("n")).first()
    assert row.t == ["DAL", "UAL", "AAL", "JBLU"] and row.r == "EU-UK" and row.p == ["DAL", "IAG.L"] and row.a == ["LFPG", "EHAM"] and row.n == []


def test_client_retries_and_refreshes():
    answers = [(401, {}, None), (429, {"Retry-After": "2"}, None), (503, {}, None), (200, {}, [1])]
    waits, fresh = [], []
    c = feeds.Client(lambda p, q: answers.pop(0), refresh=lambda: fresh.append(1), sleep=waits.append)
    assert c.fetch("/x", {}) == [1] and fresh == [1] and waits == [2.0, 4.0]
    assert feeds.Client(lambda p, q: (404, {}, None)).fetch("/x", {}) == []
    with pytest.raises(feeds.QuotaError):
        feeds.Client(lambda p, q: (429, {"Retry-After": "999"}, None)).fetch("/x", {})


def test_pages_run_backward():
    rows = [{"datetime": f"2024-01-{d:02d}"} for d in range(9, 0, -1)]

    def page(q):
        left = [r for r in rows if "end_date" not in q or r["datetime"] < q["end_date"]]
        return left[: q["outputsize"]]

    assert list(feeds.backward_pages(page, 4)) == rows


def test_flights_from_json(spark):
    x = spark.createDataFrame([('{"icao24": " ABC ", "firstSeen": 1, "lastSeen": 2, "callsign": " "}',), ('{"callsign": "x"}',), ("nonsense",)], "value string")
    got = feeds.flights_from_json(x, "KJFK", "arrival").collect()
    assert len(got) == 1 and got[0].icao24 == "abc" and got[0].callsign is None


def test_day_bounds():
    got = feeds.day_bounds(datetime(2024, 1, 1, 12, tzinfo=UTC), datetime(2024, 1, 2, 6, tzinfo=UTC))
    assert [b - a for a, b in got] == [43199, 21600]


def test_streaming_bars_equal_batch(spark, tmp_path):
    from millrace.streaming import bars as live

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.run_incremental(live.stream_bars(live.read_ticks(spark, str(tmp_path / "in"), events.schema), late="0 seconds"), str(tmp_path / "out"), ["symbol", "ts"], str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.symbol, r.ts): (r.open, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.symbol, r.ts): (r.open, r.close, r.volume) for r in tables.bars_1h(spark, sf).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 5


def test_barriers_with_ranges_and_flat_verticals(spark):
    df = frame(spark, [100, 100, 100, 100]).withColumn("t", F.lit(0.005))
    assert [r.label for r in labels.triple_barrier(df, 2, 1, 1, "t", use_range=True).orderBy("ts").collect()] == [1, 1, 1, None]
    assert [r.label for r in labels.triple_barrier(df, 2, 1, 1, "t", vertical_zero=True).orderBy("ts").collect()] == [0, 0, 0, None]
    two = frame(spark, [100, 103]).withColumn("ts", F.when(F.col("close") == 103, F.timestamp_seconds(F.lit(1_800_000_000))).otherwise(F.col("ts"))).withColumn("t", F.lit(0.02))
    assert [r.label for r in labels.triple_barrier(two, 2, 1, 1, "t").orderBy("ts").collect()] == [None, None]
    assert [r.label for r in labels.triple_barrier(two, 2, 1, 1, "t", across=True).orderBy("ts").collect()] == [1, None]


def test_intervals_snap_and_resample_strictly(spark):
    monthly = spark.createDataFrame([("x", datetime.fromtimestamp(1_700_000_000 + i * 2_500_000, UTC)) for i in range(4)], "symbol string, ts timestamp")
    assert bars.infer_interval(monthly) == "1mo"
    with pytest.raises(ValueError):
        bars.infer_interval(monthly.limit(1))
    df = frame(spark, list(range(1, 24))).withColumn("adjusted_close", F.col("close") * 2).withColumn("note", F.lit("n"))
    got = bars.resample_to(df, "5m", drop_partial=True).orderBy("ts").collect()
    assert [r.n_bars for r in got] == [5, 5, 5, 5] and [r.adjusted_close for r in got] == [10.0, 20.0, 30.0, 40.0] and "note" not in got[0].asDict()
    assert bars.resample_to(df, "5m").count() == 5 and {r.n_bars for r in bars.resample_to(df, "1m").collect()} == {1}
    with pytest.raises(ValueError):
        bars.resample_to(df, "1wk")


def test_bad_chunks_are_skipped_and_empty_features_refused(spark):
    df = frame(spark, [1, 2, 3]).unionByName(frame(spark, [1, -2, 3], "y"))
    assert {r.symbol for r in bars.valid_only(df).collect()} == {"x"}
    with pytest.raises(Exception, match="no value at all"):
        bars.check_features(df.withColumn("f", F.lit(None).cast("double")), ["f"]).collect()
    with pytest.raises(ValueError):
        bars.check_features(df, ["g"])


def test_manifest_adds_up_and_never_goes_back(spark, tmp_path):
    path = str(tmp_path / "marks")
    late = frame(spark, [1, 2]).withColumn("ts", F.to_timestamp(F.lit("2024-01-03")))
    store.update_manifest(late, path)
    r = store.update_manifest(frame(spark, [1]), path).first()
    assert r.n_rows == 3 and str(r.high_water) == "2024-01-03 00:00:00"


def test_merges_keep_the_last_complete_version(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    store.merge_keyed(rows((1, "a"), (2, "b")), path, ["k"])
    with pytest.raises(Exception):  # noqa: B017 a merge that fails leaves the table as it was
        store.merge_keyed(rows((1, "x")).withColumn("v", F.raise_error(F.lit("lost")).cast("string")), path, ["k"])
    assert sorted(map(tuple, store.read_keyed(spark, path).collect())) == [(1, "a"), (2, "b")]
    store.merge_keyed(rows((2, "c"), (3, "d")), path, ["k"])
    assert sorted(map(tuple, store.read_keyed(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_registry_compares_updates_and_forgets(spark, tmp_path):
    reg = str(tmp_path / "registry")
    store.register_version(spark, reg, "m", '{"a": 1}')
    assert store.update_metrics(spark, reg, "m", {"auc": float("nan"), "n": [1, 2.5]}) == 2
    rows = store.compare_versions(spark, reg, "m").collect()
    assert [(r.version, r.is_latest) for r in rows] == [(2, True), (1, False)] and rows[0].metrics == '{"auc": null, "n": [1, 2.5]}' and rows[0].params == '{"a": 1}'
    store.forget(spark, reg, "m", 2)
    assert [r.version for r in store.compare_versions(spark, reg, "m").collect()] == [1]
    assert store.register_version(spark, reg, "m", "{}") == 3  # a version is never given twice


def test_migrations_run_once(spark, tmp_path):
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql/001_first.sql").write_text("CREATE OR REPLACE TEMP VIEW one AS SELECT 1 AS x; SELECT 1")
    record = str(tmp_path / "done")
    assert store.migrate(spark, str(tmp_path / "sql"), record) == ["001_first.sql"] and store.migrate(spark, str(tmp_path / "sql"), record) == []


def test_results_and_csv_are_written(spark, tmp_path):
    out, trades = simulate.whole_share(strategies.BuyAndHold().signals(frame(spark, [10, 11, 12])))
    store.save_result(out, trades, str(tmp_path / "r"), "run", points=2)
    assert len(spark.read.parquet(str(tmp_path / "r")).first().equity) == 2
    store.write_csv(out.select("symbol", "equity"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_shorts_prices_and_unshifted_fills(spark):
    df = frame(spark, [100, 110, 99]).withColumn("e", F.lit(-1.0)).withColumn("mid", F.col("close") * 2)
    got = simulate.exposure(df, "e", commission=0.0, slippage=0.0, clip=False, price="mid").orderBy("ts").collect()
    assert [round(r.ret, 6) for r in got] == [0.0, -0.1, 0.1]
    s = frame(spark, [100, 110, 99]).withColumn("signal", F.when(F.minute("ts") == 30, 1).otherwise(0))
    assert [r.position for r in simulate.fractional(s, shift=0).orderBy("ts").collect()] == [1, 1, 1]
    assert [r.position for r in simulate.desired(s.withColumn("d", F.lit(1)), "d").orderBy("ts").collect()] == [0, 1, 1]
    out, _ = simulate.whole_share(s, capital=1000.0, commission=0.0, slippage=0.0, shift=0)
    assert [r.shares for r in out.orderBy("ts").collect()] == [10, 10, 10]


def test_joins_of_trading_days_by_kind(spark):
    l = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, v int").withColumn("day", F.to_date("day"))  # noqa: E741
    r = spark.createDataFrame([("2024-01-02", 5), ("2024-01-03", 6)], "day string, v int").withColumn("day", F.to_date("day"))
    rows = {how: sorted((str(x.day), x.v_flight, x.v_ohlcv) for x in align.trading_day_join(l, r, how).collect()) for how in ("left", "right", "full")}
    assert rows["left"] == [("2024-01-01", 1, None), ("2024-01-02", 2, 5)] and rows["right"] == [("2024-01-02", 2, 5), ("2024-01-03", None, 6)] and len(rows["full"]) == 3


def test_expanding_folds_and_lost_weights(spark):
    df = spark.createDataFrame([("x", i, i + 1 if i < 9 else None, 1.0) for i in range(10)], "symbol string, pos long, touch_pos long, close double")
    folds = research.purged_kfold(df, 5, expanding=True).collect()
    assert all(r.pos < 2 * r.fold for r in folds if r.role == "train") and sum(r.role == "test" for r in folds) == 10
    decay = [r.decay for r in research.time_decay(df, -0.5).orderBy("pos").collect()]
    assert decay[0] == 0.0 and decay[-1] == 1.0 and decay == sorted(decay)


def test_backtest_agrees_with_its_parts_and_benchmark(spark):
    df = frame(spark, [100 + 5 * math.sin(i / 3) for i in range(60)])
    out, trades, m = __import__("millrace.operators.runs", fromlist=["backtest"]).backtest(strategies.EMACrossover(2, 4), df, interval="1min")
    assert m.first().n_trades == trades.count() and m.first().final_capital == out.orderBy(F.desc("ts")).first().equity
    hold = __import__("millrace.operators.runs", fromlist=["backtest"]).backtest_predictions(df.withColumn("p", F.lit(1.0)), "p", 98280).first()
    assert hold.sharpe_edge == 0 and not hold.beats and hold.strat_exposure == hold.bench_exposure


def test_scalers_merge_and_windows_shuffle(spark, tmp_path):
    from millrace.operators import models

    df = frame(spark, [1, 2, 3, 4]).unionByName(frame(spark, [5, 5], "y"))
    parts = [models.scaler(df.where("close < 3"), ["close"]), models.scaler(df.where("close >= 3"), ["close"])]
    fitted = models.merged_scaler(parts, ["close"])
    got = [r.close for r in models.scaled(df, fitted, ["close"]).orderBy("symbol", "ts").collect()]
    assert got[:4] == pytest.approx([-1.341641, -0.447214, 0.447214, 1.341641], abs=1e-6) and got[4:] == [0.0, 0.0]
    one = [(r.symbol, r.pos) for r in models.shuffled_windows(df, ["close"], 2)]
    assert sorted(one) == [("x", 1), ("x", 2), ("x", 3), ("y", 1)] and one == [(r.symbol, r.pos) for r in models.shuffled_windows(df, ["close"], 2)]
    shares = [[(r.symbol, r.pos) for r in models.shuffled_windows(df, ["close"], 2, worker=w, workers=2)] for w in (0, 1)]
    assert sorted(shares[0] + shares[1]) == sorted(one)


def test_models_are_saved_with_their_hash(spark, tmp_path):
    from millrace.operators import models

    df = spark.createDataFrame([("x", i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)], "symbol string, ts long, a double, b double, label int").withColumn("ts", F.timestamp_seconds("ts")).withColumn("close", F.lit(1.0) + F.col("a"))
    for kind in ("random_forest", "boosted_trees"):
        m = models.train(df, ["a", "b"], "label", kind, scale=True)
        code = models.save_model(m, str(tmp_path / kind))
        again = models.load_model(str(tmp_path / kind), code)
        stats, money = models.evaluate(again, df, ["a", "b"], "label")
        assert stats.first().accuracy > 0.95 and money is None
        with pytest.raises(ValueError):
            models.load_model(str(tmp_path / kind), "0")
    assert models.evaluate(again, df, ["a", "b"], "label", bars=True)[1].count() == 1


def test_tokens_are_renewed_before_they_end():
    now, asked = [0.0], []
    cache = feeds.TokenCache(lambda: (asked.append(1) or f"t{len(asked)}", 100.0), margin=10, clock=lambda: now[0])
    assert cache.token == cache.token == "t1"
    now[0] = 91
    assert cache.token == "t2"
    cache.refresh()
    assert cache.token == "t3"


def test_flights_tolerate_partial_failure(spark):
    def get(path, params):
        if params["airport"] == "KXXX" or path.endswith("departure"):
            return 400, {}, None
        return 200, {}, [{"icao24": "Ab", "firstSeen": params["begin"], "lastSeen": params["end"]}]

    class Local(feeds.FlightsSource):
        @classmethod
        def name(cls):
            return "local_flights"

        def reader(self, schema):
            return feeds.FlightsReader(dict(self.options), get)

    spark.dataSource.register(Local)
    read = lambda a: spark.read.format("local_flights").options(airports=a, start="2024-01-01T00:00:00", end="2024-01-02T12:00:00").load()
    got = feeds.typed_flights(read("kjfk,kxxx")).collect()
    assert sorted((r.airport, r.direction) for r in got) == [("KJFK", "arrival")] * 2
    with pytest.raises(RuntimeError, match="all 4 requests failed"):
        feeds.typed_flights(read("kxxx"))


def test_ticker_readers_share_one_allowance():
    reader = feeds.BarsReader({"tickers": "a,b,c,d", "per_minute": "8"}, lambda p, q: (200, {}, []))
    seen = []
    original = feeds.Client.__init__
    feeds.Client.__init__ = lambda self, get, per_minute=60, **k: (seen.append(per_minute), original(self, get, per_minute, **k))[1]
    try:
        for part in reader.partitions():
            assert list(reader.read(part)) == []
    finally:
        feeds.Client.__init__ = original
    assert seen == [2, 2, 2, 2]
