"""Queries without SQL against plain loops: the horizons run and the forest's out-of-sample scores."""

import math
import os

import pytest

from millrace.operators import indicators as I
from millrace.operators import labels as L
from millrace.operators import metrics as M
from millrace.operators import models
from millrace.operators import research as R
from millrace.functions import series as S
from millrace.plans import registry
from millrace.sources import tables as T

SF = "/root/testdata/sf0.001"
SPAN, AHEAD, WIDE, FOLDS, EMBARGO = 100, 20, 2.0, 6, 0.01

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def deviations(returns):
    """Bias-corrected exponential deviation of all returns so far; missing ones age the others."""
    out, seen = [], 0
    for i, r in enumerate(returns):
        seen += r is not None
        if seen < max(2, SPAN // 4):
            out.append(None)
            continue
        pairs = [((1 - 2 / (SPAN + 1)) ** (i - j), x) for j, x in enumerate(returns[: i + 1]) if x is not None]
        total = sum(w for w, _ in pairs)
        mean = sum(w * x for w, x in pairs) / total
        variance = sum(w * (x - mean) ** 2 for w, x in pairs) / total
        out.append(math.sqrt(variance * total**2 / (total**2 - sum(w * w for w, _ in pairs))))
    return out


def touches(days, closes, targets, daily):
    """(position, return) of the barrier reached first, or none, per bar."""
    out = []
    for i, (c, t) in enumerate(zip(closes, targets, strict=True)):
        reach = [j for j in range(i + 1, min(i + AHEAD + 1, len(closes))) if daily or days[j] == days[i]]
        if t is None or not reach:
            out.append(None)
            continue
        found = (reach[-1], closes[reach[-1]] / c - 1)
        for j in reach:
            if abs(closes[j] / c - 1) >= WIDE * t:
                found = (j, WIDE * t if closes[j] >= c else -WIDE * t)
                break
        out.append(found)
    return out


def summary(days, closes, daily):
    n = len(closes)
    returns = [closes[i] / closes[i - 1] - 1 if i and (daily or days[i] == days[i - 1]) else None for i in range(n)]
    spans = touches(days, closes, deviations(returns), daily)
    over = [sum(s is not None and i <= p <= s[0] for i, s in enumerate(spans)) for p in range(n)]
    unique, raw = [None] * n, [None] * n
    for i, s in enumerate(spans):
        if s:
            inside = range(i, s[0] + 1)
            unique[i] = sum(1 / over[p] for p in inside) / len(inside)
            raw[i] = abs(sum(math.log(closes[p] / closes[p - 1]) / over[p] for p in inside if p > i))
    total, so_far, weighted = sum(u or 0 for u in unique), 0.0, []
    for u, w in zip(unique, raw, strict=True):
        so_far += u or 0
        if u is not None:
            weighted.append(w * (1 - 0.5 * (total - so_far) / total))
    labelled = [s for s in spans if s]
    train = test = 0
    for f in range(FOLDS):
        lo, hi = n * f // FOLDS, n * (f + 1) // FOLDS
        for i, s in enumerate(spans):
            if lo <= i < hi:
                test += 1
            elif not (hi <= i < hi + math.floor(n * EMBARGO)) and not (i < lo and s and s[0] >= lo):
                train += 1
    share = lambda xs: sum(xs) / len(xs) if xs else None
    got = [u for u in unique if u is not None]
    return {
        "n_bars": n, "n_labels": len(labelled), "share_up": share([s[1] > 0 for s in labelled]), "concurrency": share(over), "uniqueness": share(got),
        "effective_size": sum(got) if got else None, "weight": len(weighted) if weighted else None, "n_train": train, "n_test": test,
    }


def test_horizons_equal_plain_loops(spark):
    series = {}
    for r in T.bars_1h(spark, SF).orderBy("symbol", "ts").collect():
        series.setdefault(r.symbol, []).append((r.ts.date(), r.close))
    want = {}
    for symbol, rows in series.items():
        ends = dict(rows)  # the last close of each day
        want["1h", symbol] = summary([d for d, _ in rows], [c for _, c in rows], False)
        want["1d", symbol] = summary(list(ends), list(ends.values()), True)
    got = {(r.interval, r.symbol): r.asDict() for r in registry.QUERIES["multi_horizon"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == (value if value is None else pytest.approx(value, abs=2e-6)), (key, name)
    assert any(row["n_labels"] for (kind, _), row in want.items() if kind == "1h")


def test_forest_scores_equal_plain_counts(spark):
    features = ["rsi", "volatility", "volume_features_volume_ratio", "atr"]
    x = I.compute(T.bars_1h(spark, SF), ["rsi", "volatility", "volume_features", "atr"])
    x = R.chronological_split(S.with_pos(L.next_up(x)))
    train = x.where("role = 'train'")
    fitted = models.train(train, features, "target")
    assert models.fingerprint(fitted) == models.fingerprint(models.train(train, features, "target"))
    out = models.predict(fitted, x.where("role = 'test' AND target IS NOT NULL"), features)
    rows = [(int(r.target), int(r.prediction), r.p) for r in out.collect()]
    got = M.classification(out, "target", "prediction", "p").first()
    cells = {(t, p): sum(1 for a, b, _ in rows if (a, b) == (t, p)) for t in (0, 1) for p in (0, 1)}
    assert (got.tp, got.fp, got.tn, got.fn) == (cells[1, 1], cells[0, 1], cells[0, 0], cells[1, 0])
    assert got.accuracy == pytest.approx((cells[1, 1] + cells[0, 0]) / len(rows))
    up, down = [s for t, _, s in rows if t], [s for t, _, s in rows if not t]
    assert up and down
    assert got.auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down)))


def test_horizons_read_the_bars_once_each(spark):
    plan = registry.QUERIES["multi_horizon"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and "Join" not in plan


def test_spans_that_end_beyond_the_rows_have_no_weight(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 1, "x"), ("a", 1, 2.0, 9, "y"), ("a", 2, 4.0, None, "z"), ("b", 0, 1.0, None, None)], "symbol string, pos long, close double, touch_pos long, row string")
    got = {(r.symbol, r.pos): (r.concurrency, r.uniqueness, r.row) for r in R.uniqueness(df).collect()}
    assert got == {("a", 0): (1, 0.75, "x"), ("a", 1): (2, None, "y"), ("a", 2): (1, None, "z"), ("b", 0): (0, None, None)}
