"""Sample weights, purged cross-validation, and statistics of overfitting.

Label spans are (pos, touch_pos) in a symbol's order; a null or negative touch_pos is no label.
"""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import series as S

EULER_GAMMA = 0.5772156649015329


def _labelled() -> Column:
    return F.coalesce(F.col("touch_pos") >= 0, F.lit(False))


def _events(df: DataFrame, *events: Column) -> DataFrame:
    """(symbol, at, kind, value, row) of each row's events: a series read once, ordered anew, no join."""
    return df.select("symbol", F.explode(F.filter(F.array(*events), lambda e: e["at"].isNotNull())).alias("_e")).select("symbol", "_e.*")


def _event(at: Column, kind: int, value: Column, row: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind"), value.alias("value"), row.alias("row"))


def _packed(df: DataFrame, *without: str) -> tuple[Column, Column]:
    """The columns beside symbol as a struct, and a null of its type."""
    row = F.struct(*[c for c in df.columns if c not in ("symbol", *without)])
    return row, F.when(F.lit(False), row)


def concurrency(df: DataFrame) -> DataFrame:
    """Adds concurrency: how many label spans [pos, touch_pos] cover each row. Starts add one, the
    rows after ends take one away; a running sum does the rest."""
    row, none = _packed(df, "concurrency")
    end = F.when(_labelled(), F.col("touch_pos") + 1)
    x = _events(df, _event(F.col("pos"), 0, _labelled().cast("long"), row), _event(end, 0, F.lit(-1).cast("long"), none))
    so_far = Window.partitionBy("symbol").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("concurrency", F.sum("value").over(so_far)).where("row IS NOT NULL").select("symbol", "row.*", "concurrency")


def _span_sum(df: DataFrame, value: Column, name: str, from_next: bool) -> DataFrame:
    """Adds the sum of value over [pos (+1), touch_pos], by prefix sums at the span's two ends. Rows go
    to their span's end, where they meet its prefix sum; an end that is no row gives null."""
    x = df.withColumn("_v", F.coalesce(value, F.lit(0.0))).withColumn("_p", F.sum("_v").over(S.running(order="pos")))
    row, none = _packed(x, name)
    prefix = F.struct(F.col("pos").cast("long").alias("pos"), F.col("_p").alias("p"))
    end = F.when(_labelled(), F.col("touch_pos")).otherwise(F.col("pos"))
    x = _events(x, _event(F.col("pos"), 0, prefix, none), _event(end, 1, F.when(F.lit(False), prefix), row))
    x = x.withColumn("_e", F.last("value", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.where("row IS NOT NULL").select("symbol", "row.*", "_e")
    met = _labelled() & (F.col("_e.pos") == F.col("touch_pos"))
    return x.withColumn(name, F.when(met, F.col("_e.p") - F.col("_p") + (F.lit(0.0) if from_next else F.col("_v")))).drop("_v", "_p", "_e")


def uniqueness(df: DataFrame) -> DataFrame:
    """Adds uniqueness: the mean of 1 / concurrency over the label's span."""
    x = df if "concurrency" in df.columns else concurrency(df)
    x = _span_sum(x, F.try_divide(F.lit(1.0), F.col("concurrency")), "_u", from_next=False)
    return x.withColumn("uniqueness", F.col("_u") / (F.col("touch_pos") - F.col("pos") + 1)).drop("_u")


def return_weights(df: DataFrame, close: str = "close") -> DataFrame:
    """Adds weight: |sum of log return / concurrency over the span|, with mean 1 per symbol."""
    x = df if "concurrency" in df.columns else concurrency(df)
    r = F.ln(F.try_divide(F.col(close), F.lag(close).over(S.by_symbol(order="pos"))))
    x = x.withColumn("_r", F.try_divide(r, F.col("concurrency")))
    x = _span_sum(x, F.col("_r"), "_w", from_next=True).withColumn("_w", F.abs("_w"))
    return x.withColumn("weight", F.try_divide(F.col("_w"), F.avg("_w").over(Window.partitionBy("symbol")))).drop("_r", "_w")


def time_decay(df: DataFrame, last_weight: float = 0.5) -> DataFrame:
    """Adds decay: linear in cumulated uniqueness, 1 at the newest; last_weight at the oldest, or, if
    negative, nothing for that share of the oldest. -1 itself leaves no weight and is refused."""
    if last_weight <= -1:
        raise ValueError("last_weight must be above -1")
    x = df if "uniqueness" in df.columns else uniqueness(df)
    x = x.withColumn("_c", F.sum(F.coalesce("uniqueness", F.lit(0.0))).over(S.running(order="pos")))
    total = F.max("_c").over(Window.partitionBy("symbol"))
    slope = (1 - last_weight) / total if last_weight >= 0 else 1 / ((last_weight + 1) * total)
    return x.withColumn("decay", F.when(total > 0, F.greatest(F.lit(0.0), 1 - slope * (total - F.col("_c"))))).drop("_c")


def combined_weights(df: DataFrame, last_weight: float = 0.5) -> DataFrame:
    x = time_decay(uniqueness(return_weights(df)), last_weight).withColumn("_w", F.col("weight") * F.col("decay"))
    return x.withColumn("combined", F.try_divide(F.col("_w"), F.avg("_w").over(Window.partitionBy("symbol")))).drop("_w")


def effective_size(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.sum("uniqueness").alias("effective_size"))


# ------------------------------------------------------------------------------- cross-validation
def _bounds(n: Column, k: int) -> Column:
    """k structs (fold, lo, hi) that cut [0, n) at int(n * i / k)."""
    return F.array(*[F.struct(F.lit(i).alias("fold"), F.floor(n * i / k).cast("long").alias("lo"), F.floor(n * (i + 1) / k).cast("long").alias("hi")) for i in range(k)])


def _train(lo: Column, hi: Column, n: Column, embargo: float) -> Column:
    """Whether a row may train against the test block [lo, hi): outside it and the embargo after it,
    and its label span doesn't reach into it."""
    late = hi + F.floor(n * embargo)
    inside = (F.col("pos") >= lo) & (F.col("pos") < late)
    overlaps = (F.col("pos") < hi) & (F.coalesce(F.col("touch_pos"), F.lit(-1)) >= lo)
    return ~inside & ~overlaps


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))


def purged_kfold(df: DataFrame, k: int = 5, embargo: float = 0.0, expanding: bool = False) -> DataFrame:
    """(symbol, pos, fold, role): train and test rows of each fold; purged rows have no role.
    expanding: only rows before the test block train."""
    x = _counted(df).withColumn("_f", F.explode(_bounds(F.col("_n"), k))).select("symbol", "pos", "touch_pos", "_n", "_f.*")
    train = _train(F.col("lo"), F.col("hi"), F.col("_n"), embargo)
    if expanding:
        train = train & (F.col("pos") < F.col("lo"))
    role = F.when((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")), "test").when(train, "train")
    return x.select("symbol", "pos", "fold", role.alias("role")).where("role IS NOT NULL")


def with_fold_counts(df: DataFrame, k: int = 5, embargo: float = 0.0) -> DataFrame:
    """Adds n_train and n_test: in how many of the purged folds a row trains and tests. No rows are made."""
    inside = lambda b: (F.col("pos") >= b["lo"]) & (F.col("pos") < b["hi"])
    train = lambda b: _train(b["lo"], b["hi"], F.col("_n"), embargo) & ~inside(b)
    x = _counted(df).withColumn("_b", _bounds(F.col("_n"), k))
    return x.withColumn("n_train", F.size(F.filter("_b", train)).cast("long")).withColumn("n_test", F.size(F.filter("_b", inside)).cast("long")).drop("_b", "_n")


def combinatorial_splits(df: DataFrame, groups: int = 6, tests: int = 2, embargo: float = 0.0) -> DataFrame:
    """(symbol, pos, split, role) for all choices of test groups; train rows clear every test block."""
    combos = list(combinations(range(groups), tests))
    x = _counted(df).withColumn("_b", _bounds(F.col("_n"), groups))
    x = x.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("split"), F.array(*map(F.lit, c)).alias("g")) for i, c in enumerate(combos)])))
    blocks = F.transform(F.col("_s.g"), lambda g: F.get("_b", g))
    x = x.withColumn("_t", blocks)
    test = F.exists("_t", lambda b: (F.col("pos") >= b["lo"]) & (F.col("pos") < b["hi"]))
    train = F.forall("_t", lambda b: _train(b["lo"], b["hi"], F.col("_n"), embargo))
    role = F.when(test, "test").when(train, "train")
    return x.select("symbol", "pos", F.col("_s.split").alias("split"), role.alias("role")).where("role IS NOT NULL")


def n_paths(groups: int, tests: int) -> int:
    return math.comb(groups, tests) * tests // groups


def time_series_split(df: DataFrame, k: int = 5) -> DataFrame:
    """(symbol, pos, fold, role): k test blocks of n // (k + 1) rows at the end, all before them train."""
    size = F.floor(F.col("_n") / (k + 1))
    folds = F.array(*[F.struct(F.lit(i).alias("fold"), (F.col("_n") - size * (k - i)).cast("long").alias("lo"), (F.col("_n") - size * (k - i - 1)).cast("long").alias("hi")) for i in range(k)])
    x = _counted(df).withColumn("_f", F.explode(folds)).select("symbol", "pos", "_f.*")
    role = F.when((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")), "test").when(F.col("pos") < F.col("lo"), "train")
    return x.select("symbol", "pos", "fold", role.alias("role")).where("role IS NOT NULL")


def chronological_split(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    x = _counted(df)
    return x.withColumn("role", F.when(F.col("pos") < F.floor(F.col("_n") * (1 - test_size)), "train").otherwise("test")).drop("_n")


# ------------------------------------------------------------------------------------ overfitting
_N = NormalDist()


def probabilistic_sharpe(sr: float, n: int, skew: float = 0.0, kurtosis: float = 3.0, benchmark: float = 0.0) -> float:
    """Probability that the true Sharpe ratio (a period) beats the benchmark; NaN if undefined."""
    var = 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr
    return _N.cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(var)) if var > 0 and n > 1 else math.nan


def expected_max_sharpe(variance: float, trials: int) -> float:
    if trials < 2:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER_GAMMA) * _N.inv_cdf(1 - 1 / trials) + EULER_GAMMA * _N.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: float, n: int, variance: float, trials: int, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    return probabilistic_sharpe(sr, n, skew, kurtosis, expected_max_sharpe(variance, trials))


def minimum_track_record(sr: float, skew: float = 0.0, kurtosis: float = 3.0, benchmark: float = 0.0, confidence: float = 0.95) -> float:
    if sr <= benchmark:
        return math.inf
    return 1 + (1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) * (_N.inv_cdf(confidence) / (sr - benchmark)) ** 2


def backtest_overfitting(perf: DataFrame, groups: int = 8) -> DataFrame:
    """(split, best, rank, logit) for every half of ``groups`` row blocks of perf (period, config, perf).

    Periods are reduced to sums per (block, config) first, so what the splits look at is a matrix of
    groups x configs whatever the number of periods; PBO is the share of logits <= 0.
    """
    order = perf.select("period").distinct().withColumn("_i", F.row_number().over(Window.orderBy("period")) - 1)
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    order = order.withColumn("block", F.floor(F.col("_i") * groups / total).cast("int"))
    cells = perf.join(order, "period").groupBy("block", "config").agg(
        F.count(F.lit(1)).alias("n"), F.sum("perf").alias("s"), F.sum(F.col("perf") * F.col("perf")).alias("q")
    )
    halves = [set(c) for c in combinations(range(groups), groups // 2)]
    splits = F.array(*[F.struct(F.lit(i).alias("split"), F.array(*[F.lit(b) for b in sorted(h)]).alias("inside")) for i, h in enumerate(halves)])
    x = cells.withColumn("_s", F.explode(splits)).select("block", "config", "n", "s", "q", "_s.split", F.array_contains("_s.inside", F.col("block")).alias("inside"))

    def ratio(inside: bool) -> Column:
        on = F.col("inside") == inside
        m, a, b = F.sum(F.when(on, F.col("n"))), F.sum(F.when(on, F.col("s"))), F.sum(F.when(on, F.col("q")))
        var = (b - a * a / m) / (m - 1)
        return F.when(var > 0, (a / m) / F.sqrt(var)).otherwise(0.0)

    sr = x.groupBy("split", "config").agg(ratio(True).alias("inner"), ratio(False).alias("outer"))
    w = Window.partitionBy("split")
    ranked = sr.withColumn("rank", F.rank().over(w.orderBy("outer"))).withColumn("m", F.count(F.lit(1)).over(w))
    best = ranked.withColumn("_b", F.row_number().over(w.orderBy(F.col("inner").desc(), "config"))).where("_b = 1")
    share = F.col("rank") / (F.col("m") + 1)
    return best.select("split", F.col("config").alias("best"), "rank", F.ln(share / (1 - share)).alias("logit"))


def pbo(perf: DataFrame, groups: int = 8) -> float:
    return backtest_overfitting(perf, groups).agg(F.avg((F.col("logit") <= 0).cast("double"))).first()[0]
