"""Bars: cleaning, validation, gaps, sessions, resampling, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import series as S

PRICES = ("open", "high", "low", "close", "volume")
SESSION_MINUTES, SESSIONS_PER_YEAR = 390, 252

#: Bars a year by interval.
PERIODS_PER_YEAR = {"1min": 98280, "5min": 19656, "15min": 6552, "30min": 3276, "1h": 1638, "1d": 252, "1wk": 52, "1mo": 12}
#: Spellings of the intervals.
ALIASES = {
    "1m": "1min", "1t": "1min", "min": "1min", "minute": "1min", "5m": "5min", "5t": "5min", "15m": "15min", "15t": "15min", "30m": "30min", "30t": "30min",
    "60min": "1h", "60m": "1h", "h": "1h", "hour": "1h", "hourly": "1h", "d": "1d", "day": "1d", "daily": "1d", "1day": "1d",
    "w": "1wk", "1w": "1wk", "week": "1wk", "weekly": "1wk", "m": "1mo", "1month": "1mo", "month": "1mo", "monthly": "1mo",
}
#: Nominal spacing of the intervals, in seconds.
NOMINAL_SECONDS = {"1min": 60.0, "5min": 300.0, "15min": 900.0, "30min": 1800.0, "1h": 3600.0, "1d": 86400.0, "1wk": 604800.0, "1mo": 2629800.0}

_SPELLED = ALIASES | {k: k for k in PERIODS_PER_YEAR}


def interval(name: str) -> str:
    """The interval that a spelling stands for."""
    try:
        return _SPELLED[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown interval {name!r}") from None


def spacing(seconds: Column) -> Column:
    """The name of the interval that a spacing is nearest to, in proportion; the shorter of equals."""
    near = [F.struct(F.abs(seconds / x - 1).alias("off"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, (k, x) in enumerate(NOMINAL_SECONDS.items())]
    return F.array_min(F.array(*near))["name"]


def infer_interval(bars: DataFrame) -> str:
    """The interval nearest to the median spacing of the bars; an error without any spacing."""
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(S.by_symbol())
    median = bars.select((gap / 1e6).alias("g")).where("g > 0").agg(F.median("g").alias("m"))
    found = median.select(F.when(F.col("m").isNotNull(), spacing(F.col("m"))).alias("name")).first()["name"]
    if found is None:
        raise ValueError("no positive spacing between bars")
    return found


def resolve_periods(periods: int | None = None, name: str | None = None, bars: DataFrame | None = None) -> int:
    """Periods a year: given, by interval name, or inferred, in this order."""
    if periods:
        return periods
    name = name or (infer_interval(bars) if bars is not None else None)
    if name is None:
        raise ValueError("neither periods nor interval are known")
    return PERIODS_PER_YEAR[interval(name)]


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key: the one with the greatest ``seq``."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clean(bars: DataFrame, seq: str) -> DataFrame:
    """Last arrival of each (symbol, ts), forward fill, no nulls, high >= low and volume >= 0."""
    one = keep_last(bars, ["symbol", "ts"], seq)
    filled = one.select(*[F.last(c, ignorenulls=True).over(S.running()).alias(c) if c in PRICES else F.col(c) for c in one.columns])
    return filled.dropna(subset=[c for c in PRICES if c in one.columns]).where("high >= low AND volume >= 0")


def outliers(bars: DataFrame, column: str = "close", n_std: float = 3.0, window: int = 20) -> DataFrame:
    """Flags values beyond n_std deviations of the trailing window, which holds the value itself."""
    w = S.trailing(window)
    x = F.col(column)
    return bars.withColumn("is_outlier", F.abs(x - F.avg(x).over(w)) > n_std * F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)))


def largest_segment(bars: DataFrame, max_gap_days: float = 5) -> DataFrame:
    """The longest run of rows without a gap over max_gap_days; of equal runs the earliest."""
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(S.by_symbol())
    marked = bars.withColumn("_cut", (F.coalesce(gap, F.lit(0)) > max_gap_days * 86_400_000_000).cast("int")).withColumn("_seg", F.sum("_cut").over(S.running()))
    sizes = marked.groupBy("symbol", "_seg").agg(F.count(F.lit(1)).alias("_n"))
    best = sizes.groupBy("symbol").agg(F.max_by("_seg", F.struct("_n", -F.col("_seg"))).alias("_seg"))
    return marked.join(best, ["symbol", "_seg"], "left_semi").drop("_cut", "_seg")


RULES = {
    "close > 0": "bad_close", "high >= low": "bad_range", "volume >= 0": "bad_volume",
}


def validation(bars: DataFrame) -> DataFrame:
    """Per symbol: rows, and rows that break each rule or repeat a timestamp."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for rule, name in RULES.items()],
        (F.count(F.lit(1)) - F.count_distinct("ts")).alias("repeated_ts"),
    )


def valid_only(bars: DataFrame) -> DataFrame:
    """The bars of symbols without any broken rule or repeated timestamp; missing columns are an error."""
    missing = [c for c in ("symbol", "ts", *PRICES) if c not in bars.columns]
    if missing:
        raise ValueError(f"bars lack columns: {', '.join(missing)}")
    broken = validation(bars).where(" OR ".join(f"{c} > 0" for c in (*RULES.values(), "repeated_ts"))).select("symbol")
    return bars.join(broken, "symbol", "left_anti")


def check_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: its share of nulls. A missing column, or one that is null throughout, is an error."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"features are missing: {', '.join(missing)}")
    share = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features])
    return share.unpivot([], features, "feature", "null_share").withColumn(
        "null_share", F.when(F.col("null_share") == 1, F.raise_error(F.concat(F.lit("no value at all of "), "feature")).cast("double")).otherwise(F.col("null_share"))
    )


# -------------------------------------------------------------------------------------- sessions
def with_session(bars: DataFrame) -> DataFrame:
    """day (UTC), pos and n (in the symbol), bar (in the session), session_end (last pos of the session)."""
    day = Window.partitionBy("symbol", "day")
    return (
        S.with_pos(bars).withColumn("day", F.to_date("ts"))
        .withColumn("bar", (F.row_number().over(day.orderBy("ts")) - 1).cast("long"))
        .withColumn("session_end", F.max("pos").over(day))
    )


def session_return() -> Column:
    """Close over the previous close of the same session; null on a session's first bar."""
    return F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("symbol", "day").orderBy("ts"))) - 1


def is_intraday(bars: DataFrame) -> DataFrame:
    """Per symbol: whether any two neighbouring bars share a session."""
    day = F.to_date("ts")
    same = bars.select("symbol", (day == F.lag(day).over(S.by_symbol())).alias("same"))
    return same.groupBy("symbol").agg(F.coalesce(F.bool_or("same"), F.lit(False)).alias("intraday"))


#: Minutes of the intervals that bars can be resampled to; a day is one session.
MINUTES = {"1min": 1, "5min": 5, "15min": 15, "30min": 30, "1h": 60, "1d": 390}


def resample(bars: DataFrame, minutes: int, session_aware: bool = True, full: int | None = None, min_bars: int = 1) -> DataFrame:
    """Bars of ``minutes``, labelled by their open. Session-aware bins count from the session's first
    bar; a day is one bin of a session (minutes >= 390). Otherwise bins are floors of the clock. Other
    numeric columns take their last value. ``full`` drops bins of fewer bars than that."""
    us = F.unix_micros("ts")
    width = minutes * 60_000_000
    if session_aware:
        first = F.min(us).over(Window.partitionBy("symbol", F.to_date("ts")))
        at = first if minutes >= SESSION_MINUTES else first + F.floor((us - first) / width) * width
    else:
        at = F.floor(us / width) * width
    how = {"open": F.min_by("open", "ts"), "high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", "ts"), "volume": F.sum("volume")}
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    aggs = [how[c].alias(c) if c in how else F.max_by(c, "ts").alias(c) for c, t in bars.dtypes if c in how or (c not in ("symbol", "ts") and t.split("(")[0] in kinds)]
    out = bars.withColumn("_at", at.cast("long")).groupBy("symbol", "_at").agg(*aggs, F.count(F.lit(1)).alias("n_bars"))
    return out.where(F.col("n_bars") >= max(min_bars, full or 1)).withColumn("ts", F.timestamp_micros("_at")).drop("_at")


def resample_to(bars: DataFrame, target: str, source: str = "1min", session_aware: bool = True, drop_partial: bool = False, min_bars: int = 1) -> DataFrame:
    """Bars of a named interval from bars of a shorter one; the source's own are only numbered.
    drop_partial leaves out bins that hold fewer bars than the target's interval has of the source's."""
    name, source = interval(target), interval(source)
    if name not in MINUTES:
        raise ValueError(f"bars are resampled to {', '.join(MINUTES)}, not {name}")
    if name == source:
        return bars.withColumn("n_bars", F.lit(1).cast("long"))
    return resample(bars, MINUTES[name], session_aware, bars_per_period(source, name) if drop_partial else None, min_bars)


def bars_per_period(source: str, target: str) -> int:
    s, t = PERIODS_PER_YEAR[interval(source)], PERIODS_PER_YEAR[interval(target)]
    if t > s:
        raise ValueError("resampling can't make shorter bars")
    return round(s / t)


# -------------------------------------------------------------------------- exploration statistics
def coverage(events: DataFrame, by: str) -> DataFrame:
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def hour_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def bars_per_day(bars: DataFrame) -> DataFrame:
    daily = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("n").alias("min_bars"), F.max("n").alias("max_bars"), F.avg("n").alias("avg_bars"), F.percentile("n", F.lit(0.5)).alias("median_bars")
    )


def autocorrelation(df: DataFrame, column: str, lags: list[int]) -> DataFrame:
    """symbol, lag, autocorr of the non-null values in order."""
    x = df.where(F.col(column).isNotNull())
    mean = F.avg(column).over(Window.partitionBy("symbol"))
    c = x.withColumn("_d", F.col(column) - mean)
    c = c.select("symbol", "_d", *[F.lead("_d", k).over(S.by_symbol()).alias(f"_l{k}") for k in lags])
    agg = c.groupBy("symbol").agg(*[F.try_divide(F.sum(F.col("_d") * F.col(f"_l{k}")), F.sum(F.col("_d") * F.col("_d"))).alias(str(k)) for k in lags])
    return agg.unpivot("symbol", [str(k) for k in lags], "lag", "autocorr").withColumn("lag", F.col("lag").cast("int"))


def variance_ratio(df: DataFrame, column: str, q: int) -> DataFrame:
    """Var of overlapping q-sums (from the row after the first full one) over q times Var of one."""
    x = S.with_pos(df.where(F.col(column).isNotNull()))
    x = x.withColumn("_q", F.when(F.col("pos") >= q, F.sum(column).over(S.trailing(q))))
    return x.groupBy("symbol").agg(F.try_divide(F.var_samp("_q"), q * F.var_samp(column)).alias("variance_ratio"))


def overnight_intraday(bars: DataFrame) -> DataFrame:
    """Per symbol and day: close-to-close, overnight and intraday returns."""
    daily = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min_by("open", "ts").alias("o"), F.max_by("close", "ts").alias("c"))
    before = F.lag("c").over(S.by_symbol(order="day"))
    return daily.select("symbol", "day", (F.try_divide("c", before) - 1).alias("total"), (F.try_divide("o", before) - 1).alias("overnight"), (F.try_divide("c", "o") - 1).alias("intraday"))


def intraday_profile(bars: DataFrame) -> DataFrame:
    """By bar of the session: mean return and mean absolute return in basis points, mean volume."""
    x = with_session(bars).withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(S.by_symbol())) - 1)
    return x.groupBy("symbol", "bar").agg((F.avg("r") * 1e4).alias("mean_ret_bps"), (F.avg(F.abs("r")) * 1e4).alias("mean_abs_ret_bps"), F.avg("volume").alias("mean_volume"))


def realised_volatility(bars: DataFrame) -> DataFrame:
    """Per symbol and day: root of the sum of squared within-session returns."""
    x = bars.withColumn("day", F.to_date("ts")).withColumn("r", session_return())
    return x.groupBy("symbol", "day").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("rv"))


