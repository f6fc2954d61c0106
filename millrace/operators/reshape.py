"""Long and wide features, keyed upserts, increments, registries, sequence windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import series as S
from millrace.operators.bars import keep_last


def to_long(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """(keys, feature_name, feature_value), nulls left out."""
    x = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return x.unpivot(list(keys), columns, "feature_name", "feature_value").where("feature_value IS NOT NULL")


def to_wide(long: DataFrame, names: list[str], keys: tuple[str, ...] = ("symbol", "ts"), seq: str | None = None) -> DataFrame:
    """One column a feature name. With ``seq`` the last value of a repeated key wins; without it a
    repeated key is an error."""
    if seq:
        return long.groupBy(*keys).pivot("feature_name", names).agg(F.max_by("feature_value", seq))
    once = F.when(F.count("feature_value") > 1, F.raise_error(F.lit("repeated feature key")).cast("double")).otherwise(F.max("feature_value"))
    return long.groupBy(*keys).pivot("feature_name", names).agg(once)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target after INSERT ... ON CONFLICT DO UPDATE: source rows win, one row a key."""
    both = target.withColumn("_src", F.lit(0)).unionByName(source.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, "_src").drop("_src")


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target after INSERT ... ON CONFLICT DO NOTHING."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def incremental(df: DataFrame, high_water: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows after each key's high-water mark (columns key, high_water); keys without one come whole."""
    x = df.join(high_water.select(key, F.col("high_water").alias("_hw")), key, "left")
    return x.where(F.col("_hw").isNull() | (F.col(ts) > F.col("_hw"))).drop("_hw")


def with_warm_up(df: DataFrame, high_water: DataFrame, rows: int, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """New rows plus the ``rows`` before them (is_new tells them apart), so that windows start warm."""
    x = df.join(high_water.select(key, F.col("high_water").alias("_hw")), key, "left")
    x = x.withColumn("is_new", F.col("_hw").isNull() | (F.col(ts) > F.col("_hw"))).drop("_hw")
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    x = x.withColumn("_old", F.sum((~F.col("is_new")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where(F.col("is_new") | (F.col("_old") <= rows)).drop("_old")


def upsert_some(target: DataFrame, source: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """The target after INSERT ... ON CONFLICT DO UPDATE SET of the columns ``updated`` only: a row that
    is there keeps its other values, a new one comes whole. One row a key on either side."""
    new = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in source.columns if c not in keys], F.lit(True).alias("_src"))
    both = target.withColumn("_old", F.lit(True)).join(new, keys, "full")
    pick = lambda c: F.when(F.col("_old").isNull() | (F.col("_src") & F.lit(c in updated)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[F.col(c) if c in keys or c not in source.columns else pick(c) for c in target.columns])


def keep_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key: the one with the least ``seq``."""
    w = Window.partitionBy(*keys).orderBy(seq)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def research_load(df: DataFrame, seq: str, edge: str | None = None) -> DataFrame:
    """First arrival of each (symbol, ts) as doubles. A symbol's last day goes if it is ``edge`` or later:
    a day that the stored history is known to break off in."""
    x = keep_first(df, ["symbol", "ts"], seq)
    x = x.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume") if c in x.columns})
    if edge is None:
        return x
    day, last = F.to_date("ts"), F.max(F.to_date("ts")).over(Window.partitionBy("symbol"))
    return x.withColumn("_last", last).where((F.col("_last") < F.lit(edge).cast("date")) | (day < F.col("_last"))).drop("_last")


def high_water(df: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    return df.groupBy(key).agg(F.max(ts).alias("high_water"), F.count(F.lit(1)).alias("n_rows"))


def latest(registry: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """The highest version of each name."""
    w = Window.partitionBy(name).orderBy(F.col(version).desc())
    return registry.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def next_version(registry: DataFrame, name: str) -> int:
    found = registry.where(F.col("name") == name).agg(F.max("version")).first()[0]
    return (found or 0) + 1


def sequences(df: DataFrame, columns: list[str], length: int, stride: int = 1, target: str | None = None) -> DataFrame:
    """(symbol, ts, window[, target]): the last ``length`` rows of the columns, every ``stride``-th
    row from the first full window; the last possible window is among them."""
    w = S.by_symbol().rowsBetween(-(length - 1), 0)
    x = S.with_pos(df).withColumn("window", F.collect_list(F.array(*[F.col(c).cast("float") for c in columns])).over(w))
    keep = (F.col("pos") >= length - 1) & (F.pmod(F.col("pos") - (length - 1), F.lit(stride)) == 0) & (F.size("window") == length)
    return x.where(keep).select("symbol", "ts", "pos", "window", *([F.col(target).alias("target")] if target else []))


#: Columns that describe the bar a window already ends on.
CONTEMPORANEOUS = ("open", "high", "low", "close", "volume", "adjusted_close", "returns", "log_returns", "price_direction")
#: The engine's own features of the same kind.
LEAKY = (*CONTEMPORANEOUS, "price_features_gap", "price_features_close_open_range", "price_features_high_low_range")


def check_target(target: str, features: list[str]) -> None:
    """Refuses targets that are known when the features are."""
    if target in LEAKY:
        raise ValueError(f"{target!r} is contemporaneous with the features; use a forward-looking label")
    if target in features:
        raise ValueError(f"{target!r} is a feature and the target")
