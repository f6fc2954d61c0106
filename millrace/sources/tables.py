"""Adapters from the star-schema and event tables to ticks, bars, flights and daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; zone-less timestamps become UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("tie"))


def bars_from_ticks(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """symbol, ts (bar open), open, high, low, close, volume: first and last by (ts, tie)."""
    order = F.struct("ts", "tie")
    return ticks.groupBy("symbol", F.date_trunc(unit, "ts").alias("bar")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    ).withColumnRenamed("bar", "ts")


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir))


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume")
    )


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = read(spark, sf_dir, "events").where("event_type IN ('click', 'view', 'purchase', 'signup')")
    arrival = F.col("event_type").isin("click", "view")
    here, there = F.concat(F.lit("K"), F.pmod("event_id", F.lit(8))), F.concat(F.lit("A"), F.pmod(k, F.lit(7)))
    return e.select(
        F.col("user_id").cast("string").alias("icao24"), F.when(arrival, "arrival").otherwise("departure").alias("direction"), here.alias("airport"),
        F.col("ts").alias("first_seen"), F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 60_000_000).cast("long")).alias("last_seen"),
        F.upper(F.substring("event_type", 1, 3)).alias("callsign"), F.when(arrival, there).otherwise(here).alias("dep_airport"),
        F.when(arrival, here).otherwise(there).alias("arr_airport"), (k * 200).alias("distance"), F.col("event_id").alias("seq"),
    )
