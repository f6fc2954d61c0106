"""Bars and signals over streams: event-time windows with watermarks, incremental batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.store import merge_keyed


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of (symbol, ts, price, tie): rows later than ``late`` are left out."""
    order = F.struct("ts", "tie")
    agg = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return agg.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def read_ticks(spark: SparkSession, path: str, schema) -> DataFrame:
    """A directory of event files as a stream of ticks."""
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("tie"))


def run_incremental(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Merges everything new into a keyed table, then stops; the checkpoint is the high-water mark."""
    return (
        stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, _: merge_keyed(df, path, keys)).start()
    )
