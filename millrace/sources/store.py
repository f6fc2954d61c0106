"""Stored tables: Hive-partitioned features, keyed tables, manifests, JDBC, CSV, registries.

Writes are idempotent: partitions are overwritten, not appended to, and keyed tables are merged
into a new version with the last row of a key winning. Readers are plain scans, so that filters on the partition
columns prune and others are pushed down.
"""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.reshape import high_water, latest, upsert


def write_features(df: DataFrame, root: str, single: bool = True) -> None:
    """date=/symbol= Parquet, zstd; doubles as floats. Rewrites exactly the partitions it holds."""
    narrow = [F.col(c).cast("float").alias(c) if single and t == "double" else F.col(c) for c, t in df.dtypes]
    out = df.select(*narrow).withColumn("date", F.to_date("ts"))
    (
        out.repartition("date", "symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date", "symbol").parquet(root)
    )


def read_features(spark: SparkSession, root: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the symbols between two dates (inclusive); with a limit, the first by (symbol, ts). A
    selection without a limit isn't sorted: partitions are, and windows order for themselves."""
    df = spark.read.parquet(root)
    if symbols:
        df = df.where(F.col("symbol").isin(symbols))
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    df = df.orderBy("symbol", "ts").limit(limit) if limit else df
    return df.select(*columns) if columns else df


def available(spark: SparkSession, root: str) -> DataFrame:
    """(date, symbol) pairs of a store, from the names of its folders; no file is opened."""
    fs, at = _fs(spark, root)
    found = fs.globStatus(at(f"{root}/date=*/symbol=*"))
    pairs = [(f.getPath().getParent().getName()[5:], unquote(f.getPath().getName()[7:])) for f in found]
    return spark.createDataFrame(pairs, "date string, symbol string").withColumn("date", F.col("date").cast("date"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a keyed table: those whose last file, _SUCCESS, is there."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at(path)) if f.isDirectory()]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(at(f"{path}/{n}/_SUCCESS")))


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a keyed table."""
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")


def merge_keyed(df: DataFrame, path: str, keys: list[str], how=upsert) -> None:
    """INSERT ... ON CONFLICT into a Parquet table. Each merge writes a version of its own, which counts
    once it is complete; only then the one before goes, so a lost driver loses nothing. Two writers of
    one version can't both claim it."""
    spark = df.sparkSession
    have = _versions(spark, path)
    fs, at = _fs(spark, path)
    now = have[-1] + 1 if have else 1
    fs.mkdirs(at(path))
    claim = at(f"{path}/_claim-{now}")
    if not fs.createNewFile(claim):
        raise RuntimeError(f"version {now} of {path} is being written; after a crash remove {claim.toString()}")
    try:
        rows = how(read_keyed(spark, path), df, keys) if have else df
        rows.write.mode("overwrite").parquet(f"{path}/version={now}")
    finally:
        fs.delete(claim, False)
    for old in have:
        fs.delete(at(f"{path}/version={old}"), True)


def _add_marks(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    both = target.unionByName(source)
    return both.groupBy(*keys).agg(F.max("high_water").alias("high_water"), F.sum("n_rows").alias("n_rows"), F.max("updated_at").alias("updated_at"))


def update_manifest(df: DataFrame, path: str) -> DataFrame:
    """Adds a batch to the manifest: each symbol's high-water mark never moves back, and its row count
    is that of all batches. Returns the new marks."""
    merge_keyed(high_water(df).withColumn("updated_at", F.current_timestamp()), path, ["symbol"], _add_marks)
    return read_keyed(df.sparkSession, path)


REGISTRY = "name string, version long, params string, metrics string"


def register_version(spark: SparkSession, path: str, name: str, params: str, metrics: str = "{}") -> int:
    """Adds the next version of a strategy or model to a registry table (JSON in strings). A version is
    claimed by an empty file before it is written, so that two writers never get the same."""
    fs, at = _fs(spark, path)
    known = spark.read.parquet(path).where(F.col("name") == name).agg(F.max("version")).first()[0] if exists(spark, path) else None
    version = (known or 0) + 1
    tag = hashlib.sha256(name.encode()).hexdigest()[:24]
    while not fs.createNewFile(at(f"{path}.claims/{tag}-{version}")):
        version += 1
    row = spark.createDataFrame([(name, version, params, metrics)], REGISTRY)
    row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)
    return version


def compare_versions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All versions of a name, newest first, with is_latest."""
    x = spark.read.parquet(path).where(F.col("name") == name)
    return x.withColumn("is_latest", F.col("version") == F.max("version").over(_by_name())).orderBy(F.desc("version"))


def forget(spark: SparkSession, path: str, name: str, version: int | None = None) -> None:
    """Deletes one version of a name, or all: the registry is written anew beside itself, then renamed."""
    gone = (F.col("name") == name) & (F.lit(version is None) | (F.col("version") == F.lit(version or 0)))
    fs, at = _fs(spark, path)
    spark.read.parquet(path).where(~gone).write.mode("overwrite").parquet(f"{path}.kept")
    fs.rename(at(path), at(f"{path}.before"))
    fs.rename(at(f"{path}.kept"), at(path))
    fs.delete(at(f"{path}.before"), True)


def update_metrics(spark: SparkSession, path: str, name: str, metrics: dict) -> int:
    """The latest version's parameters with new metrics, as the next version."""
    old = registered(spark, path).where(F.col("name") == name).first()
    return register_version(spark, path, name, old["params"], json.dumps(json_safe(metrics)))


def json_safe(x):
    """Plain values of nested numpy and Spark ones; what isn't finite becomes null."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)) or type(x).__name__ == "ndarray":
        return [json_safe(v) for v in (x.tolist() if hasattr(x, "tolist") else x)]
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def _by_name():
    from pyspark.sql import Window

    return Window.partitionBy("name")


def migrate(spark: SparkSession, folder: str, record: str) -> list[str]:
    """Runs the statements of NNN_*.sql files in order, once each; the record table names what has run."""
    done = {r["name"] for r in read_keyed(spark, record).collect()} if _versions(spark, record) else set()
    ran = []
    for f in sorted(Path(folder).glob("[0-9][0-9][0-9]_*.sql")):
        if f.name not in done:
            for statement in f.read_text().split(";"):
                if statement.strip():
                    spark.sql(statement)
            merge_keyed(spark.createDataFrame([(f.name,)], "name string"), record, ["name"])
            ran.append(f.name)
    return ran


def registered(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The latest version of every name, or all versions of one."""
    df = spark.read.parquet(path)
    return df.where(F.col("name") == name).orderBy("version") if name else latest(df)


def read_jdbc(spark: SparkSession, url: str, table: str, start: str, end: str, partitions: int = 8, column: str = "ts", fetch: int = 50_000, **options: str) -> DataFrame:
    """A table in ranges of a timestamp column, one connection a range, rows fetched in chunks."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=start, upperBound=end, numPartitions=partitions, fetchsize=fetch, **options).load()
        .where((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.lit(end).cast("timestamp")))
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_result(bars: DataFrame, trades: DataFrame, path: str, run_id: str, points: int = 5000) -> None:
    """One row a symbol: the first ``points`` of the equity curve, and the trades, as arrays."""
    first = bars.withColumn("_i", F.row_number().over(_order())).where(F.col("_i") <= points)
    curve = first.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "equity"))), lambda p: p["equity"]).alias("equity"))
    log = trades.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*[c for c in trades.columns if c != "symbol"]))).alias("trades"))
    curve.join(log, "symbol", "left").withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("symbol").orderBy("ts")
