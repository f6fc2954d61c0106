"""Shared pieces of the training-data operators: scratch tables, prefix sums, UTF-8 word hashing."""

from __future__ import annotations

import atexit
import gc
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.workers import on_workers

__all__ = ["SPACE", "WORD", "Scratch", "checkpoint_dir", "joined", "mix64", "n_buckets", "on_workers", "prefix_sum", "release_shuffles", "shingle_set", "word_hashes"]

#: White space of the contracts, and a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local default serves a
    local master only: on a cluster each machine would write its own disk, and later reads lack rows."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL_CHECKPOINT_DIR).rstrip("/")


class Scratch:
    """Tables written under the shared checkpoint folder: they cut lineage and outlive executors.

    ``save`` writes and rereads one; ``drop`` removes one that is no longer needed. What a lazy
    result still reads stays until the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[str] = []
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append(path)
        out._scratch_path = path
        return out

    def mark(self) -> int:
        return len(self._paths)

    def drop_since(self, mark: int, *keep: DataFrame) -> None:
        """Removes what has been saved since the mark, but for the tables to keep."""
        kept = {t._scratch_path for t in keep}
        for path in self._paths[mark:]:
            if path not in kept:
                self._remove(path)
        self._paths[mark:] = [p for p in self._paths[mark:] if p in kept]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._remove(t._scratch_path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before the process
            pass


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are gone: it waits for the driver's garbage
    collectors, which have little reason to run while a loop of small jobs fills disks elsewhere."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def prefix_sum(df: DataFrame, keys: list[str], bucket: Column, order: list, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys`` in the order (bucket, order).

    A key may hold any share of the rows: only (key, bucket) groups are sorted, and the running
    sum over buckets works on one pre-aggregated row per (key, bucket).
    """
    df = df.withColumn("_pb", bucket)
    group = [*keys, "_pb"]
    totals = df.groupBy(*group).agg(F.sum(value).alias("_pt"))
    over = Window.partitionBy(*keys).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*group, F.coalesce(F.sum("_pt").over(over), F.lit(0)).cast("long").alias("_base"))
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(base, group)
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long"))
        .drop("_pb", "_base")
    )


def joined(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, scratch: Scratch, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key) on ``keys``, which are never null.

    A key with more rows than an even share of a shuffle partition is dealt out by the hash of column
    ``spread`` into parts of that share or less; the table's row goes to each part. Such keys are fewer
    than partitions, so their hashes fit into the plan, and the copies are at most three times as many.
    ``sizes`` (keys, n) saves the count.
    """
    if sizes is None:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = scratch.save(sizes.select(F.xxhash64(*keys).alias("h"), "n"), "sizes")
    share = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot: dict[int, list[int]] = {}
    for r in sizes.where(F.col("n") > share).collect():
        hot.setdefault(1 << (-(-r["n"] // share) - 1).bit_length(), []).append(r["h"])
    scratch.drop(sizes)
    few = reduce(lambda e, p: F.when(F.xxhash64(*keys).isin(sorted(hot[p])), p).otherwise(e), sorted(hot), F.lit(1))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), few).cast("int"))
    copies = table.withColumn("_part", F.explode(F.sequence(F.lit(0), few - 1)))
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def n_buckets(rows: int, per_bucket: int = 20_000, least: int = 64) -> int:
    """Buckets that keep a group of all ``rows`` at about ``per_bucket`` rows each."""
    return max(least, -(-rows // per_bucket))


# ---------------------------------------------------------------------------------------------
# numpy: words of many UTF-8 texts at once

_MULT = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def word_hashes(text: bytes) -> np.ndarray:
    """One uint64 for each white-space separated word of a UTF-8 text, A-Z lower-cased.

    Equal words have equal hashes; each is a polynomial over random byte values, made from
    prefix sums, so that no word becomes a Python object.
    """
    if not text:
        return np.empty(0, np.uint64)
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    word = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _power_table(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct uint64 hashes of the word ``width``-shingles; with fewer words, of the whole sequence."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(len(words) - width + 1, 1)
    acc = np.zeros(n, np.uint64)
    for j in range(min(width, len(words))):
        acc = mix64(acc * _BASE + words[j : j + n])
    if len(words) < width:
        acc = mix64(acc + np.array([len(words)], np.uint64) * _MULT)  # a short sequence never equals a full shingle
    return np.unique(acc)
