"""Exact duplicates against immutable snapshots, screened by static binary-fuse filters.

A snapshot's distinct digests are dealt into buckets by their leading bits; each bucket gets one
3-wise binary-fuse filter. Digests, buckets and filters are stored once and never change; batches
read them. A batch's distinct digests pass their bucket's filter; only positives join the snapshot's
exact bucket, and only texts that seem repeated are compared byte by byte (found by one semi-join on
doc_id and text hash, the only step that moves texts). Duplicates inside a batch are grouped
separately, and equal texts are combined inside each task before they move again.

Defined cases: null text is empty text; an empty table gives an empty result; rows without doc_id
come after all others, so that one stays only in a group without any doc_id; of rows equal in
doc_id and text exactly one stays, the snapshot's before the batch's; very long texts are hashed and
compared whole; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, Scratch, joined, mix64, on_workers

KEYS_PER_BUCKET = 50_000


class FuseFilter:
    """A 3-wise binary-fuse filter with 8-bit fingerprints over distinct uint64 keys."""

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray):
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys + np.uint64(seed))
        first = ((h >> np.uint64(32)) * np.uint64(segment * count)) >> np.uint64(32)
        mask, step = np.uint64(segment - 1), np.uint64(segment)
        slots = np.stack([first, (first + step) ^ ((h >> np.uint64(18)) & mask), (first + step + step) ^ (h & mask)])
        return slots.astype(np.int64), (mix64(h) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        n = len(keys)
        segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
        count = max(1, math.ceil((n * factor + 8) / segment) - 2) + 1
        for seed in range(1, 1000):
            slots, prints = cls._slots(keys, seed * 0x9E3779B97F4A7C15 % 2**64, segment, count)
            size = (count + 2) * segment
            degree = np.bincount(slots.ravel(), minlength=size)
            index = np.zeros(size, np.int64)
            np.add.at(index, slots.ravel(), np.tile(np.arange(n), 3))
            rounds, peeled = [], 0
            single = np.flatnonzero(degree == 1)
            while len(single):
                own, at = np.unique(index[single], return_index=True)
                rounds.append((own, single[at]))
                peeled += len(own)
                gone = slots[:, own].ravel()
                np.subtract.at(degree, gone, 1)
                np.subtract.at(index, gone, np.tile(own, 3))
                gone = np.unique(gone)
                single = gone[degree[gone] == 1]
            if peeled == n:
                table = np.zeros(size, np.uint8)
                for own, at in reversed(rounds):  # keys of one round never share the slots they set
                    a, b, c = slots[:, own]
                    table[at] = prints[own] ^ table[a] ^ table[b] ^ table[c]
                return cls(seed * 0x9E3779B97F4A7C15 % 2**64, segment, count, table)
        raise ValueError("keys are not distinct")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self._slots(keys, self.seed, self.segment, self.count)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == prints

    def pack(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], np.uint64).tobytes() + self.table.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> FuseFilter:
        seed, segment, count = (int(x) for x in np.frombuffer(raw[:24], np.uint64))
        return cls(seed, segment, count, np.frombuffer(raw[24:], np.uint8))


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; runs that are one space already are left alone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D]{SPACE}*|\x20{SPACE}+", " ")


def digests(docs: DataFrame) -> DataFrame:
    norm = normalised(F.col("text"))
    return docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2(norm, 256).alias("sha"), F.xxhash64(norm).alias("xx")
    )


def grouped(hashed: DataFrame) -> DataFrame:
    """One row per digest: sha, xx, n, first (the row that stays), key."""
    key = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "new", "rid"))
    return hashed.groupBy("sha", "xx").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).withColumn("key", key)


def build_filters(digests: DataFrame) -> DataFrame:
    """(bucket, filter) of a snapshot's distinct digests (columns key, bucket)."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(group["key"].to_numpy(np.uint64))
        return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "filter": [FuseFilter.build(keys).pack()]})

    return digests.select("key", "bucket").groupBy("bucket").applyInPandas(build, "bucket long, filter binary")


@dataclass(frozen=True)
class Snapshot:
    """A stored, immutable set of digests: its rows, one row a digest in exact buckets, a filter a bucket."""

    path: str
    rows: DataFrame
    digests: DataFrame
    filters: DataFrame
    buckets: int


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    read = lambda part: spark.read.parquet(f"{path}/{part}")
    return Snapshot(path, read("rows"), read("digests"), read("filters"), read("size").first()["buckets"])


def store_snapshot(hashed: DataFrame, path: str) -> Snapshot:
    """Writes a snapshot of stored rows (rid, doc_id, sha, xx, new) once; an existing path is an error."""
    spark = hashed.sparkSession
    on_workers(spark)
    hashed.write.parquet(f"{path}/rows")
    buckets = max(1, -(-spark.read.parquet(f"{path}/rows").count() // KEYS_PER_BUCKET))
    grouped(spark.read.schema(hashed.schema).parquet(f"{path}/rows")).withColumn("bucket", F.pmod("key", F.lit(buckets))).write.parquet(f"{path}/digests")
    build_filters(spark.read.parquet(f"{path}/digests")).write.parquet(f"{path}/filters")
    spark.createDataFrame([(buckets,)], "buckets long").write.parquet(f"{path}/size")  # last: what has it is complete
    return open_snapshot(spark, path)


def write_snapshot(docs: DataFrame, path: str) -> Snapshot:
    """A snapshot of documents; batches are then checked by ``dedup_incoming`` without building it anew."""
    scratch = Scratch(docs.sparkSession, "snapshot")
    return store_snapshot(scratch.save(digests(docs).withColumn("new", F.lit(False)), "digests"), path)


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """The batch's digests that a snapshot may hold: every true member, and about 0.4 % of others."""

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty or left.empty:
            return left.iloc[:0]
        return left[FuseFilter.unpack(right["filter"].iloc[0]).contains(left["key"].to_numpy(np.uint64))]

    return batch.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(check, batch.schema)


def _repeated(snapshot: Snapshot, hashed: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per digest that occurs more than once: sha, xx, first, n, of snapshot and batch (the
    rows of ``hashed`` that are new)."""
    old = snapshot.digests.select("sha", "xx", "n", "first")
    new = scratch.save(grouped(hashed.where("new")).withColumn("bucket", F.pmod("key", F.lit(snapshot.buckets))), "incoming")
    # exact buckets: a positive is a duplicate only if its digest is there; batch groups stand beside
    positives = screen(new.select("sha", "xx", "key", "bucket"), snapshot.filters)
    met = scratch.save(positives.select("sha", "xx").join(old.select("sha", "xx"), ["sha", "xx"], "left_semi").withColumn("met", F.lit(True)), "met")
    both = old.unionByName(new.select("sha", "xx", "n", "first")).join(met, ["sha", "xx"], "left").where("met OR n > 1")
    return scratch.save(both.groupBy("sha", "xx").agg(F.min("first").alias("first"), F.sum("n").alias("n")), "repeated")


def _settled(hashed: DataFrame, members: DataFrame, docs: DataFrame, repeated: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``hashed`` with their group; the texts of all repeated digests' ``members`` are found
    in ``docs`` and compared byte by byte."""
    keys = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null")]
    sizes = repeated.select("sha", "xx", "n")
    ids = joined(members, repeated.select("sha", "xx"), ["sha", "xx"], "rid", scratch, "left_semi", sizes).select(*keys, "xx").distinct()
    # equal texts meet inside each task first; the hash beside the id keeps rows without one apart
    norm = normalised(F.col("text"))
    again = docs.select(*keys, norm.alias("norm")).withColumn("xx", F.xxhash64("norm")).join(ids, ["_id", "_null", "xx"], "left_semi")
    bytewise = (
        again.groupBy("norm").agg(F.lit(1).alias("_"))
        .groupBy(F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("xx"))
        .agg(F.count(F.lit(1)).alias("texts"))
    )
    size = F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share SHA-256 and xxHash64")))
    groups = scratch.save(repeated.join(bytewise, ["sha", "xx"]).select("sha", "xx", "first", size.alias("size")), "groups")
    out = joined(hashed, groups, ["sha", "xx"], "rid", scratch, "left", sizes)
    single = F.col("size").isNull()
    return out.select(
        "doc_id",
        "xx",
        F.when(single, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | ((F.col("rid") == F.col("first.rid")) & (F.col("new") == F.col("first.new")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def dedup_incoming(docs: DataFrame, snapshot: Snapshot, snapshot_docs: DataFrame) -> DataFrame:
    """A batch against a stored snapshot: one row per document of the batch, as of ``dedup_batch``; the
    snapshot's documents are read only where texts have to be compared."""
    on_workers(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "incoming")
    docs = docs.select("doc_id", "text")
    hashed = scratch.save(digests(docs).withColumn("new", F.lit(True)), "digests")
    members = hashed.unionByName(snapshot.rows)
    return _settled(hashed, members, docs.unionByName(snapshot_docs.select("doc_id", "text")), _repeated(snapshot, hashed, scratch), scratch)


def dedup_batch(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """One row per document: doc_id, xx (xxHash64 of the normalised text), keep_id, group_size, kept, text_sha256.

    ``in_snapshot`` tells the snapshot's rows (over doc_id) from the incoming batch, where one table
    holds both; the snapshot is stored for the run.
    """
    on_workers(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "dedup")
    docs = docs.select("doc_id", "text")
    hashed = scratch.save(digests(docs).withColumn("new", ~F.coalesce(in_snapshot, F.lit(False))), "digests")
    snapshot = store_snapshot(hashed.where("NOT new"), f"{scratch.root}/snapshot")
    return _settled(hashed, hashed, docs, _repeated(snapshot, hashed, scratch), scratch)


def first_copies(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """The given rows, all columns, without exact duplicates."""
    keys = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null")]
    kept = dedup_batch(docs, in_snapshot).where("kept").select(*keys, F.col("xx").alias("_xx"))
    rows = docs.select("*", *keys, F.xxhash64(normalised(F.col("text"))).alias("_xx"))
    names = ["_id", "_null", "_xx"]
    # rows equal in doc_id and text can't be told apart by a join: folded where the join has put them
    return rows.join(kept, names, "left_semi").dropDuplicates(names).select(docs.columns)


def middle(docs: DataFrame) -> Column:
    """The older half of the id range, as the snapshot of a table that holds both."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= ((lo or 0) + (hi or 0)) // 2
