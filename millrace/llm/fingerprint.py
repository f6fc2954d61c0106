"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; in every window of ``window`` consecutive hashes the
smallest is chosen, the rightmost of equal ones. Chosen hashes keep their positions, so any shared
passage of at least window + k - 1 code points shares a fingerprint entry. The string is the
concatenation of 16 hex digits per entry: position, then 32-bit hash. A text shorter than k is one
gram; an empty text has an empty fingerprint.

Defined cases: null text is empty; the next document is the next row by doc_id (null doc_ids
first, equal ones by text hash), after the last row the first, which may be the row itself; ids may be
any 64-bit integers, as far apart as they like; rows equal in doc_id and text follow one another in
one range, in streaming order; two empty fingerprints are alike (1), an empty and another aren't (0);
very long texts are fingerprinted whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, mix64, on_workers

GRAM = 16  # a power of two: hashes double in length
WINDOW = 40
ROWS_PER_RANGE = 250
#: Ranges are streamed, so more rows in each cost time in a task, not memory.
MOST_RANGES = 32_768
SAMPLE = 16
BYTES_PER_TASK = 32 << 20
_FACTOR = 0x9E3779B97F4A7C15

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    h, size = points.astype(np.uint64) + np.uint64(1), 1
    while size < k:
        h = h[:-size] * np.uint64(pow(_FACTOR, size, 2**64)) + h[size:]
        size *= 2
    return mix64(h) >> np.uint64(32)


def winnow(text: str, k: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Sorted entries of a text, (position << 32) | hash."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.empty(0, np.uint64)
    if n < k:
        points = np.concatenate([points, np.full(k - n, 0xFFFFFFFE, np.uint32)])
    low = np.uint64(0xFFFFFFFF)
    h = gram_hashes(points, k)
    best = (h << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64))  # least: smallest hash, then rightmost
    width, want = 1, min(window, len(h))
    while width < want:
        step = min(width, want - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    chosen = best[np.flatnonzero(np.diff(best, prepend=best[0] + np.uint64(1)))] if len(best) > 1 else best
    return np.unique(((low - (chosen & low)) << np.uint64(32)) | (chosen >> np.uint64(32)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' hashes, wherever they stand."""
    a, b = np.unique(a & np.uint64(0xFFFFFFFF)), np.unique(b & np.uint64(0xFFFFFFFF))
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _row(doc_id, text: str, own: np.ndarray, after: str, after_own: np.ndarray) -> tuple:
    n = len(text)
    cut = n // 4
    edited = text[: n - cut] + after[:cut]
    changed = winnow(edited) if cut else own
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, sha, own.astype(">u8").tobytes().hex(), changed.astype(">u8").tobytes().hex(), likeness(own, changed), likeness(own, after_own)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    before = None
    for batch in batches:
        rows, held = [], 0
        for r, doc_id, text in zip(batch.column("r"), batch.column("doc_id"), batch.column("text"), strict=True):
            now = (r.as_py(), doc_id.as_py(), text.as_py())
            own = winnow(now[2])
            if before and before[0][0] == now[0]:
                rows.append(_row(before[0][1], before[0][2], before[1], now[2], own))
                held += len(rows[-1][3]) + len(rows[-1][4])
            before = (now, own)
            if held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Ranges:
    """Numbers of the ranges of (doc_id, hash), null ids first, between sorted bounds."""

    def __init__(self, bounds: list[tuple[int | None, int]]):
        self.no_id = np.array([h for d, h in bounds if d is None], np.int64)
        rest = [(d, h) for d, h in bounds if d is not None]
        self.ids, self.hashes = np.array([d for d, _ in rest], np.int64), np.array([h for _, h in rest], np.int64)

    def __call__(self, has_id: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """How many bounds are at most each key."""
        low, high = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for i in np.flatnonzero((low < high) & has_id):  # bounds of this very id: by hash
            low[i] += np.searchsorted(self.hashes[low[i] : high[i]], hashes[i], "right")
        return np.where(has_id, len(self.no_id) + low, np.searchsorted(self.no_id, hashes, "right"))


def _bounds(keys: DataFrame, rows: int, ranges: int) -> list[tuple[int | None, int]]:
    """At most ranges - 1 bounds at even steps through a hash-chosen sample of SAMPLE keys a range."""
    share = min(1.0, SAMPLE * ranges / max(rows, 1))
    chosen = F.shiftrightunsigned(F.xxhash64("doc_id", "h", F.lit("range")), 11) / float(1 << 53) < share
    seen = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["h"]) for r in keys.where(chosen).select("doc_id", "h").distinct().collect()})
    at = sorted({len(seen) * k // ranges for k in range(1, ranges)}) if seen else []
    return [(seen[i][1] if seen[i][0] else None, seen[i][2]) for i in at if i]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts (SCHEMA).

    Rows are dealt by ranges of (doc_id, text hash) with about equally many rows, whatever the ids
    are: the bounds come from a sample of at most SAMPLE x MOST_RANGES keys. Each range is followed by
    a copy of the first row of the next, so that texts move once and no range waits for another.
    """
    spark = docs.sparkSession
    on_workers(spark)
    scratch = Scratch(spark, "winnow")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keys = scratch.save(docs.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("bytes")), "keys")
    n, size = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    range_of = Ranges(_bounds(keys, n, min(MOST_RANGES, max(1, -(-n // ROWS_PER_RANGE)))))

    # null ids cross to pandas as a flag and 0, so that no id passes through floating point
    @F.pandas_udf("long")
    def number(has: pd.Series, doc_id: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(has.to_numpy(bool), doc_id.to_numpy(np.int64), h.to_numpy(np.int64)))

    r = number(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("h")).alias("r")
    firsts = scratch.save(keys.select("doc_id", "h", r).groupBy("r").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "h")).alias("first")), "firsts")
    order = Window.orderBy("r")  # one row a range: MOST_RANGES at most
    follow = F.coalesce(F.lead("r").over(order), F.min("r").over(Window.partitionBy(F.lit(0))))
    links = firsts.select(F.col("r").alias("into"), follow.alias("r")).join(firsts, "r").select("into", F.col("first.doc_id").alias("_d"), F.col("first.h").alias("h"))
    links = scratch.save(links, "links")  # at most MOST_RANGES rows: small enough for every task
    texts = docs.withColumn("h", F.xxhash64("text"))
    heads = texts.join(F.broadcast(links), (texts["h"] == links["h"]) & texts["doc_id"].eqNullSafe(links["_d"])).groupBy("into").agg(F.first("doc_id").alias("doc_id"), F.first(texts["h"]).alias("h"), F.first("text").alias("text"))
    closing = heads.select(F.col("into").alias("r"), "doc_id", "h", "text", F.lit(1).alias("closing"))
    stream = texts.select(r, "doc_id", "h", "text", F.lit(0).alias("closing")).unionByName(closing)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_PER_TASK))
    stream = stream.repartition(parts, "r").sortWithinPartitions("r", "closing", F.col("doc_id").asc_nulls_first(), "h")
    return stream.select("r", "doc_id", "text").mapInArrow(_pairs, SCHEMA)
