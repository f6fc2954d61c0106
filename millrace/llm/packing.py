"""Best-fit packing by linear grouping.

A document's token ids end with an end-of-text id. Only documents longer than a sequence are cut,
into full pieces after a shorter first one. The plan needs lengths only: a histogram of at most
``length`` integers, whatever the size of the corpus. Large lengths fall into groups of equal
cardinality and are rounded up to the largest of their group; the few sizes left get an optimal
mix of configurations (a linear programme by column generation, rounded down); actual lengths then
take the groups' places, the last place by the room that really is left, for as long as a
configuration wastes at most ``slack`` tokens; and small pieces, with the large ones left over, go
longest first to the sequence with the least room that holds them.

Equal lengths are interchangeable, so the plan speaks of runs: pieces of length l with ranks
[a, b) go to sequences base, base+1, ... at one offset. Ranks are dealt out in two levels and
meet the runs in an equi-join on (length, block of ranks).

Defined cases: null text is an empty text of one token; an empty table gives an empty result;
repeated rows and null doc_ids are separate documents; very long texts are encoded whole and cut into
pieces; which of several equal lengths takes which place is settled by hash, and rows equal in all
columns are interchangeable; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, n_buckets, on_workers, prefix_sum

LENGTH = 1024
END = 2
GROUPS = 60
SLACK = 4
SMALL = 128
RANKS = 8192


# ---------------------------------------------------------------------------------------- tokens
@dataclass(frozen=True)
class Engine:
    """What encodes a tokenizers JSON file, settled on the driver for the whole job.

    ``ranks``: a byte-level BPE's ranks beside the file, which ``tiktoken`` turns into the ids of the
    ``tokenizers`` library several times faster (tests compare every text of a table). Texts that hold
    one of the file's added tokens (``special``) go through the library itself, as all do without
    ranks. A worker that lacks a library or a file fails; it never falls back to another engine.
    """

    path: str
    ranks: str | None
    special: tuple[str, ...]


def engine_of(path: str, fast: bool = True) -> Engine:
    ranks = path.removesuffix(".json") + ".tiktoken"
    with open(path, encoding="utf-8") as f:
        special = tuple(t["content"] for t in json.load(f)["added_tokens"])
    return Engine(path, ranks if fast and os.path.exists(ranks) else None, special)


class Encoder:
    def __init__(self, engine: Engine):
        self.path, self.special = engine.path, engine.special
        self._full = self._fast = None
        if engine.ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(engine.ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    @property
    def full(self):
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.path)
        return self._full

    def __call__(self, text: str) -> np.ndarray:
        if self._fast is not None and not any(x in text for x in self.special):
            return np.array(self._fast.encode_ordinary(text), np.uint32)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(engine: Engine) -> Encoder:
    return Encoder(engine)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian uint32) for every piece."""
    on_workers(docs.sparkSession)
    engine = engine_of(tokenizer or default_tokenizer())
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if keep_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(engine)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                at = 0
                for k, end in enumerate(range((len(ids) - 1) % length + 1, len(ids) + 1, length)):
                    raw = ids[at:end].tobytes()
                    rows.append((doc_id, k, at, end - at, zlib.crc32(raw), *([raw] if keep_ids else [])))
                    at = end
            cols = zip(*rows, strict=True) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    )


# ------------------------------------------------------------------------------------------ plan
def _best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The multiset of sizes within room of the greatest value; one step for each item it holds."""
    worth = value > 1e-12
    items, sizes_w, value_w = np.flatnonzero(worth), sizes[worth], value[worth]
    pattern = np.zeros(len(sizes), np.int64)
    if not len(items):
        return pattern
    best = np.zeros(room + 1)
    reach = np.arange(room + 1)[None, :] - sizes_w[:, None]
    fits, reach = reach >= 0, np.maximum(reach, 0)
    choices = []
    for _ in range(room // int(sizes_w.min())):
        got = np.where(fits, best[reach] + value_w[:, None], -1.0)
        pick = got.argmax(axis=0)
        top = got[pick, np.arange(room + 1)]
        better = top > best + 1e-12
        if not better[room]:
            break
        choices.append((np.where(better, pick, -1), best))
        best = np.where(better, top, best)
    c = room
    for pick, _ in reversed(choices):
        if pick[c] >= 0:
            pattern[items[pick[c]]] += 1
            c -= int(sizes_w[pick[c]])
    return pattern


def configurations(sizes: list[int], counts: list[int], room: int) -> list[tuple[int, list[int]]]:
    """(times, indexes into sizes): patterns that hold the items, by column generation, the
    programme's rounding at the end; revised simplex over the inverse of the basis."""
    if not sizes:
        return []
    s, need = np.array(sizes), np.array(counts, float)
    k = len(sizes)
    basis = np.diag([float(room // x) for x in sizes])
    inverse = np.diag([1.0 / (room // x) for x in sizes])
    level = inverse @ need
    for step in range(40 * k):
        duals = inverse.sum(axis=0)
        column = _best_pattern(duals, s, room).astype(float)
        if duals @ column <= 1 + 1e-6:
            break
        way = inverse @ column
        ok = way > 1e-9
        if not ok.any():
            break
        j = int(np.argmin(np.where(ok, np.maximum(level, 0) / np.where(ok, way, 1), np.inf)))
        basis[:, j] = column
        row = inverse[j] / way[j]
        inverse -= np.outer(way, row)
        inverse[j] = row
        if step % 200 == 199:  # rounding errors don't pile up
            inverse = np.linalg.inv(basis)
        level = inverse @ need
    level = np.linalg.solve(basis, need)
    out, left = [], need.astype(np.int64)
    for j in np.argsort(-level):
        pattern = basis[:, j].astype(np.int64)
        used = pattern > 0
        times = min(int(max(level[j], 0) + 1e-9), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if times > 0:
            left -= times * pattern
            out.append((times, [i for i in range(k) for _ in range(pattern[i])]))
    # the rest of the rounding: fill one pattern after the other, the largest sizes first
    while left.any():
        free, pick = room, []
        for i in sorted(range(k), key=lambda i: -sizes[i]):
            n = min(int(left[i]), free // sizes[i])
            pick += [i] * n
            free -= n * sizes[i]
        n = np.bincount(pick, minlength=k)
        times = int(min(left[i] // n[i] for i in range(k) if n[i]))
        left -= times * n
        out.append((times, pick))
    return out


def plan(histogram: dict[int, int], length: int = LENGTH, groups: int = GROUPS, small: int = SMALL, slack: int = SLACK) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset) for pieces counted by length."""
    sequence = 0
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)  # ranks given out, by length
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room: runs of sequences [a, b)

    def give(size: int, n: int, first: int, offset: int) -> None:
        runs.append((size, used[size], used[size] + n, first, offset))
        used[size] += n

    full = histogram.get(length, 0)
    if full:
        give(length, full, 0, 0)
        sequence = full
    left = {x: n for x, n in sorted(histogram.items()) if small < x < length and n > 0}
    lens, total = list(left), sum(left.values())
    rounded, counts, quota = [], [], -(-total // groups) if total else 0
    room_left = 0
    for x in reversed(lens):  # equal cardinalities, from the longest down; a length may fall into two groups
        n = left[x]
        while n:
            if not room_left:
                room_left = quota
                if not rounded or rounded[-1] != x:
                    rounded.append(x)
                    counts.append(0)
            take = min(n, room_left)
            counts[-1] += take
            n -= take
            room_left -= take

    def longest(most: int, picked: list[int]) -> int | None:
        """The longest remaining length of at most ``most``, besides those picked for this sequence."""
        i = bisect_right(lens, most) - 1
        while i >= 0 and left[lens[i]] <= picked.count(lens[i]):
            i -= 1
        return lens[i] if i >= 0 else None

    for times, pattern in configurations(rounded, counts, length):
        while times:  # actual lengths take the places, the last one by the room that really is left
            picked: list[int] = []
            for k, g in enumerate(pattern):
                free = length - sum(picked)
                x = longest(free if k == len(pattern) - 1 else min(rounded[g], free), picked)
                if x is not None:
                    picked.append(x)
            if not picked or length - sum(picked) > slack:
                break  # best-fit below does better with what is left
            n = min(times, min(left[x] // picked.count(x) for x in picked))
            offset = 0
            for x in picked:
                give(x, n, sequence, offset)
                offset += x
                left[x] -= n
                if not left[x]:
                    del lens[bisect_left(lens, x)]
            bins[length - offset].append((sequence, sequence + n))
            sequence += n
            times -= n
    rest = {x: n for x, n in left.items() if n} | {x: n for x, n in histogram.items() if 0 < x <= small}
    rooms = sorted(r for r in bins if r > 0)
    for x, n in sorted(rest.items(), reverse=True):
        while n:
            i = bisect_left(rooms, x)
            if i == len(rooms):  # no room anywhere: open as many sequences as this length needs
                more = -(-n // (length // x))
                bins[length].append((sequence, sequence + more))
                sequence += more
                insort(rooms, length)
                continue
            room = rooms[i]
            a, b = bins[room].pop()
            if not bins[room]:
                rooms.pop(i)
            m = min(n, b - a)
            give(x, m, a, length - room)
            n -= m
            for r, lo, hi in ((room, a + m, b), (room - x, a, a + m)):
                if lo < hi and r > 0:
                    if not bins.get(r):
                        insort(rooms, r)
                    bins[r].append((lo, hi))
    return runs


def place(pieces: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``length`` rows
    runs = plan(counts, length, **options)
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, a long, b long, first long, offset long")
    table = table.where("b > a").withColumn("blk", F.explode(F.sequence(F.expr(f"a div {RANKS}"), F.expr(f"(b - 1) div {RANKS}"))))
    hashed = pieces.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("_one", F.lit(1))
    ranked = prefix_sum(hashed, ["length"], F.pmod("_h", F.lit(n_buckets(sum(counts.values())))), ["_h", "doc_id", "piece", "ids_crc32"], "_one", "_rank")
    return (
        ranked.withColumn("blk", F.expr(f"_rank div {RANKS}"))
        .join(table, ["length", "blk"])
        .where((F.col("_rank") >= F.col("a")) & (F.col("_rank") < F.col("b")))
        .withColumn("sequence_id", F.col("first") + F.col("_rank") - F.col("a"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset for every piece."""
    scratch = Scratch(docs.sparkSession, "pack")
    return place(scratch.save(token_pieces(docs, tokenizer, length, keep_ids), "pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids of a result of ``pack(keep_ids=True)``: at most ``length`` ids each."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.array_join(parts, "")).alias("ids"))
