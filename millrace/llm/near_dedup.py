"""Near duplicates: MinHash bands propose, odd sketches screen, full shingle sets decide.

Documents with equal shingle sets form one class. A class has BANDS x ROWS MinHash values; bands
deal classes into buckets. The values are also folded into a parity bitmap (an odd sketch): the
population count of two bitmaps' XOR estimates their similarity, most precisely where it is high,
which settles in a few JVM operations that most proposed pairs are none. What an estimate leaves
possible is decided on the full sets. Buckets are never expanded into all pairs: every class first
meets one head per bucket, links make components, and further rounds (with other heads) look only at
buckets that still hold several components. Once few pairs are left, or after ROUNDS_OF_HEADS, these
are compared block by block, exactly, so that no pair that shares a bucket is left out, however large
the bucket is; a block gives only links that still join something. Keys with many rows are dealt out.

A pair at a threshold of 0.85 shares no bucket with probability (1 - 0.85**4)**24 = 2e-8, at 0.8
with 3e-6; its estimate is ruled out with less than 1e-6.

Defined cases: null text, or text without words, is an empty set, linked with nothing, also not
with copies of itself; rows equal in text are one class; null doc_ids come after all others (a
component of such rows only has component_id null and keeps them, but ``keep_one`` leaves one row of
each); very long texts give their whole sets, and a pair's two sets meet in one task; empty table:
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, Scratch, joined, mix64, n_buckets, on_workers, prefix_sum, release_shuffles, shingle_set
from millrace.llm.components import connected_components

BANDS, ROWS = 24, 4
BITS = 512
#: The screen lets pass what is within so many standard deviations of the threshold.
DEVIATIONS = 5.5
BLOCK = 512
ROUNDS_OF_HEADS = 6
MEETINGS_PER_TASK = 64

_N = BANDS * ROWS
_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = mix64(np.arange(1, _N + 1, dtype=np.uint64))
_WORDS = [f"s{i}" for i in range(BITS // 64)]


def estimate(bits: float) -> float:
    """The similarity that an odd sketch estimates: of 2 x differing values folded into BITS bits, so
    many are expected to differ."""
    return 1 + BITS / (4 * _N) * math.log(1 - 2 * bits / BITS) if 2 * bits < BITS else 0.0


def deviation(j: float) -> float:
    """Standard deviation of the estimate at similarity j: that of MinHash and that of the fold."""
    return math.sqrt(j * (1 - j) / _N + BITS / 4 * (math.exp(8 * _N * (1 - j) / BITS) - 1) / (4 * _N * _N))


def most_bits(percent: int) -> int:
    """The differing bits of a pair whose estimate is DEVIATIONS standard deviations below the threshold."""
    least = percent / 100 - DEVIATIONS * deviation(percent / 100)
    return max(x for x in range(BITS // 2) if estimate(x) >= least)


def minhashes(items: np.ndarray) -> np.ndarray:
    out = np.full(_N, 2**64 - 1, np.uint64)
    for at in range(0, len(items), 2048):
        np.minimum(out, (items[at : at + 2048, None] * _MULTIPLIERS[None, :]).min(axis=0), out=out)
    return out


def bands_and_sketch(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the bands, and the odd sketch as int64 words."""
    mixed = mix64(values ^ _SALTS)
    acc = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        acc = mix64(acc + mixed.reshape(BANDS, ROWS)[:, r])
    bits = np.bincount((mixed >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return acc.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def _digest(items: np.ndarray) -> tuple[int, int]:
    a, b = mix64(items).sum(dtype=np.uint64), mix64(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    lo, hi = mix64(np.array([a, b + np.uint64(len(items))], np.uint64)).view(np.int64)
    return int(lo), int(hi)


_SKETCHED = "rid long, doc_id long, text_hash long, n_shingles long, lo long, hi long, bands array<long>, sketch array<long>"


def sketched(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = pa.list_(pa.int64())
        for batch in batches:
            n, lo, hi, bands, sketches = [], [], [], [], []
            for text in batch.column("text"):
                items = shingle_set((text.as_py() or "").encode("utf-8", "surrogatepass"), width)
                a, b = _digest(items)
                n.append(len(items))
                lo.append(a)
                hi.append(b)
                keys, sketch = bands_and_sketch(minhashes(items)) if len(items) else (None, None)
                bands.append(keys)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(bands, many), pa.array(sketches, many)],
                ["rid", "doc_id", "text_hash", "n_shingles", "lo", "hi", "bands", "sketch"],
            )

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, _SKETCHED)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, sets = [], [], []
            for text in batch.column("text"):
                items = shingle_set((text.as_py() or "").encode("utf-8", "surrogatepass"), width)
                a, b = _digest(items)
                lo.append(a)
                hi.append(b)
                sets.append(items.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["lo", "hi", "items"])

    return docs.select("text").mapInArrow(run, "lo long, hi long, items array<long>")


def _differing(a: str, b: str) -> Column:
    parts = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, sets_of_u: DataFrame | None = None) -> DataFrame:
    """The pairs (u, v) of classes that are links: sizes and estimates first, then full sets. A u with
    many partners is dealt out."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    pairs = scratch.save(pairs, "pairs")
    likely = (
        joined(pairs, side("u"), ["u"], "v", scratch).join(side("v"), "v")
        .where((F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent) & (_differing("s_u", "s_v") <= most_bits(percent)))
        .select("u", "v")
    )
    likely = scratch.save(likely, "likely")
    scratch.drop(pairs)
    items = lambda c: (sets if sets_of_u is None or c == "v" else sets_of_u).select(F.col("cid").alias(c), F.col("items").alias(f"i_{c}"))
    both = F.size(F.array_intersect("i_u", "i_v"))
    return (
        joined(likely.join(items("v"), "v"), items("u"), ["u"], "v", scratch, sizes=likely.groupBy("u").agg(F.count(F.lit(1)).alias("n")))
        .select("u", "v", both.alias("both"), (F.size("i_u") + F.size("i_v")).alias("sum"))
        .where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent)
        .select("u", "v")
    )


def _merge(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (cid, comp) after the links (u, v) between classes."""
    if labels is not None:
        for c in ("u", "v"):
            links = links.join(labels.select(F.col("cid").alias(c), F.col("comp").alias(f"{c}_")), c, "left").withColumn(c, F.coalesce(f"{c}_", c)).drop(f"{c}_")
        links = links.select("u", "v")
    roots = connected_components(links, scratch).select(F.col("node").alias("cid"), F.col("root").alias("comp"))
    if labels is None:
        return scratch.save(roots, "labels")
    moved = labels.join(roots.select(F.col("cid").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("cid", F.coalesce("to", "comp").alias("comp"))
    new = roots.join(labels.select("cid"), "cid", "left_anti")
    return scratch.save(moved.unionByName(new), "labels")


def _open_buckets(buckets: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (key, cid, comp) of the buckets of three or more classes that hold several components."""
    rows = buckets.where("n > 2").select("key", "cid").join(labels, "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"))
    rows = scratch.save(rows, "labelled")
    several = scratch.save(rows.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("n")).where("a != b").select("key", "n"), "several")
    return joined(rows, several.select("key"), ["key"], "cid", scratch, "left_semi", several)


def _columns(g: pd.DataFrame) -> dict[str, np.ndarray]:
    return {
        "cid": g["cid"].to_numpy(np.int64), "comp": g["comp"].to_numpy(np.int64), "n": g["n_shingles"].to_numpy(np.int64),
        "bands": np.stack(g["bands"].to_numpy()).astype(np.int64), "sketch": np.stack(g["sketch"].to_numpy()).astype(np.int64).view(np.uint64),
    }


def _sides(g: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    same = bool(g["block"].iloc[0] == g["block2"].iloc[0])
    return (g, g, True) if same else (g[g["side"] == 0], g[g["side"] == 1], False)


def _candidates(left: dict, right: dict, same: bool, key: int, percent: int) -> np.ndarray:
    """Which pairs of two blocks are across components, of like size and sketch, and meet in this
    bucket first (a pair that shares several bands is looked at once)."""
    most = most_bits(percent)
    out = np.zeros((len(left["cid"]), len(right["cid"])), bool)
    for i in range(len(out)):
        ok = (right["comp"] != left["comp"][i]) & (np.minimum(right["n"], left["n"][i]) * 100 >= np.maximum(right["n"], left["n"][i]) * percent)
        if same:
            ok &= right["cid"] > left["cid"][i]
        at = np.flatnonzero(ok)
        at = at[np.bitwise_count(right["sketch"][at] ^ left["sketch"][i]).sum(axis=1) <= most]
        shared = right["bands"][at] == left["bands"][i]
        out[i, at[left["bands"][i][shared.argmax(axis=1)] == key]] = True
    return out


def _links(left: list[np.ndarray], right: list[np.ndarray], likely: np.ndarray, percent: int, slab: int = 1 << 15) -> np.ndarray:
    """Which likely pairs of sets are links. Items that stand in one set only are counted out; the
    others become bitmaps, slab by slab, and intersections population counts."""
    sizes = np.array([len(x) for x in left + right])
    items, at = np.unique(np.concatenate(left + right), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    common = np.bincount(at, minlength=len(items)) > 1
    keep = common[at]
    row, at = row[keep], (np.cumsum(common) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    pairs = [(i, np.flatnonzero(likely[i])) for i in np.flatnonzero(likely.any(axis=1))]
    both = [np.zeros(len(j), np.int64) for _, j in pairs]
    for lo in range(0, int(common.sum()), slab):
        a, b = np.searchsorted(at, [lo, lo + slab])
        bits = np.zeros((len(sizes), slab), bool)
        bits[row[a:b], at[a:b] - lo] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for (i, j), n in zip(pairs, both, strict=True):
            n += np.bitwise_count(words[len(left) + j] & words[i]).sum(axis=1, dtype=np.int64)
    out = np.zeros_like(likely)
    for (i, j), n in zip(pairs, both, strict=True):
        out[i, j] = n * 100 >= (sizes[i] + sizes[len(left) + j] - n) * percent
    return out


def _spanning(us: np.ndarray, vs: np.ndarray) -> tuple[list[int], list[int]]:
    """The pairs that still join something: never more than there are classes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out_u, out_v = [], []
    for u, v in zip(us.tolist(), vs.tolist(), strict=True):
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            out_u.append(u)
            out_v.append(v)
    return out_u, out_v


def _rest(rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) that join all components joined by any pair that shares a bucket.

    A bucket's rows are numbered and cut into blocks; two blocks meet unless both lie in one and the
    same component. Sketches tell, row by row, which classes have a likely partner; only these come
    again with their full sets, and what leaves a meeting is at most one link a class.
    """
    ordered = rows.withColumn("one", F.lit(1))
    ordered = prefix_sum(ordered, ["key"], F.pmod(F.xxhash64("comp"), F.lit(n_buckets(rows.count(), BLOCK))), ["comp", "cid"], "one", "at")
    blocks = ordered.select("key", "cid", "comp", F.expr(f"at div {BLOCK}").alias("block"))
    spans = blocks.groupBy("key", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    other = spans.select("key", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = spans.join(other, "key").where((F.col("block") <= F.col("block2")) & ~((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2"))))
    meet = scratch.save(meet.select("key", "block", "block2"), "meet")
    one = blocks.join(meet, ["key", "block"]).select("key", "block", "block2", "cid", "comp", F.lit(0).alias("side"))
    two = blocks.withColumnRenamed("block", "block2").join(meet.where("block != block2"), ["key", "block2"]).select("key", "block", "block2", "cid", "comp", F.lit(1).alias("side"))
    seen = classes.select("cid", "n_shingles", "bands", "sketch")
    names = ["key", "block", "block2", "cid", "comp", "side"]

    def mark(g: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(g)
        if left.empty or right.empty:
            return g.iloc[:0][names]
        likely = _candidates(_columns(left), _columns(right), same, g["key"].iloc[0], percent)
        rows_, cols = likely.any(axis=1), likely.any(axis=0)
        return left[rows_ | cols][names] if same else pd.concat([left[rows_], right[cols]])[names]

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(g)
        if left.empty or right.empty:
            return pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
        a, b = _columns(left), _columns(right)
        likely = _candidates(a, b, same, g["key"].iloc[0], percent)
        i, j = np.nonzero(_links(list(left["items"]), list(right["items"]), likely, percent))
        u, v = _spanning(a["cid"][i], b["cid"][j])
        return pd.DataFrame({"u": u, "v": v}, dtype=np.int64)

    group = ["key", "block", "block2"]
    # few bytes, much work: not to be coalesced
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-meet.count() // MEETINGS_PER_TASK))
    likely = one.unionByName(two).join(seen, "cid").repartition(parts, *group).groupBy(*group).applyInPandas(mark, "key long, block long, block2 long, cid long, comp long, side int")
    again = likely.join(seen, "cid").join(sets, "cid").repartition(parts, *group)
    return again.groupBy(*group).applyInPandas(settle, "u long, v long").distinct()


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """rid, doc_id, text_hash, n_shingles, comp, component_id for every document (comp: a row id of the
    component, null without words)."""
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 0.8 and more")
    spark = docs.sparkSession
    on_workers(spark)
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = scratch.save(sketched(docs, width), "sketched")
    sets_of = seen.groupBy("lo", "hi").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    sets_of = scratch.save(sets_of, "sets_of")
    filled = seen.where("n_shingles > 0")
    classes = scratch.save(filled.join(sets_of, (filled["rid"] == sets_of["cid"])).select("cid", "least", filled["lo"], filled["hi"], "n_shingles", "bands", "sketch"), "classes")
    dealt = classes.select("cid", F.explode("bands").alias("key"))
    heads = dealt.groupBy("key").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = scratch.save(heads, "heads")
    buckets = scratch.save(joined(dealt, heads, ["key"], "cid", scratch, sizes=heads), "buckets")

    # full sets of every class that shares a bucket
    wanted = classes.join(buckets.select("cid").distinct(), "cid", "left_semi").select("cid", "least", "lo", "hi")
    id_key, id_null = F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null")
    ids = wanted.select(F.coalesce("least", F.lit(0)).alias("_id"), F.col("least").isNull().alias("_null")).distinct()
    texts = docs.select(id_key, id_null, "text").join(ids, ["_id", "_null"], "left_semi")
    sets = full_sets(texts, width).join(wanted.select("cid", "lo", "hi"), ["lo", "hi"]).select("cid", "items").dropDuplicates(["cid"])
    sets = scratch.save(sets, "sets")

    start = scratch.mark()
    pairs = buckets.where("cid != head").select(F.col("head").alias("u"), F.col("cid").alias("v")).distinct()
    labels = _merge(None, verified(pairs, classes, sets, percent, scratch), scratch)
    scratch.drop_since(start, labels)
    release_shuffles(spark)
    for k in range(ROUNDS_OF_HEADS + 1):
        start, before = scratch.mark(), labels
        rows = scratch.save(_open_buckets(buckets, labels, scratch), "open")
        by_comp = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
        left, n = by_comp.groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("q")).agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2), F.sum("n")).first()
        if not n:
            break
        if left <= 2 * n or k == ROUNDS_OF_HEADS:  # few pairs are left: all of them, exactly
            labels = _merge(labels, _rest(rows, classes, sets, percent, scratch), scratch)
            scratch.drop_since(start, labels)
            break
        order = F.xxhash64(F.lit(k), "cid")
        head = rows.groupBy("key").agg(F.min(F.struct(order.alias("h"), F.col("cid").alias("u"), F.col("comp").alias("c"))).alias("t"), F.count(F.lit(1)).alias("n"))
        head = scratch.save(head.select("key", "t.u", "t.c", "n"), "heads")
        pairs = joined(rows, head.drop("n"), ["key"], "cid", scratch, sizes=head).where("comp != c").select("u", F.col("cid").alias("v")).distinct()
        # the heads of large buckets are few: stored by themselves, Spark knows whether they can be broadcast
        of_heads = scratch.save(sets.join(head.select(F.col("u").alias("cid")).distinct(), "cid", "left_semi"), "head_sets")
        labels = _merge(labels, verified(pairs, classes, sets, percent, scratch, of_heads), scratch)
        scratch.drop(before)
        scratch.drop_since(start, labels)
        release_shuffles(spark)

    scratch.drop(sets, buckets)
    release_shuffles(spark)
    comp_of = classes.select("cid", "least").join(labels, "cid", "left").select("cid", "least", F.coalesce("comp", "cid").alias("comp"))
    named = comp_of.join(comp_of.groupBy("comp").agg(F.min("least").alias("component_id")), "comp")
    by_set = classes.select("cid", "lo", "hi").join(named.select("cid", "comp", "component_id"), "cid").select("lo", "hi", "comp", "component_id")
    rows = seen.select("rid", "doc_id", "text_hash", "n_shingles", "lo", "hi")
    found = joined(rows, scratch.save(by_set, "by_set"), ["lo", "hi"], "rid", scratch, "left", sets_of)
    return found.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))).drop("lo", "hi")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; a link is a pair whose sets of
    ``width``-word shingles have 100 x intersection >= percent x union. percent is at least 80."""
    found = _components(docs, width, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The given rows, all columns, without near duplicates. Of each component exactly one row stays, the
    one of the least doc_id (null last); rows without words all stay."""
    found = Scratch(docs.sparkSession, "keep").save(_components(docs, width, percent), "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("t")
    names = ["_id", "_null", "_hash"]
    key = lambda d, h: [F.coalesce(d, F.lit(0)).alias("_id"), d.isNull().alias("_null"), h.alias("_hash")]
    kept = found.where("comp IS NOT NULL").groupBy("comp").agg(first).select(*key(F.col("t.doc_id"), F.col("t.text_hash")))
    wordless = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = docs.where(~wordless).select("*", *key(F.col("doc_id").cast("long"), F.xxhash64("text")))
    # rows equal in doc_id and text can't be told apart by a join: folded where the join has put them
    one = rows.join(kept, names, "left_semi").dropDuplicates(names).select(docs.columns)
    return one.unionByName(docs.where(wordless))
