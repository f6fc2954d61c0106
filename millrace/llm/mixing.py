"""Mixing sources to target weights.

Words of each source form one stream, cut into fixed-length blocks. Every output shard draws its
slots' sources from a multinomial; totals are then reconciled to the targets, each source's slots
are numbered over the shards, and slot numbers pass through a per-source, per-epoch pseudorandom
permutation of block indices (swap-or-not, a bijection on any range). Slots and blocks meet in an
equi-join on (source, block). DataFrame and SQL functions only.

Defined cases: a null text has no words; a document without words takes none; a null source is a
source of its own; repeated rows and repeated or null doc_ids are separate documents; ties of the
order of documents are settled by id, text hash and row id; a very long text is counted whole and lies
in many blocks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, WORD, Scratch, n_buckets, prefix_sum

ROUNDS = 24
CELLS = 1024
SHARD_GROUP = 4096
SLOTS_PER_TASK = 100_000


@dataclass(frozen=True)
class Mix:
    """documents: rid, doc_id, skey, size, place (in the source's stream), and the carried columns;
    sources: skey, source, source_size, target, n_blocks, n_slots; pieces: rid, skey, block, at,
    word_from, n_words; slots: shard, skey, ordinal, epoch, block, words."""

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame
    slots: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _swap_or_not(x: Column, n: Column, salt: list[Column], inverse: bool = False) -> Column:
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(acc: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*salt, r), n) - acc, n)
        coin = F.xxhash64(*salt, r, F.greatest(acc, partner), F.lit("coin"))
        return F.when(coin.bitwiseAND(F.lit(1)) == 1, partner).otherwise(acc)

    return F.aggregate(rounds, x.cast("long"), step)


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds ``target``: sources by code point, null last, take weights in turn; targets sum to
    share x all words, none above most x its own, the excess reshared by weight (water level)."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    below = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    want = F.sum("source_size").over(everything) * F.lit(float(share))
    return (
        sources.withColumn("weight", weight)
        .withColumn("_ratio", cap / F.col("weight"))
        .withColumn("_level", (want - below) / left)
        .withColumn("target", F.least(F.col("weight") * F.max("_level").over(everything), cap))
        .drop("_ratio", "_level")
    )


def _in_cells(df: DataFrame, lo: str, hi: str, total: int) -> DataFrame:
    """Cuts [lo, hi) at the borders of CELLS equal cells of [0, total): range matches become equi-joins."""
    width = max(1, -(-total // CELLS))
    return (
        df.where(F.col(hi) > F.col(lo))
        .withColumn("cell", F.explode(F.sequence(F.expr(f"{lo} div {width}"), F.expr(f"({hi} - 1) div {width}"))))
        .withColumn(lo, F.greatest(F.col(lo), F.col("cell") * width))
        .withColumn(hi, F.least(F.col(hi), (F.col("cell") + 1) * width))
    )


def plan_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 256,
    shard_slots: int = 4096,
    seed: int = 17,
    carry: tuple[str, ...] = (),
) -> Mix:
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = scratch.save(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("skey"),
            "source",
            word_count(F.col("text")).alias("size"),
            F.xxhash64("text").alias("text_hash"),
            *carry,
        ),
        "sized",
    )
    n = n_buckets(sized.count())
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash"))
    placed = scratch.save(
        prefix_sum(
            sized.select("rid", "doc_id", "skey", "size", "text_hash").withColumn("_o", order),
            ["skey"], F.pmod("_o", F.lit(n)), ["_o", "doc_id", "text_hash", "rid"], "size", "place",
        ).drop("_o"),
        "placed",
    )

    whole = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = targets(whole, weights, share, most)
    size, b = F.col("source_size"), F.lit(block)
    sources = (
        sources.withColumn("n_blocks", F.ceil(size / b).cast("long"))
        .withColumn("_want", F.least(F.round("target").cast("long"), F.floor(size * F.lit(float(most))).cast("long")))
        .withColumn("_epochs", F.when(size > 0, F.expr("_want div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.col("_want") - F.col("_epochs") * size)
        .withColumn("_last", size - (F.col("n_blocks") - 1) * b)
        .withColumn("_p", F.when(F.col("n_blocks") > 0, _swap_or_not(F.col("n_blocks") - 1, F.col("n_blocks"), [F.lit(seed), F.col("skey"), F.col("_epochs")], inverse=True)).otherwise(F.lit(0)))
    )
    before, rest = F.col("_p") * b, F.col("_rest")
    more = F.ceil((rest - before - F.col("_last")) / b).cast("long")
    slots_left = F.when(rest <= 0, F.lit(0)).when(rest <= before, F.ceil(rest / b)).when(rest <= before + F.col("_last"), F.col("_p") + 1).otherwise(F.col("_p") + 1 + more).cast("long")
    filled = F.when(F.col("_m") - 1 <= F.col("_p"), (F.col("_m") - 1) * b).otherwise((F.col("_m") - 2) * b + F.col("_last"))
    sources = (
        sources.withColumn("_m", slots_left)
        .withColumn("n_slots", F.col("_epochs") * F.col("n_blocks") + F.col("_m"))
        .withColumn("final_words", F.when(F.col("_m") > 0, rest - filled))
    )
    sources = scratch.save(sources.drop("_want", "_epochs", "_rest", "_p", "_m"), "sources")

    total = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    slots = _slots(spark, scratch, sources, total, shard_slots, block, seed)

    pieces = placed.withColumn(
        "block",
        F.explode(
            F.when(F.col("size") > 0, F.sequence(F.expr(f"place div {block}"), F.expr(f"(place + size - 1) div {block}"))).otherwise(F.array(F.lit(-1).cast("long")))
        ),
    )
    lo, hi = F.greatest(F.col("place"), F.col("block") * b), F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * b)
    pieces = pieces.select(
        "rid", "doc_id", "skey", "size", "block",
        F.when(F.col("block") >= 0, lo - F.col("block") * b).otherwise(F.lit(0)).alias("at"),
        F.when(F.col("block") >= 0, lo - F.col("place")).otherwise(F.lit(0)).alias("word_from"),
        F.when(F.col("block") >= 0, hi - lo).otherwise(F.lit(0)).alias("n_words"),
    )
    return Mix(sized, sources, pieces, slots)


def _slots(spark, scratch: Scratch, sources: DataFrame, total: int, shard_slots: int, block: int, seed: int) -> DataFrame:
    # 1. each slot of each shard draws a source; counted by shard, that is one multinomial a shard
    ends = sources.withColumn("_hi", F.sum("n_slots").over(Window.orderBy("skey"))).select("skey", (F.col("_hi") - F.col("n_slots")).alias("_lo"), "_hi")
    width = max(1, -(-total // CELLS))
    drawn = (
        spark.range(total)
        .select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(max(total, 1))).alias("u"))
        .withColumn("cell", F.expr(f"u div {width}"))
        .join(_in_cells(ends, "_lo", "_hi", total), "cell")
        .where((F.col("u") >= F.col("_lo")) & (F.col("u") < F.col("_hi")))
        .groupBy("shard", "skey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    group = F.expr(f"shard div {SHARD_GROUP}")
    # 2. draws beyond a source's total go, in shard order, to the sources that drew too few
    counted = prefix_sum(drawn, ["skey"], group, ["shard"], "n", "c").join(sources.select("skey", "n_slots"), "skey")
    kept = F.least(F.col("n"), F.greatest(F.col("n_slots") - F.col("c"), F.lit(0)))
    counted = scratch.save(counted.select("shard", "skey", kept.alias("keep"), (F.col("n") - kept).alias("over")), "counted")
    short = sources.join(counted.groupBy("skey").agg(F.sum("keep").alias("_k")), "skey", "left").select("skey", (F.col("n_slots") - F.coalesce("_k", F.lit(0))).alias("d"))
    short = short.withColumn("d_hi", F.sum("d").over(Window.orderBy("skey"))).withColumn("d_lo", F.col("d_hi") - F.col("d"))
    spare = counted.groupBy("shard").agg(F.sum("over").alias("x")).withColumn("one", F.lit(0))
    spare = prefix_sum(spare, ["one"], group, ["shard"], "x", "x_lo").withColumn("x_hi", F.col("x_lo") + F.col("x"))
    moved_total = counted.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    moved = (
        _in_cells(spare.select("shard", "x_lo", "x_hi"), "x_lo", "x_hi", moved_total)
        .join(_in_cells(short.select("skey", "d_lo", "d_hi"), "d_lo", "d_hi", moved_total), "cell")
        .select("shard", "skey", (F.least("x_hi", "d_hi") - F.greatest("x_lo", "d_lo")).alias("n"))
        .where("n > 0")
    )
    final = counted.select("shard", "skey", F.col("keep").alias("n")).unionByName(moved).groupBy("shard", "skey").agg(F.sum("n").alias("n")).where("n > 0")
    # 3. number each source's slots over the shards, and permute
    numbered = prefix_sum(final, ["skey"], group, ["shard"], "n", "c")
    last = F.col("ordinal") == F.col("n_slots") - 1
    whole = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("_last")).otherwise(F.lit(block))
    parts = max(1, -(-total // SLOTS_PER_TASK))  # few counts become many slots: dealt before they are spread out
    return (
        numbered.repartition(parts, "shard", "skey").select("shard", "skey", F.explode(F.sequence("c", F.col("c") + F.col("n") - 1)).alias("ordinal"))
        .join(sources.select("skey", "n_blocks", "n_slots", "_last", "final_words"), "skey")
        .withColumn("epoch", F.expr("ordinal div n_blocks"))
        .withColumn("block", _swap_or_not(F.expr("ordinal % n_blocks"), F.col("n_blocks"), [F.lit(seed), F.col("skey"), F.col("epoch")]))
        .select("shard", "skey", "ordinal", "epoch", "block", F.when(last & F.col("final_words").isNotNull(), F.col("final_words")).otherwise(whole).alias("words"))
    )


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: rid, doc_id, size, source_size, target, taken."""
    words = F.greatest(F.least(F.col("n_words"), F.coalesce("words", F.lit(0)) - F.col("at")), F.lit(0))  # least() skips nulls
    taken = (
        mix.pieces.join(mix.slots.select("skey", "block", "words"), ["skey", "block"], "left")
        .groupBy("rid", "doc_id", "skey", "size")
        .agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken"))
    )
    return taken.join(mix.sources.select("skey", "source_size", "target"), "skey").select("rid", "doc_id", "size", "source_size", "target", "taken")


def mixed_pieces(mix: Mix) -> DataFrame:
    """The mixture itself: shard, skey, ordinal, epoch, block, at, rid, doc_id, word_from, n_words
    for every piece of a document in a drawn block, trimmed to the words that the slot takes."""
    words = F.least(F.col("n_words"), F.col("words") - F.col("at"))
    return (
        mix.pieces.where("block >= 0").join(mix.slots, ["skey", "block"])
        .select("shard", "skey", "ordinal", "epoch", "block", "at", "rid", "doc_id", "size", "word_from", words.alias("n_words"))
        .where("n_words > 0")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents as the mixture takes them: for each document and epoch its taken words, the whole
    unchanged text where all are taken, else each run of neighbouring taken blocks as one text.
    Returns the columns doc_id, text, lang, source, n_chars; a document without words isn't mixed."""
    mix = plan_mix(docs, carry=("text", "lang"), **options)
    runs = mixed_pieces(mix).select("rid", "epoch", "size", "word_from", "n_words")
    w = Window.partitionBy("rid", "epoch").orderBy("word_from")
    gap = F.col("word_from") != F.coalesce(F.lag(F.col("word_from") + F.col("n_words")).over(w), F.lit(-1))
    runs = (
        runs.withColumn("_g", F.sum(gap.cast("int")).over(w))
        .groupBy("rid", "epoch", "size", "_g")
        .agg(F.min("word_from").alias("word_from"), F.sum("n_words").alias("n_words"))
        .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("epoch", "word_from", "n_words"))).alias("runs"))  # at most a run a block and epoch
    )
    # a text is cut into words once, whatever is taken of it, and not at all if it is taken whole
    cut = F.when(F.exists("runs", lambda r: r["n_words"] != F.col("size")), F.regexp_extract_all("text", F.lit(f"{SPACE}*{WORD}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    part = lambda words, r: F.regexp_replace(F.array_join(F.slice(words, (r["word_from"] + 1).cast("int"), r["n_words"].cast("int")), ""), f"^{SPACE}+", "")
    texts = F.transform(F.array(cut), lambda words: F.transform("runs", lambda r: F.when(r["n_words"] == F.col("size"), F.col("text")).otherwise(part(words, r))))[0]
    taken = mix.documents.join(runs, "rid").select("doc_id", F.explode(texts).alias("text"), "lang", "source")
    return taken.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
