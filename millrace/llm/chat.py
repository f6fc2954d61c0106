"""Preference formatting: one prompt and two masked completions from a pair of conversations.

The prompt is the longest common prefix of turns (equal role and text) of the chosen and the
rejected conversation, rendered once. What follows on each side is that side's completion; its
mask names the spans (start:end, code points, end exclusive) that carry loss: assistant turns.
Turns are compared and rendered as rows; a group is never larger than one conversation pair.

Defined cases: null role is ``user``, null text is empty; turns without conv_id belong to no
conversation and give no row; turns of equal number (or without one, which come last) keep the order
of role and text, and repeated rows are turns of their own; a pair with one side only has an empty
other completion and complete = false; very long texts are rendered whole, and a pair, being one row
of the result, is made by one task; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def pair_by_parity(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected side of pair k."""
    c = conversations.where("conv_id IS NOT NULL")
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")
    return c.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), side.alias("side"), "turn", "role", "text")


def pair_by_reply(conversations: DataFrame) -> DataFrame:
    """Every conversation c is the chosen side of pair c. Its rejected side is what comes before its last
    assistant turn, then the last assistant turn of its neighbour (2k and 2k + 1 are neighbours): a
    reply that was written for another prompt. Without a neighbour's reply nothing follows."""
    c = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    key = F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "text")
    last = F.max(F.when(F.col("role") == TRAINED, key)).over(Window.partitionBy("conv_id"))
    sides = F.when(F.col("last").isNull() | F.coalesce(key < F.col("last"), F.lit(False)), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen")))
    own = c.withColumn("last", last).select(F.col("conv_id").alias("pair_id"), F.explode(sides).alias("side"), "turn", "role", "text")
    reply = c.where(F.col("role") == TRAINED).groupBy(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("pair_id")).agg(F.max(key).alias("last"))
    reply = reply.join(c.select(F.col("conv_id").alias("pair_id")).distinct(), "pair_id", "left_semi")  # neighbours that have turns
    return own.unionByName(reply.select("pair_id", F.lit("rejected").alias("side"), F.lit(None).cast("long").alias("turn"), F.col("last.role").alias("role"), F.col("last.text").alias("text")))


def _joined(what: Column, order: str, separator: str = "") -> Column:
    rows = F.array_sort(F.collect_list(F.when(what.isNotNull(), F.struct(F.col(order).alias("o"), what.alias("x")))))
    return F.array_join(F.transform(rows, lambda r: r["x"]), separator)


def format_preferences(turns: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, complete
    from turns (pair_id, side, turn, role, text)."""
    own = Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    t = turns.select("pair_id", "side", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("pos", F.row_number().over(own))
    same = (F.count(F.lit(1)) == 2) & (F.min(F.struct("role", "text")) == F.max(F.struct("role", "text")))
    place = t.groupBy("pair_id", "pos").agg(same.alias("same"))
    lcp = place.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(~F.col("same"), F.col("pos"))) - 1, F.max("pos")).cast("long").alias("n_prompt_turns")
    )
    body = F.concat(F.col("text"), F.lit(END))
    t = t.join(lcp, "pair_id").withColumn("after", F.col("pos") > F.col("n_prompt_turns"))
    t = t.withColumn("seg", F.concat(F.lit(BEGIN), "role", F.lit(MIDDLE), body))
    run = Window.partitionBy("pair_id", "side", "after").orderBy("pos")
    t = t.withColumn("end", F.sum(F.length("seg")).over(run))
    trained = F.when(F.col("after") & (F.col("role") == TRAINED), F.concat_ws(":", F.col("end") - F.length(body), "end"))

    def of(side: str) -> Column:
        return F.col("after") & (F.col("side") == side)

    out = t.groupBy("pair_id", "n_prompt_turns").agg(
        F.max((F.col("side") == "chosen").cast("int")).alias("_c"),
        F.max((F.col("side") == "rejected").cast("int")).alias("_r"),
        _joined(F.when(~F.col("after") & (F.col("side") == "chosen"), F.col("seg")), "pos").alias("prompt"),
        *[_joined(F.when(of(s), F.col("seg")), "pos").alias(s) for s in ("chosen", "rejected")],
        *[_joined(F.when(of(s), trained), "pos", ",").alias(f"{s}_mask") for s in ("chosen", "rejected")],
    )
    return out.select(
        "pair_id", "n_prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask", ((F.col("_c") == 1) & (F.col("_r") == 1)).alias("complete")
    )
