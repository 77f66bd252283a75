"""Preference formatting: shared prompt and paired, masked completions.

A pair is two conversations (arrays of turns). Their longest common turn
prefix is rendered once as the prompt; the rest of each is its completion,
with the character spans a trainer may learn from (assistant turns) as a mask.

``conversations`` gathers the turns of a conversation into one row, since a
conversation is one training record; groups of conversations are never
gathered. ``preference_pairs`` derives pairs from plain conversations:

* ``sibling``: conversations with the same opening turn. The one with the
  longest assistant text (ties: smallest id) is chosen against each other one.
  Groups meet through one aggregated row, so a group of n gives n - 1 pairs.
* ``stale``: a conversation with two assistant turns or more is chosen against
  itself cut at its last assistant turn, which repeats the one before.

Defined results: a null text is rendered as empty, a null role as ``unknown``;
repeated rows count once; turns are ordered by (turn, role, text) with nulls
first; rows without a conversation id are no conversation and are left out;
completions may be empty when one conversation is a prefix of the other; empty
tables give no pairs; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def render(turn: Column) -> Column:
    """One turn as text: <|role|>, the text, <|end|>."""
    return F.concat(F.lit(TEMPLATE[0]), turn["role"], F.lit(TEMPLATE[1]), turn["text"], F.lit(TEMPLATE[2]))


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation id: its turns in order."""
    t = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return t.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))


def _talk(turns: Column) -> Column:
    return F.filter(turns, lambda t: t["role"] == "assistant")


def sibling_pairs(convs: DataFrame) -> DataFrame:
    """Chosen against each other conversation with the same opening turn."""
    opening = F.sha2(F.concat_ws("\u0000", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256)
    said = F.aggregate(_talk(F.col("turns")), F.lit(0).cast("bigint"), lambda a, t: a + F.length(t["text"]))
    c = convs.select("conv_id", "turns", opening.alias("opening"), said.alias("said"))
    # Fixed-width buffers, combined before the shuffle: only one row per group and task meets.
    best = (c.groupBy("opening").agg(F.max(F.struct("said", (-F.col("conv_id")).alias("neg"))).alias("b"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("opening", (-F.col("b.neg")).alias("chosen_id")))
    best = best.join(convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id")
    return (c.join(best, "opening").where(F.col("conv_id") != F.col("chosen_id"))
             .select(F.lit("sibling").alias("kind"), "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen",
                     F.col("turns").alias("rejected")))


def stale_pairs(convs: DataFrame) -> DataFrame:
    """A conversation up to its last answer, against itself with the previous answer repeated."""
    turns = F.col("turns")
    last = F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i).otherwise(-1)))
    talk = _talk(turns)
    stale = F.struct(turns[F.col("last")]["turn"].alias("turn"), F.lit("assistant").alias("role"),
                     F.element_at(talk, -2)["text"].alias("text"))
    return (convs.where(F.size(talk) >= 2).withColumn("last", last)
                 .select(F.lit("stale").alias("kind"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
                         F.slice(turns, F.lit(1), F.col("last") + 1).alias("chosen"),
                         F.concat(F.slice(turns, F.lit(1), F.col("last")), F.array(stale)).alias("rejected")))


def preference_pairs(turns: DataFrame) -> DataFrame:
    convs = conversations(turns)
    return sibling_pairs(convs).unionByName(stale_pairs(convs))


def _spans(turns: Column) -> Column:
    """'start:end' of each assistant text in the rendered turns, code points, end exclusive."""
    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["role"]) + len(TEMPLATE[0]) + len(TEMPLATE[1])
        end = begin + F.length(t["text"])
        mark = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + len(TEMPLATE[2])).cast("int").alias("at"), F.when(
            t["role"] == "assistant", F.concat(acc["spans"], F.array(mark))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, zero, step)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Adds prompt, completions, masks and the number of shared turns.

    Turns are shared while role and text are equal, one by one from the first.
    """
    differ = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(
        (a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))), False)
    shared = F.when(differ > 0, differ - 1).otherwise(F.least(F.size("chosen"), F.size("rejected"))).cast("int")
    p = pairs.withColumn("n_shared", shared)
    text = lambda turns: F.array_join(F.transform(turns, render), "")

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n_shared") + 1, F.size(side) + 1)

    return p.select(*[c for c in pairs.columns if c not in ("chosen", "rejected")], "n_shared",
                    text(F.slice("chosen", F.lit(1), F.col("n_shared"))).alias("prompt"),
                    let(rest("chosen"), text).alias("chosen"), F.array_join(let(rest("chosen"), _spans), ",").alias("chosen_mask"),
                    let(rest("rejected"), text).alias("rejected"), F.array_join(let(rest("rejected"), _spans), ",").alias("rejected_mask"))


def op10(turns: DataFrame) -> DataFrame:
    return format_pairs(preference_pairs(turns))
