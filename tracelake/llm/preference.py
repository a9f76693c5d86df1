"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

For each pair the longest common prefix of turns (same role and text) is
rendered once as the prompt.  What follows in either conversation is rendered as
its completion, with a mask: the spans of the completion, in code points, that
are trained on (what an assistant says, and its end mark).  The prompt and
everything else is masked out.

A turn is rendered as ``<|im_start|>role`` line feed, text, ``<|im_end|>`` line
feed.

Turns are gathered by conversation, which bounds a group by the length of one
conversation; a conversation that very many pairs name is joined to them, not
grouped.

Defined cases: null roles and texts are empty; turns of one number are ordered
by role and text, turns without number or conversation are left out; a
conversation without turns, or that a pair doesn't name, is empty; pairs whose
completions are equal or where one says nothing are not ``usable`` but stay; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(f"{CLOSE}\n"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    return numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))


def common(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two conversations."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs == 0, shorter).otherwise(differs - 1).cast("int")


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask_of(turns: Column) -> Column:
    """start:end of each trained span of the rendered turns, comma-joined."""
    opening = lambda t: F.char_length(t["role"]) + len(OPEN) + 1

    def walk(state: Column, t: Column) -> Column:
        start = state["at"] + opening(t)
        end = start + F.char_length(t["text"]) + len(CLOSE)
        span = F.when(t["role"] == TRAINED, F.array(F.concat_ws(":", start, end))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(state["spans"], span).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, walk, lambda s: F.array_join(s["spans"], ","))


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair (pair_id, chosen_id, rejected_id): prompt, completions, masks and ``usable``."""
    convs = conversations(turns.select("conv_id", "turn", "role", "text"))
    none = F.array().cast(TURNS)
    sides = pairs.select("pair_id", "chosen_id", "rejected_id")
    for side in ("chosen", "rejected"):
        gathered = convs.select(F.col("conv_id").alias(f"{side}_id"), F.col("turns").cast(TURNS).alias(f"_{side}"))
        sides = sides.join(gathered, f"{side}_id", "left").withColumn(f"_{side}", F.coalesce(f"_{side}", none))
    n = common(F.col("_chosen"), F.col("_rejected"))
    cut_at = sides.withColumn("n_common", n)
    rest = lambda side: F.slice(F.col(side), F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    parts = cut_at.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_common").cast("long"), text_of(F.slice("_chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        rest("_chosen").alias("_c"), rest("_rejected").alias("_r"),
    )
    out = parts.select(
        "pair_id", "chosen_id", "rejected_id", "n_common", "prompt",
        text_of(F.col("_c")).alias("chosen"), mask_of(F.col("_c")).alias("chosen_mask"),
        text_of(F.col("_r")).alias("rejected"), mask_of(F.col("_r")).alias("rejected_mask"),
    )
    usable = (F.col("chosen_mask") != "") & (F.col("rejected_mask") != "") & (F.col("chosen") != F.col("rejected"))
    return out.withColumn("usable", usable)


def neighbouring_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected), for tables that name no pairs."""
    ids = turns.where(F.col("conv_id").isNotNull()).select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id")).distinct()
    return ids.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
