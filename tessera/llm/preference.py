"""Preference formatting: the common turns of two conversations become one prompt, the rest paired, masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running

HEAD, BODY, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"


def render(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(turn["role"], F.lit("")), F.lit(BODY), F.coalesce(turn["text"], F.lit("")), F.lit(TAIL))


def _spans(turns: Column, trained: str) -> Column:
    """Character spans from-to of the trained role's texts and their ends, in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, turn: Column) -> Column:
        begin = acc["at"] + F.lit(len(HEAD) + len(BODY)) + F.length(F.coalesce(turn["role"], F.lit("")))
        end = acc["at"] + F.length(render(turn))
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        own = F.coalesce(turn["role"] == F.lit(trained), F.lit(False))
        return F.struct(end.alias("at"), F.when(own, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, add)["spans"], ",")


def format_preferences(turns: DataFrame, pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per pair: chosen_id, rejected_id, n_common, prompt, chosen, rejected and the masks of both completions.

    turns(conv_id, turn, role, text) are ordered by turn, role and text (nulls first). Two turns are equal when role and text
    are, null equal to null. A mask lists the spans "from-to" of characters to train on: the texts of `trained` turns with
    their end mark. Equal conversations have empty completions; a null or unknown id has no turns. A pair without a rejected
    side (null id) has no common turns. Turns with a null conv_id belong to no conversation. Repeated pairs stay repeated.
    Turns of any length are rendered whole; other columns are ignored; without pairs there are no rows.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    side = lambda name: whole.select(F.col("conv_id").alias(f"{name}_id"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(f"{name}_turns"))
    both = pairs.select("chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")
    empty = F.array().cast("array<struct<role:string,text:string>>")
    for name in ("chosen", "rejected"):
        both = both.withColumn(f"{name}_turns", F.coalesce(f"{name}_turns", empty))
    same = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: F.coalesce(a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]), F.lit(False)))
    differ = F.array_position(same, F.lit(False)).cast("int")
    both = both.withColumn("n_common", F.when(differ == 0, F.size("chosen_turns")).otherwise(differ - 1))
    rest = lambda name: F.slice(f"{name}_turns", F.col("n_common") + 1, F.size(f"{name}_turns"))
    text = lambda part: F.array_join(F.transform(part, render), "")
    return both.select(
        "chosen_id", "rejected_id", "n_common", text(F.slice("chosen_turns", 1, F.col("n_common"))).alias("prompt"),
        text(rest("chosen")).alias("chosen"), text(rest("rejected")).alias("rejected"),
        _spans(rest("chosen"), trained).alias("chosen_mask"), _spans(rest("rejected"), trained).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): conversations in order of first role, first text and id, paired two by two.

    Conversations that begin alike stand together, so that they share prompts. The last of an odd number has no rejected side.
    """
    first = F.min(F.struct("turn", "role", "text")).alias("t")
    heads = turns.where("conv_id is not null").groupBy("conv_id").agg(first).select("conv_id", F.col("t.role").alias("role"), F.col("t.text").alias("text"))
    ranked = running(heads, ["role", "text", "conv_id"], {"rank": None})
    pair = F.floor(F.col("rank") / 2).alias("pair")
    even = F.col("rank") % 2 == 0
    return (
        ranked.groupBy(pair).agg(F.max(F.when(even, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(~even, F.col("conv_id"))).alias("rejected_id"))
        .select("chosen_id", "rejected_id")
    )
