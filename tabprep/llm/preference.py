"""Preference pairs for training: a shared prompt and two completions with their loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: _rendered(t["role"], t["text"])), "")


def _mask(turns: Column, role: str) -> Column:
    """Spans ``from-to`` of the characters that are trained on: texts of ``role`` with the line break that ends them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(done, t):
        head = done["at"] + F.length(t["role"]) + 5
        end = head + F.length(t["text"]) + 1
        span = F.concat(head.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, add)["spans"], ";")


def preference_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side", role: str = "assistant") -> DataFrame:
    """One row per pair from turns (pair, side ``chosen`` or ``rejected``, turn, role, text).

    Turns of a side are ordered by turn, then role and text; null roles and texts are empty, a null turn comes first.
    The longest common prefix (same roles and texts) is rendered once as ``prompt``; what follows on each side is its
    completion, with the spans of ``role`` in it as mask. A side without turns, or equal sides, have an empty
    completion. Repeated turns stay. One aggregation by pair; a row holds the turns of one pair.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    ordered = turns.groupBy(F.col(pair).alias("pair_id")).agg(
        *[F.array_sort(F.collect_list(F.when(F.col(side) == s, turn))).alias(s) for s in ("chosen", "rejected")]
    )
    same = F.zip_with(
        "chosen", "rejected",
        lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)),
    )
    differs = F.array_position(F.col("_same"), F.lit(False))
    parted = ordered.withColumn("_same", same).withColumn(
        "n_common", F.when(differs > 0, differs - 1).otherwise(F.size("_same")).cast("long")
    )
    rest = {s: F.slice(F.col(s), F.col("n_common").cast("int") + 1, F.greatest(F.size(s), F.lit(1))) for s in ("chosen", "rejected")}
    return parted.select(
        "pair_id", "n_common", _text(F.slice("chosen", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"),
        _text(rest["chosen"]).alias("chosen"), _mask(rest["chosen"], role).alias("chosen_mask"),
        _text(rest["rejected"]).alias("rejected"), _mask(rest["rejected"], role).alias("rejected_mask"),
    )


def own_reply_pairs(conversations: DataFrame) -> DataFrame:
    """Preference turns from plain conversations: rejected is the same conversation with an earlier reply at its end.

    Chosen are the turns up to the last assistant turn; in rejected the text of that turn is the one of the assistant
    turn before it (empty if there is none). A conversation without assistant turns is the same on both sides. Repeated
    turns stay, null texts stay null, an empty table gives no rows; columns other than conv_id, turn, role and text
    take no part, whatever their names.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    reply = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    last = conversations.groupBy(F.col("conv_id").alias("_id")).agg(F.slice(F.reverse(F.array_sort(F.collect_list(reply))), 1, 2).alias("_last"))
    joined = conversations.join(last, F.col("conv_id").eqNullSafe(F.col("_id")))
    end, before = F.get("_last", F.lit(0)), F.get("_last", F.lit(1))
    kept = joined.filter(F.col("_last").isNull() | end.isNull() | (F.col("turn") <= end["turn"]) | F.col("turn").isNull())
    is_end = (F.col("turn") == end["turn"]) & (F.col("role") == "assistant")
    sides = F.explode(F.array(F.lit("chosen"), F.lit("rejected"))).alias("side")
    both = kept.select(F.col("conv_id").alias("pair_id"), sides, "turn", "role", "text", is_end.alias("_end"), F.coalesce(before["text"], F.lit("")).alias("_other"))
    text = F.when((F.col("side") == "rejected") & F.col("_end"), F.col("_other")).otherwise(F.col("text"))
    return both.select("pair_id", "side", "turn", "role", text.alias("text"))
