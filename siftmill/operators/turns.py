"""Conversations in long form: (conv_id, turn, role, text) with one row per turn.

Neighbouring turns meet in an equality join on (conversation, place). Both sides are spread
over the whole key, so a conversation of any length is shared by all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.functions import text
from siftmill.operators.filters import chunk_rows, composite_id
from siftmill.operators.ranking import first_rows, positions, row_key
from siftmill.session import durable


def with_place(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Add `place`, the 0-based position of a turn among all turns of its conversation.

    In a conversation whose turn numbers are 0..n-1, each once, the number is the place. The turns
    of all other conversations are counted across ranges; of turns with one number (a missing one
    comes first) the order is that of a hash of their values.
    """
    per = df.groupBy(conv).agg(
        F.min(turn).alias("lo"), F.max(turn).alias("hi"), F.count("*").alias("n"),
        F.count_distinct(turn).alias("kinds"),
    )
    whole = (F.col("lo") == 0) & (F.col("hi") + 1 == F.col("n")) & (F.col("kinds") == F.col("n"))
    odd = durable(per.where(~F.coalesce(whole, F.lit(False))).select(F.col(conv).alias("_conv")))
    if odd.isEmpty():
        return df.withColumn("place", F.col(turn).cast("long"))
    same = F.col(conv).eqNullSafe(F.col("_conv"))
    plain = df.join(odd, same, "left_anti").withColumn("place", F.col(turn).cast("long"))
    uneven = df.join(odd, same, "left_semi").withColumn("_key", row_key(*df.columns))
    placed = positions(uneven, [turn, "_key"], [conv], name="place").drop("_key")
    return plain.unionByName(placed)


def turn_pairs(
    df: DataFrame, conv: str = "conv_id", carry: Sequence[str] = (), placed: bool = False
) -> DataFrame:
    """(conv, turn_id, *carry, input, output): user turns directly followed by the assistant."""
    turns = df if placed else with_place(df, conv)
    asked = turns.where(F.col("role") == "user").select(
        conv, "place", *carry, F.col("text").alias("input")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        conv, (F.col("place") - 1).alias("place"), F.col("text").alias("output")
    )
    return asked.join(answered, [conv, "place"]).select(
        conv, (F.floor(F.col("place") / 2) + 1).alias("turn_id"), *carry, "input", "output"
    )


def first_user(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, text): the first user turn of each conversation, dropped if it is empty."""
    first = df.where(F.col("role") == "user").groupBy(conv).agg(
        F.min_by(F.struct("text"), F.col(turn)).alias("_first")
    )
    return first.select(conv, F.col("_first.text").alias("text")).where(F.length("text") > 0)


def user_turns(df: DataFrame, conv: str = "conv_id", longer: int = 5) -> DataFrame:
    """(id, text): every user turn with more than `longer` characters, named by its place."""
    turns = with_place(df, conv).where(
        (F.col("role") == "user") & (F.length(text.strip(F.col("text"))) > longer)
    )
    return turns.select(composite_id(conv, "place").alias("id"), "text")


def of_first_conversations(pairs: DataFrame, n: int, conv: str = "conv_id") -> DataFrame:
    """The pairs of the first n conversations that hold a pair."""
    wanted = first_rows(pairs.select(conv).distinct(), [conv], n)
    return pairs.join(wanted, conv, "left_semi")


def chat_chunks(pairs: DataFrame, conv: str = "conv_id", **options) -> DataFrame:
    """Chunks of the user text; the answer and all other columns of the pairs are carried along."""
    carried = [c for c in pairs.columns if c not in (conv, "turn_id", "input")]
    return chunk_rows(pairs, "input", [conv, "turn_id", *carried], **options)
