"""Sequence operators on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.catalog import query
from siftmill.catalog import views as V
from siftmill.operators import turns

TURNS = f"""{V.CHATS}, turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
    lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM chats)"""
PAIRS = f"""{TURNS}, turn_pairs AS (
  SELECT conv_id, CAST(floor(place / 2) + 1 AS BIGINT) AS turn_id, language, model, text AS input,
    next_text AS output FROM turns WHERE role = 'user' AND next_role = 'assistant')"""


@query(
    "c01_turn_pairs",
    f"WITH {PAIRS} SELECT conv_id, turn_id, md5(input) AS input, md5(output) AS output FROM turn_pairs",
)
def c01_turn_pairs(spark, d):
    pairs = turns.turn_pairs(V.chats(spark, d))
    return pairs.select(
        "conv_id", "turn_id", F.md5("input").alias("input"), F.md5("output").alias("output")
    )


@query(
    "c02_first_user",
    f"""WITH {V.CHATS}, u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id
      ORDER BY turn) AS r FROM chats WHERE role = 'user')
    SELECT conv_id, md5(text) AS text FROM u WHERE r = 1 AND length(text) > 0""",
)
def c02_first_user(spark, d):
    return turns.first_user(V.chats(spark, d)).select("conv_id", F.md5("text").alias("text"))


@query(
    "c03_user_turns",
    f"""WITH {TURNS} SELECT conv_id || '_' || place AS id, md5(text) AS text FROM turns
    WHERE role = 'user' AND length({V.strip_sql('text')}) > 5""",
)
def c03_user_turns(spark, d):
    return turns.user_turns(V.chats(spark, d)).select("id", F.md5("text").alias("text"))


@query(
    "c04_first_conversations",
    f"""WITH {PAIRS} SELECT conv_id, turn_id FROM turn_pairs WHERE conv_id IN
    (SELECT DISTINCT conv_id FROM turn_pairs ORDER BY conv_id LIMIT 40)""",
)
def c04_first_conversations(spark, d):
    pairs = turns.turn_pairs(V.chats(spark, d))
    return turns.of_first_conversations(pairs, 40).select("conv_id", "turn_id")


@query(
    "c05_chat_chunks",
    f"""WITH {PAIRS}, {V.chunks_sql('turn_pairs', 'conv_id, turn_id, language, model, output', 'input')}
    SELECT conv_id, turn_id, language, model, chunk_id, chunk AS input, tokens AS input_tokens,
      md5(output) AS output FROM chunks""",
)
def c05_chat_chunks(spark, d):
    pairs = turns.turn_pairs(V.chats(spark, d), carry=["language", "model"])
    return turns.chat_chunks(pairs).select(
        "conv_id", "turn_id", "language", "model", V.long(F.col("chunk_id")).alias("chunk_id"), "input",
        V.long(F.col("input_tokens")).alias("input_tokens"), F.md5("output").alias("output"),
    )
