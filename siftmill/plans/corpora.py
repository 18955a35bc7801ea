"""Preparation of posts, chats and labelled texts into chunk tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.functions import parsing, text
from siftmill.operators import filters, ranking, sampling, turns
from siftmill.session import durable
from siftmill.sources import tables


POST_COLUMNS = ("author", "created_utc", "score", "subreddit", "title")


def post_columns(posts: DataFrame) -> DataFrame:
    """Posts with all of POST_COLUMNS: a score that is no number is 0, a missing author or group
    `unknown`, a missing title empty."""
    kinds = {"author": "string", "created_utc": "double", "score": "string", "subreddit": "string", "title": "string"}
    grown = filters.ensure_columns(posts, kinds)
    return grown.withColumns({
        "author": F.coalesce("author", F.lit("unknown")),
        "score": parsing.to_int(F.col("score")),
        "subreddit": F.coalesce("subreddit", F.lit("unknown")),
        "title": F.coalesce("title", F.lit("")),
    })


def risk_posts(
    posts: DataFrame, key: str = "post_id", body: str = "selftext", order: Sequence[str] = ("post_id",),
    rate: float = 1.0, limit: int | None = None, cap: int = settings.AUTHOR_CAP,
    carry: Sequence[str] = POST_COLUMNS,
) -> DataFrame:
    """Valid bodies, sampled, inside the period, capped per author, in chunks, limited.

    The cheap filters and the cap run on rows before any text is cut. The cap takes posts in
    `order`, which names a post uniquely; the limit takes chunks in the same order.
    """
    kept = filters.valid_body(post_columns(posts), body)
    kept = filters.in_period(sampling.bernoulli(kept, key, rate))
    capped = sampling.author_cap(kept, "author", order, cap)
    keys = list(dict.fromkeys([key, *order, *carry]))
    if limit is None:
        return filters.chunk_rows(capped, body, keys)
    return first_chunks(capped, body, keys, order, limit)


def first_chunks(
    posts: DataFrame, body: str, keys: Sequence[str], order: Sequence[str], limit: int
) -> DataFrame:
    """The first `limit` chunks of the posts in order.

    The cut is found on a slim table of chunk counts; only the posts before it are cut into rows.
    """
    counted = durable(posts.select(*order, F.size(text.chunks(F.col(body))).alias("_n")))
    placed = ranking.sums_before(counted, order, {"_before": F.col("_n").cast("long")})
    chosen = placed.where(F.col("_before") < limit).select(*order, "_before")
    rows = filters.chunk_rows(posts.join(chosen, list(order)), body, [*keys, "_before"])
    return rows.where(F.col("_before") + F.col("chunk_id") <= limit).drop("_before")


def control_posts(
    posts: DataFrame, wanted: Sequence[tuple[str, int]] | DataFrame, key: str = "post_id",
    body: str = "selftext", group: str = "subreddit", order: Sequence[str] = ("post_id",),
    cap: int = settings.AUTHOR_CAP, seed: int = settings.SEED, carry: Sequence[str] = POST_COLUMNS,
) -> DataFrame:
    """Good posts, read group by group until each quota of chunks, capped per author.

    Caps, quotas and the final shuffle work on slim tables of chunk counts and chunk numbers;
    the texts are cut into rows for the kept posts only.
    """
    good = filters.quality_body(filters.in_period(post_columns(posts)), body)
    sized = good.withColumn("_chunks", F.size(text.chunks(text.strip(F.col(body)))))
    slim = durable(sized.select(*dict.fromkeys([key, *order, "author", group, "_chunks"])))
    kept = durable(sampling.cap_and_quota(slim, "author", group, order, "_chunks", wanted, cap))
    numbered = kept.select(key, F.explode(F.sequence(F.lit(1), F.col("_chunks"))).alias("chunk_id"))
    numbered = numbered.withColumn("_id", filters.composite_id(key, "chunk_id"))
    placed = sampling.shuffled(durable(numbered), "_id", seed).drop("_id")
    chosen = good.join(kept.select(key), key, "left_semi")
    rows = filters.chunk_rows(chosen, body, list(dict.fromkeys([key, group, *carry])))
    return rows.join(placed, [key, "chunk_id"])


def quota_table(posts: DataFrame, group: str, **bounds) -> DataFrame:
    """(group, quota): as many rows as there are groups, joined where they are needed."""
    return sampling.quotas(posts, group, **bounds).select(group, "quota")


def chat_pairs(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """All user-assistant pairs with the tokens of the question."""
    pairs = turns.turn_pairs(chats, conv, carry=["language", "model"])
    return pairs.withColumn("input_tokens", text.token_count(F.col("input")))


def chat_chunks(
    chats: DataFrame, conversations: int | None = None, language: str = "English",
    conv: str = "conv_id",
) -> DataFrame:
    """Chunks of the questions of the first conversations in a language, with language and model."""
    pairs = turns.turn_pairs(chats.where(F.col("language") == language), conv, carry=["language", "model"])
    if conversations is not None:
        pairs = turns.of_first_conversations(pairs, conversations, conv)
    return turns.chat_chunks(pairs, conv)


def labelled_emotions(
    rows: DataFrame, key: str = "id", body: str = "text", names: Sequence[str] = settings.EMOTIONS
) -> DataFrame:
    """Clear rows in chunks, with their group and the list of their active emotions.

    A row without an id is named by a hash of its values, a missing group is `unknown`.
    """
    clear = filters.ensure_columns(filters.drop_flagged(rows), {key: "string", "subreddit": "string"})
    named = F.concat(F.lit("row_"), F.hex(F.xxhash64(*sorted(rows.columns))))
    listed = clear.withColumns({
        "emotions": parsing.active_labels(clear, names),
        "subreddit": F.coalesce("subreddit", F.lit("unknown")),
        key: F.coalesce(F.col(key).cast("string"), named),
    })
    return filters.chunk_rows(listed, body, [key, "subreddit", "emotions"])


def nested_chats(
    df: DataFrame, conv: str, language: str | None = None, carry: Sequence[str] = ("language", "model")
) -> DataFrame:
    """Long form of a table with one array of turns per conversation."""
    kept = df if language is None else filters.in_language(df, language, "conversation")
    return tables.unnest_conversations(kept, conv, carry)
