"""Tables derived from the given ones, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.functions import dists as D
from siftmill.session import tune

RISK_LABELS = (0, 4, 7)
TOKEN = settings.TOKEN
BLANK_CODES = [ord(c) for c in settings.BLANKS]
_BLANKS_SQL = "||".join(f"chr({c})" for c in BLANK_CODES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def long(value: Column) -> Column:
    return value.cast("long")


def six(value: Column) -> Column:
    """Rounded so that the order of additions does not show."""
    return F.round(value.cast("double"), 6)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    ident = F.col("vec_id")

    def squash(index: int) -> Column:
        return 1 / (1 + F.exp(-10 * F.col("embedding")[index].cast("double")))

    return table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("subreddit"),
        F.col("label").isin(*RISK_LABELS).cast("int").alias("binary_label"),
        F.when(ident % 41 == 0, "unknown")
        .when(ident % 43 == 0, "[deleted]")
        .otherwise(F.concat(F.lit("a"), (ident % 197).cast("string")))
        .alias("author"),
        squash(0).alias("pos_score"),
        squash(1).alias("neg_score"),
        "embedding",
    )


VECTORS = """vectors AS (
  SELECT vec_id, label, 'c' || label AS subreddit,
    CASE WHEN label IN (0, 4, 7) THEN 1 ELSE 0 END AS binary_label,
    CASE WHEN vec_id % 41 = 0 THEN 'unknown' WHEN vec_id % 43 = 0 THEN '[deleted]'
      ELSE 'a' || (vec_id % 197) END AS author,
    1 / (1 + exp(-10 * CAST(embedding[1] AS DOUBLE))) AS pos_score,
    1 / (1 + exp(-10 * CAST(embedding[2] AS DOUBLE))) AS neg_score,
    embedding, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings)"""


def posts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    people = docs.agg(F.greatest(F.lit(10), F.floor(F.count("*") / 20)).alias("m")).scalar()
    ident = F.col("doc_id")
    return docs.select(
        "doc_id",
        F.concat(F.lit("p"), ident.cast("string")).alias("post_id"),
        F.when(ident % 29 == 0, "unknown")
        .when(ident % 31 == 0, "[deleted]")
        .otherwise(F.concat(F.lit("u"), (ident % people).cast("string")))
        .alias("author"),
        (F.lit(1620000000) + (ident * 7919 * 37) % 60000000).cast("double").alias("created_utc"),
        F.col("source").alias("subreddit"),
        F.when(ident % 37 == 0, "[removed]").when(ident % 53 == 0, "")
        .otherwise(F.col("text")).alias("selftext"),
        "n_chars",
        F.when(ident % 41 == 0, None).otherwise(F.concat(F.lit("title "), (ident % 97).cast("string"))).alias("title"),
        F.when(ident % 43 == 0, "none").otherwise((ident % 50).cast("string")).alias("score"),
    )


POSTS = """posts AS (
  SELECT doc_id, 'p' || doc_id AS post_id,
    CASE WHEN doc_id % 29 = 0 THEN 'unknown' WHEN doc_id % 31 = 0 THEN '[deleted]'
      ELSE 'u' || (doc_id % (SELECT CAST(greatest(10, floor(count(*) / 20)) AS BIGINT)
                             FROM documents)) END AS author,
    CAST(1620000000 + (doc_id * 7919 * 37) % 60000000 AS DOUBLE) AS created_utc,
    source AS subreddit,
    CASE WHEN doc_id % 37 = 0 THEN '[removed]' WHEN doc_id % 53 = 0 THEN '' ELSE text END
      AS selftext, n_chars,
    CASE WHEN doc_id % 41 = 0 THEN NULL ELSE 'title ' || (doc_id % 97) END AS title,
    CASE WHEN doc_id % 43 = 0 THEN 'none' ELSE CAST(doc_id % 50 AS VARCHAR) END AS score
  FROM documents)"""


def dists(spark: SparkSession, folder: str) -> DataFrame:
    def logits(start: int) -> Column:
        return F.transform(F.slice("embedding", start, 10), lambda x: x.cast("double") * 8)

    return table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        logits(1).alias("teacher_logits"),
        logits(11).alias("student_logits"),
        D.softmax(logits(1)).alias("teacher"),
        D.softmax(logits(11)).alias("student"),
    )


DISTS = """dists AS (
  SELECT vec_id, label,
    list_transform(te, lambda x: x / list_sum(te)) AS teacher,
    list_transform(se, lambda x: x / list_sum(se)) AS student
  FROM (SELECT vec_id, label,
      list_transform(embedding[1:10], lambda x: exp(CAST(x AS DOUBLE) * 8)) AS te,
      list_transform(embedding[11:20], lambda x: exp(CAST(x AS DOUBLE) * 8)) AS se
    FROM embeddings))"""
DISTS_LONG = (
    DISTS
    + """, long_dists AS (
  SELECT vec_id, label, unnest(range(0, 10)) AS class_idx, unnest(teacher) AS p,
    unnest(student) AS q FROM dists)"""
)


def chats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("conv_id") % 4 == 0, "French").otherwise("English").alias("language"),
        F.lit("m").alias("model"),
    )


CHATS = """chats AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN conv_id % 4 = 0 THEN 'French' ELSE 'English' END AS language, 'm' AS model
  FROM conversations)"""


def usage(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("tokens"),
    )


def strip_sql(text: str) -> str:
    return f"trim({text}, {_BLANKS_SQL})"


def tokens_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{TOKEN}'))"


def sentences_sql(text: str) -> str:
    """The sentences of a text as a list."""
    cut = (
        f"string_split(regexp_replace(replace({text}, '...', chr(64976)), '([.!?]+)', "
        "'\\1' || chr(64977), 'g'), chr(64977))"
    )
    trimmed = strip_sql("replace(s, chr(64976), '...')")
    return f"list_filter(list_transform({cut}, lambda s: {trimmed}), lambda s: s <> '')"


def windows_sql(items: str, size: int = 3, stride: int = 1) -> str:
    return (
        f"CASE WHEN len({items}) = 0 THEN []::VARCHAR[] "
        f"WHEN len({items}) <= {size} THEN [array_to_string({items}, ' ')] "
        f"ELSE list_transform(range(1, len({items}) - {size} + 2, {stride}), "
        f"lambda i: array_to_string(list_slice({items}, i, i + {size} - 1), ' ')) END"
    )


def chunks_sql(
    source: str, keys: str, text: str, name: str = "chunks", size: int = 3, stride: int = 1,
    min_tokens: int = 20, trimmed: bool = True,
) -> str:
    """CTEs that end in `name(keys, chunk_id, chunk, tokens)`."""
    n = name
    whole = strip_sql("body") if trimmed else "body"
    return f"""{n}_s AS (SELECT {keys}, {text} AS body, {sentences_sql(text)} AS sents FROM {source}),
{n}_w AS (SELECT {keys}, body, {windows_sql('sents', size, stride)} AS win FROM {n}_s),
{n}_k AS (SELECT {keys}, body, win,
  list_filter(win, lambda c: {tokens_sql('c')} >= {min_tokens}) AS kept FROM {n}_w),
{n}_f AS (SELECT {keys}, CASE WHEN len(kept) = 0 AND len(win) > 0
  THEN [{whole}] ELSE kept END AS made FROM {n}_k),
{n} AS (SELECT {keys}, unnest(range(1, len(made) + 1)) AS chunk_id, unnest(made) AS chunk,
  unnest(list_transform(made, lambda c: {tokens_sql('c')})) AS tokens FROM {n}_f)"""
