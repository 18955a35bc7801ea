"""Emotion scores written back to a table, and silver labels of a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.functions import parsing, text
from siftmill.operators import filters, probe, scoring, turns
from siftmill.operators.ranking import first_rows
from siftmill.sources import sinks


def emotion_columns(
    rows: DataFrame, model: probe.Probe, key: str, vec: str,
    threshold: float = settings.PROBE_THRESHOLD,
) -> DataFrame:
    """(key, predicted_emotions, emotion_scores) of the rows that have a vector."""
    kind = rows.schema[vec].dataType.typeName()
    value = parsing.parse_vector(F.col(vec)) if kind == "string" else F.col(vec)
    valid = rows.select(key, value.alias("_v")).where(F.col("_v").isNotNull())
    scored = valid.select(key, model.scores(F.col("_v")).alias("_s"))
    fused = scored.select(
        key,
        probe.late_fusion(F.col("_s"), model.classes, settings.POSITIVE_EMOTIONS).alias("p"),
        probe.late_fusion(F.col("_s"), model.classes, settings.NEGATIVE_EMOTIONS).alias("n"),
    )
    return fused.select(
        key,
        probe.emotion_labels(F.col("p"), F.col("n"), threshold).alias("predicted_emotions"),
        F.struct(F.col("n").alias("negative"), F.col("p").alias("positive")).alias("emotion_scores"),
    )


def enrich(
    rows: DataFrame, model: probe.Probe, key: str, vec: str, path: str, version: int,
    threshold: float = settings.PROBE_THRESHOLD,
) -> DataFrame:
    """The table with both emotion columns updated, as a new version at `path`."""
    kinds = {"predicted_emotions": "array<string>", "emotion_scores": parsing.SCORES}
    grown = filters.ensure_columns(rows, kinds)
    changes = emotion_columns(rows, model, key, vec, threshold)
    return sinks.replace(sinks.updated(grown, changes, key, list(kinds)), path, version)


def training_labels(rows: DataFrame, labels: str, vec: str) -> DataFrame:
    """Stored label lists and vectors ready for the probe: wanted labels only, none empty."""
    read = rows.withColumn(
        "emotions",
        parsing.keep_labels(
            parsing.parse_labels(F.col(labels)),
            settings.POSITIVE_EMOTIONS + settings.NEGATIVE_EMOTIONS,
        ),
    ).withColumn("embedding", parsing.parse_vector(F.col(vec)))
    return read.where((F.size("emotions") > 0) & F.col("embedding").isNotNull())


def silver_corpus(
    rows: DataFrame, ident: str, column: str, load: Callable, path: str,
    names: DataFrame | None = None, temperature: float = settings.TEMPERATURE,
) -> DataFrame:
    """Score a corpus and keep the rows that have a distribution, as a table at `path`."""
    made = scoring.silver_labels(rows, ident, column, load, names, temperature)
    sinks.write_silver(made, path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


def first_turns(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    first = turns.first_user(chats, conv)
    return first.select(F.col(conv).cast("string").alias("id"), "text")


def all_user_turns(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    return turns.user_turns(chats, conv)


def long_posts(
    posts: DataFrame, ident: str = "post_id", body: str = "selftext", longer: int = 5,
    limit: int | None = None,
) -> DataFrame:
    """(id, text): posts with more than `longer` characters, the first `limit` of them by id."""
    rows = posts.select(F.col(ident).cast("string").alias("id"), F.col(body).alias("text"))
    kept = rows.where(F.length(text.strip(F.col("text"))) > longer)
    return kept if limit is None else first_rows(kept, ["id"], limit)
