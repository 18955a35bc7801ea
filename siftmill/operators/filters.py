"""Row filters and column changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill import settings
from siftmill.functions import parsing, text


def standard_names(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Rename columns whose target does not exist yet."""
    wanted = names or {"full_dist": "labels", "input": "text"}
    found = {a: b for a, b in wanted.items() if a in df.columns and b not in df.columns}
    return df.withColumnsRenamed(found)


def ensure_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Add missing columns as typed nulls."""
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def in_period(
    df: DataFrame, column: str = "created_utc",
    first: float = settings.FIRST_SECOND, last: float = settings.LAST_SECOND,
) -> DataFrame:
    """Rows of the inclusive period; a time that cannot be read is outside.

    A numeric column is compared as it is, so the bounds reach the Parquet scan.
    """
    kind = df.schema[column].dataType
    value = F.col(column) if isinstance(kind, T.NumericType) else parsing.to_double(F.col(column))
    return df.where(value.between(first, last))


def valid_body(df: DataFrame, column: str) -> DataFrame:
    return df.where(~text.is_empty_body(F.col(column)))


def quality_body(
    df: DataFrame, column: str, min_tokens: int = settings.MIN_TOKENS
) -> DataFrame:
    """Bodies that are not blank, carry no removal mark and have enough tokens."""
    body = F.col(column)
    return df.where(
        (text.strip(body) != "")
        & ~text.has_removal_mark(body)
        & (text.token_count(body) >= min_tokens)
    )


def longer_than(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return df.where(F.length(text.strip(F.col(column))) > n)


def drop_flagged(df: DataFrame, flag: str = "example_very_unclear") -> DataFrame:
    """Keep rows whose flag is false; a table without the flag is kept whole."""
    return df.where(~F.col(flag)) if flag in df.columns else df


def in_language(df: DataFrame, language: str = "English", content: str = "text") -> DataFrame:
    return df.where((F.col("language") == language) & F.col(content).isNotNull())


def tag_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("dataset_type", F.lit(source))


def binary_label(source: Column, mark: str = settings.RISK_TABLE_MARK) -> Column:
    return F.coalesce(F.contains(source, F.lit(mark)), F.lit(False)).cast("int")


def strip_nul(df: DataFrame) -> DataFrame:
    """Remove NUL characters from the string columns."""
    changed = {
        f.name: F.replace(F.col(f.name), F.lit("\0"), F.lit(""))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(changed) if changed else df


def composite_id(*parts: str | Column) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("_", *[c.cast("string") for c in columns])


def happy_risk(
    positive: Column, negative: Column,
    high: float = settings.HIGH_EMOTION, low: float = settings.LOW_EMOTION,
) -> Column:
    return (positive > high) & (negative < low)


def drop_happy_risk(
    df: DataFrame, positive: str = "pos_score", negative: str = "neg_score",
    high: float = settings.HIGH_EMOTION, low: float = settings.LOW_EMOTION,
) -> DataFrame:
    """Drop risk rows that look happy; if that leaves nothing, keep them all."""
    bad = F.coalesce(happy_risk(F.col(positive), F.col(negative), high, low), F.lit(False))
    left = df.agg(F.coalesce(F.sum((~bad).cast("long")), F.lit(0))).scalar()
    return df.where(~bad | (left == 0))


def chunk_rows(
    df: DataFrame, column: str, keys: Sequence[str], **options
) -> DataFrame:
    """(keys, chunk_id, input, input_tokens): one row per chunk, numbered from 1 per parent."""
    made = F.filter(
        text.chunks(F.col(column), **options), lambda c: text.strip(c["chunk"]) != ""
    )
    exploded = df.select(*keys, F.posexplode(made).alias("pos", "c"))
    return exploded.select(
        *keys,
        (F.col("pos") + 1).alias("chunk_id"),
        # Windows are trimmed already; a whole text that stands in for them comes first.
        F.when(F.col("pos") == 0, text.strip(F.col("c.chunk"))).otherwise(F.col("c.chunk"))
        .alias("input"),
        F.col("c.tokens").alias("input_tokens"),
    )
