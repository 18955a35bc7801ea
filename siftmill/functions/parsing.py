"""Vectors, label lists and scores that arrive as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = "struct<negative:double,positive:double>"


def to_int(value: Column, default: int | None = 0) -> Column:
    """Whole number of a string or number; `default` where it cannot be read."""
    read = value.try_cast("int")
    return read if default is None else F.coalesce(read, F.lit(default))


def to_double(value: Column, default: float | None = None) -> Column:
    read = value.try_cast("double")
    return read if default is None else F.coalesce(read, F.lit(default))


def parse_vector(text: Column) -> Column:
    """`[1, 2]` or `(1, 2)` as an array of floats; null when any part is not a number."""
    read = F.from_json(F.translate(text, "()", "[]"), "array<float>")
    return F.when(~F.exists(read, lambda x: x.isNull()), read)


def parse_labels(text: Column) -> Column:
    """A label list given as JSON, as JSON inside a JSON string, as one word or with single quotes.

    Text that is none of these gives an empty list.
    """
    plain = F.from_json(text, "array<string>")
    inner = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]
    quoted = F.startswith(F.ltrim(text), F.lit('"'))
    nested = F.from_json(inner, "array<string>")
    one = F.when(F.length(inner) > 0, F.array(inner))
    empty = F.array().cast("array<string>")
    starts_list = F.startswith(F.ltrim(text), F.lit("["))
    return (
        F.when(starts_list, F.coalesce(plain, empty))
        .when(quoted, F.coalesce(nested, one, empty))
        .otherwise(empty)
    )


def keep_labels(labels: Column, wanted: Sequence[str]) -> Column:
    """The wanted labels in their order, repeats included."""
    return F.filter(labels, lambda x: x.isin(*wanted))


def emotion_score(scores: Column, predicted: Column, name: str) -> Column:
    """Score by name; without scores 1.0 if the name was predicted, else 0.0."""
    listed = F.when(F.array_contains(predicted, name), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(scores.isNotNull(), F.coalesce(scores[name], F.lit(0.0))).otherwise(listed)


def read_scores(text: Column) -> Column:
    return F.from_json(text, SCORES)


def active_labels(df: DataFrame, names: Sequence[str]) -> Column:
    """Names of the 0/1 columns that hold 1; names that are no column are left out."""
    present = [n for n in names if n in df.columns]
    if not present:
        return F.array().cast("array<string>")
    flags = F.array(*[F.when(F.col(n).try_cast("int") == 1, F.lit(n)) for n in present])
    return F.filter(flags, lambda x: x.isNotNull())
