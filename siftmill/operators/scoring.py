"""Scoring of texts and vectors in Arrow batches, and the labels read off the scores."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill import settings
from siftmill.functions import dists, text
from siftmill.operators.sets import with_names

Scorer = Callable[[list[str]], np.ndarray]


def once_per_worker(name: str, load: Callable[[], object]) -> Callable[[], object]:
    """A loader whose result stays in the Python worker, which serves many tasks in turn.

    Functions are sent to every task anew, so the result is kept on a module that all tasks of
    a worker share. `name` tells models and their versions apart.
    """

    def held():
        kept = sys.modules["pyspark"].__dict__.setdefault("_held_by_worker", {})
        if name not in kept:
            kept[name] = load()
        return kept[name]

    return held


def linear_scores(vec: Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    """weights @ vec + bias as an array, one matrix product per Arrow batch."""
    matrix = np.asarray(weights, np.float64).T
    shift = np.asarray(bias, np.float64)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(batch.to_numpy()).astype(np.float64) @ matrix + shift))

    return run(vec)


def sigmoid_scores(vec: Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    return F.transform(linear_scores(vec, weights, bias), lambda x: 1 / (1 + F.exp(-x)))


def is_scorable(body: Column) -> Column:
    return F.coalesce(F.length(text.strip(body)) > 0, F.lit(False))


def score_texts(
    df: DataFrame, column: str, load: Callable[[], Scorer], out: str = "logits",
    batch: int = 256, tokens: int | None = settings.MAX_MODEL_TOKENS,
) -> DataFrame:
    """Add the scores of a text column; blank and null texts get an empty array.

    The model sees the first `tokens` tokens of a longer text, set apart by blanks; the column
    itself stays as it is.

    `load` is called once per task and returns a function from texts to a score matrix; wrap a
    heavy model in `once_per_worker`.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for frame in frames:
            good = frame["_ok"].to_numpy(dtype=bool)
            texts = frame.loc[good, "_seen"].tolist()
            frame = frame.drop(columns=["_ok", "_seen"])
            rows = [score(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            found = iter(np.concatenate(rows)) if rows else iter(())
            frame[out] = [next(found).tolist() if ok else [] for ok in good]
            yield frame

    seen = F.col(column) if tokens is None else text.first_tokens(F.col(column), tokens)
    given = df.withColumns({"_ok": is_scorable(F.col(column)), "_seen": seen})
    return given.mapInPandas(run, schema)


def top_labels(
    df: DataFrame, dist: str = "full_dist", names: DataFrame | None = None
) -> DataFrame:
    """Add `top_class`, `top_label` and `confidence`; an empty distribution gives N/A and 0."""
    empty = F.size(dist) == 0
    ranked = df.withColumn("top_class", F.when(~empty, dists.top_class(F.col(dist)))).withColumn(
        "confidence", F.when(empty, F.lit(0.0)).otherwise(dists.confidence(F.col(dist)))
    )
    if names is None:
        named = ranked.withColumn("_name", F.col("top_class").cast("string"))
    else:
        book = names.select(F.col("class_idx").alias("top_class"), "name")
        named = with_names(ranked, book, "top_class", "name", "_name")
    return named.withColumn("top_label", F.coalesce("_name", F.lit("N/A"))).drop("_name")


def silver_labels(
    df: DataFrame, ident: str, column: str, load: Callable[[], Scorer],
    names: DataFrame | None = None, temperature: float = settings.TEMPERATURE,
) -> DataFrame:
    """(id, text, top_label, confidence, full_dist): every row is kept, unscored ones as N/A."""
    slim = df.select(F.col(ident).alias("id"), F.col(column).alias("text"))
    scored = score_texts(slim, "text", load)
    dist = F.when(F.size("logits") > 0, dists.softmax(F.col("logits"), temperature)).otherwise(
        F.col("logits")
    )
    made = top_labels(scored.select("id", "text", dist.alias("full_dist")), names=names)
    return made.select("id", "text", "top_label", "confidence", "full_dist")


def decide(df: DataFrame, mass: str, threshold: DataFrame) -> DataFrame:
    """Add `risk`: mass above the threshold of the one-row side table, 0.5 if it has none."""
    limit = threshold.agg(F.max("risk_threshold")).scalar()
    above = F.col(mass) > F.coalesce(limit, F.lit(settings.RISK_THRESHOLD))
    return df.withColumn("risk", above.cast("int"))


def token_counter(encoding) -> Callable[[Column], Column]:
    """A token count by a byte-pair encoder, for users who hold its vocabulary.

    `encoding` is a function without arguments that returns an object with
    `encode_ordinary(text)`; it is called once per task.
    """

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoding()
        for batch in batches:
            yield batch.map(
                lambda t: len(encoder.encode_ordinary(t)) if isinstance(t, str) else 0
            )

    return count


def embed_column(
    df: DataFrame, column: str, load: Callable[[], Scorer], out: str = "embedding",
    batch: int = 256,
) -> DataFrame:
    """Add a vector per text by a user function from texts to rows of numbers.

    The function gets `batch` texts at a time; where it fails, these are tried one by one, and a
    text that fails alone, or has no value, gets null.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()

        def attempt(texts: list[str]) -> list:
            try:
                rows = [[float(x) for x in row] for row in embed(texts)]
                if len(rows) != len(texts):
                    raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
                return rows
            except Exception:  # noqa: BLE001 - any failure of the user function is a null
                return [None] if len(texts) == 1 else [attempt([t])[0] for t in texts]

        for frame in frames:
            values = frame[column].tolist()
            there = [i for i, v in enumerate(values) if isinstance(v, str)]
            made = [None] * len(values)
            for start in range(0, len(there), batch):
                places = there[start : start + batch]
                for i, row in zip(places, attempt([values[i] for i in places]), strict=True):
                    made[i] = row
            frame[out] = pd.Series(made, index=frame.index, dtype=object)
            yield frame

    return df.mapInPandas(run, schema)
