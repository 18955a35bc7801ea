"""Bounded samples of labelled rows, and the frame of the two classifiers."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import map_batches
from siftmill.session import durable

SEED = 42
FOLDS = 2


def learning_row(ident: str, modulus: int, held: int) -> Column:
    """False for the rows whose labels are held out: crc32(id as text) mod `modulus` = `held`."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % modulus != held


def marked_rows(labels: DataFrame, label: str, learn) -> DataFrame:
    """(doc_id, y) of the ids whose label can be learned: the larger of several labels; labels other
    than 0 and 1 and null ids are left out."""
    marked = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(label).cast("int").alias("y")
    )


def fold_of(ident: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED + 1), F.col(ident)), F.lit(FOLDS))


def sample_rows(
    docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int, seed: int = SEED,
) -> tuple[DataFrame, list[int]]:
    """(doc_id, text, y, fold) of at most `per_class` rows of each class, kept durable, and the
    number of rows of each class that could have been taken.

    The rows with the lowest seeded hash of their id are taken; of rows with one id, one.
    """
    there = durable(marked_rows(labels, label, learn).join(docs.select("doc_id"), "doc_id", "left_semi"))
    found = {r["y"]: r["n"] for r in there.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    drawn = [there.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    # At most 2 * per_class ids, so the broadcast is bounded.
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    rows = docs.join(chosen, "doc_id").dropDuplicates(["doc_id"]).withColumn("fold", fold_of("doc_id"))
    return durable(rows.select("doc_id", "text", "y", "fold")), [found.get(0, 0), found.get(1, 0)]


def judged(
    docs: DataFrame, labels: DataFrame, fit, scores, modulus: int, held: int, cutoff: float,
    **options,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) by a model that never reads held-out labels.

    A row with a null id is not held out.
    """
    learn = learning_row("doc_id", modulus, held)
    model = fit(docs, labels, learn=learn, **options)
    return scores(docs, model).select(
        "doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cutoff).cast("int").alias("predicted"),
    )


def rows_by_score(
    docs: DataFrame, model, keep: Callable[[float], bool], text: str = "text"
) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text `model` gives a score that `keep`
    accepts; null texts are scored as empty. One pass, nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores([t or "" for t in batch.column(text).to_pylist()])
        return batch.filter(pa.array([keep(s) for s in scores], pa.bool_()))

    return map_batches(docs, run, docs.schema)
