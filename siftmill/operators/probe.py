"""Multi-label probe: one logistic regression per label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.operators import linear
from siftmill.operators.sampling import random_split
from siftmill.operators.scoring import sigmoid_scores
from siftmill.session import listed


def multi_hot(labels: Column, classes: Sequence[str]) -> Column:
    return F.array(*[F.array_contains(labels, c).cast("int") for c in classes])


@dataclass
class Probe:
    """Weights per label on unscaled vectors."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    # The largest entry of the mean gradient the fit ended with.
    gradient: float = 0.0

    def scores(self, vec: Column) -> Column:
        """Probability per label as an array."""
        return sigmoid_scores(vec, self.weights, self.bias)


def fit_probe(
    df: DataFrame, key: str, vec: str, labels: str,
    test_share: float = 0.2, seed: int = settings.SEED, iterations: int = 1000,
) -> tuple[Probe, DataFrame]:
    """A probe fitted on the train side and the split rows with their `side`.

    The penalty is that of a regression on standardised vectors with one unit of inverse
    strength. All labels are fitted together, in one pass of the table per step. Rows without a
    vector take no part in the fit; a list without a wanted label, or none, is a row of zeros.
    """
    found = df.select(F.explode(labels).alias("c")).distinct().where(F.col("c").isNotNull())
    classes = sorted(r["c"] for r in listed(found))
    split = random_split(df, key, test_share, seed)
    hot = multi_hot(F.coalesce(F.col(labels), F.array().cast("array<string>")), classes)
    rows = split.where("side = 'train'").select(F.col(vec).alias("x"), hot.alias("hot"))
    made = linear.fit(rows, "x", "hot", len(classes), linear.logistic, iterations=iterations)
    return Probe(classes, made.weights, made.bias, made.gradient), split


def late_fusion(scores: Column, classes: Sequence[str], group: Sequence[str]) -> Column:
    """Highest probability among the labels of the group."""
    places = [i for i, c in enumerate(classes) if c in set(group)]
    return F.array_max(F.array(*[scores[i] for i in places]))


def emotion_labels(
    positive: Column, negative: Column, threshold: float = settings.PROBE_THRESHOLD
) -> Column:
    """`positive`, `negative`, both or none."""
    flags = F.array(
        F.when(positive >= threshold, F.lit("positive")),
        F.when(negative >= threshold, F.lit("negative")),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def predicted(scores: Column, classes: Sequence[str], threshold: float = 0.5) -> Column:
    """Labels whose probability is above the threshold, in class order."""
    flags = F.array(*[F.when(scores[i] > threshold, F.lit(c)) for i, c in enumerate(classes)])
    return F.filter(flags, lambda x: x.isNotNull())


def label_report(df: DataFrame, truth: str, guess: str, classes: Sequence[str]) -> DataFrame:
    """(label, precision, recall, f1, support) per label and their averages.

    One pass of conditional sums; a division by zero counts as 0.
    """
    sums = []
    for i, name in enumerate(classes):
        t, g = F.array_contains(truth, name), F.array_contains(guess, name)
        sums += [
            F.sum((t & g).cast("long")).alias(f"tp{i}"),
            F.sum(t.cast("long")).alias(f"t{i}"),
            F.sum(g.cast("long")).alias(f"g{i}"),
        ]
    row = F.array(*[
        F.struct(
            F.lit(c).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"t{i}").alias("support"),
            F.col(f"g{i}").alias("guessed"),
        )
        for i, c in enumerate(classes)
    ])
    counts = df.agg(*sums).select(F.inline(row))
    per = _ratios(counts)
    micro = _ratios(counts.agg(
        F.lit("micro avg").alias("label"), F.sum("tp").alias("tp"),
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"),
    ))

    def average(name: str, weight: Column) -> DataFrame:
        parts = [
            F.coalesce(F.sum(F.col(m) * weight) / F.sum(weight), F.lit(0.0)).alias(m)
            for m in ("precision", "recall", "f1")
        ]
        return per.agg(*parts, F.sum("support").alias("support")).select(
            F.lit(name).alias("label"), "precision", "recall", "f1", "support"
        )

    return (
        per.unionByName(micro)
        .unionByName(average("macro avg", F.lit(1.0)))
        .unionByName(average("weighted avg", F.col("support")))
    )


def _ratios(counts: DataFrame) -> DataFrame:
    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    tp, support, guessed = F.col("tp"), F.col("support"), F.col("guessed")
    return counts.select(
        "label",
        ratio(tp, guessed).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, support + guessed).alias("f1"),
        "support",
    )


def subset_accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Share of rows whose label sets are equal."""
    same = F.sort_array(F.array_distinct(truth)) == F.sort_array(F.array_distinct(guess))
    return df.agg(F.avg(same.cast("double")).alias("subset_accuracy"))
