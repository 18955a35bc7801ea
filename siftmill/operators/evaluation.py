"""Metrics on class distributions. Rows are reduced to counts before anything is combined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.functions import dists, text
from siftmill.operators.ranking import take_seeded

METRICS = ("accuracy", "precision", "recall", "f1", "top3_accuracy")


def _tops(df: DataFrame, guess: str, truth: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *keep,
        dists.top_class(F.col(truth)).alias("t"),
        dists.top_class(F.col(guess)).alias("g"),
        F.when(F.size(guess) >= 3, dists.in_top(F.col(guess), dists.top_class(F.col(truth)), 3))
        .alias("in3"),
    )


def accuracy(df: DataFrame, guess: str, truth: str) -> DataFrame:
    tops = _tops(df, guess, truth)
    return tops.agg(F.avg((F.col("t") == F.col("g")).cast("double")).alias("accuracy"))


def top3_accuracy(df: DataFrame, guess: str, truth: str) -> DataFrame:
    """Top-1 accuracy where there are fewer than three classes."""
    hit = F.coalesce("in3", F.col("t") == F.col("g")).cast("double")
    return _tops(df, guess, truth).agg(F.avg(hit).alias("top3_accuracy"))


def confusion(df: DataFrame, guess: str, truth: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, t, g, n, n3): at most classes x classes rows per kept group."""
    hit = F.coalesce("in3", F.col("t") == F.col("g")).cast("long")
    return _tops(df, guess, truth, keep).groupBy(*keep, "t", "g").agg(
        F.count("*").alias("n"), F.sum(hit).alias("n3")
    )


def weighted_scores(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, METRICS) from confusion counts; classes weigh by support, 0/0 is 0."""
    same = F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)
    actual = counts.groupBy(*keep, F.col("t").alias("c")).agg(
        F.sum("n").alias("support"), F.sum(same).alias("tp"), F.sum("n3").alias("n3")
    )
    guessed = counts.groupBy(*keep, F.col("g").alias("c")).agg(F.sum("n").alias("guessed"))
    joined = actual.join(guessed, [*keep, "c"], "left").fillna(0, ["guessed"])
    tp, support, called = F.col("tp"), F.col("support"), F.col("guessed")
    precision = F.when(called > 0, tp / called).otherwise(0.0)
    total = F.sum("support")

    def weighted(value: Column, name: str) -> Column:
        return (F.sum(value * support) / total).alias(name)

    return joined.groupBy(*keep).agg(
        (F.sum("tp") / total).alias("accuracy"),
        weighted(precision, "precision"),
        weighted(tp / support, "recall"),
        weighted(2 * tp / (support + called), "f1"),
        (F.sum("n3") / total).alias("top3_accuracy"),
    )


def metrics(df: DataFrame, guess: str, truth: str, keep: Sequence[str] = ()) -> DataFrame:
    return weighted_scores(confusion(df, guess, truth, keep), keep)


def per_dataset(df: DataFrame, dataset: str, guess: str, truth: str) -> DataFrame:
    """(metric, value) with the dataset's name as prefix."""
    made = metrics(df, guess, truth, [dataset])
    entries = F.array(*[
        F.struct(F.concat_ws("_", dataset, F.lit(m)).alias("metric"), F.col(m).alias("value"))
        for m in METRICS
    ])
    return made.select(F.inline(entries))


def divergence(df: DataFrame, teacher: str, student: str) -> DataFrame:
    return df.agg(F.avg(dists.kl(F.col(teacher), F.col(student))).alias("kl"))


def hierarchical_loss(
    df: DataFrame, teacher: str, student: str, risk: Sequence[int], weight: float = 0.5
) -> DataFrame:
    """(kl, mse, loss): divergence plus the weighted squared error of the risk masses."""
    gap = dists.mass(F.col(student), risk) - dists.mass(F.col(teacher), risk)
    parts = df.agg(
        F.avg(dists.kl(F.col(teacher), F.col(student))).alias("kl"), F.avg(gap * gap).alias("mse")
    )
    return parts.withColumn("loss", F.col("kl") + weight * F.col("mse"))


THRESHOLDS = tuple(0.1 + 0.05 * i for i in range(17))


def threshold_sweep(
    df: DataFrame, guess_mass: Column, true_mass: Column, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """(threshold, f1) for every threshold.

    A row is reduced to the number of thresholds its mass passes; the sweep then runs on at
    most (thresholds + 1) x 2 counts.
    """
    passed = F.lit(0)
    for value in thresholds:
        passed = passed + (guess_mass > F.lit(float(value))).cast("int")
    truth = (true_mass > 0.5).cast("int")
    counts = df.select(passed.alias("passed"), truth.alias("t")).groupBy("passed", "t").agg(
        F.count("*").alias("n")
    )
    steps = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("threshold"))
        for i, v in enumerate(thresholds)
    ])
    each = counts.select("passed", "t", "n", F.inline(steps))
    called = F.col("passed") > F.col("i")
    sums = each.groupBy("threshold").agg(
        F.sum(F.when(called & (F.col("t") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(called, F.col("n")).otherwise(0)).alias("called"),
        F.sum(F.when(F.col("t") == 1, F.col("n")).otherwise(0)).alias("actual"),
    )
    bottom = F.col("called") + F.col("actual")
    f1 = F.when(bottom > 0, 2 * F.col("tp") / bottom).otherwise(0.0)
    return sums.select("threshold", f1.alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """(risk_threshold, f1_score): the lowest threshold with the best F1; 0.5 if none scores."""
    best = sweep.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("m"))).alias("b"))
    return best.select(
        F.when(F.col("b.f1") > 0, -F.col("b.m")).otherwise(settings.RISK_THRESHOLD)
        .alias("risk_threshold"),
        F.coalesce("b.f1", F.lit(0.0)).alias("f1_score"),
    )


def review_sample(
    df: DataFrame, key: str, n: int = 50, column: str = "text", seed: int = settings.SEED
) -> DataFrame:
    """(key, text, top_label, conf): a seeded sample shortened for reading."""
    picked = take_seeded(df, key, n, seed=seed)
    return picked.select(
        key, text.preview(F.col(column)).alias("text"), "top_label",
        text.percent(F.col("confidence")).alias("conf"),
    )
