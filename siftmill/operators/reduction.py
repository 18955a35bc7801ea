"""Principal components and standard scaling on Spark ML."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_features(vec: Column) -> Column:
    return array_to_vector(vec.cast("array<double>"))


@dataclass
class Reducer:
    """A fitted projection; without a model it passes vectors through."""

    model: PCAModel | None
    mean: list[float]

    def apply(self, df: DataFrame, vec: str, out: str = "reduced") -> DataFrame:
        if self.model is None:
            return df.withColumn(out, F.col(vec).cast("array<double>"))
        centred = F.zip_with(
            F.col(vec).cast("array<double>"), _literal(self.mean), lambda x, m: x - m
        )
        made = self.model.transform(df.withColumn("_centred", array_to_vector(centred)))
        return made.withColumn(out, vector_to_array("_pca")).drop("_centred", "_pca")


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _moments(df: DataFrame, vec: str) -> tuple[list[float], list[float], int]:
    """Mean and population deviation per dimension, in one pass that sums vectors per task."""
    made = df.select(as_features(F.col(vec)).alias("x"))
    row = made.select(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("x")).alias("s")
    ).first()["s"]
    n = row["count"]
    shrink = (n - 1) / n if n else 0.0
    return list(row["mean"]), [math.sqrt(v * shrink) for v in row["variance"]], n


def fit_pca(df: DataFrame, vec: str, n: int = 100) -> Reducer:
    """Principal components of the mean-centred vectors; none if they have no more than n entries."""
    width = df.select(F.size(vec).alias("w")).first()["w"]
    if width <= n:
        return Reducer(None, [])
    mean, _, _ = _moments(df, vec)
    centred = F.zip_with(F.col(vec).cast("array<double>"), _literal(mean), lambda x, m: x - m)
    rows = df.select(array_to_vector(centred).alias("_centred"))
    return Reducer(PCA(k=n, inputCol="_centred", outputCol="_pca").fit(rows), mean)


@dataclass
class Scaler:
    mean: list[float]
    deviation: list[float]

    def apply(self, vec: Column) -> Column:
        """(x - mean) / deviation; a constant dimension is only centred."""
        scale = [d if d > 0 else 1.0 for d in self.deviation]
        centred = F.zip_with(vec.cast("array<double>"), _literal(self.mean), lambda x, m: x - m)
        return F.zip_with(centred, _literal(scale), lambda x, s: x / s)


def fit_scaler(df: DataFrame, vec: str) -> Scaler:
    mean, deviation, _ = _moments(df, vec)
    return Scaler(mean, deviation)
