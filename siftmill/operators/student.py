"""A student model distilled from class distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.functions import dists
from siftmill.operators import linear
from siftmill.operators.scoring import linear_scores


def fit_student(
    df: DataFrame, vec: str, dist: str, regularisation: float = 1e-3, iterations: int = 50
) -> linear.Fitted:
    """Multinomial regression against soft labels: the least mean cross-entropy with `dist`.

    Rows without a vector or a distribution, such as those that could not be scored, take no part;
    the first distribution found gives the number of classes.
    """
    known = df.where((F.size(dist) > 0) & F.col(vec).isNotNull())
    some = known.select(F.size(dist).alias("classes")).first()
    if some is None:
        raise ValueError("no row with a vector and a distribution")
    return linear.fit(known, vec, dist, some["classes"], linear.multinomial, regularisation, iterations)


def apply_student(model: linear.Fitted, df: DataFrame, vec: str, out: str = "student") -> DataFrame:
    """Add the distribution the student gives."""
    scored = df.withColumn("_logits", linear_scores(F.col(vec), model.weights, model.bias))
    return scored.withColumn(out, dists.softmax(F.col("_logits"), 1.0)).drop("_logits")
