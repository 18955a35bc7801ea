"""Class distributions held as arrays. All of it is row-local: no shuffle, no explode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.functions.text import bind


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column, temperature: float = settings.TEMPERATURE) -> Column:
    def shifted(top: Column) -> Column:
        grown = F.transform(logits, lambda x: F.exp((x.cast("double") - top) / temperature))
        return bind(grown, lambda e: bind(_sum(e), lambda s: F.transform(e, lambda x: x / s)))

    return bind(F.array_max(logits).cast("double"), shifted)


def top_class(dist: Column) -> Column:
    """Index of the largest entry, the lowest index on ties."""
    return (F.array_position(dist, F.array_max(dist)) - 1).cast("int")


def confidence(dist: Column) -> Column:
    return F.array_max(dist)


def mass(dist: Column, classes: Sequence[int]) -> Column:
    """Probability summed over `classes`, 0 if there are none."""
    total = F.lit(0.0)
    for index in classes:
        total = total + F.coalesce(F.get(dist, F.lit(int(index))).cast("double"), F.lit(0.0))
    return total


def kl(teacher: Column, student: Column) -> Column:
    """Divergence of the student from the teacher; entries the teacher gives 0 add nothing."""
    terms = F.zip_with(
        teacher, student, lambda p, q: F.when(p > 0, p * (F.ln(p) - F.ln(q))).otherwise(0.0)
    )
    return _sum(terms)


def in_top(dist: Column, index: Column, k: int = 3) -> Column:
    """Whether entry `index` is among the k largest; lower indices win ties."""
    own = F.get(dist, index)
    ahead = F.filter(
        F.transform(dist, lambda x, i: (x > own) | ((x == own) & (i < index))), lambda b: b
    )
    return F.size(ahead) < k


def display_label(label: Column, conf: Column, below: float = settings.AMBIGUOUS_BELOW) -> Column:
    return F.when(conf < below, F.concat(label, F.lit(" (?)"))).otherwise(label)
