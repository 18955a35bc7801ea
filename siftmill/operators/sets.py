"""Joins by membership, unions, class dictionaries and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.operators.ranking import positions
from siftmill.session import small_or_same


def members(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def non_members(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key `other` does not hold; a null key is held by nothing."""
    return df.join(other.select(key), key, "left_anti")


def with_names(df: DataFrame, names: DataFrame, index: str, name: str, out: str) -> DataFrame:
    """Look up a name by index; an unknown index is its own name.

    The size of `names` decides at run time between a broadcast and a shuffled join.
    """
    book = names.select(F.col(index).alias("_i"), F.col(name).alias("_n"))
    joined = df.join(book, F.col(index) == F.col("_i"), "left")
    return joined.select(
        *df.columns, F.coalesce("_n", F.col(index).cast("string")).alias(out)
    )


def gather(ids: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Bring the vectors of the listed rows; repeated ids bring them repeatedly."""
    return ids.join(vectors, key)


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows by column name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in order. Reduced per task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [c for c in order if c in rest] + [c for c in rest if c not in order]
    first = F.min(F.struct(*ranked)).alias("_first")
    picked = df.groupBy(*keys).agg(first)
    return picked.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


_DICTIONARY_ROWS = 10_000


def class_index(df: DataFrame, name: str, out: str = "class_idx") -> DataFrame:
    """(name, index): 0-based place of each distinct name in binary order.

    A dictionary of checked size is sorted in one task; a longer one gets distributed positions.
    """
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    held = names.limit(_DICTIONARY_ROWS + 1).toArrow()
    if held.num_rows > _DICTIONARY_ROWS:
        return positions(names, [name], name=out).withColumn(out, F.col(out).cast("int"))
    held = held.sort_by(name)
    held = held.append_column(out, pa.array(range(held.num_rows), pa.int32()))
    return df.sparkSession.createDataFrame(held)


def positive_classes(df: DataFrame, index: DataFrame, name: str, label: str) -> DataFrame:
    """Indices of the classes that hold any positive row."""
    held = df.groupBy(name).agg(F.max(label).alias("_any")).where(F.col("_any") == 1)
    return held.join(index, name).select(name, "class_idx")


def category_counts(df: DataFrame, categories: dict[str, Column], none: str) -> DataFrame:
    """One row: rows per category, where a row may count in several, and rows in none."""
    any_of = reduce(lambda a, b: a | b, categories.values())
    sums = [F.sum(c.cast("long")).alias(n) for n, c in categories.items()]
    return df.agg(*sums, F.sum((~any_of).cast("long")).alias(none))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """(step, stage, rows): rows left after each filter, counted in one pass."""
    passed, sums = F.lit(True), [F.count("*").alias("_0")]
    for place, keep in enumerate(steps.values(), 1):
        passed = passed & F.coalesce(keep, F.lit(False))
        sums.append(F.sum(passed.cast("long")).alias(f"_{place}"))
    names = ["all", *steps]
    stages = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(f"_{i}").alias("rows"))
        for i, n in enumerate(names)
    ])
    return df.agg(*sums).select(F.inline(stages))


def class_count(df: DataFrame, vector: str) -> DataFrame:
    """(classes, same): length of the label vectors and whether all have it."""
    return df.agg(
        F.max(F.size(vector)).alias("classes"),
        (F.min(F.size(vector)) == F.max(F.size(vector))).cast("int").alias("same"),
    )


def shares(df: DataFrame, group: str) -> DataFrame:
    """(group, n, total, share) of the table, from one scan."""
    counted = small_or_same(df.groupBy(group).agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n").alias("t")).scalar()
    return counted.select(
        group, "n", total.alias("total"), (F.col("n") / total).alias("share")
    )
