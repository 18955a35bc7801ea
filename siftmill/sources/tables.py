"""Scans: column subsets, id ranges, pages, batches and nested conversations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators.ranking import first_rows, positions


def scan(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan that reads only the named columns."""
    return spark.read.parquet(path).select(*columns)


def id_ranges(df: DataFrame, ident: str, n: int) -> DataFrame:
    """(first_id, last_id, rows): at most n contiguous id ranges that cover the table."""
    low, high = df.agg(F.min(ident), F.max(ident)).first()
    if low is None:
        low, high = 0, -1
    step = max(1, math.ceil((high - low) / n) + 1) if high > low else 1
    part = F.expr(f"(`{ident}` - {low}) div {step}")
    counted = df.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    return counted.select(
        (F.col("part") * step + low).alias("first_id"),
        F.least(F.col("part") * step + low + step - 1, F.lit(high)).alias("last_id"),
        "rows",
    )


def read_jdbc_ranges(
    spark: SparkSession, url: str, table: str, ident: str, low: int, high: int, n: int,
    columns: Sequence[str] | None = None, **options: str,
) -> DataFrame:
    """Parallel read of a database table by id range; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=ident, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(n), **options,
    )
    df = reader.load()
    return (df.select(*columns) if columns else df).dropDuplicates([ident])


def keyset_page(df: DataFrame, ident: str, after: int, n: int, until: int | None = None):
    """The next n rows after an id, in id order."""
    later = df.where(F.col(ident) > after)
    if until is not None:
        later = later.where(F.col(ident) <= until)
    return first_rows(later, [ident], n)


def offset_page(df: DataFrame, order: Sequence[str], skip: int, n: int) -> DataFrame:
    return first_rows(df, order, n, skip)


def batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Add `batch`, 0-based: consecutive rows in order, `size` to a batch.

    `order` names a row uniquely. Wide rows meet their batch in a join on it; only the order
    columns are sorted.
    """
    placed = positions(df.select(*order), order, name="_pos")
    numbered = placed.withColumn("batch", F.floor(F.col("_pos") / size)).drop("_pos")
    if set(df.columns) == set(order):
        return numbered
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in order])
    met = df.alias("l").join(numbered.alias("r"), same)
    return met.select(*[F.col(f"l.{c}") for c in df.columns], "r.batch")


_SEGMENT = 1000


def nest_conversations(df: DataFrame, conv: str = "conv_id", segment: int = _SEGMENT) -> DataFrame:
    """(conv, part, conversation): turns as an array, at most `segment` turn numbers to a row.

    A conversation of any length stays spread over rows of bounded size.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return (
        df.groupBy(conv, F.floor(F.col("turn") / segment).alias("part"))
        .agg(turns.alias("conversation"))
    )


def unnest_conversations(
    df: DataFrame, conv: str = "conv_id", carry: Sequence[str] = ()
) -> DataFrame:
    """(conv, turn, role, text, *carry) from conversation arrays.

    Arrays without turn numbers are numbered by place; a null conversation gives no row.
    """
    item = df.schema["conversation"].dataType.elementType
    exploded = df.select(conv, *carry, F.posexplode("conversation").alias("_place", "_t"))
    turn = F.col("_t.turn") if "turn" in item.names else F.col("_place").cast("long")
    return exploded.select(
        conv, turn.alias("turn"), F.col("_t.role").alias("role"),
        F.col("_t.content").alias("text"), *carry,
    )
