"""Numbers for rows that have no key of their own, assigned once and kept as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.operators.ranking import _offsets, row_key
from siftmill.session import scratch, shuffle_width, small_or_same

_RANGE, _AT, _TIE, _COPY = "_range", "_at", "_tie", "_copy"
# `monotonically_increasing_id` counts the rows of a task in its lower 33 bits.
_IN_TASK = (1 << 33) - 1


def numbered(df: DataFrame, order: Sequence[str], name: str = "row") -> DataFrame:
    """Add the 0-based place of each row in `order`, nulls first.

    Rows that the order does not tell apart follow a hash of their values; equal rows get
    different numbers in any order. The rows are cut into ranges and written to the shared folder
    with their place within the range, so that a number stays with its row whatever is read again;
    the numbers of a range start at the sum of the sizes before it, one row per range. Many equal
    rows are spread over ranges by their place in the input. An empty table stays empty. A column
    called `name` is replaced.
    """
    spark = df.sparkSession
    held = df.drop(name)
    keys = [*order, _TIE, _COPY]
    tied = held.select(
        "*", row_key(*held.columns).alias(_TIE), F.monotonically_increasing_id().alias(_COPY)
    )
    ranged = tied.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    placed = ranged.select(
        *held.columns, F.spark_partition_id().alias(_RANGE),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK)).alias(_AT),
    )
    path = scratch(spark, "identity")
    placed.write.parquet(path)
    kept = spark.read.schema(placed.schema).parquet(path)
    sizes = kept.groupBy(_RANGE).agg(F.count("*").alias("_t_n"))
    starts = small_or_same(_offsets(sizes, [], _RANGE, ["n"]))
    return kept.join(starts, F.col(_RANGE) == F.col(f"_o_{_RANGE}")).select(
        *held.columns, (F.col("_o_n") + F.col(_AT)).alias(name)
    )
