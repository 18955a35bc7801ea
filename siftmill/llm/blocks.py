"""Vectors packed into blocks of bounded size, and pairs of blocks that meet."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks_for(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def packed(df: DataFrame, keys: list[str], ident: str, vec: str, items: str) -> DataFrame:
    """One row per key with the array `items` of (id, v). Keys must bound the rows of a block."""
    item = F.struct(F.col(ident).alias("id"), F.col(vec).alias("v"))
    return df.groupBy(*keys).agg(F.collect_list(item).alias(items))


def spread_over(row: Column, parts: Column | int) -> Column:
    """A part number from a row's own number, evenly, whatever the rows hold."""
    return F.pmod(F.xxhash64(row), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def unpacked(batch: pa.RecordBatch, items: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of each row's block."""
    for row in batch.column(items):
        block = row.values
        vectors = block.field("v")
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        yield block.field("id").to_numpy(zero_copy_only=False), flat.reshape(len(block), -1)
