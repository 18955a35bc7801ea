"""Fill a chunk table with vectors, in as many runs as it takes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from siftmill.operators import filters, scoring
from siftmill.sources import sinks


def populate(
    chunks: DataFrame, keys: Sequence[str], load: Callable, path: str, column: str = "input"
) -> DataFrame:
    """Embed the chunks that the table at `path` does not hold yet and append them.

    Chunks whose embedding failed are not stored, so the next run tries them again; a run that
    was cut off goes on with what is missing.
    """
    todo = filters.strip_nul(sinks.remaining(chunks, path, keys))
    sinks.append_valid(scoring.embed_column(todo, column, load), path)
    return chunks.sparkSession.read.parquet(path)


def start_over(spark, path: str) -> str:
    """The path of a fresh, empty version next to the tables of earlier versions."""
    n = 1
    while sinks.exists(spark, sinks.version(path, n)):
        n += 1
    return sinks.version(path, n)
