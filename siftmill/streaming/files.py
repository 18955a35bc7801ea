"""File streams that are worked off and stop: restartable incremental forms of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill import settings
from siftmill.operators.filters import chunk_rows
from siftmill.operators.scoring import Scorer, silver_labels


def arriving(
    spark: SparkSession, folder: str, schema: T.StructType,
    pattern: str | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def append_available(stream: DataFrame, out: str, progress: str) -> None:
    """Append all that has arrived to `out`; `progress` remembers what is done."""
    started = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    started.awaitTermination()


def stream_chunks(stream: DataFrame, column: str, keys: list[str], out: str, progress: str) -> None:
    """Chunks of arriving texts."""
    append_available(chunk_rows(stream, column, keys), out, progress)


def stream_silver(
    stream: DataFrame, ident: str, column: str, load: Callable[[], Scorer], out: str,
    progress: str, temperature: float = settings.TEMPERATURE,
) -> None:
    """Silver labels of arriving texts."""
    made = silver_labels(stream, ident, column, load, temperature=temperature)
    append_available(made, out, progress)


def each_page(
    stream: DataFrame, page: Callable[[DataFrame, int], None], progress: str
) -> None:
    """Hand every page of arriving rows to a callback with its number."""
    started = (
        stream.writeStream.foreachBatch(page).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    started.awaitTermination()


def append_pages(stream: DataFrame, vector: str, out: str, progress: str) -> None:
    """Rows that have a vector, one folder per page.

    A page that is run again overwrites its own folder, so a replay adds nothing.
    """

    def page(rows: DataFrame, number: int) -> None:
        kept = rows.where(F.col(vector).isNotNull())
        kept.write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    each_page(stream, page, progress)
