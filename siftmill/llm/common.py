"""What the operators of this package share: whole texts, Arrow batches, checks of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.session import scratch

# Rows and bytes of one slice of texts; a longer text is a slice of its own.
TEXT_ROWS = 1000
TEXT_BYTES = 16 << 20
# What a row counts beside its text, so that empty texts fill a slice too.
_ROW_BYTES = 32


def whole_texts(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): whole texts, null ones as the empty text; other columns stay behind."""
    return docs.select(
        F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def table_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


def slices_by_size(
    batches: Iterator[pa.RecordBatch], text: str, size: int = TEXT_BYTES, rows: int | None = None,
) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes of column `text` and of at most `rows` rows; small
    batches are put together if only bytes are bounded."""
    waiting, held = [], 0

    def together() -> pa.RecordBatch:
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
        sizes = np.cumsum(lengths.astype(np.int64) + _ROW_BYTES)
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            stop = max(int(np.searchsorted(sizes, before + size - held, "right")), start + 1)
            stop = min(stop, batch.num_rows, start + (rows or batch.num_rows))
            waiting.append(batch.slice(start, stop - start))
            held += int(sizes[stop - 1]) - before
            if rows or held >= size or stop < batch.num_rows:
                yield together()
                waiting, held = [], 0
            start = stop
    if waiting:
        yield together()


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
    rows: int = TEXT_ROWS,
) -> DataFrame:
    """`fn` over slices of at most `rows` rows and, of texts, about TEXT_BYTES; a slice may give no
    result."""
    text = "text" if dict(df.dtypes).get("text") == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if text:
            slices = slices_by_size(batches, text, rows=rows)
        else:
            slices = (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        for part in slices:
            made = fn(part)
            if made is not None and made.num_rows:
                yield made

    return df.mapInArrow(run, schema)


def usable_vectors(
    vectors: DataFrame, ident: str = "vec_id", vec: str = "embedding", zero: bool = False
) -> DataFrame:
    """(vec_id, vec): rows with an id whose vector is neither null nor empty nor holds null, NaN or
    infinite components, as doubles; the zero vector stays if `zero`."""
    wide = F.transform(F.col(vec), lambda x: x.cast("double"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), wide.alias("vec")).where(
        F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite
    )
    return rows if zero else rows.where(F.exists("vec", lambda x: x != 0))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: compressed, unlike a checkpoint."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
