"""A folder tree of CSV files with differing headers, read as one table of strings."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill import settings

_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
_OVERFLOW = "_overflow"


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The column names of one file: only its first record is read, which may span lines.

    A byte-order mark is no part of the first name.
    """
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        while (line := reader.readLine()) is not None:
            lines.append(line)
            if sum(part.count('"') for part in lines) % 2 == 0:
                break
    finally:
        stream.close()
    record = "\n".join(lines).removeprefix("\ufeff")
    return tuple(next(csv.reader(io.StringIO(record, newline="")))) if record else ()


_NUMBER, _PATH = "_number", "_path"


def _read(spark: SparkSession, paths: list[str], names: tuple[str, ...]) -> DataFrame:
    """Files of one layout. A line with more fields than the header is dropped; a line with
    fewer keeps nulls."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _OVERFLOW)])
    rows = spark.read.options(**_OPTIONS).option("columnPruning", "false").schema(schema).csv(paths)
    numbered = rows.withColumn(_NUMBER, F.monotonically_increasing_id()).withColumn(
        _PATH, F.col("_metadata.file_path")
    )
    return numbered.where(F.col(_OVERFLOW).isNull()).drop(_OVERFLOW)


def _named(rows: DataFrame, root: str, name: str) -> DataFrame:
    """Add `name`: the path of the file below `root` and the row's number in the file.

    A file is read by one task from its first line on, so a number less the least one of its file
    does not depend on how files are dealt out.
    """
    first = rows.groupBy(_PATH).agg(F.min(_NUMBER).alias("_first"))
    number = (F.col(_NUMBER) - F.col("_first")).cast("string")
    below = F.regexp_replace(_PATH, "^" + re.escape(root) + "/?", "")
    return rows.join(first, _PATH).withColumn(name, F.concat_ws("_", below, number)).drop("_first")


def read_csv_tree(
    spark: SparkSession,
    root: str,
    required: Sequence[str] = (),
    skip_files: Sequence[str] = settings.SKIPPED_CSV_FILES,
    row_name: str | None = None,
) -> DataFrame:
    """All CSV files below `root` but the skipped ones and those without a required column.

    `row_name` adds a column that names each row by the path of its file below `root` and its
    number in the file, as a default for rows without an id; another cluster gives the same names.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .load(root)
        .select("path")
    )
    # One short string per file reaches the driver, no content.
    paths = sorted(r["path"] for r in listed.collect())
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        if path.rsplit("/", 1)[-1] in skip_files:
            continue
        names = _header(spark, path)
        if names and set(required) <= set(names):
            layouts.setdefault(names, []).append(path)
    if not layouts:
        raise ValueError(f"no CSV file with the columns {list(required)} below {root}")
    tables = [_read(spark, files, names) for names, files in layouts.items()]
    if row_name:
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        base = system.makeQualified(where).toString()
        tables = [_named(t, base, row_name) for t in tables]
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.drop(_NUMBER, _PATH) for t in tables]
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**{k: v for k, v in _OPTIONS.items() if k != "multiLine"}).csv(path)
