"""Session settings, shared folders and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 4096 vectors of 1536 floats are 25 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}
_AT_START = {
    # Checkpoints go when no DataFrame needs them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "siftmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **_AT_START}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _is_local(spark: SparkSession) -> bool:
    """Driver and tasks in one process; local clusters are none."""
    return re.match(r"local($|\[)", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by `spark.checkpoint.dir`.

    Only a local session may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named or context.getCheckpointDir()
    if root is None:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siftmill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def durable(df: DataFrame) -> DataFrame:
    """Compute once and keep the rows in the shared folder.

    The result survives the loss of executors, and partition ids taken before the call stay
    what they were.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


_SPREAD_BELOW = 16 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a small table over the cores before heavy work on its rows.

    A file of one row group is one task. The estimated size decides without running anything:
    from 16 MB per core on, the scan has enough tasks and passes without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * _SPREAD_BELOW else df.repartition(cores, *keys)


def shuffle_width(spark: SparkSession) -> int:
    """Tasks for an explicit repartition: the session's shuffle width, not below the cores."""
    cores = spark.sparkContext.defaultParallelism
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cores if _is_local(spark) else max(width, cores)


def small_or_same(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast copy if `df` has at most `rows` rows, else `df` itself for a shuffled join."""
    held = df.limit(rows + 1).toArrow()
    if held.num_rows > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(held, df.schema))


def listed(df: DataFrame, rows: int = 10_000) -> list:
    """All rows of a configuration-sized table; an error, never a cut, if there are more."""
    held = df.limit(rows + 1).collect()
    if len(held) > rows:
        raise ValueError(f"more than {rows} rows where a short list is expected")
    return held
