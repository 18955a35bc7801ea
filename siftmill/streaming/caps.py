"""Author cap that holds across the pages of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.sources.sinks import exists
from siftmill.streaming.files import each_page


def _counts_before(spark: SparkSession, author: str, folder: str, page: int) -> DataFrame | None:
    """Slots used by the pages before `page`; every page leaves a table of what it used."""
    paths = [f"{folder}/page={n}" for n in range(page)]
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise RuntimeError(f"the counts of {len(missing)} earlier pages are missing, e.g. {missing[-1]}")
    if not paths:
        return None
    return spark.read.parquet(*paths).groupBy(author).agg(F.sum("_used").alias("_used"))


def stream_author_cap(
    stream: DataFrame, author: str, order: Sequence[str], out: str, counts: str, progress: str,
    cap: int = settings.AUTHOR_CAP, exempt: Sequence[str] = settings.EXEMPT_AUTHORS,
) -> None:
    """Keep the first `cap` rows per author over all pages; exempt authors keep all.

    Inside a page at most `cap` rows per author and task reach the shuffle. The slots used so
    far are a table in the shared folder, so neither one author nor all of them have to fit
    into a task's state, and a page that is run again gives the same rows.
    """

    def page(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        used = _counts_before(spark, author, counts, number)
        free = F.coalesce(F.col(author).isin(*exempt), F.lit(True))
        rank = F.row_number().over(W.partitionBy(author).orderBy(*order))
        named = rows.where(~free).withColumn("_r", rank).where(F.col("_r") <= cap)
        if used is not None:
            named = named.join(used, author, "left").where(
                F.col("_r") + F.coalesce("_used", F.lit(0)) <= cap
            )
        target = f"{out}/batch_id={number}"
        named.select(*rows.columns).unionByName(rows.where(free)).write.mode("overwrite").parquet(
            target
        )
        kept = spark.read.parquet(target).where(~free)
        now = kept.groupBy(author).agg(F.count("*").alias("_used"))
        now.write.mode("overwrite").parquet(f"{counts}/page={number}")

    each_page(stream, page, progress)
