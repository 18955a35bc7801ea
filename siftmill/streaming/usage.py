"""Requests and tokens per minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill import settings


def usage_windows(
    df: DataFrame, ts: str = "ts", tokens: str = "tokens", width: str = "60 seconds",
    late: str = "60 seconds",
) -> DataFrame:
    """(start, requests, tokens) per aligned window, for tables and for streams.

    Windows are summed per task before they are shuffled.
    """
    timed = df.withWatermark(ts, late) if df.isStreaming else df
    summed = timed.groupBy(F.window(ts, width).alias("w")).agg(
        F.count("*").alias("requests"), F.sum(tokens).alias("tokens")
    )
    return summed.select(F.col("w.start").alias("start"), "requests", "tokens")


def over_budget(
    windows: DataFrame, requests: int = settings.REQUESTS_PER_MINUTE,
    tokens: float = settings.TOKENS_PER_MINUTE,
) -> DataFrame:
    """Windows that pass either limit."""
    return windows.where((F.col("requests") > requests) | (F.col("tokens") > tokens))
