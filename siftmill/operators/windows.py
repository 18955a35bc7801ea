"""Windows that open at a request instead of at a full minute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.session import durable

_MICROS = 1_000_000


def _buckets(moments: DataFrame, width: int) -> DataFrame:
    """Per window-wide stretch of the clock that holds requests: its first request and the facts
    on its neighbours that the requests in it need.

    A stretch begins a session if its first request comes more than `width` after the last request
    before it; whatever window was open then has ended, so that request opens one.
    """
    per = W.partitionBy("_g").orderBy("_b")
    held = moments.groupBy("_g", "_b").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    gap = F.col("_first") - F.lag("_last").over(per)
    known = held.withColumn("_new", F.coalesce(gap > width, F.lit(True)))
    ahead = known.select(
        "*", F.lead("_b").over(per).alias("_b1"),
        *[F.lead(F.struct("_first", "_new"), i).over(per).alias(f"_ahead{i}") for i in (1, 2)],
    )
    # The first stretch that begins after the next one has ended to take in requests.
    beyond = F.when(F.col("_b1") > F.col("_b") + 1, F.col("_ahead1")).otherwise(F.col("_ahead2"))
    return ahead.withColumn("_beyond", beyond)


def _successors(moments: DataFrame, buckets: DataFrame, width: int) -> DataFrame:
    """(_g, _at, _to): the first request more than `width` later, if the session has one."""
    requests = moments.select("_g", "_b", "_at", F.col("_at").alias("_event"))
    ends = moments.select(
        "_g", (F.col("_b") + 1).alias("_b"), (F.col("_at") + width).alias("_at"),
        F.lit(None).cast("long").alias("_event"),
    )
    # Latest first and an end before a request of its moment: the last request seen is the answer.
    seen = W.partitionBy("_g", "_b").orderBy(F.desc("_at"), F.col("_event").asc_nulls_first())
    later = requests.unionByName(ends).withColumn(
        "_later", F.last("_event", ignorenulls=True).over(seen.rowsBetween(W.unboundedPreceding, -1))
    )
    found = later.where(F.col("_event").isNull()).select(
        "_g", (F.col("_b") - 1).alias("_b"), (F.col("_at") - width).alias("_at"), "_later"
    )
    near = found.join(buckets.select("_g", "_b", "_ahead1", "_beyond"), ["_g", "_b"])
    own = F.struct(
        F.col("_later").alias("_first"),
        ((F.col("_later") == F.col("_ahead1._first")) & F.col("_ahead1._new")).alias("_new"),
    )
    target = F.when(F.col("_later").isNotNull(), own).otherwise(F.col("_beyond"))
    return near.withColumn("_t", target).where(
        F.col("_t").isNotNull() & ~F.col("_t._new")
    ).select("_g", "_at", F.col("_t._first").alias("_to"))


def _openings(moments: DataFrame, buckets: DataFrame, width: int) -> DataFrame:
    """(_g, _at): all openings, by doubling the reach of the successors.

    After round i the first 2**i openings of every session are known, so the rounds grow with the
    logarithm of the windows in the longest session.
    """
    known = buckets.where("_new").select("_g", F.col("_first").alias("_at"))
    jumps = durable(_successors(moments, buckets, width))
    while True:
        new = durable(known.join(jumps, ["_g", "_at"]).select("_g", F.col("_to").alias("_at")))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        then = jumps.select("_g", F.col("_at").alias("_to"), F.col("_to").alias("_then"))
        jumps = durable(jumps.join(then, ["_g", "_to"]).select("_g", "_at", F.col("_then").alias("_to")))


def opened_windows(
    df: DataFrame, ts: str = "ts", tokens: str = "tokens", group: Sequence[str] = (),
    seconds: int = 60,
) -> DataFrame:
    """(*group, start, requests, tokens): the first request opens a window, and so does each
    request that comes more than `seconds` after the last opening.

    Requests of the same moment are added up before anything else, so a busy moment is one row and
    a window-wide stretch of the clock holds at most `seconds` million of them. Whether a request
    opens a window hangs on all before it; sessions set apart by long gaps do not depend on each
    other, and within a session successors are doubled. Two openings never share a stretch, so
    requests find theirs by one join. Requests without a time have no window; null tokens add
    nothing (all null: null); a null group is a group; no requests, no windows.
    """
    width = seconds * _MICROS
    named = F.struct(*[F.col(c) for c in group]) if group else F.struct(F.lit(0).alias("_none"))
    timed = df.where(F.col(ts).isNotNull()).select(
        named.alias("_g"), F.unix_micros(F.col(ts)).alias("_at"), F.col(tokens).alias("_tokens")
    )
    summed = timed.groupBy("_g", "_at").agg(
        F.count("*").alias("_requests"), F.sum("_tokens").alias("_tokens")
    )
    at = F.col("_at")
    # A double holds the quotient exactly: the remainder is taken off first.
    moments = durable(summed.withColumn("_b", ((at - F.pmod(at, F.lit(width))) / width).cast("long")))
    buckets = durable(_buckets(moments, width))
    opened = _openings(moments, buckets, width).select(
        "_g", ((at - F.pmod(at, F.lit(width))) / width).cast("long").alias("_b"), at.alias("_open")
    )
    per = W.partitionBy("_g").orderBy("_b")
    both = buckets.select("_g", "_b").join(opened, ["_g", "_b"], "left").select(
        "*", F.when(F.lag("_b").over(per) == F.col("_b") - 1, F.lag("_open").over(per)).alias("_before")
    )
    start = F.when(F.col("_open") <= at, F.col("_open")).otherwise(F.col("_before"))
    placed = moments.join(both, ["_g", "_b"]).withColumn("_start", start)
    made = placed.groupBy("_g", "_start").agg(
        F.sum("_requests").alias("requests"), F.sum("_tokens").alias("tokens")
    )
    return made.select(
        *[F.col(f"_g.{c}").alias(c) for c in group], F.timestamp_micros("_start").alias("start"),
        "requests", "tokens",
    )
