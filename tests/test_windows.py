"""Windows that open at the first request, against a sequential model."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftmill.operators.windows import opened_windows


def model(rows, seconds):
    """{(group, start): (requests, tokens)}, one request after the other."""
    made, opened = {}, {}
    for group, at, tokens in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if group not in opened or at - opened[group] > seconds * 1_000_000:
            opened[group] = at
        n, total = made.get((group, opened[group]), (0, 0))
        made[group, opened[group]] = (n + 1, total + tokens)
    return made


def run(spark, rows, seconds):
    df = spark.createDataFrame(rows, "who string, at long, tokens long").select(
        "who", F.timestamp_micros("at").alias("ts"), "tokens")
    got = opened_windows(df, group=["who"], seconds=seconds).withColumn("start", F.unix_micros("start"))
    return {(r["who"], r["start"]): (r["requests"], r["tokens"]) for r in got.collect()}


@pytest.mark.parametrize("seconds,step", [(60, 10_000_000), (7, 9_000_000)])
def test_against_the_model(spark, seconds, step):
    """Dense and sparse groups, a null one, repeated moments, ends that a request meets exactly."""
    rng = random.Random(seconds)
    rows = []
    for group, pace in (("dense", step // 20), ("usual", step), ("sparse", step * 9), (None, step)):
        at = rng.randrange(10**9)
        for _ in range(250):
            rows.append((group, at, rng.randrange(9)))
            at += rng.choice([0, rng.randrange(pace), rng.randrange(pace), seconds * 1_000_000])
    rows += [("before 1970", -at, 1) for at in range(0, 900_000_000, 20_000_000)]
    assert run(spark, rows, seconds) == model(rows, seconds)


def test_exact_end_and_the_microsecond_after(spark):
    rows = [("a", 5, 1), ("a", 60_000_005, 1), ("b", 5, 1), ("b", 60_000_006, 1)]
    assert run(spark, rows, 60) == {("a", 5): (2, 2), ("b", 5): (1, 1), ("b", 60_000_006): (1, 1)}


def test_no_times_and_no_requests(spark):
    schema = "ts timestamp, tokens double"
    assert opened_windows(spark.createDataFrame([], schema)).count() == 0
    assert opened_windows(spark.createDataFrame([(None, 1.0)], schema)).count() == 0
