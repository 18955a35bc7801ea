"""Distributed positions and selections against sorted lists, with one heavy group."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftmill.operators import ranking


def heavy(spark, n=3000, parts=5):
    """A third of the rows in one group, many ties in the leading order column."""
    return spark.range(n, numPartitions=parts).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.floor(F.col("id") / 1000).alias("t"),
        (F.col("id") % 5 + 1).alias("v"),
    )


def order_of(key):
    return hashlib.md5(f"42:{key}".encode()).hexdigest(), key


def test_sums_before(spark):
    got = ranking.sums_before(
        heavy(spark), ["t", "id"], {"before": F.col("v"), "pos": F.lit(1)}, ["g"]
    ).collect()
    groups = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["t"], r["id"])):
        seen = groups[r["g"]]
        assert r["before"] == sum(seen) and r["pos"] == len(seen)
        seen.append(r["v"])
    assert len(got) == 3000


def test_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, g string")
    got = {r["id"]: r["pos"] for r in ranking.positions(df, ["id"], ["g"]).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


@pytest.mark.parametrize("parts", [1, 7])
def test_take_seeded(spark, parts):
    rows = heavy(spark, 2000, parts)
    got = ranking.take_seeded(rows, "id", F.ceil(F.col("n") * 0.15), ["g"]).collect()
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r["g"]].append(r["id"])
    for g, ids in groups.items():
        want = sorted(ids, key=order_of)[: -(-len(ids) * 15 // 100)]
        assert {r["id"] for r in got if r["g"] == g} == set(want)


@pytest.mark.parametrize("n", [0, 1, 123, 5000])
def test_take_seeded_whole(spark, n):
    got = {r["id"] for r in ranking.take_seeded(heavy(spark, 1000), "id", n).collect()}
    assert got == set(sorted(range(1000), key=order_of)[:n])


def test_seeded_positions(spark):
    got = ranking.seeded_positions(heavy(spark, 1000), "id").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["pos"])] == sorted(range(1000), key=order_of)


def test_deep_page(spark):
    got = ranking.first_rows(heavy(spark), ["t", "id"], 50, 2000).collect()
    assert [r["id"] for r in got] == list(range(2000, 2050))


@pytest.mark.parametrize("n", [9_999, 10_000, 10_001, 20_000])
def test_pages_with_ties_and_nulls(spark, n):
    df = spark.range(12_000).select(
        F.when(F.col("id") % 100 != 0, F.col("id") % 10).alias("t"), (F.col("id") % 40).alias("v")
    )
    got = [(r["t"], r["v"]) for r in ranking.first_rows(df, ["t"], n).collect()]
    assert len(got) == min(n, 12_000)
    every = Counter((None if i % 100 == 0 else i % 10, i % 40) for i in range(12_000))
    kept = Counter(got)
    assert all(kept[k] <= every[k] for k in kept)
    order = [-1 if t is None else t for t, _ in got]
    assert order == sorted(-1 if i % 100 == 0 else i % 10 for i in range(12_000))[:n]
    rest = [(r["t"], r["v"]) for r in ranking.first_rows(df, ["t"], 12_000, n).collect()]
    assert kept + Counter(rest) == every


def test_results_do_not_depend_on_partitioning(spark):
    rows = heavy(spark, 2000)
    answers = set()
    for parts, width in [(1, "3"), (9, "8"), (4, "1")]:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        df = rows.repartition(parts)
        taken = ranking.take_seeded(df, "id", F.ceil(F.col("n") * 0.3), ["g"])
        placed = ranking.positions(df, ["t", "id"], ["g"])
        answers.add((
            tuple(sorted(r["id"] for r in taken.collect())),
            tuple(sorted((r["id"], r["pos"]) for r in placed.collect())),
        ))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(answers) == 1


def test_prefix_and_last_agree(spark):
    rows = heavy(spark, 2000)
    layout = ranking.prefix_layout(rows, ["t", "id"], "v", ["g"])
    kept = ranking.prefix_rows(layout, ["t", "id"], ["g"], F.lit(300)).collect()
    limits = rows.select("g").distinct().withColumn("limit", F.lit(300))
    ends = {
        r["g"]: tuple(r["last"])
        for r in ranking.last_within(layout, ["t", "id"], "g", limits, "limit").collect()
    }
    tops = defaultdict(lambda: (-1, -1))
    totals = defaultdict(int)
    for r in kept:
        tops[r["g"]] = max(tops[r["g"]], (r["t"], r["id"]))
        totals[r["g"]] += r["v"]
    assert {g: tops[g] for g in ends} == ends
    assert all(totals[g] >= 300 for g in ends)
