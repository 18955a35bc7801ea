"""Caps, quotas and splits against sequential models."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from siftmill.operators import sampling, sets
from siftmill.plans.control_groups import default_quotas


def posts(n=2000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        author = "unknown" if rng.random() < 0.3 else f"u{min(int(rng.expovariate(0.03)), 90)}"
        group = "a" if rng.random() < 0.4 else rng.choice("bcd")
        rows.append((i, author, group, rng.randint(0, 50), rng.randint(0, 4)))
    return rows


COLUMNS = "id int, author string, g string, t int, n int"


def sequential(rows, wanted, cap=5):
    """Groups in the given order, posts in (t, id) order, counters carried on."""
    used, kept = Counter(), set()
    for group, quota in wanted:
        total = 0
        for i, author, g, _, n in sorted(rows, key=lambda r: (r[3], r[0])):
            if g != group:
                continue
            if total >= quota:
                break
            if author != "unknown":
                if used[author] >= cap:
                    continue
                used[author] += 1
            kept.add(i)
            total += n
    return kept


def test_cap_and_quota_is_sequential(spark):
    rows = posts()
    df = spark.createDataFrame(rows, COLUMNS)
    for wanted in ([("c", 60), ("a", 150), ("b", 40), ("d", 10_000)], [("a", 10_000), ("b", 5)]):
        got = sampling.cap_and_quota(df, "author", "g", ["t", "id"], "n", wanted)
        assert {r["id"] for r in got.select("id").collect()} == sequential(rows, wanted)


def test_author_cap(spark):
    rows = posts()
    df = spark.createDataFrame(rows, COLUMNS).repartition(7)
    got = sampling.author_cap(df, "author", ["t", "id"]).collect()
    taken = defaultdict(list)
    for r in got:
        taken[r["author"]].append((r["t"], r["id"]))
    everything = defaultdict(list)
    for i, author, _, t, _ in rows:
        everything[author].append((t, i))
    for author, all_rows in everything.items():
        want = sorted(all_rows) if author == "unknown" else sorted(all_rows)[:5]
        assert sorted(taken[author]) == want


def test_missing_author_is_exempt(spark):
    df = spark.createDataFrame([(i, None) for i in range(9)], "id int, author string")
    assert sampling.author_cap(df, "author", ["id"]).count() == 9


def test_quota_prefix(spark):
    rows = posts()
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r["id"] for r in sampling.until_quota(df, ["g"], ["t", "id"], "n", F.lit(100)).collect()}
    for group in "abcd":
        total = 0
        for i, _, _, _, n in sorted((r for r in rows if r[2] == group), key=lambda r: (r[3], r[0])):
            assert (i in got) == (total < 100)
            total += n


def test_default_quotas(spark):
    made = [quota for _, quota in default_quotas(spark)]
    assert (len(made), sum(made)) == (50, 2_606_023)
    assert (made.count(200_000), made.count(10_000)) == (3, 9)


def test_author_split(spark):
    rows = [(i, f"a{i % 60}", int(i % 7 == 0)) for i in range(900)]
    rows += [(1000 + i, a, 1) for i, a in enumerate(["unknown", "[deleted]", "", None] * 5)]
    df = spark.createDataFrame(rows, "id int, author string, binary_label int")
    got = sampling.author_split(df).collect()
    sides = defaultdict(set)
    for r in got:
        sides[r["author"]].add(r["side"])
    assert len(got) == len(rows)
    assert all(len(s) == 1 for s in sides.values())
    assert all(sides[a] == {"train"} for a in ("unknown", "[deleted]", "", None))
    again = sampling.author_split(df.repartition(13)).collect()
    assert {(r["id"], r["side"]) for r in got} == {(r["id"], r["side"]) for r in again}


def test_balance_counts(spark):
    safe = spark.range(1000).select(
        "id", (F.col("id") % 2 == 0).alias("sad"), (F.col("id") % 3 == 0).alias("happy")
    )
    got = sampling.balanced_safe(safe, F.lit(100), "id", F.lit(True)).collect()
    kinds = Counter(
        "sad" if 1 <= r["copy_id"] <= 3 else "happy" if r["copy_id"] > 3 else "neutral" for r in got
    )
    assert kinds == {"sad": 99, "happy": 50, "neutral": 100}
    assert len({(r["id"], r["copy_id"]) for r in got}) == len(got)


def test_random_split_is_exact(spark):
    got = Counter(r["side"] for r in sampling.random_split(spark.range(1001), "id", 0.1).collect())
    assert got == {"test": 101, "train": 900}


def test_long_dictionary(spark, monkeypatch):
    rows = spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 37).alias("name"))
    short = {r["name"]: r["class_idx"] for r in sets.class_index(rows, "name").collect()}
    monkeypatch.setattr(sets, "_DICTIONARY_ROWS", 5)
    spread = {r["name"]: r["class_idx"] for r in sets.class_index(rows, "name").collect()}
    assert short == spread == {n: i for i, n in enumerate(sorted(short))}
