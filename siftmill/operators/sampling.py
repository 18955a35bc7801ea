"""Seeded samples, caps, quotas and splits.

Random choice is the order of md5(seed:key): the same rows whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.operators.ranking import (
    last_within,
    mark_seeded,
    positions,
    prefix_layout,
    prefix_rows,
    seeded_hash,
    seeded_positions,
    take_seeded,
)
from siftmill.session import durable, small_or_same


def bernoulli(df: DataFrame, key: str, rate: float, seed: int = settings.SEED) -> DataFrame:
    """Each row with probability `rate`."""
    if rate >= 1.0:
        return df
    limit = f"{int(rate * 16**8):08x}"
    return df.where(F.substring(seeded_hash(key, seed), 1, 8) < limit)


def sample_n(df: DataFrame, key: str, n: int, seed: int = settings.SEED) -> DataFrame:
    """Exactly n rows; all of them if there are no more."""
    return take_seeded(df, key, n, seed=seed)


def shuffled(df: DataFrame, key: str, seed: int = settings.SEED) -> DataFrame:
    """Add `pos`, the place in a random order."""
    return seeded_positions(df, key, seed)


def quotas(
    df: DataFrame, group: str,
    per_group: int = settings.QUOTA_PER_GROUP,
    low: int = settings.QUOTA_FLOOR, high: int = settings.QUOTA_CEILING,
) -> DataFrame:
    """(group, n, quota): the share of each group in the target, held between two bounds."""
    counted = small_or_same(df.groupBy(group).agg(F.count("*").alias("n")))
    return quotas_of_counts(counted, group, per_group, low, high)


def quotas_of_counts(
    counted: DataFrame, group: str,
    per_group: int = settings.QUOTA_PER_GROUP,
    low: int = settings.QUOTA_FLOOR, high: int = settings.QUOTA_CEILING,
) -> DataFrame:
    total = counted.agg(F.sum("n")).scalar()
    target = counted.agg(F.count("*") * per_group).scalar()
    share = F.floor(F.col("n") / total * target)
    return counted.select(
        group, "n", F.greatest(F.lit(low), F.least(share, F.lit(high))).cast("long").alias("quota")
    )


def until_quota(
    df: DataFrame, group: Sequence[str], order: Sequence[str], size: str, quota: Column
) -> DataFrame:
    """Whole rows in order until their sizes reach the quota; the last one may pass it."""
    return prefix_rows(prefix_layout(df, order, size, group), order, group, quota)


def _exempt(author: str, exempt: Sequence[str]) -> Column:
    return F.coalesce(F.col(author).isin(*exempt), F.lit(True))


def author_cap(
    df: DataFrame, author: str, order: Sequence[str],
    cap: int = settings.AUTHOR_CAP, exempt: Sequence[str] = settings.EXEMPT_AUTHORS,
) -> DataFrame:
    """The first `cap` rows per author; exempt and missing authors keep all.

    Exempt rows never enter the window, and the rank filter also runs before the shuffle, so
    neither a prolific author nor the unknown one fills a task.
    """
    free = _exempt(author, exempt)
    rank = F.row_number().over(W.partitionBy(author).orderBy(*order))
    named = df.where(~free).withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")
    return named.unionByName(df.where(free))


def cap_then_quota(
    df: DataFrame, author: str, group: str, order: Sequence[str], size: str, quota: int,
    cap: int = settings.AUTHOR_CAP, exempt: Sequence[str] = settings.EXEMPT_AUTHORS,
) -> DataFrame:
    """Author cap over the whole table in order, then a quota per group."""
    capped = author_cap(df, author, order, cap, exempt)
    return until_quota(capped, [group], order, size, F.lit(quota))


def cap_and_quota(
    df: DataFrame, author: str, group: str, order: Sequence[str], size: str,
    wanted: Sequence[tuple[str, int]] | DataFrame,
    cap: int = settings.AUTHOR_CAP, exempt: Sequence[str] = settings.EXEMPT_AUTHORS,
) -> DataFrame:
    """Groups read one after another, each until its quota; the author cap holds across them.

    A row cut off by a full quota uses no slot of its author, so where a group ends depends on
    where the groups before it end. All ends are computed together from the ends of the last
    round, starting without any. The first group is right after one round, the second after
    two, and so on; ends that repeat themselves are the only possible ones. Most tables
    settle in a few rounds, and none takes more than there are groups.

    `wanted` is a list of (group, quota) in reading order, or a table (group, quota) of any size
    whose groups are read in order of their names.
    """
    free = _exempt(author, exempt)
    if isinstance(wanted, DataFrame):
        named = wanted.select(F.col(group).alias("_name"), F.col("quota").alias("_quota"))
        plan = durable(positions(named.where("_name IS NOT NULL"), ["_name"], name="_g"))
    else:
        names, quotas_ = zip(*wanted)
        plan = df.sparkSession.createDataFrame(pa.table({
            "_name": pa.array(names),
            "_g": pa.array(range(len(names)), pa.int64()),
            "_quota": pa.array(quotas_, pa.int64()),
        }))
    groups = plan.count()
    listed = df.join(plan.drop("_quota"), F.col(group) == F.col("_name")).drop("_name")
    # Only the first `cap` rows of an author in a group can ever be taken.
    rank = F.row_number().over(W.partitionBy(author, "_g").orderBy(*order))
    named = listed.where(~free).withColumn("_r", rank).where(F.col("_r") <= cap)
    rows = named.unionByName(listed.where(free).withColumn("_r", F.lit(0)))
    layout = prefix_layout(rows, order, size, ["_g"])

    def open_rows(ends: DataFrame | None) -> DataFrame:
        """Rows whose author has a slot left, given where the earlier groups end."""
        if ends is None:
            read = layout.withColumn("_read", F.lit(1))
        else:
            inside = F.col("last").isNull() | (F.struct(*order) <= F.col("last"))
            read = layout.join(ends, "_g", "left").withColumn("_read", inside.cast("int"))
            read = read.drop("last")
        earlier = W.partitionBy(author).orderBy("_g").rangeBetween(W.unboundedPreceding, -1)
        used = F.coalesce(F.sum("_read").over(earlier), F.lit(0))
        slots = read.where(~free).withColumn("_used", used).where(
            F.col("_used") + F.col("_r") <= cap
        )
        return slots.drop("_used").unionByName(read.where(free))

    ends, before = None, None
    for _ in range(groups + 1):
        found = durable(last_within(
            open_rows(ends), order, "_g", plan.select("_g", "_quota"), "_quota"
        ))
        held = tuple(found.agg(
            F.count("*"), F.sum(F.xxhash64("_g", "last").cast("decimal(38,0)"))
        ).first())
        if held == before:
            break
        before, ends = held, found
    return open_rows(ends).where("_read = 1").select(*df.columns)


def replicate(df: DataFrame, times: int, first: int = 1) -> DataFrame:
    """Every row `times` times, told apart by `copy_id`."""
    last = first + times - 1
    return df.withColumn("copy_id", F.explode(F.sequence(F.lit(first), F.lit(last))))


def balanced_safe(
    safe: DataFrame, risk_rows: Column, key: str, neutral_ok: Column,
    sad: str = "sad", happy: str = "happy", seed: int = settings.SEED,
) -> DataFrame:
    """Safe rows in proportion to the risk rows: sad ones three times, happy ones twice.

    A row that is both is drawn on each side. `copy_id` tells the copies of a row apart:
    1-3 sad, 4-5 happy, 0 neutral.
    """
    sad_take = F.floor(risk_rows * 1.0 / 3)
    happy_take = F.floor(F.floor(risk_rows * 0.5) / 2)
    sads = take_seeded(safe.where(F.col(sad)), key, sad_take, seed=seed)
    happies = take_seeded(safe.where(F.col(happy)), key, happy_take, seed=seed)
    rest = safe.where(~F.col(sad) & ~F.col(happy) & neutral_ok)
    neutral = take_seeded(rest, key, risk_rows, seed=seed)
    return (
        replicate(sads, 3, 1)
        .unionByName(replicate(happies, 2, 4))
        .unionByName(neutral.withColumn("copy_id", F.lit(0)))
    )


def author_split(
    df: DataFrame, author: str = "author", label: str = "binary_label",
    share: float = settings.TEST_SHARE, unknown: Sequence[str] = settings.UNKNOWN_AUTHORS,
    seed: int = settings.SEED,
) -> DataFrame:
    """Add `side`: a share of the (author, label) pairs of each label goes to test.

    Unknown authors are train, and so is an author with any pair in train.
    """
    known = ~F.coalesce(F.col(author).isin(*unknown), F.lit(True))
    pairs = df.where(known).select(author, label).distinct()
    drawn = mark_seeded(pairs, author, F.ceil(F.col("n") * share), [label], seed)
    test = (
        drawn.groupBy(author).agg(F.bool_and("picked").alias("_test")).where("_test")
    )
    # Unknown authors may hold a third of all rows; they never enter the join.
    joined = df.where(known).join(test, author, "left")
    side = F.when(F.coalesce("_test", F.lit(False)), "test").otherwise("train")
    return joined.select(*df.columns, side.alias("side")).unionByName(
        df.where(~known).select("*", F.lit("train").alias("side"))
    )


def random_split(
    df: DataFrame, key: str, share: float, seed: int = settings.SEED
) -> DataFrame:
    """Add `side`: exactly ceil(n * share) random rows are test."""
    marked = mark_seeded(df, key, F.ceil(F.col("n") * share), seed=seed)
    side = F.when(F.col("picked"), "test").otherwise("train")
    return marked.select(*df.columns, side.alias("side"))
