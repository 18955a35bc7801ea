"""Exact positions, running sums and seeded selections without a one-task group.

A window over a whole group puts the group into one task. Two ways around it:

* any order: cut the table into ranges of (group, order), keep the cut durable, add up each
  range, and start every range at the sum of the ranges before it;
* seeded order: rows are ordered by md5, whose leading digits are evenly spread, so they
  serve as ranges without any sampling or materialisation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.session import durable, shuffle_width, small_or_same

_PART = "_part"
_HASH = "_hash"
_BUCKET = "_bucket"


def _before(window):
    return window.rowsBetween(W.unboundedPreceding, -1)


def _offsets(totals: DataFrame, group: Sequence[str], part: str, names: Sequence[str]) -> DataFrame:
    """Sums over earlier ranges of the group: one row per range, never one per row of data."""
    ordered = _before(W.partitionBy(*group).orderBy(part) if group else W.partitionBy(F.lit(0)).orderBy(part))
    return totals.select(
        *[F.col(c).alias(f"_o_{c}") for c in (*group, part)],
        *[F.coalesce(F.sum(f"_t_{n}").over(ordered), F.lit(0)).alias(f"_o_{n}") for n in names],
        *[f"_t_{n}" for n in names],
    )


def _with_offsets(df: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = F.lit(True)
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_o_{key}"))
    return df.join(small_or_same(offsets), on, "inner").drop(*[f"_o_{k}" for k in keys])


def _ranged(df: DataFrame, order, group, values: Mapping[str, Column]) -> DataFrame:
    width = shuffle_width(df.sparkSession)
    return (
        df.select("*", *[values[n].alias(f"_v_{n}") for n in values])
        .repartitionByRange(width, *group, *order)
        .withColumn(_PART, F.spark_partition_id())
    )


def _range_sums(ranged: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per range (_o_group, _o__part) the sum before it (_o_name) and its own sum (_t_name)."""
    keys = [*group, _PART]
    totals = ranged.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    return _offsets(totals, group, _PART, names)


def sums_before(
    df: DataFrame,
    order: Sequence[str],
    values: Mapping[str, Column],
    group: Sequence[str] = (),
) -> DataFrame:
    """Add, per name, the sum of its value over the earlier rows of the group.

    `order` must name a row uniquely within its group. Hand over slim rows: they are written
    once to the shared folder.
    """
    names = list(values)
    keys = [*group, _PART]
    ranged = durable(_ranged(df, order, group, values))
    joined = _with_offsets(ranged, _range_sums(ranged, group, names), keys)
    inside = _before(W.partitionBy(*keys).orderBy(*order))
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))).alias(n)
            for n in names
        ],
    )


def prefix_layout(
    df: DataFrame, order: Sequence[str], size: str, group: Sequence[str] = ()
) -> DataFrame:
    """Rows in ranges of (group, order), kept durable: the input of `prefix_rows`."""
    return durable(_ranged(df, order, group, {"s": F.col(size).cast("long")}))


def prefix_rows(
    layout: DataFrame, order: Sequence[str], group: Sequence[str], limit: Column
) -> DataFrame:
    """Rows of a layout (or of a part of it) whose sizes before them stay below the limit.

    Ranges below the limit are kept and ranges above it dropped as a whole; only the range the
    limit falls into, one per group, needs a running sum.
    """
    keys = [*group, _PART]
    columns = [c for c in layout.columns if c not in (_PART, "_v_s")]
    sums = _range_sums(layout, group, ["s"]).where(F.col("_o_s") < limit)
    near = _with_offsets(layout, sums, keys)
    whole = F.col("_o_s") + F.col("_t_s") <= limit
    inside = _before(W.partitionBy(*keys).orderBy(*order))
    running = F.col("_o_s") + F.coalesce(F.sum("_v_s").over(inside), F.lit(0))
    edge = near.where(~whole).withColumn("before", running).where(F.col("before") < limit)
    return near.where(whole).select(*columns).unionByName(edge.select(*columns))


def last_within(
    layout: DataFrame, order: Sequence[str], group: str, limits: DataFrame, limit: str
) -> DataFrame:
    """(group, last): the last row whose sizes before it stay below the limit.

    Groups that never reach their limit are left out. `limits` holds (group, limit).
    """
    sums = _range_sums(layout, [group], ["s"])
    ends = F.col("_o_s") + F.col("_t_s")
    crossed = sums.join(limits, F.col(f"_o_{group}") == F.col(group)).where(
        (F.col("_o_s") < F.col(limit)) & (ends >= F.col(limit))
    )
    near = _with_offsets(layout, crossed.drop(group), [group, _PART])
    inside = _before(W.partitionBy(group, _PART).orderBy(*order))
    running = F.col("_o_s") + F.coalesce(F.sum("_v_s").over(inside), F.lit(0))
    kept = near.withColumn("before", running).where(F.col("before") < F.col(limit))
    return kept.groupBy(group).agg(F.max(F.struct(*order)).alias("last"))


def positions(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row in its group (or in the table)."""
    return sums_before(df, order, {name: F.lit(1).cast("long")}, group)


def seeded_hash(key: str, seed: int = settings.SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _hashed(df: DataFrame, key: str, seed: int, digits: int) -> DataFrame:
    return df.withColumn(_HASH, seeded_hash(key, seed)).withColumn(
        _BUCKET, F.substring(_HASH, 1, digits)
    )


def seeded_positions(
    df: DataFrame,
    key: str,
    seed: int = settings.SEED,
    group: Sequence[str] = (),
    name: str = "pos",
    digits: int = 3,
) -> DataFrame:
    """0-based position in the seeded order; 16**digits ranges per group."""
    hashed = _hashed(df, key, seed, digits)
    keys = [*group, _BUCKET]
    totals = hashed.groupBy(*keys).agg(F.count("*").alias("_t_n"))
    joined = _with_offsets(hashed, _offsets(totals, group, _BUCKET, ["n"]), keys)
    inside = W.partitionBy(*keys).orderBy(_HASH, key)
    return joined.select(
        *df.columns, (F.col("_o_n") + F.row_number().over(inside) - 1).alias(name)
    )


def seeded_cut(
    df: DataFrame,
    key: str,
    take: Column,
    strata: Sequence[str] = (),
    seed: int = settings.SEED,
    digits: int = 3,
) -> DataFrame:
    """Per stratum the hash and key of the last row among the first `take` in seeded order.

    `take` may read `n`, the size of the stratum. Counts per leading digits find the range
    the cut falls into; only the rows of that range are ranked.
    """
    hashed = _hashed(df.select(*strata, key), key, seed, digits)
    counted = hashed.groupBy(*strata, _BUCKET).agg(F.count("*").alias("c"))
    per = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(0))
    placed = counted.select(
        *strata,
        _BUCKET,
        F.coalesce(F.sum("c").over(_before(per.orderBy(_BUCKET))), F.lit(0)).alias("before"),
        F.sum("c").over(per).alias("n"),
    ).withColumn("take", take.cast("long"))
    edge = (
        placed.where(F.col("before") < F.col("take"))
        .groupBy(*strata)
        .agg(
            F.max(_BUCKET).alias("edge"),
            F.max_by(F.col("take") - F.col("before"), F.col(_BUCKET)).alias("need"),
        )
    )
    if strata:
        near = hashed.join(edge, list(strata)).where(F.col(_BUCKET) == F.col("edge"))
    else:
        found = edge.select(F.struct("edge", "need")).scalar()
        near = hashed.where(F.col(_BUCKET) == found["edge"]).withColumn("need", found["need"])
    ranked = near.withColumn(
        "r", F.row_number().over(W.partitionBy(*strata, _BUCKET).orderBy(_HASH, key))
    ).where(F.col("r") <= F.col("need"))
    return ranked.groupBy(*strata).agg(
        F.max(F.struct(F.col(_HASH).alias("h"), F.col(key).alias("k"))).alias("cut")
    )


def mark_seeded(
    df: DataFrame,
    key: str,
    take: Column,
    strata: Sequence[str] = (),
    seed: int = settings.SEED,
    name: str = "picked",
) -> DataFrame:
    """Flag exactly the first `take` rows per stratum of the seeded order.

    The wide rows are never shuffled: they are compared with one cut per stratum.
    """
    cut = seeded_cut(df, key, take, strata, seed)
    own = F.struct(seeded_hash(key, seed).alias("h"), F.col(key).alias("k"))
    if strata:
        joined = df.join(small_or_same(cut), list(strata), "left")
        return joined.select(*df.columns, F.coalesce(own <= F.col("cut"), F.lit(False)).alias(name))
    limit = cut.select("cut").scalar()
    return df.withColumn(name, F.coalesce(own <= limit, F.lit(False)))


def take_seeded(df, key, take, strata=(), seed=settings.SEED) -> DataFrame:
    """Exactly the first `take` rows (a number or a column over `n`) of each stratum."""
    wanted = F.lit(take) if isinstance(take, int) else take
    return mark_seeded(df, key, wanted, strata, seed, "_picked").where("_picked").drop("_picked")


_KEY = "_key"


def row_key(*columns: str) -> Column:
    """128 bits that name a row by its values, nulls among them."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(settings.SEED), *columns).alias("b"))


def first_rows(df: DataFrame, order: Sequence[str], n: int, skip: int = 0) -> DataFrame:
    """Rows skip..skip+n-1 in order, nulls first; the page comes back in that order.

    Rows that the order columns do not tell apart follow each other by a hash of their values, so
    the page is exact whatever repeats. The places are counted on a table of order columns, hash
    and number of equal rows; only the rows of the page are sorted.
    """
    clear = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(
        {_KEY: row_key(*df.columns), **{c: F.col(o) for c, o in zip(clear, order)}}
    )
    counted = keyed.groupBy(*clear, _KEY).agg(F.count("*").alias("_n"))
    placed = sums_before(counted, [*clear, _KEY], {"_at": F.col("_n")})
    until = F.least(F.col("_at") + F.col("_n"), F.lit(skip + n))
    cut = placed.withColumn("_take", until - F.greatest(F.col("_at"), F.lit(skip)))
    page = cut.where(F.col("_take") > 0)
    same = F.lit(True)
    for c in (*clear, _KEY):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))

    def rows(chosen: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        met = keyed.alias("l").join(chosen.alias("r"), same)
        return met.select(*[F.col(f"l.`{c}`") for c in keyed.columns], *[F.col(f"r.{c}") for c in extra])

    whole = rows(page.where("_take = _n"))
    # Of equal rows at an end of the page some stay: one of them, as often as needed.
    edge = rows(page.where("_take < _n"), ["_take"]).groupBy(*clear, _KEY).agg(
        *[F.any_value(c).alias(c) for c in df.columns], F.any_value("_take").alias("_take")
    )
    edge = edge.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_take"))))
    both = whole.unionByName(edge.drop("_take", "_i"))
    return both.orderBy(*clear, _KEY).select(*df.columns)
