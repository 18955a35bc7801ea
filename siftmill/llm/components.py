"""Connected components of a table of links, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.session import durable


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.unionByName(turned)


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least node of its neighbourhood."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = near.join(least, "a").where(F.col("b") > F.col("a"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its lower neighbours are tied to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return lower.unionByName(own).where("a <> b").distinct()


def _digest(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node reachable, for every node that has a link (a, b) to another.

    Alternating large and small stars: the rounds grow with the logarithm of the longest path,
    no node's neighbours are gathered in one place, and each round is cut by a checkpoint.
    Nulls, loops and repeated links add nothing; no links give no rows.
    """
    now = durable(links.where("a <> b").select("a", "b").distinct())
    before = _digest(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = durable(_small_star(_large_star(now)))
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return ends.unionByName(roots).distinct()
