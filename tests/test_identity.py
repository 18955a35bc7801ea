"""Row numbers kept as a table, and the sets compiled from rows without a key."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.operators.identity import numbered
from siftmill.plans import compile as compiling
from siftmill.session import scratch
from siftmill.sources import sinks


def test_numbers_follow_the_order(spark):
    df = spark.range(5000, numPartitions=7).select(
        F.when(F.col("id") % 10 != 0, (F.col("id") * 7919) % 1000).alias("at"), F.col("id").cast("string").alias("name"),
    )
    got = numbered(df, ["at"]).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(5000))
    held = [r["at"] for r in got]
    assert held == sorted(held, key=lambda x: (x is not None, x or 0)) and held[499] is None


def test_equal_rows_get_numbers_of_their_own(spark):
    """A third of the rows are copies of one; nulls, empty text, arrays and structs are values."""
    df = spark.range(3000, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("post_id"),
        F.when(F.col("id") % 3 == 1, F.array(F.col("id").cast("float"))).alias("embedding"),
        F.lit("old").alias("row"),
    )
    made = numbered(df, ["post_id"])
    first = {r["row"]: r["post_id"] for r in made.collect()}
    assert sorted(first) == list(range(3000)) and made.columns == ["post_id", "embedding", "row"]
    assert {r["row"]: r["post_id"] for r in made.repartition(3).collect()} == first
    assert all(first[i] is None for i in range(1000)) and all(first[i] == "" for i in range(1000, 2000))


def test_empty_table_and_own_column_names(spark):
    df = spark.range(0).withColumnRenamed("id", "post_id")
    assert numbered(df, ["post_id"]).count() == 0
    twice = numbered(numbered(spark.range(40), ["id"]), ["id"], "again")
    assert twice.where("row <> again or row <> id").count() == 0


def snapshot(spark, rows):
    n = F.col("id")
    return spark.range(rows).select(
        F.concat(F.lit("p"), n).alias("post_id"), F.concat(F.lit("text "), n).alias("input"),
        F.array(F.cos(n).cast("float"), F.sin(n).cast("float")).alias("embedding"),
        F.concat(F.lit("c"), n % 3).alias("subreddit"), F.concat(F.lit("u"), n % 90).alias("author"),
        F.struct(F.lit(0.1).alias("negative"), F.lit(0.1).alias("positive")).alias("emotion_scores"),
        (n % 2).alias("_kind"),
    )


OPTIONS = compiling.CompileOptions(neighbours=3, label_neighbours=3, risk_density=-1.0, safe_density=-1.0)


def stored(spark, rows):
    path = scratch(spark, "snapshot")
    made = snapshot(spark, rows)
    sinks.write_snapshot(
        {"mental_health_posts": made.where("_kind = 1"), "safe_posts": made.where("_kind = 0")}, path
    )
    return path


def test_snapshot_to_files(spark):
    made = compiling.compile_snapshot(stored(spark, 400), scratch(spark, "sets"), spark, options=OPTIONS)
    counts = {r["side"]: r["n"] for r in made.rows.groupBy("side").agg(F.count("*").alias("n")).collect()}
    assert counts["train"] > counts["test"] > 0
    width = made.classes.count()
    wrong = made.rows.where(
        (F.size("soft_label") != width) | ~F.startswith("text", F.lit("text "))
        | (F.abs(F.aggregate("soft_label", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9)
        | (F.substring("text", 6, 9).cast("int") % 2 != F.col("label"))
    )
    assert width == 3 == made.risk_classes.count() and wrong.count() == 0


def test_any_key_and_equal_funnel(spark):
    """Text keys, and counts of the passes that equal counts of the rows."""
    rows = compiling.with_scores(snapshot(spark, 300).withColumn(
        "dataset_type", F.when(F.col("_kind") == 1, "mental_health_posts").otherwise("safe_posts")))
    made = compiling.compile_sets(rows, "post_id", options=OPTIONS)
    counts = {r["stage"]: r["rows"] for r in made.funnel.collect()}
    assert list(counts) == list(compiling.STAGES)
    assert counts["all"] == 300 and counts["risk"] + counts["safe"] == counts["train"]
    assert made.rows.where("side = 'train'").count() == counts["final_train"]
    assert made.rows.where("side = 'test'").count() == counts["test"]
    assert made.rows.select("row_id").distinct().count() == made.rows.count()


def test_empty_snapshot(spark):
    rows = compiling.with_scores(snapshot(spark, 0).withColumn("dataset_type", F.lit("safe_posts")))
    made = compiling.compile_sets(rows, "post_id", options=OPTIONS)
    assert {r["rows"] for r in made.funnel.collect()} == {0}
    assert made.shares.count() == 0
