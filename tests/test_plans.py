"""Physical plans: pruned scans, pushed filters, filters on ranks before the shuffle."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from siftmill import session
from siftmill.operators import filters, ranking, sampling
from siftmill.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_the_named_columns(spark, small):
    plan = plan_of(tables.scan(spark, f"{small}/documents.parquet", ["doc_id", "lang"]))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_period_is_pushed_to_the_scan(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    plan = plan_of(filters.in_period(events, "value", 1.0, 2.0).select("event_id"))
    assert "GreaterThanOrEqual(value,1.0)" in plan and "LessThanOrEqual(value,2.0)" in plan


def test_cap_limits_groups_before_the_shuffle(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn(
        "author", F.col("event_type")
    )
    plan = plan_of(sampling.author_cap(events, "author", ["ts", "event_id"]))
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_seeded_sample_does_not_shuffle_the_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    picked = ranking.take_seeded(docs, "doc_id", F.ceil(F.col("n") * 0.5), ["lang"])
    main = plan_of(picked)
    assert "text" in main and "Exchange hashpartitioning" not in main


def test_conversation_pairs_join_on_place(spark, medium):
    from siftmill.operators import turns

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(turns.turn_pairs(spark.read.parquet(f"{medium}/conversations.parquet")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(conv_id" in plan and "place" in plan and "Window" not in plan


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        session.shared_folder(fake)


def test_only_small_tables_are_spread(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert "Exchange" in plan_of(session.spread(docs, "doc_id"))
    monkeypatch.setattr(session, "_SPREAD_BELOW", 1)
    assert "Exchange" not in plan_of(session.spread(docs, "doc_id"))


def test_lists_are_never_cut(spark):
    with pytest.raises(ValueError):
        session.listed(spark.range(11), 10)
    assert len(session.listed(spark.range(10), 10)) == 10


def test_big_side_tables_are_not_broadcast(spark):
    assert "LocalTableScan" in plan_of(session.small_or_same(spark.range(10), 10))
    assert "LocalTableScan" not in plan_of(session.small_or_same(spark.range(11), 10))
