"""Fitted models: invariants instead of fixed numbers."""

import os
import uuid

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from siftmill.catalog import models
from siftmill.catalog import views as V
from siftmill.functions import dists
from siftmill.operators import evaluation, linear, probe, reduction, scoring, student


def test_pca(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    made = reduction.fit_pca(rows, "embedding", 5)
    x = np.stack(rows.orderBy("vec_id").toPandas()["embedding"]).astype(float)
    got = np.stack(made.apply(rows, "embedding").orderBy("vec_id").toPandas()["reduced"])
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(centred @ vt[:5].T), atol=1e-5)
    basis = made.model.pc.toArray()
    assert np.allclose(basis.T @ basis, np.eye(5), atol=1e-8)
    assert np.allclose(got.var(axis=0) * len(x), s[:5] ** 2)


def test_pca_skips_narrow_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    made = reduction.fit_pca(df, "v", 2)
    assert made.model is None and made.apply(df, "v").first()["reduced"] == [1.0, 2.0]


def test_probe_beats_the_base_rate(spark, small):
    rows = models.tagged(spark, small)
    first, split = probe.fit_probe(rows, "vec_id", "embedding", "emotions", iterations=30)
    again, _ = probe.fit_probe(rows.repartition(3), "vec_id", "embedding", "emotions", iterations=30)
    assert first.classes == again.classes
    assert np.allclose(first.weights, again.weights, atol=1e-3)
    train = split.where("side = 'train'").withColumn("s", first.scores(F.col("embedding")))
    hot = probe.multi_hot(F.col("emotions"), first.classes)
    pairs = train.select(F.explode(F.arrays_zip(F.col("s"), hot.alias("h"))).alias("z"))
    row = pairs.select(
        F.avg(F.when(F.col("z.h") == 1, F.col("z.s"))).alias("yes"),
        F.avg(F.when(F.col("z.h") == 0, F.col("z.s"))).alias("no"),
    ).first()
    assert row["yes"] > row["no"] + 0.1


def test_probe_solves_the_scaled_problem(spark, small):
    """The gradient of the penalised loss on standardised vectors vanishes at the solution."""
    rows = models.tagged(spark, small)
    made, split = probe.fit_probe(rows, "vec_id", "embedding", "emotions", iterations=500)
    train = split.where("side = 'train'").select(
        "embedding", probe.multi_hot(F.col("emotions"), made.classes).alias("hot")
    ).toPandas()
    x, y = np.stack(train["embedding"]).astype(float), np.stack(train["hot"]).astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / scale
    weights = made.weights * scale
    p = 1 / (1 + np.exp(-(x @ made.weights.T + made.bias)))
    gradient = z.T @ (p - y) + weights.T
    assert np.abs(gradient).max() < 0.05
    assert np.abs((p - y).sum(axis=0)).max() < 0.05


def test_student_learns(spark, small):
    rows = V.dists(spark, small).select("vec_id", "teacher").join(
        spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding"), "vec_id"
    )
    model = student.fit_student(rows, "embedding", "teacher")
    made = student.apply_student(model, rows, "embedding").withColumn(
        "uniform", F.array(*[F.lit(0.1)] * 10)
    )
    learned = evaluation.divergence(made, "teacher", "student").first()["kl"]
    flat = evaluation.divergence(made, "teacher", "uniform").first()["kl"]
    assert learned < flat / 2


def test_student_solves_the_penalised_problem(spark, small):
    """The gradient vanishes at the solution, on copied, empty and constant input too."""
    rows = V.dists(spark, small).select("vec_id", "teacher").join(
        spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding"), "vec_id"
    ).withColumn("embedding", F.concat(F.transform("embedding", lambda v: v * 50 + 1000), F.array(F.lit(3.0))))
    unscored = rows.limit(3).withColumn("teacher", F.array().cast("array<double>"))
    model = student.fit_student(rows.unionByName(unscored).repartition(7), "embedding", "teacher", iterations=200)
    held = rows.toPandas()
    x, y = np.stack(held["embedding"]).astype(float), np.stack(held["teacher"])
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0))[:, :-1] / scale[:-1]
    logits = x @ model.weights.T + model.bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    slope = p / p.sum(axis=1, keepdims=True) - y
    gradient = slope.T @ z / len(x) + 1e-3 * model.weights[:, :-1] * scale[:-1]
    assert np.abs(gradient).max() < 1e-5 and np.abs(slope.mean(axis=0)).max() < 1e-5
    assert (model.weights[:, -1] == 0).all() and model.rows == len(x) and model.gradient < 1e-5


def test_wide_vectors_are_scaled_by_variances(spark, small, monkeypatch):
    rows = models.tagged(spark, small)
    narrow, _ = probe.fit_probe(rows, "vec_id", "embedding", "emotions")
    monkeypatch.setattr(linear, "COVARIANCE_WIDTH", 8)
    wide, _ = probe.fit_probe(rows, "vec_id", "embedding", "emotions")
    assert np.allclose(narrow.weights, wide.weights, atol=1e-3)
    assert narrow.gradient < 1e-5 and wide.gradient < 1e-5


def test_fit_refuses_ragged_vectors_and_empty_tables(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0]), ([1.0], [0.0])], "x array<double>, y array<double>")
    with pytest.raises(Exception, match="different lengths"):
        linear.fit(df, "x", "y", 1, linear.logistic)
    with pytest.raises(ValueError, match="no row"):
        linear.fit(df.where("false"), "x", "y", 1, linear.logistic)


def test_weighted_scores_match_spark_ml(spark, small):
    rows = V.dists(spark, small)
    ours = evaluation.metrics(rows, "student", "teacher").first()
    pairs = rows.select(
        dists.top_class(F.col("student")).cast("double").alias("prediction"),
        dists.top_class(F.col("teacher")).cast("double").alias("label"),
    )
    names = {
        "accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall",
        "f1": "weightedFMeasure",
    }
    for mine, theirs in names.items():
        value = MulticlassClassificationEvaluator(metricName=theirs).evaluate(pairs)
        assert abs(ours[mine] - value) < 1e-9


def test_two_classes_top3_is_top1(spark):
    df = spark.createDataFrame([([0.9, 0.1], [0.2, 0.8]), ([0.6, 0.4], [1.0, 0.0])], "p array<double>, q array<double>")
    assert evaluation.top3_accuracy(df, "p", "q").first()[0] == 0.5
    made = evaluation.metrics(df, "p", "q").first()
    assert made["accuracy"] == made["top3_accuracy"] == 0.5


def test_ties_take_the_lowest_class(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    assert df.select(dists.top_class(F.col("p"))).first()[0] == 0


def test_no_threshold_scores(spark):
    df = spark.createDataFrame([(0.05, 0.1), (0.04, 0.2)], "m double, t double")
    sweep = evaluation.threshold_sweep(df, F.col("m"), F.col("t"))
    assert sweep.count() == 17
    assert tuple(evaluation.best_threshold(sweep).first()) == (0.5, 0.0)


def test_model_is_loaded_once_per_worker(spark):
    def load():
        made = uuid.uuid4().int % 10**6

        def score(texts):
            return np.array([[os.getpid(), made, len(t)] for t in texts], float)

        return score

    df = spark.range(400, numPartitions=40).select(F.col("id").cast("string").alias("t"))
    held = scoring.score_texts(df, "t", scoring.once_per_worker("counted", load), batch=3)
    rows = [tuple(r["logits"][:2]) for r in held.collect()]
    assert len(rows) == 400
    assert len(set(rows)) == len({pid for pid, _ in rows})


def test_failures_of_the_embedder_are_null(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    made = scoring.embed_column(df, "t", lambda: lambda ts: [[1 / len(t), 2] for t in ts]).collect()
    assert [r["embedding"] is None for r in made] == [False, True, True]


def test_models_see_the_first_tokens_only(spark):
    long = " ".join(f"w{i}" for i in range(600))
    df = spark.createDataFrame([(1, long + "!"), (2, "short, text")], "id int, t string")

    def load():
        return lambda texts: np.array([[len(t.split(" ")), len(t)] for t in texts], float)

    got = {r["id"]: r["logits"] for r in scoring.score_texts(df, "t", load).collect()}
    assert got[1] == [512.0, float(len(" ".join(f"w{i}" for i in range(512))))] and got[2] == [2.0, 11.0]
    whole = scoring.score_texts(df.where("id = 1"), "t", load, tokens=None).first()
    assert whole["logits"] == [600.0, float(len(long) + 1)]


def test_byte_pair_counter(spark):
    class Encoder:
        def encode_ordinary(self, text):
            return text.split("-")

    df = spark.createDataFrame([("a-b-c",), (None,)], "t string")
    assert [r[0] for r in df.select(scoring.token_counter(Encoder)(F.col("t"))).collect()] == [3, 0]


def test_unscored_rows_are_kept(spark):
    df = spark.createDataFrame([(1, "text"), (2, "  "), (3, None)], "id int, t string")

    def load():
        return lambda texts: np.tile([0.0, 2.0, 1.0], (len(texts), 1))

    names = spark.createDataFrame([(1, "one")], "class_idx int, name string")
    rows = {r["id"]: r for r in scoring.silver_labels(df, "id", "t", load, names).collect()}
    assert (rows[1]["top_label"], len(rows[1]["full_dist"])) == ("one", 3)
    assert all((rows[i]["top_label"], rows[i]["confidence"], rows[i]["full_dist"]) == ("N/A", 0.0, [])
               for i in (2, 3))
