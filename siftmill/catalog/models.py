"""Probe and student models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.catalog import query
from siftmill.catalog import views as V
from siftmill.catalog.sampling import H
from siftmill.operators import evaluation, probe, sampling, student
from siftmill.plans import labels
from siftmill.session import durable

CLASSES = sorted(settings.POSITIVE_EMOTIONS + settings.NEGATIVE_EMOTIONS)


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def fixed_probe(width: int = 64) -> probe.Probe:
    """A probe with weights given by a rule, the same on every run."""
    rows, columns = np.arange(len(CLASSES))[:, None], np.arange(width)[None, :]
    weights = ((columns * 7 + rows * 13) % 11 - 5) * 0.8
    return probe.Probe(CLASSES, weights.astype(float), np.zeros(len(CLASSES)))


SCORED = f"""x AS (SELECT vec_id, label, unnest(range(0, 64)) AS i,
    unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
classes AS (SELECT unnest([{quoted(CLASSES)}]) AS class, unnest(range(0, {len(CLASSES)})) AS j),
scored AS (SELECT vec_id, class, j, 1 / (1 + exp(-sum(x * ((i * 7 + j * 13) % 11 - 5) * 0.8))) AS p
  FROM x, classes GROUP BY vec_id, class, j),
fused AS (SELECT vec_id,
  max(p) FILTER (WHERE class IN ({quoted(settings.POSITIVE_EMOTIONS)})) AS pos,
  max(p) FILTER (WHERE class IN ({quoted(settings.NEGATIVE_EMOTIONS)})) AS neg
  FROM scored GROUP BY vec_id)"""


def tagged(spark, d):
    """Vectors with two emotion labels that follow from their class."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    return V.table(spark, d, "embeddings").select(
        "vec_id", "embedding",
        F.array_distinct(F.array(
            F.get(names, F.col("label")), F.get(names, F.col("label") % 3)
        )).alias("emotions"),
    )


def scored(spark, d):
    rows = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    return rows.select("vec_id", fixed_probe().scores(F.col("embedding")).alias("scores"))


def fused(spark, d):
    scores = F.col("scores")
    return scored(spark, d).select(
        "vec_id",
        probe.late_fusion(scores, CLASSES, settings.POSITIVE_EMOTIONS).alias("pos"),
        probe.late_fusion(scores, CLASSES, settings.NEGATIVE_EMOTIONS).alias("neg"),
    )


@query(
    "m01_multihot",
    f"""WITH classes AS (SELECT unnest([{quoted(CLASSES)}]) AS class,
      unnest(range(0, {len(CLASSES)})) AS j)
    SELECT vec_id, class, CAST(j = label OR j = label % 3 AS INTEGER) AS hot
    FROM embeddings, classes""",
)
def m01_multihot(spark, d):
    names = F.array(*[F.lit(c) for c in CLASSES])
    hot = probe.multi_hot(F.col("emotions"), CLASSES)
    made = tagged(spark, d).select("vec_id", F.posexplode(hot).alias("j", "hot"))
    return made.select("vec_id", F.get(names, F.col("j")).alias("class"), "hot")


def train_side(share: float) -> str:
    """SQL for the ids on the train side of a seeded split of the vectors."""
    return f"""ranked AS (SELECT vec_id, label, row_number() OVER (ORDER BY {H.format('vec_id')}, vec_id) AS r,
      count(*) OVER () AS n FROM embeddings),
    train AS (SELECT vec_id, label FROM ranked WHERE r > ceil(n * {share}))"""


def fitted_probe(spark, d):
    stored = tagged(spark, d).select(
        "vec_id", F.to_json("embedding").alias("embedding"), F.to_json("emotions").alias("emotions")
    )
    rows = durable(labels.training_labels(stored, "emotions", "embedding"))
    return probe.fit_probe(rows, "vec_id", "embedding", "emotions")


@query("m02_probe_fit")
def m02_probe_fit(spark, d):
    made, split = fitted_probe(spark, d)
    guess = probe.predicted(F.col("scores"), made.classes)
    test = split.where("side = 'test'").withColumn("scores", made.scores(F.col("embedding")))
    checked = test.withColumn("guess", guess)
    return probe.label_report(checked, "emotions", "guess", made.classes)


@query(
    "m02_probe_certificate",
    f"""WITH classes AS (SELECT unnest([{quoted(CLASSES)}]) AS class,
      unnest(range(0, {len(CLASSES)})) AS j),
    {train_side(0.2)}
    SELECT class AS label, count(*) AS rows,
      count(*) FILTER (WHERE j = label OR j = label % 3) AS positives,
      1 AS calibrated, 1 AS settled
    FROM train, classes WHERE j IN (SELECT label FROM embeddings UNION SELECT label % 3 FROM embeddings)
    GROUP BY class""",
)
def m02_probe_certificate(spark, d):
    """What the optimum of each label's regression must show on the rows it was fitted on.

    The bias carries no penalty, so the mean score is the share of positives.
    """
    made, split = fitted_probe(spark, d)
    train = split.where("side = 'train'").select(
        made.scores(F.col("embedding")).alias("s"),
        probe.multi_hot(F.col("emotions"), made.classes).alias("h"),
    )
    each = train.select(F.posexplode(F.arrays_zip("s", "h")).alias("j", "z"))
    sums = each.groupBy("j").agg(
        F.count("*").alias("rows"), F.sum("z.h").alias("positives"), F.avg("z.s").alias("expected")
    )
    names = F.array(*[F.lit(c) for c in made.classes])
    share = F.col("positives") / F.col("rows")
    return sums.select(
        F.get(names, F.col("j")).alias("label"), "rows", "positives",
        (F.abs(F.col("expected") - share) < 1e-4).cast("int").alias("calibrated"),
        F.lit(int(made.gradient < 1e-4)).alias("settled"),
    )


@query("m03_probe_score", f"WITH {SCORED} SELECT vec_id, CAST(j AS INTEGER) AS j, round(p, 6) AS p FROM scored")
def m03_probe_score(spark, d):
    made = scored(spark, d).select("vec_id", F.posexplode("scores").alias("j", "p"))
    return made.select("vec_id", "j", V.six(F.col("p")).alias("p"))


@query(
    "m04_late_fusion",
    f"WITH {SCORED} SELECT vec_id, round(pos, 6) AS pos, round(neg, 6) AS neg FROM fused",
)
def m04_late_fusion(spark, d):
    return fused(spark, d).select(
        "vec_id", V.six(F.col("pos")).alias("pos"), V.six(F.col("neg")).alias("neg")
    )


@query(
    "m05_emotion_labels",
    f"""WITH {SCORED} SELECT vec_id, CASE WHEN pos >= 0.9 AND neg >= 0.9 THEN 'positive|negative'
      WHEN pos >= 0.9 THEN 'positive' WHEN neg >= 0.9 THEN 'negative' ELSE '' END AS labels
    FROM fused""",
)
def m05_emotion_labels(spark, d):
    made = probe.emotion_labels(F.col("pos"), F.col("neg"))
    return fused(spark, d).select("vec_id", F.array_join(made, "|").alias("labels"))


@query(
    "m06_label_report",
    f"""WITH {SCORED}, m AS (SELECT s.class AS label, s.j = e.label OR s.j = e.label % 3 AS t,
      s.p > 0.5 AS g, s.vec_id FROM scored s JOIN embeddings e ON s.vec_id = e.vec_id),
    c AS (SELECT label, count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE t) AS support,
      count(*) FILTER (WHERE g) AS guessed FROM m GROUP BY label),
    a AS (SELECT * FROM c UNION ALL
      SELECT 'micro avg', sum(tp), sum(support), sum(guessed) FROM c),
    r AS (SELECT label, coalesce(tp / nullif(guessed, 0), 0) AS precision,
      coalesce(tp / nullif(support, 0), 0) AS recall,
      coalesce(2 * tp / nullif(support + guessed, 0), 0) AS f1, support FROM a),
    p AS (SELECT * FROM r WHERE label <> 'micro avg'),
    u AS (SELECT * FROM r UNION ALL
      SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM p UNION ALL
      SELECT 'weighted avg', sum(precision * support) / sum(support),
        sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM p
      UNION ALL SELECT 'subset accuracy', avg(CAST(ok AS INT)), 0, 0, count(*) FROM
        (SELECT vec_id, bool_and(t = g) AS ok FROM m GROUP BY vec_id))
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u""",
)
def m06_label_report(spark, d):
    scores = fixed_probe().scores(F.col("embedding"))
    rows = tagged(spark, d).withColumn("guess", probe.predicted(scores, CLASSES))
    report = probe.label_report(rows, "emotions", "guess", CLASSES)
    same = probe.subset_accuracy(rows, "emotions", "guess").select(
        F.lit("subset accuracy").alias("label"), F.col("subset_accuracy").alias("precision"),
        F.lit(0.0).alias("recall"), F.lit(0.0).alias("f1"),
        rows.agg(F.count("*")).scalar().alias("support"),
    )
    return report.unionByName(same).select(
        "label", *[V.six(F.col(m)).alias(m) for m in ("precision", "recall", "f1")], "support"
    )


def fitted_student(spark, d):
    rows = V.dists(spark, d).select("vec_id", "label", "teacher").join(
        V.table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id"
    ).withColumn("dataset", F.when(F.col("label") < 5, "low").otherwise("high"))
    split = sampling.random_split(rows, "vec_id", 0.1)
    return student.fit_student(split.where("side = 'train'"), "embedding", "teacher"), split


@query("m07_student")
def m07_student(spark, d):
    model, split = fitted_student(spark, d)
    test = student.apply_student(model, split.where("side = 'test'"), "embedding")
    made = evaluation.per_dataset(test, "dataset", "student", "teacher")
    extra = evaluation.divergence(test, "teacher", "student").select(
        F.lit("kl").alias("metric"), F.col("kl").alias("value")
    )
    return made.unionByName(extra)


@query(
    "m07_student_certificate",
    f"""WITH {V.DISTS_LONG}, {train_side(0.1)}
    SELECT CAST(class_idx AS INTEGER) AS class_idx, count(*) AS rows, round(sum(p), 4) AS mass,
      1 AS calibrated, 1 AS settled
    FROM long_dists JOIN train USING (vec_id) GROUP BY class_idx""",
)
def m07_student_certificate(spark, d):
    """What the optimum must show: the student gives each class its teacher's mass on train rows."""
    model, split = fitted_student(spark, d)
    train = student.apply_student(model, split.where("side = 'train'"), "embedding")
    each = train.select(F.posexplode(F.arrays_zip("teacher", "student")).alias("class_idx", "z"))
    sums = each.groupBy("class_idx").agg(
        F.count("*").alias("rows"), F.sum("z.teacher").alias("sum"), F.sum("z.student").alias("given")
    )
    return sums.select(
        "class_idx", "rows", F.round("sum", 4).alias("mass"),
        (F.abs(F.col("given") - F.col("sum")) < F.col("rows") * 1e-4).cast("int").alias("calibrated"),
        F.lit(int(model.gradient < 1e-4)).alias("settled"),
    )
