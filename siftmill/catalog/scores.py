"""Distribution scoring and evaluation."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from siftmill.catalog import query
from siftmill.catalog import views as V
from siftmill.functions import dists
from siftmill.operators import evaluation, scoring
from siftmill.session import spread

CLASSES = 7


def _load():
    """A scorer that needs no model file: logits follow from a digest of all that it sees."""

    def score(texts: list[str]) -> np.ndarray:
        seen = np.array([int(hashlib.md5(t.encode()).hexdigest()[:3], 16) for t in texts])[:, None]
        return (seen * (np.arange(CLASSES)[None, :] + 3) % 17) / 4.0

    return score


load_scorer = scoring.once_per_worker("digest-scorer", _load)


def seen_sql(text: str) -> str:
    """The number that the scorer reads off the first 512 tokens of a text."""
    cut = f"regexp_extract_all({text}, '{V.TOKEN}')"
    seen = f"CASE WHEN len({cut}) <= 512 THEN {text} ELSE array_to_string({cut}[1:512], ' ') END"
    digits = [f"(strpos('0123456789abcdef', substr(md5({seen}), {i}, 1)) - 1)" for i in (1, 2, 3)]
    return f"({digits[0]} * 256 + {digits[1]} * 16 + {digits[2]})"


def silver_sql(source: str, ident: str, text: str, heat: float = 1.0) -> str:
    """CTEs that end in `silver(id, text, top_class, confidence, dist)`."""
    return f"""silver_s AS (SELECT {ident} AS id, {text} AS text, {seen_sql(text)} AS seen FROM {source}),
silver_l AS (SELECT id, text,
  CASE WHEN length({V.strip_sql('text')}) > 0 THEN list_transform(range(0, {CLASSES}),
    lambda j: exp((seen * (j + 3)) % 17 / 4.0 / {heat})) ELSE []::DOUBLE[] END AS e
  FROM silver_s),
silver_d AS (SELECT id, text, list_transform(e, lambda x: x / list_sum(e)) AS dist FROM silver_l),
silver AS (SELECT id, text, dist, CAST(list_position(dist, list_max(dist)) - 1 AS INTEGER)
  AS top_class, coalesce(list_max(dist), 0) AS confidence FROM silver_d)"""


@query(
    "i01_batch_score",
    f"""WITH s AS (SELECT doc_id, {seen_sql('text')} AS seen FROM documents)
    SELECT doc_id, unnest(range(0, {CLASSES})) AS j,
      unnest(list_transform(range(0, {CLASSES}), lambda j: (seen * (j + 3)) % 17 / 4.0)) AS logit
    FROM s""",
)
def i01_batch_score(spark, d):
    docs = spread(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    made = scoring.score_texts(docs, "text", load_scorer)
    long = made.select("doc_id", F.posexplode("logits").alias("j", "logit"))
    return long.select("doc_id", V.long(F.col("j")).alias("j"), "logit")


@query(
    "i02_softmax",
    """WITH e AS (SELECT vec_id, list_transform(embedding[1:10],
      lambda x: exp(CAST(x AS DOUBLE) * 8 / 0.5)) AS e FROM embeddings)
    SELECT vec_id, unnest(range(0, 10)) AS class_idx,
      unnest(list_transform(e, lambda x: round(x / list_sum(e), 6))) AS p FROM e""",
)
def i02_softmax(spark, d):
    made = V.dists(spark, d).select(
        "vec_id", F.posexplode(dists.softmax(F.col("teacher_logits"), 0.5)).alias("c", "p")
    )
    return made.select("vec_id", V.long(F.col("c")).alias("class_idx"), V.six(F.col("p")).alias("p"))


NAMES = "names AS (SELECT DISTINCT label AS i, 'class ' || label AS name FROM embeddings WHERE label <> 2)"


def class_names(spark, d):
    labels = V.table(spark, d, "embeddings").select("label").where("label <> 2").distinct()
    return labels.select(
        F.col("label").alias("class_idx"),
        F.concat(F.lit("class "), F.col("label").cast("string")).alias("name"),
    )


TOPS = """tops AS (SELECT vec_id, label, teacher, student,
  CAST(list_position(teacher, list_max(teacher)) - 1 AS INTEGER) AS t,
  CAST(list_position(student, list_max(student)) - 1 AS INTEGER) AS g,
  teacher[1] + teacher[5] + teacher[8] AS true_mass,
  student[1] + student[5] + student[8] AS mass FROM dists)"""


@query(
    "i03_top_label",
    f"""WITH {V.DISTS}, {TOPS}, {NAMES} SELECT vec_id, t AS top_class,
      coalesce(name, CAST(t AS VARCHAR)) AS top_label, round(list_max(teacher), 6) AS confidence
    FROM tops LEFT JOIN names ON t = i""",
)
def i03_top_label(spark, d):
    made = scoring.top_labels(V.dists(spark, d), "teacher", class_names(spark, d))
    return made.select("vec_id", "top_class", "top_label", V.six(F.col("confidence")).alias("confidence"))


@query(
    "i04_risk_mass",
    f"WITH {V.DISTS}, {TOPS} SELECT vec_id, round(true_mass, 6) AS mass, 0.0::DOUBLE AS none FROM tops",
)
def i04_risk_mass(spark, d):
    dist = F.col("teacher")
    return V.dists(spark, d).select(
        "vec_id", V.six(dists.mass(dist, V.RISK_LABELS)).alias("mass"),
        dists.mass(dist, []).alias("none"),
    )


@query(
    "i05_ambiguous",
    f"""WITH {V.DISTS}, {TOPS} SELECT vec_id, CASE WHEN list_max(teacher) < 0.25
      THEN t || ' (?)' ELSE CAST(t AS VARCHAR) END AS label FROM tops""",
)
def i05_ambiguous(spark, d):
    made = scoring.top_labels(V.dists(spark, d), "teacher")
    return made.select(
        "vec_id", dists.display_label(F.col("top_label"), F.col("confidence")).alias("label")
    )


@query(
    "i06_sentinels",
    f"""WITH {V.POSTS}, {silver_sql('posts', 'post_id', 'selftext')}
    SELECT id, CASE WHEN len(dist) = 0 THEN 'N/A' ELSE CAST(top_class AS VARCHAR) END AS top_label,
      round(confidence, 6) AS confidence, len(dist) AS classes FROM silver""",
)
def i06_sentinels(spark, d):
    posts = spread(V.posts(spark, d), "post_id")
    made = scoring.silver_labels(posts, "post_id", "selftext", load_scorer)
    return made.select(
        "id", "top_label", V.six(F.col("confidence")).alias("confidence"),
        V.long(F.size("full_dist")).alias("classes"),
    )


@query(
    "i07_decide",
    f"""WITH {V.DISTS}, {TOPS} SELECT vec_id, CAST(mass > 0.3 AS INTEGER) AS risk FROM tops""",
)
def i07_decide(spark, d):
    rows = V.dists(spark, d).withColumn("mass", dists.mass(F.col("student"), V.RISK_LABELS))
    side = rows.agg((F.min(F.lit(0.3))).alias("risk_threshold"))
    return scoring.decide(rows, "mass", side).select("vec_id", "risk")


@query(
    "e01_accuracy",
    f"WITH {V.DISTS}, {TOPS} SELECT round(avg(CAST(t = g AS INT)), 6) AS accuracy FROM tops",
)
def e01_accuracy(spark, d):
    made = evaluation.accuracy(V.dists(spark, d), "student", "teacher")
    return made.select(V.six(F.col("accuracy")).alias("accuracy"))


def prf_sql(keep: str = "") -> str:
    """CTE `prf(keep, accuracy, precision, recall, f1, top3_accuracy)` of table `tops`."""
    k = f"{keep}, " if keep else ""
    on = f"s.{keep} = p.{keep} AND " if keep else ""
    sk = f"s.{keep}, " if keep else ""
    group = f"GROUP BY {keep}" if keep else ""
    return f"""hits AS (SELECT *, len(list_filter(list_zip(student, range(0, 10)),
    lambda z: z[1] > student[t + 1] OR (z[1] = student[t + 1] AND z[2] < t))) < 3 AS in3 FROM tops),
s AS (SELECT {k}t AS c, count(*) AS support, count(*) FILTER (WHERE t = g) AS tp,
  count(*) FILTER (WHERE in3) AS n3 FROM hits GROUP BY {k}t),
p AS (SELECT {k}g AS c, count(*) AS called FROM hits GROUP BY {k}g),
j AS (SELECT {sk}s.c, support, tp, n3, coalesce(called, 0) AS called FROM s LEFT JOIN p ON {on}s.c = p.c),
prf AS (SELECT {k}sum(tp) / sum(support) AS accuracy,
  sum(coalesce(tp / nullif(called, 0), 0) * support) / sum(support) AS precision,
  sum(tp / support * support) / sum(support) AS recall,
  sum(2 * tp / (support + called) * support) / sum(support) AS f1,
  sum(n3) / sum(support) AS top3_accuracy FROM j {group})"""


@query(
    "e02_weighted_prf",
    f"""WITH {V.DISTS}, {TOPS}, {prf_sql()} SELECT round(precision, 6) AS precision,
      round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf""",
)
def e02_weighted_prf(spark, d):
    made = evaluation.metrics(V.dists(spark, d), "student", "teacher")
    return made.select(*[V.six(F.col(m)).alias(m) for m in ("precision", "recall", "f1")])


@query(
    "e03_top3",
    f"WITH {V.DISTS}, {TOPS}, {prf_sql()} SELECT round(top3_accuracy, 6) AS top3_accuracy FROM prf",
)
def e03_top3(spark, d):
    made = evaluation.top3_accuracy(V.dists(spark, d), "student", "teacher")
    return made.select(V.six(F.col("top3_accuracy")).alias("top3_accuracy"))


KL = f"""{V.DISTS_LONG}, per AS (SELECT vec_id, sum(p * (ln(p) - ln(q))) AS kl,
  sum(p) FILTER (WHERE class_idx IN (0, 4, 7)) AS tm, sum(q) FILTER (WHERE class_idx IN (0, 4, 7)) AS sm
  FROM long_dists GROUP BY vec_id)"""


@query("e04_kl", f"WITH {KL} SELECT round(avg(kl), 6) AS kl FROM per")
def e04_kl(spark, d):
    made = evaluation.divergence(V.dists(spark, d), "teacher", "student")
    return made.select(V.six(F.col("kl")).alias("kl"))


@query(
    "e05_hier_loss",
    f"""WITH {KL} SELECT round(avg(kl), 6) AS kl, round(avg((sm - tm) * (sm - tm)), 6) AS mse,
      round(avg(kl) + 0.5 * avg((sm - tm) * (sm - tm)), 6) AS loss FROM per""",
)
def e05_hier_loss(spark, d):
    made = evaluation.hierarchical_loss(V.dists(spark, d), "teacher", "student", V.RISK_LABELS)
    return made.select(*[V.six(F.col(m)).alias(m) for m in ("kl", "mse", "loss")])


@query(
    "e06_threshold_sweep",
    f"""WITH {V.DISTS}, {TOPS}, th AS (SELECT i, 0.1::DOUBLE + 0.05::DOUBLE * i AS threshold
      FROM range(0, 17) r(i)),
    s AS (SELECT threshold, count(*) FILTER (WHERE mass > threshold AND true_mass > 0.5) AS tp,
      count(*) FILTER (WHERE mass > threshold) AS called,
      count(*) FILTER (WHERE true_mass > 0.5) AS actual FROM tops, th GROUP BY threshold),
    f AS (SELECT threshold, coalesce(2 * tp / nullif(called + actual, 0), 0) AS f1 FROM s)
    SELECT 'sweep' AS kind, round(threshold, 2) AS threshold, round(f1, 6) AS f1 FROM f
    UNION ALL (SELECT 'best', CASE WHEN f1 > 0 THEN round(threshold, 2) ELSE 0.5 END, round(f1, 6)
      FROM f ORDER BY f1 DESC, threshold LIMIT 1)""",
)
def e06_threshold_sweep(spark, d):
    sweep = evaluation.threshold_sweep(
        V.dists(spark, d),
        dists.mass(F.col("student"), V.RISK_LABELS),
        dists.mass(F.col("teacher"), V.RISK_LABELS),
    )
    best = evaluation.best_threshold(sweep).select(
        F.lit("best").alias("kind"), F.col("risk_threshold").alias("threshold"),
        F.col("f1_score").alias("f1"),
    )
    both = sweep.select(F.lit("sweep").alias("kind"), "threshold", "f1").unionByName(best)
    return both.select("kind", F.round("threshold", 2).alias("threshold"), V.six(F.col("f1")).alias("f1"))


_DATASET = "CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS dataset, teacher"


@query(
    "e07_per_dataset",
    f"""WITH {V.DISTS}, {TOPS.replace('label, teacher', _DATASET)},
    {prf_sql('dataset')}, u AS (UNPIVOT prf ON accuracy, precision, recall, f1, top3_accuracy
      INTO NAME m VALUE value)
    SELECT dataset || '_' || m AS metric, round(value, 6) AS value FROM u""",
)
def e07_per_dataset(spark, d):
    rows = V.dists(spark, d).withColumn(
        "dataset", F.when(F.col("label") < 5, "low").otherwise("high")
    )
    made = evaluation.per_dataset(rows, "dataset", "student", "teacher")
    return made.select("metric", V.six(F.col("value")).alias("value"))


@query(
    "e08_review_sample",
    """WITH s AS (SELECT doc_id, text, source, n_chars FROM documents
      ORDER BY md5('42:' || doc_id), doc_id LIMIT 50)
    SELECT doc_id, substr(replace(text, chr(10), ' '), 1, 78) AS text, source AS top_label,
      printf('%.1f%%', CAST(100 * (n_chars % 1000) / 1024.0 AS DOUBLE)) AS conf FROM s""",
)
def e08_review_sample(spark, d):
    rows = V.table(spark, d, "documents").select(
        "doc_id", "text", F.col("source").alias("top_label"),
        ((F.col("n_chars") % 1000) / 1024.0).cast("double").alias("confidence"),
    )
    return evaluation.review_sample(rows, "doc_id")
