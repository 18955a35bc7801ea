"""Joins, set operations and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill import settings
from siftmill.catalog import query
from siftmill.catalog import views as V
from siftmill.functions import text
from siftmill.operators import sets


@query(
    "j01_semi_anti",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'labelled' END AS side
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def j01_semi_anti(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id")
    labels = V.table(spark, d, "labels")
    held = sets.members(docs, labels, "doc_id").withColumn("side", F.lit("labelled"))
    other = sets.non_members(docs, labels, "doc_id").withColumn("side", F.lit("missing"))
    return held.unionByName(other)


@query(
    "j02_lookup",
    """WITH b AS (SELECT DISTINCT label AS i, 'class ' || label AS name FROM embeddings
      WHERE label <> 3)
    SELECT e.vec_id, coalesce(b.name, CAST(e.label AS VARCHAR)) AS name
    FROM embeddings e LEFT JOIN b ON e.label = b.i""",
)
def j02_lookup(spark, d):
    rows = V.table(spark, d, "embeddings").select("vec_id", "label")
    book = rows.where("label <> 3").select(
        F.col("label").alias("i"), F.concat(F.lit("class "), F.col("label").cast("string")).alias("n")
    ).distinct()
    named = sets.with_names(rows.withColumnRenamed("label", "i"), book, "i", "n", "name")
    return named.select("vec_id", "name")


@query(
    "j03_gather",
    """SELECT d.doc_id, CAST(d.doc_id % 2 AS INTEGER) AS copy, len(e.embedding) AS width,
      round(CAST(e.embedding[1] AS DOUBLE), 6) AS first
    FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id
    UNION ALL SELECT d.doc_id, 2, len(e.embedding), round(CAST(e.embedding[1] AS DOUBLE), 6)
    FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.lang = 'en'""",
)
def j03_gather(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    once = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("copy"))
    again = docs.where("lang = 'en'").select("doc_id", F.lit(2).alias("copy"))
    vectors = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return sets.gather(once.unionByName(again), vectors, "doc_id").select(
        "doc_id", "copy", V.long(F.size("embedding")).alias("width"),
        V.six(F.col("embedding")[0]).alias("first"),
    )


@query(
    "u01_union_all",
    """SELECT doc_id, lang, CAST(NULL AS INTEGER) AS quality FROM documents
    UNION ALL SELECT doc_id, NULL, quality FROM labels""",
)
def u01_union_all(spark, d):
    return sets.union_all(
        V.table(spark, d, "documents").select("doc_id", "lang"),
        V.table(spark, d, "labels").select("quality", "doc_id"),
    )


@query(
    "u02_distinct",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER
      (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1""",
)
def u02_distinct(spark, d):
    events = V.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return sets.distinct_on(events, ["user_id", "event_type"], ["event_id"])


@query(
    "u03_partition",
    f"""WITH {V.VECTORS} SELECT vec_id, CASE WHEN neg_score > 0.5 OR pos_score > 0.5
      THEN 'special' ELSE 'neutral' END AS part FROM vectors WHERE binary_label = 0""",
)
def u03_partition(spark, d):
    safe = V.vectors(spark, d).where("binary_label = 0")
    special = (F.col("neg_score") > settings.EMOTION_FLAG) | (F.col("pos_score") > settings.EMOTION_FLAG)
    return safe.select("vec_id", F.when(special, "special").otherwise("neutral").alias("part"))


INDEX = """idx AS (SELECT subreddit, CAST(row_number() OVER (ORDER BY subreddit) - 1 AS INTEGER)
    AS class_idx FROM (SELECT DISTINCT subreddit FROM vectors))"""


@query(
    "u04_class_index",
    """SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS class_idx
    FROM (SELECT DISTINCT source FROM documents)""",
)
def u04_class_index(spark, d):
    return sets.class_index(V.table(spark, d, "documents"), "source")


@query(
    "u05_risk_classes",
    f"""WITH {V.VECTORS}, {INDEX} SELECT subreddit, class_idx FROM idx WHERE subreddit IN
    (SELECT subreddit FROM vectors WHERE binary_label = 1)""",
)
def u05_risk_classes(spark, d):
    rows = V.vectors(spark, d)
    index = sets.class_index(rows, "subreddit")
    return sets.positive_classes(rows, index, "subreddit", "binary_label")


@query(
    "a01_category_counts",
    f"""WITH {V.VECTORS} SELECT CAST(sum(CAST(pos_score >= 0.6 AS INT)) AS BIGINT) AS positive,
      CAST(sum(CAST(neg_score >= 0.6 AS INT)) AS BIGINT) AS negative,
      CAST(sum(CAST(pos_score < 0.6 AND neg_score < 0.6 AS INT)) AS BIGINT) AS neutral
    FROM vectors""",
)
def a01_category_counts(spark, d):
    return sets.category_counts(
        V.vectors(spark, d),
        {"positive": F.col("pos_score") >= 0.6, "negative": F.col("neg_score") >= 0.6},
        "neutral",
    )


@query(
    "a02_funnel",
    f"""WITH {V.POSTS}, f AS (SELECT
      lower(selftext) NOT IN ('nan', 'none', '', '[removed]', '[deleted]') AS a,
      created_utc BETWEEN 1627776000 AND 1661990400 AS b, n_chars >= 200 AS c FROM posts)
    SELECT 0 AS step, 'all' AS stage, count(*) AS rows FROM f
    UNION ALL SELECT 1, 'body', count(*) FROM f WHERE a
    UNION ALL SELECT 2, 'period', count(*) FROM f WHERE a AND b
    UNION ALL SELECT 3, 'length', count(*) FROM f WHERE a AND b AND c""",
)
def a02_funnel(spark, d):
    return sets.funnel(
        V.posts(spark, d),
        {
            "body": ~text.is_empty_body(F.col("selftext")),
            "period": F.col("created_utc").between(settings.FIRST_SECOND, settings.LAST_SECOND),
            "length": F.col("n_chars") >= 200,
        },
    )


@query(
    "a03_num_classes",
    f"""WITH {V.DISTS} SELECT CAST(max(len(teacher)) AS INTEGER) AS classes,
      CAST(min(len(teacher)) = max(len(teacher)) AS INTEGER) AS same FROM dists""",
)
def a03_num_classes(spark, d):
    return sets.class_count(V.dists(spark, d), "teacher")


@query(
    "a04_share",
    """SELECT source, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
      round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source""",
)
def a04_share(spark, d):
    made = sets.shares(V.table(spark, d, "documents"), "source")
    return made.withColumn("share", V.six(F.col("share")))
