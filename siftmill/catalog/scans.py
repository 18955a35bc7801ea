"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.catalog import query
from siftmill.catalog import views as V
from siftmill.session import scratch
from siftmill.sources import csv_tree, sinks, tables


@query("s01_scan", "SELECT doc_id, lang, n_chars FROM documents")
def s01_scan(spark, d):
    V.tune(spark)
    return tables.scan(spark, f"{d}/documents.parquet", ["doc_id", "lang", "n_chars"])


@query(
    "s02_csv_tree",
    """SELECT doc_id, md5(text) AS selftext, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang
    FROM documents""",
)
def s02_csv_tree(spark, d):
    docs = V.table(spark, d, "documents").withColumnRenamed("text", "selftext")
    root = scratch(spark, "csv")
    even = F.col("doc_id") % 2 == 0
    csv_tree.write_csv(docs.where(even).select("doc_id", "selftext", "lang"), f"{root}/a/x")
    csv_tree.write_csv(docs.where(~even).select("selftext", "doc_id"), f"{root}/b")
    csv_tree.write_csv(V.table(spark, d, "labels"), f"{root}/c")
    read = csv_tree.read_csv_tree(spark, root, required=["selftext"])
    return read.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5("selftext").alias("selftext"), "lang"
    )


@query("s03_nested_conversations", "SELECT conv_id, turn, role, md5(text) AS text FROM conversations")
def s03_nested_conversations(spark, d):
    path = scratch(spark, "nested")
    tables.nest_conversations(V.table(spark, d, "conversations")).write.parquet(path)
    read = tables.unnest_conversations(spark.read.parquet(path))
    return read.select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query(
    "s04_id_ranges",
    """WITH b AS (SELECT min(event_id) AS lo, max(event_id) AS hi,
        CAST(ceil((max(event_id) - min(event_id)) / 30.0) AS BIGINT) AS w FROM events),
    r AS (SELECT lo + i * (w + 1) AS first_id, least(lo + i * (w + 1) + w, hi) AS last_id
      FROM b, range(0, 30) t(i) WHERE lo + i * (w + 1) <= hi)
    SELECT first_id, last_id, count(*) AS rows FROM r
    JOIN events ON event_id BETWEEN first_id AND last_id GROUP BY ALL""",
)
def s04_id_ranges(spark, d):
    return tables.id_ranges(V.table(spark, d, "events"), "event_id", 30).select(
        V.long(F.col("first_id")).alias("first_id"), V.long(F.col("last_id")).alias("last_id"), "rows"
    )


@query(
    "s05_keyset_page",
    """SELECT event_id, user_id FROM events WHERE event_id > 100 AND event_id <= 900
    ORDER BY event_id LIMIT 500""",
)
def s05_keyset_page(spark, d):
    events = V.table(spark, d, "events").select("event_id", "user_id")
    return tables.keyset_page(events, "event_id", 100, 500, 900)


@query("s06_offset_page", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def s06_offset_page(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    return tables.offset_page(docs, ["doc_id"], 50, 100)


@query(
    "s07_batches",
    """SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 500) AS BIGINT)
      AS batch FROM events""",
)
def s07_batches(spark, d):
    events = V.table(spark, d, "events").select("event_id")
    return tables.batches(events, ["event_id"], 500)


@query("s08_resume", "SELECT doc_id, lang, 1 AS copies FROM documents")
def s08_resume(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    path = scratch(spark, "resume")
    half = docs.agg(F.max("doc_id") / 2).scalar()
    docs.where(F.col("doc_id") <= half).write.parquet(path)
    sinks.remaining(docs, path, ["doc_id"]).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    return stored.groupBy("doc_id", "lang").agg(F.count("*").cast("int").alias("copies"))


@query("s09_append_valid", "SELECT vec_id, label FROM embeddings WHERE vec_id % 9 <> 0")
def s09_append_valid(spark, d):
    rows = V.table(spark, d, "embeddings").withColumn(
        "embedding", F.when(F.col("vec_id") % 9 != 0, F.col("embedding"))
    )
    path = scratch(spark, "append")
    sinks.append_valid(rows.where("label < 5"), path)
    sinks.append_valid(rows.where("label >= 5"), path)
    return spark.read.parquet(path).select("vec_id", "label")


@query("s10_reset", "SELECT doc_id, quality FROM labels WHERE quality = 1")
def s10_reset(spark, d):
    labels = V.table(spark, d, "labels").select("doc_id", "quality")
    path = scratch(spark, "reset")
    sinks.replace(labels, path, 1)
    return sinks.replace(labels.where("quality = 1"), path, 2)


@query(
    "s11_keyed_update",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, d.lang
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def s11_keyed_update(spark, d):
    old = V.table(spark, d, "documents").select(
        "doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"), "lang"
    )
    new = sinks.updated(old, V.table(spark, d, "labels"), "doc_id", ["quality", "toxic"])
    return sinks.replace(new, scratch(spark, "update"), 2)


@query(
    "s12_snapshot",
    f"""WITH {V.VECTORS} SELECT 'v' || vec_id AS post_id,
      CASE WHEN binary_label = 1 THEN 'mental_health_posts' ELSE 'safe_posts' END AS dataset_type,
      subreddit, author, len(embedding) AS width,
      round(CASE WHEN binary_label = 0 THEN neg_score END, 6) AS negative,
      CAST(NULL AS VARCHAR) AS predicted FROM vectors""",
)
def s12_snapshot(spark, d):
    rows = V.vectors(spark, d).select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("post_id"),
        F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("input"),
        "embedding", "subreddit", "author", "binary_label",
        F.struct(
            F.col("neg_score").alias("negative"), F.col("pos_score").alias("positive")
        ).alias("emotion_scores"),
    )
    path = scratch(spark, "snapshot")
    sinks.write_snapshot(
        {
            "mental_health_posts": rows.where("binary_label = 1").drop("emotion_scores"),
            "safe_posts": rows.where("binary_label = 0"),
        },
        path,
    )
    stored = spark.read.schema(sinks.SNAPSHOT).parquet(path)
    return stored.select(
        "post_id", "dataset_type", "subreddit", "author", V.long(F.size("embedding")).alias("width"),
        V.six(F.col("emotion_scores.negative")).alias("negative"),
        F.array_join("predicted_emotions", "|").alias("predicted"),
    )


@query(
    "s13_compiled_write",
    f"""WITH {V.DISTS} SELECT 'text ' || vec_id AS text,
      CASE WHEN label IN (0, 4, 7) THEN 1 ELSE 0 END AS label, 'c' || label AS subreddit,
      round(teacher[1], 6) AS p0, len(teacher) AS classes FROM dists""",
)
def s13_compiled_write(spark, d):
    rows = V.dists(spark, d).select(
        F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("input"),
        F.col("label").isin(*V.RISK_LABELS).alias("binary_label"),
        F.col("teacher").alias("soft_label"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("subreddit"),
    )
    path = scratch(spark, "compiled")
    sinks.write_compiled(rows, path)
    return spark.read.parquet(path).select(
        "text", "label", "subreddit", V.six(F.col("soft_label")[0]).alias("p0"),
        V.long(F.size("soft_label")).alias("classes"),
    )


@query(
    "s14_side_tables",
    f"""WITH {V.VECTORS}, c AS (SELECT subreddit, max(binary_label) AS risk, count(*) AS n
      FROM vectors GROUP BY subreddit)
    SELECT subreddit, CAST(row_number() OVER (ORDER BY subreddit) - 1 AS INTEGER) AS class_idx,
      risk, n FROM c""",
)
def s14_side_tables(spark, d):
    from siftmill.operators.sets import class_index

    rows = V.vectors(spark, d)
    risk = rows.groupBy("subreddit").agg(F.max("binary_label").alias("risk"), F.count("*").alias("n"))
    path = scratch(spark, "side")
    sinks.write_side_table(class_index(rows, "subreddit").join(risk, "subreddit"), path)
    return sinks.read_side_table(spark, path, "subreddit string, class_idx int, risk int, n long")


@query("s15_materialise", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s15_materialise(spark, d):
    path = scratch(spark, "kept")
    docs = V.table(spark, d, "documents")

    def build():
        return docs.groupBy("lang").agg(F.count("*").alias("n"))

    sinks.materialised(spark, path, build)
    return sinks.materialised(spark, path, lambda: build().where("n < 0"))


@query(
    "s16_silver_sink",
    f"""WITH {V.DISTS} SELECT vec_id AS id, len(teacher) AS classes FROM dists
    WHERE vec_id % 8 <> 0""",
)
def s16_silver_sink(spark, d):
    rows = V.dists(spark, d).select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 8 == 0, F.array().cast("array<double>"))
        .otherwise(F.col("teacher")).alias("full_dist"),
    )
    path = scratch(spark, "silver")
    sinks.write_silver(rows, path)
    return spark.read.parquet(path).select("id", V.long(F.size("full_dist")).alias("classes"))
