"""Incremental and streaming jobs, and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.catalog import query
from siftmill.catalog import views as V
from siftmill.catalog.sampling import CAPPED, feed
from siftmill.catalog.scores import load_scorer, silver_sql
from siftmill.operators import scoring, windows
from siftmill.session import scratch, spread
from siftmill.sources.sinks import is_folder
from siftmill.streaming import caps, files, usage


def arriving_table(spark, d, name, **options):
    """The stored file of a table, or the files of its folder, as a stream."""
    schema, path = V.table(spark, d, name).schema, f"{d}/{name}.parquet"
    if is_folder(spark, path):
        return files.arriving(spark, path, schema, **options)
    return files.arriving(spark, d, schema, pattern=f"{name}.parquet", **options)


@query(
    "x01_stream_chunks",
    f"""WITH {V.chunks_sql('documents', 'doc_id', 'text')}
    SELECT doc_id, chunk_id, md5(chunk) AS input, tokens AS input_tokens FROM chunks""",
)
def x01_stream_chunks(spark, d):
    out = scratch(spark, "chunks")
    stream = arriving_table(spark, d, "documents").select("doc_id", "text")
    files.stream_chunks(stream, "text", ["doc_id"], out, scratch(spark, "progress"))
    return spark.read.parquet(out).select(
        "doc_id", V.long(F.col("chunk_id")).alias("chunk_id"), F.md5("input").alias("input"),
        V.long(F.col("input_tokens")).alias("input_tokens"),
    )


@query("x02_foreach_batch", "SELECT vec_id, label, 1 AS copies FROM embeddings WHERE vec_id % 9 <> 0")
def x02_foreach_batch(spark, d):
    out = scratch(spark, "pages")
    stream = arriving_table(spark, d, "embeddings").withColumn(
        "embedding", F.when(F.col("vec_id") % 9 != 0, F.col("embedding"))
    )
    for _ in range(2):  # The second run has lost its progress and replays every page.
        files.append_pages(stream, "embedding", out, scratch(spark, "progress"))
    stored = spark.read.parquet(out)
    return stored.groupBy("vec_id", "label").agg(F.count("*").cast("int").alias("copies"))


WINDOWS = """w AS (SELECT CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS start,
    count(*) AS requests, sum(value) AS tokens FROM events GROUP BY 1)"""


@query("x03_usage_windows", f"WITH {WINDOWS} SELECT start, requests, round(tokens, 6) AS tokens FROM w")
def x03_usage_windows(spark, d):
    made = usage.usage_windows(V.usage(spark, d))
    return made.select(
        F.col("start").cast("long").alias("start"), "requests", V.six(F.col("tokens")).alias("tokens")
    )


@query(
    "x04_budget",
    f"""WITH {WINDOWS} SELECT start, requests, round(tokens, 6) AS tokens FROM w
    WHERE requests > 2 OR tokens > 60""",
)
def x04_budget(spark, d):
    made = usage.over_budget(usage.usage_windows(V.usage(spark, d)), 2, 60)
    return made.select(
        F.col("start").cast("long").alias("start"), "requests", V.six(F.col("tokens")).alias("tokens")
    )


# What follows a gap of more than a minute opens a window whatever came before; from there on each
# opening leads to the first request more than a minute later.
OPENED = """RECURSIVE e AS (SELECT epoch_us(ts) AS us, count(*) AS n, sum(value) AS v FROM events GROUP BY 1),
nxt AS (SELECT *, us - lag(us) OVER (ORDER BY us) AS gap, min(us) OVER (ORDER BY us
  RANGE BETWEEN 60000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e),
starts AS (SELECT us FROM nxt WHERE gap IS NULL OR gap > 60000000),
opens AS (SELECT us FROM starts UNION ALL SELECT later FROM opens JOIN nxt ON opens.us = nxt.us
  WHERE later NOT IN (SELECT us FROM starts)),
told AS (SELECT e.*, max(o.us) OVER (ORDER BY e.us) AS start FROM e LEFT JOIN opens o ON e.us = o.us),
w AS (SELECT start, CAST(sum(n) AS BIGINT) AS requests, sum(v) AS tokens FROM told GROUP BY start)"""


@query("x03_opened_windows", f"WITH {OPENED} SELECT start, requests, round(tokens, 6) AS tokens FROM w")
def x03_opened_windows(spark, d):
    made = windows.opened_windows(V.usage(spark, d))
    return made.select(
        F.unix_micros("start").alias("start"), "requests", V.six(F.col("tokens")).alias("tokens")
    )


@query(
    "x04_opened_budget",
    f"""WITH {OPENED} SELECT start, requests, round(tokens, 6) AS tokens FROM w
    WHERE requests > 2 OR tokens > 60""",
)
def x04_opened_budget(spark, d):
    made = usage.over_budget(windows.opened_windows(V.usage(spark, d)), 2, 60)
    return made.select(
        F.unix_micros("start").alias("start"), "requests", V.six(F.col("tokens")).alias("tokens")
    )


@query("x05_stream_cap", f"WITH {CAPPED} SELECT event_id, author FROM capped")
def x05_stream_cap(spark, d):
    source, out = scratch(spark, "feed"), scratch(spark, "capped")
    rows = feed(spark, d)
    second = F.col("ts").cast("timestamp").cast("double")
    cuts = rows.agg(F.percentile_approx(second, [1 / 3, 2 / 3])).first()[0]
    edges = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(edges, edges[1:]):
        part = rows.where((second > low) & (second <= high))
        part.repartition(1).write.mode("append").parquet(source)
    stream = files.arriving(spark, source, rows.schema, files_per_trigger=1)
    caps.stream_author_cap(
        stream, "author", ["ts", "event_id"], out, scratch(spark, "counts"), scratch(spark, "progress")
    )
    return spark.read.parquet(out).select("event_id", "author")


@query(
    "x06_stream_score",
    f"""WITH {silver_sql('documents', 'doc_id', 'text')}
    SELECT id, CAST(top_class AS VARCHAR) AS top_label, round(confidence, 6) AS confidence FROM silver""",
)
def x06_stream_score(spark, d):
    out = scratch(spark, "silver")
    stream = arriving_table(spark, d, "documents").select("doc_id", "text")
    files.stream_silver(stream, "doc_id", "text", load_scorer, out, scratch(spark, "progress"))
    return spark.read.parquet(out).select(
        "id", "top_label", V.six(F.col("confidence")).alias("confidence")
    )


def load_counter():
    """Vectors of letter counts; a list that holds a short text is refused as a whole."""

    def embed(texts):
        if any(len(t) < 100 for t in texts):
            raise ValueError("too short")
        return [[len(t), t.count("e"), t.count("a"), t.count(" ")] for t in texts]

    return embed


@query(
    "y01_embed",
    """SELECT doc_id, CASE WHEN length(text) >= 100 THEN length(text) END AS size,
      CASE WHEN length(text) >= 100 THEN length(text) - length(replace(text, 'e', '')) END AS e,
      CASE WHEN length(text) >= 100 THEN length(text) - length(replace(text, 'a', '')) END AS a,
      CASE WHEN length(text) >= 100 THEN length(text) - length(replace(text, ' ', '')) END AS blanks
    FROM documents""",
)
def y01_embed(spark, d):
    docs = spread(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    made = scoring.embed_column(docs, "text", load_counter).select("doc_id", "embedding")
    return made.select(
        "doc_id",
        *[V.long(F.col("embedding")[i]).alias(n) for i, n in enumerate(("size", "e", "a", "blanks"))],
    )
