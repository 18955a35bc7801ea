"""Samples, quotas, limits and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.catalog import query
from siftmill.catalog import views as V
from siftmill.operators import ranking, sampling
from siftmill.operators.sets import union_all

H = "md5('42:' || {})"
# Chunks per group, as a share of all events.
SHARE = 33
FEED = f"""feed AS (SELECT event_id, event_type, ts, CASE WHEN user_id % 10 = 0 THEN 'unknown'
    ELSE 'u' || user_id END AS author, 1 + event_id % 4 AS n_chunks,
    (SELECT count(*) // {SHARE} FROM events) AS quota FROM events)"""
CAPPED = f"""{FEED}, capped AS (SELECT * FROM (SELECT *, row_number() OVER
    (PARTITION BY author ORDER BY ts, event_id) AS r FROM feed) WHERE r <= 5 OR author = 'unknown')"""


def feed(spark, d):
    """Events as time-ordered posts of an author, each with a number of chunks."""
    return V.table(spark, d, "events").select(
        "event_id", "event_type", "ts",
        F.when(F.col("user_id") % 10 == 0, "unknown")
        .otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("author"),
        (1 + F.col("event_id") % 4).alias("n_chunks"),
    )


def quota(spark, d):
    return V.table(spark, d, "events").count() // SHARE


@query("d01_bernoulli", f"SELECT doc_id FROM documents WHERE {H.format('doc_id')} < '40000000'")
def d01_bernoulli(spark, d):
    return sampling.bernoulli(V.table(spark, d, "documents"), "doc_id", 0.25).select("doc_id")


@query(
    "d02_sample_n",
    f"SELECT doc_id, lang FROM documents ORDER BY {H.format('doc_id')}, doc_id LIMIT 300",
)
def d02_sample_n(spark, d):
    return sampling.sample_n(V.table(spark, d, "documents"), "doc_id", 300).select("doc_id", "lang")


@query(
    "d03_shuffle",
    f"""SELECT doc_id, row_number() OVER (ORDER BY {H.format('doc_id')}, doc_id) - 1 AS pos
    FROM documents""",
)
def d03_shuffle(spark, d):
    return sampling.shuffled(V.table(spark, d, "documents").select("doc_id"), "doc_id")


@query(
    "d04_limit",
    """WITH e AS (SELECT CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 10 END AS slot,
      event_id // 3 AS third, event_type FROM events),
    cut AS (SELECT 'most' AS page, * FROM e ORDER BY slot NULLS FIRST, third, event_type
      LIMIT (SELECT count(*) * 9 // 10 FROM e)),
    few AS (SELECT 'few', * FROM e ORDER BY slot NULLS FIRST, third, event_type LIMIT 250)
    SELECT * FROM cut UNION ALL SELECT * FROM few""",
)
def d04_limit(spark, d):
    """Order columns that repeat and hold nulls, a page of nine tenths of the table and a short one."""
    events = V.table(spark, d, "events").select(
        F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 10).alias("slot"),
        F.floor(F.col("event_id") / 3).alias("third"), "event_type",
    )
    order = ["slot", "third", "event_type"]
    pages = {"most": events.count() * 9 // 10, "few": 250}
    return union_all(*[
        ranking.first_rows(events, order, n).select(F.lit(name).alias("page"), "*")
        for name, n in pages.items()
    ])


@query(
    "d05_quota",
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    t AS (SELECT sum(n) AS total, count(*) * 60 AS target FROM c)
    SELECT source, n, CAST(greatest(40, least(floor(CAST(n AS DOUBLE) / total * target), 70))
      AS BIGINT) AS quota FROM c, t""",
)
def d05_quota(spark, d):
    return sampling.quotas(V.table(spark, d, "documents"), "source", 60, 40, 70)


@query(
    "d06_take_until",
    f"""WITH {FEED}, p AS (SELECT *, coalesce(sum(n_chunks) OVER (PARTITION BY event_type
      ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
      FROM feed) SELECT event_id, event_type, n_chunks FROM p WHERE prior < quota""",
)
def d06_take_until(spark, d):
    rows = feed(spark, d).drop("author")
    kept = sampling.until_quota(
        rows, ["event_type"], ["ts", "event_id"], "n_chunks", F.lit(quota(spark, d))
    )
    return kept.select("event_id", "event_type", "n_chunks")


@query("d07_author_cap", f"WITH {CAPPED} SELECT event_id, author FROM capped")
def d07_author_cap(spark, d):
    return sampling.author_cap(feed(spark, d), "author", ["ts", "event_id"]).select(
        "event_id", "author"
    )


def in_turn_sql(source: str, key: str, group: str, order: str, size: str, quota: str) -> str:
    """CTEs that end in `taken(key)`: groups one after another by name, the author slots that
    earlier groups used carried along. `quota` may read the columns of `source`."""
    return f"""turns_g AS (SELECT {group}, row_number() OVER (ORDER BY {group}) AS step
  FROM (SELECT DISTINCT {group} FROM {source})),
acc AS (
  SELECT CAST(0 AS BIGINT) AS step, {key}, author FROM {source} WHERE false
  UNION ALL SELECT 0, NULL, NULL
  UNION ALL
  (WITH now AS (SELECT max(step) + 1 AS step FROM acc),
  used AS (SELECT author, count(*) AS used FROM acc GROUP BY author),
  ranked AS (SELECT f.*, now.step, row_number() OVER (PARTITION BY f.author ORDER BY {order}) AS r,
      coalesce(used, 0) AS used
    FROM {source} f JOIN turns_g USING ({group}) JOIN now USING (step)
    LEFT JOIN used ON f.author = used.author),
  fits AS (SELECT *, coalesce(sum({size}) OVER (ORDER BY {order}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
    FROM ranked WHERE author = 'unknown' OR r + used <= 5)
  SELECT step, {key}, author FROM fits WHERE prior < {quota}
  UNION ALL SELECT now.step, acc.{key}, acc.author FROM acc, now
    WHERE now.step <= (SELECT count(*) FROM turns_g))),
taken AS (SELECT {key} FROM acc WHERE step = (SELECT count(*) FROM turns_g) AND {key} IS NOT NULL)"""


@query(
    "d08_cap_quota",
    f"""WITH RECURSIVE {FEED}, {in_turn_sql('feed', 'event_id', 'event_type', 'ts, event_id', 'n_chunks', 'quota')}
    SELECT event_id, author, event_type, n_chunks FROM feed WHERE event_id IN (SELECT event_id FROM taken)""",
)
def d08_cap_quota(spark, d):
    rows = feed(spark, d)
    wanted = rows.select("event_type").distinct().withColumn("quota", F.lit(quota(spark, d)))
    return sampling.cap_and_quota(
        rows, "author", "event_type", ["ts", "event_id"], "n_chunks", wanted
    ).select("event_id", "author", "event_type", "n_chunks")


@query(
    "d13_cap_then_quota",
    f"""WITH {CAPPED}, p AS (SELECT *, coalesce(sum(n_chunks) OVER (PARTITION BY event_type
      ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
      FROM capped) SELECT event_id, author, event_type FROM p WHERE prior < quota""",
)
def d13_cap_then_quota(spark, d):
    kept = sampling.cap_then_quota(
        feed(spark, d), "author", "event_type", ["ts", "event_id"], "n_chunks", quota(spark, d)
    )
    return kept.select("event_id", "author", "event_type")


@query(
    "d09_replicate",
    """SELECT doc_id, unnest(range(1, 4)) AS copy_id FROM labels WHERE quality = 1
    UNION ALL SELECT doc_id, unnest(range(4, 6)) FROM labels WHERE toxic = 1""",
)
def d09_replicate(spark, d):
    labels = V.table(spark, d, "labels")
    three = sampling.replicate(labels.where("quality = 1").select("doc_id"), 3)
    two = sampling.replicate(labels.where("toxic = 1").select("doc_id"), 2, 4)
    return three.unionByName(two).select("doc_id", V.long(F.col("copy_id")).alias("copy_id"))


BALANCED = """r AS (SELECT count(*) AS n FROM vectors WHERE binary_label = 1),
safe AS (SELECT *, md5('42:' || vec_id) AS h FROM vectors WHERE binary_label = 0),
sad AS (SELECT vec_id, row_number() OVER (ORDER BY h, vec_id) AS k FROM safe WHERE neg_score > 0.5),
happy AS (SELECT vec_id, row_number() OVER (ORDER BY h, vec_id) AS k FROM safe WHERE pos_score > 0.5),
neutral AS (SELECT vec_id, row_number() OVER (ORDER BY h, vec_id) AS k FROM safe
  WHERE pos_score <= 0.5 AND neg_score <= 0.5),
balanced AS (
  SELECT vec_id, unnest(range(1, 4)) AS copy_id FROM sad, r WHERE k <= floor(floor(r.n * 1.0) / 3)
  UNION ALL SELECT vec_id, unnest(range(4, 6)) FROM happy, r WHERE k <= floor(floor(r.n * 0.5) / 2)
  UNION ALL SELECT vec_id, 0 FROM neutral, r WHERE k <= r.n)"""


@query("d10_balance", f"WITH {V.VECTORS}, {BALANCED} SELECT vec_id, copy_id FROM balanced")
def d10_balance(spark, d):
    rows = V.vectors(spark, d)
    risk = rows.where("binary_label = 1").agg(F.count("*")).scalar()
    safe = rows.where("binary_label = 0").select(
        "vec_id", (F.col("neg_score") > 0.5).alias("sad"), (F.col("pos_score") > 0.5).alias("happy")
    )
    made = sampling.balanced_safe(safe, risk, "vec_id", F.lit(True))
    return made.select("vec_id", V.long(F.col("copy_id")).alias("copy_id"))


SPLIT = """entities AS (SELECT DISTINCT author, binary_label FROM vectors
  WHERE author NOT IN ('unknown', '[deleted]', '')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY binary_label ORDER BY md5('42:' || author),
    author) AS r, count(*) OVER (PARTITION BY binary_label) AS n FROM entities),
train_authors AS (SELECT author FROM ranked WHERE r > ceil(n * 0.15)),
split AS (SELECT *, CASE WHEN author IN ('unknown', '[deleted]', '')
    OR author IN (SELECT author FROM train_authors) THEN 'train' ELSE 'test' END AS side FROM vectors)"""


@query("d11_author_split", f"WITH {V.VECTORS}, {SPLIT} SELECT vec_id, author, side FROM split")
def d11_author_split(spark, d):
    return sampling.author_split(V.vectors(spark, d)).select("vec_id", "author", "side")


@query(
    "d12_random_split",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {H.format('doc_id')}, doc_id) AS r,
      count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN r <= ceil(n * 0.1) THEN 'test' ELSE 'train' END AS side FROM r""",
)
def d12_random_split(spark, d):
    return sampling.random_split(V.table(spark, d, "documents").select("doc_id"), "doc_id", 0.1)
