"""Composite jobs over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill import settings
from siftmill.catalog import query
from siftmill.catalog import views as V
from siftmill.catalog.models import SCORED, fixed_probe
from siftmill.catalog.sampling import SPLIT, in_turn_sql
from siftmill.catalog.scores import load_scorer, silver_sql
from siftmill.catalog.sets import INDEX
from siftmill.catalog.turns import PAIRS, TURNS
from siftmill.catalog.vectors import HEAT, K, RISK_CUT, SAFE_CUT, ranked_sql
from siftmill.operators.sets import union_all
from siftmill.plans import compile as compiling
from siftmill.plans import corpora, labels, populate
from siftmill.session import scratch, spread
from siftmill.sources import csv_tree, sinks

OPTIONS = compiling.CompileOptions(
    neighbours=K, label_neighbours=K, risk_density=RISK_CUT, safe_density=SAFE_CUT,
    temperature=HEAT,
)
COMPILED_STEPS = f"""{SPLIT}, {INDEX},
risk0 AS (SELECT * FROM split WHERE side = 'train' AND binary_label = 1),
risk1 AS (SELECT * FROM risk0 WHERE NOT (pos_score > 0.7 AND neg_score < 0.3)
  OR (SELECT count(*) FROM risk0 WHERE NOT (pos_score > 0.7 AND neg_score < 0.3)) = 0),
{ranked_sql('rn', 'risk1', 'risk1')},
risk2 AS (SELECT r.* FROM risk1 r JOIN (SELECT qid, avg(sim) AS density FROM rn GROUP BY qid) x
  ON r.vec_id = x.qid WHERE density > {RISK_CUT}),
safe0 AS (SELECT * FROM split WHERE side = 'train' AND binary_label = 0),
{ranked_sql('sn', 'safe0', 'safe0')},
safe1 AS (SELECT s.*, density, md5('42:' || vec_id) AS h FROM safe0 s
  JOIN (SELECT qid, avg(sim) AS density FROM sn GROUP BY qid) x ON s.vec_id = x.qid),
rc AS (SELECT count(*) AS n FROM risk2),
sad AS (SELECT vec_id, row_number() OVER (ORDER BY h, vec_id) AS k FROM safe1 WHERE neg_score > 0.5),
happy AS (SELECT vec_id, row_number() OVER (ORDER BY h, vec_id) AS k FROM safe1 WHERE pos_score > 0.5),
neutral AS (SELECT vec_id, row_number() OVER (ORDER BY h, vec_id) AS k FROM safe1
  WHERE pos_score <= 0.5 AND neg_score <= 0.5 AND density > {SAFE_CUT}),
ids AS (SELECT vec_id, 0 AS copy_id FROM risk2
  UNION ALL SELECT vec_id, unnest(range(1, 4)) FROM sad, rc WHERE k <= floor(floor(n * 1.0) / 3)
  UNION ALL SELECT vec_id, unnest(range(4, 6)) FROM happy, rc WHERE k <= floor(floor(n * 0.5) / 2)
  UNION ALL SELECT vec_id, 0 FROM neutral, rc WHERE k <= n
  UNION ALL SELECT vec_id, 0 FROM split WHERE side = 'test'),
final AS (SELECT s.vec_id AS ident, copy_id, s.vec_id * 10 + copy_id AS vec_id, side, binary_label,
  class_idx AS label, v FROM ids i JOIN split s ON i.vec_id = s.vec_id
  JOIN idx ON s.subreddit = idx.subreddit),
teach AS (SELECT * FROM final WHERE side = 'train'),
{ranked_sql('tn', 'final', 'teach')},
wts AS (SELECT qid, label, sum(exp(sim / {HEAT})) AS w FROM tn GROUP BY qid, label),
shares AS (SELECT qid, label AS class_idx, w / sum(w) OVER (PARTITION BY qid) AS p FROM wts)"""
COMPILED = f"{V.VECTORS}, {COMPILED_STEPS}"
# A snapshot has no whole-number key: its rows are numbered by post_id. Every fifth row has predicted
# labels in place of scores.
SNAPSHOT = f"""plain AS (WITH {V.VECTORS} SELECT * FROM vectors), vectors AS (SELECT * REPLACE (
  row_number() OVER (ORDER BY 'v' || vec_id) - 1 AS vec_id,
  CASE WHEN vec_id % 5 = 0 THEN CAST(pos_score > 0.5 AS INTEGER) ELSE pos_score END AS pos_score,
  CASE WHEN vec_id % 5 = 0 THEN CAST(neg_score > 0.5 AS INTEGER) ELSE neg_score END AS neg_score),
  'text ' || vec_id AS text FROM plain)"""


@query(
    "z01_compile_train",
    f"""WITH {COMPILED} SELECT ident AS vec_id, CAST(copy_id AS INTEGER) AS copy_id, side,
      binary_label, class_idx, round(p, 6) AS p FROM final JOIN shares ON qid = vec_id""",
)
def z01_compile_train(spark, d):
    made = compiling.compile_sets(V.vectors(spark, d), options=OPTIONS)
    joined = made.rows.drop("class_idx").join(
        made.shares.withColumnRenamed("qid", "row_id"), "row_id"
    )
    return joined.select(
        "vec_id", "copy_id", "side", "binary_label", "class_idx", V.six(F.col("p")).alias("p")
    )


@query(
    "z01_compile_funnel",
    f"""WITH {COMPILED}
    SELECT 'all' AS stage, count(*) AS rows FROM vectors
    UNION ALL SELECT 'train', count(*) FROM split WHERE side = 'train'
    UNION ALL SELECT 'risk', count(*) FROM risk0
    UNION ALL SELECT 'risk_calm', count(*) FROM risk1
    UNION ALL SELECT 'risk_clean', count(*) FROM risk2
    UNION ALL SELECT 'safe', count(*) FROM safe1
    UNION ALL SELECT 'safe_sad', count(*) FROM sad
    UNION ALL SELECT 'safe_happy', count(*) FROM happy
    UNION ALL SELECT 'safe_neutral', count(*) FROM neutral
    UNION ALL SELECT 'final_train', count(*) FROM teach
    UNION ALL SELECT 'test', count(*) FROM split WHERE side = 'test'""",
)
def z01_compile_funnel(spark, d):
    return compiling.compile_sets(V.vectors(spark, d), options=OPTIONS).funnel


@query(
    "z01_compile_written",
    f"""WITH {SNAPSHOT}, {COMPILED_STEPS},
    risky AS (SELECT DISTINCT subreddit FROM vectors WHERE binary_label = 1)
    SELECT s.side, s.text, s.binary_label AS label, s.subreddit, i.class_idx,
      i.subreddit AS class_name, CAST(i.subreddit IN (SELECT subreddit FROM risky) AS INTEGER) AS risk,
      round(coalesce(p, 0), 6) AS p
    FROM final f JOIN split s ON f.ident = s.vec_id CROSS JOIN idx i
    LEFT JOIN shares h ON h.qid = f.vec_id AND h.class_idx = i.class_idx""",
)
def z01_compile_written(spark, d):
    """A snapshot is written, compiled and written again; the rows come from the written files."""
    rows = V.vectors(spark, d)
    ident = F.col("vec_id").cast("string")
    labelled = F.col("vec_id") % 5 == 0
    predicted = F.array_compact(F.array(*[
        F.when(F.col(f"{short}_score") > settings.EMOTION_FLAG, F.lit(name))
        for short, name in (("pos", "positive"), ("neg", "negative"))
    ]))
    scores = F.struct(F.col("neg_score").alias("negative"), F.col("pos_score").alias("positive"))
    posts = rows.select(
        F.concat(F.lit("v"), ident).alias("post_id"), F.concat(F.lit("text "), ident).alias("input"),
        "embedding", "subreddit", "author", "binary_label",
        F.when(~labelled, scores).alias("emotion_scores"),
        F.when(labelled, predicted).alias("predicted_emotions"),
    )
    path = scratch(spark, "snapshot")
    sinks.write_snapshot(
        {"mental_health_posts": posts.where("binary_label = 1"),
         "safe_posts": posts.where("binary_label = 0")}, path,
    )
    made = compiling.compile_snapshot(path, scratch(spark, "sets"), spark, options=OPTIONS)
    risky = made.risk_classes.select("class_idx", F.lit(1).alias("risk"))
    names = made.classes.withColumnRenamed("subreddit", "class_name").join(risky, "class_idx", "left")
    cells = made.rows.select(
        "side", "text", "label", "subreddit", F.posexplode("soft_label").alias("class_idx", "p")
    )
    return cells.join(names, "class_idx").select(
        "side", "text", "label", "subreddit", "class_idx", "class_name",
        F.coalesce("risk", F.lit(0)).alias("risk"), V.six(F.col("p")).alias("p"),
    )


@query(
    "z02_risk_posts",
    f"""WITH {V.POSTS}, ok AS (SELECT *, row_number() OVER (PARTITION BY author
        ORDER BY created_utc, post_id) AS r FROM posts
      WHERE lower(selftext) NOT IN ('nan', 'none', '', '[removed]', '[deleted]')
        AND substr(md5('42:' || post_id), 1, 8) < 'c0000000'
        AND created_utc BETWEEN 1627776000 AND 1661990400),
    capped AS (SELECT * FROM ok WHERE r <= 5 OR author = 'unknown'),
    {V.chunks_sql('capped', 'post_id, author, created_utc, subreddit, title, score', 'selftext')}
    SELECT post_id, author, created_utc, subreddit, coalesce(title, '') AS title,
      coalesce(TRY_CAST(score AS INTEGER), 0) AS score, chunk_id, md5(chunk) AS input, tokens AS input_tokens
    FROM chunks ORDER BY created_utc, post_id, chunk_id LIMIT (SELECT 5 * count(*) FROM documents)""",
)
def z02_risk_posts(spark, d):
    posts = spread(V.posts(spark, d), "post_id")
    limit = 5 * V.table(spark, d, "documents").count()
    made = corpora.risk_posts(posts, order=["created_utc", "post_id"], rate=0.75, limit=limit)
    return made.select(
        "post_id", *corpora.POST_COLUMNS, V.long(F.col("chunk_id")).alias("chunk_id"), F.md5("input").alias("input"),
        V.long(F.col("input_tokens")).alias("input_tokens"),
    )


@query(
    "z03_control_posts",
    f"""WITH RECURSIVE {V.POSTS}, shares AS (SELECT subreddit, CAST(greatest(sum(count(*)) OVER () // 25, least(floor(
        CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * (count(*) OVER () * (sum(count(*)) OVER () // 10))),
        sum(count(*)) OVER () // 5)) AS BIGINT) AS quota FROM posts GROUP BY subreddit),
    good AS (SELECT * FROM posts WHERE created_utc BETWEEN 1627776000 AND 1661990400
      AND {V.strip_sql('selftext')} <> '' AND NOT contains(selftext, '[removed]')
      AND NOT contains(selftext, '[deleted]') AND {V.tokens_sql('selftext')} >= 20),
    {V.chunks_sql('good', 'post_id', 'selftext')},
    sized AS (SELECT g.post_id, author, g.subreddit, created_utc, title, score, quota,
        (SELECT count(*) FROM chunks c WHERE c.post_id = g.post_id) AS n_chunks
      FROM good g JOIN shares USING (subreddit)),
    {in_turn_sql('sized', 'post_id', 'subreddit', 'created_utc, post_id', 'n_chunks', 'quota')}
    SELECT post_id, author, subreddit, created_utc, coalesce(title, '') AS title,
      coalesce(TRY_CAST(score AS INTEGER), 0) AS score, chunk_id, md5(chunk) AS input, tokens AS input_tokens,
      row_number() OVER (ORDER BY md5('42:' || post_id || '_' || chunk_id),
        post_id || '_' || chunk_id) - 1 AS pos
    FROM chunks JOIN sized USING (post_id) WHERE post_id IN (SELECT post_id FROM taken)""",
)
def z03_control_posts(spark, d):
    posts = spread(V.posts(spark, d), "post_id")
    n = V.table(spark, d, "documents").count()
    wanted = corpora.quota_table(posts, "subreddit", per_group=n // 10, low=n // 25, high=n // 5)
    made = corpora.control_posts(posts, wanted, order=["created_utc", "post_id"])
    return made.select(
        "post_id", *corpora.POST_COLUMNS, V.long(F.col("chunk_id")).alias("chunk_id"),
        F.md5("input").alias("input"), V.long(F.col("input_tokens")).alias("input_tokens"), "pos",
    )


@query(
    "z04_chats",
    f"""WITH {PAIRS}, english AS (SELECT * FROM turn_pairs WHERE language = 'English'),
    wanted AS (SELECT * FROM english WHERE conv_id IN
      (SELECT DISTINCT conv_id FROM english ORDER BY conv_id
        LIMIT (SELECT count(DISTINCT conv_id) // 2 FROM conversations))),
    {V.chunks_sql('wanted', 'conv_id, turn_id, language, model, output', 'input')}
    SELECT 'chunk' AS kind, conv_id, turn_id, language, model, chunk_id, md5(chunk) AS input, tokens AS input_tokens
    FROM chunks
    UNION ALL SELECT 'pair', conv_id, turn_id, language, model, 0, md5(input), {V.tokens_sql('input')} FROM turn_pairs""",
)
def z04_chats(spark, d):
    chats = V.chats(spark, d)
    pairs = corpora.chat_pairs(chats).select(
        F.lit("pair").alias("kind"), "conv_id", "turn_id", "language", "model",
        F.lit(0).alias("chunk_id"), "input", "input_tokens",
    )
    half = chats.select("conv_id").distinct().count() // 2
    chunks = corpora.chat_chunks(chats, half).withColumn("kind", F.lit("chunk"))
    return union_all(pairs, chunks).select(
        "kind", "conv_id", "turn_id", "language", "model", V.long(F.col("chunk_id")).alias("chunk_id"),
        F.md5("input").alias("input"), V.long(F.col("input_tokens")).alias("input_tokens"),
    )


EMOTION_ROWS = """SELECT d.doc_id AS id, d.text, CASE WHEN d.doc_id % 2 = 0 THEN 1 ELSE 0 END AS joy,
    CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS sadness, l.toxic,
    CASE WHEN d.doc_id % 5 = 0 THEN 'unknown' ELSE d.source END AS subreddit
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


@query(
    "z05_emotions",
    f"""WITH raw AS ({EMOTION_ROWS}), clear AS (SELECT id, subreddit, text, array_to_string(list_filter([
        CASE WHEN joy = 1 THEN 'joy' END, CASE WHEN sadness = 1 THEN 'sadness' END],
        lambda x: x IS NOT NULL), '|') AS emotions FROM raw WHERE toxic <> 1),
    {V.chunks_sql('clear', 'id, subreddit, emotions', 'text')}
    SELECT id, subreddit, emotions, chunk_id, md5(chunk) AS input, tokens AS input_tokens FROM chunks""",
)
def z05_emotions(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text", "source")
    raw = docs.join(V.table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), "text",
        (F.col("doc_id") % 3 == 0).cast("int").alias("sadness"),
        (F.col("doc_id") % 2 == 0).cast("int").alias("joy"),
        (F.col("toxic") == 1).alias("example_very_unclear"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("subreddit"),
    )
    root = scratch(spark, "emotions")
    csv_tree.write_csv(raw, f"{root}/full")
    read = csv_tree.read_csv_tree(spark, root, required=["text"])
    typed = read.withColumn("example_very_unclear", F.col("example_very_unclear").cast("boolean"))
    made = corpora.labelled_emotions(typed)
    return made.select(
        F.col("id").cast("long").alias("id"), "subreddit", F.array_join("emotions", "|").alias("emotions"),
        V.long(F.col("chunk_id")).alias("chunk_id"), F.md5("input").alias("input"),
        V.long(F.col("input_tokens")).alias("input_tokens"),
    )


@query(
    "z06_enrich",
    f"""WITH {SCORED} SELECT f.vec_id,
      CASE WHEN f.vec_id % 13 = 0 THEN 'old' WHEN pos >= 0.9 AND neg >= 0.9 THEN 'positive|negative'
        WHEN pos >= 0.9 THEN 'positive' WHEN neg >= 0.9 THEN 'negative' ELSE '' END AS predicted,
      round(CASE WHEN f.vec_id % 13 <> 0 THEN pos END, 6) AS positive,
      round(CASE WHEN f.vec_id % 13 <> 0 THEN neg END, 6) AS negative FROM fused f""",
)
def z06_enrich(spark, d):
    stored = V.table(spark, d, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 13 == 0, "bad").otherwise(F.to_json("embedding")).alias("embedding"),
        F.array(F.lit("old")).alias("predicted_emotions"),
    )
    made = labels.enrich(stored, fixed_probe(), "vec_id", "embedding", scratch(spark, "enrich"), 2)
    return made.select(
        "vec_id", F.array_join("predicted_emotions", "|").alias("predicted"),
        V.six(F.col("emotion_scores.positive")).alias("positive"),
        V.six(F.col("emotion_scores.negative")).alias("negative"),
    )


@query(
    "z07_silver",
    f"""WITH {TURNS}, {V.POSTS}, corpus AS (
      SELECT 'first_' || conv_id AS id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn) AS r FROM chats WHERE role = 'user') WHERE r = 1 AND length(text) > 0
      UNION ALL SELECT 'turn_' || conv_id || '_' || place, text FROM turns
        WHERE role = 'user' AND length({V.strip_sql('text')}) > 5
      UNION ALL SELECT 'post_' || post_id, selftext FROM posts
        WHERE length({V.strip_sql('selftext')}) > 5),
    {silver_sql('corpus', 'id', 'text', 0.5)}
    SELECT id, CAST(top_class AS VARCHAR) AS top_label, round(confidence, 6) AS confidence,
      round(dist[1], 6) AS p0 FROM silver WHERE len(dist) > 0""",
)
def z07_silver(spark, d):
    chats = V.chats(spark, d)
    posts = spread(V.posts(spark, d), "post_id")

    def named(rows, prefix, ident, column):
        return rows.select(
            F.concat(F.lit(prefix), F.col(ident)).alias("id"), F.col(column).alias("text")
        )

    corpus = union_all(
        named(labels.first_turns(chats), "first_", "id", "text"),
        named(labels.all_user_turns(chats), "turn_", "id", "text"),
        named(labels.long_posts(posts), "post_", "id", "text"),
    )
    made = labels.silver_corpus(
        corpus, "id", "text", load_scorer, scratch(spark, "silver"), temperature=0.5
    )
    return made.select(
        "id", "top_label", V.six(F.col("confidence")).alias("confidence"),
        V.six(F.col("full_dist")[0]).alias("p0"),
    )


def load_sizes(refused: int):
    """Vectors of sizes; a list that holds a text whose size leaves no rest by `refused` fails."""

    def embed(texts):
        if refused and any(len(t) % refused == 0 for t in texts):
            raise ValueError("refused")
        return [[len(t), t.count("e")] for t in texts]

    return lambda: embed


@query(
    "z08_populate",
    """SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN 2 ELSE 1 END AS run, length(text) AS size,
      length(text) - length(replace(text, 'e', '')) AS e, 1 AS copies FROM documents""",
)
def z08_populate(spark, d):
    """Two runs: the first fails on every fifth size or so, the second stores what is missing."""
    chunks = spread(V.table(spark, d, "documents"), "doc_id").select(
        "doc_id", F.lit(1).alias("chunk_id"), F.col("text").alias("input")
    )
    path = populate.start_over(spark, scratch(spark, "populate"))
    runs = [
        populate.populate(chunks.withColumn("run", F.lit(n)), ["doc_id", "chunk_id"], load_sizes(r), path)
        for n, r in ((1, 5), (2, 0))
    ]
    return runs[-1].groupBy("doc_id", "run").agg(
        V.long(F.max(F.col("embedding")[0])).alias("size"), V.long(F.max(F.col("embedding")[1])).alias("e"),
        F.count("*").cast("int").alias("copies"),
    )
