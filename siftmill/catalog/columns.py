"""Projections, filters, text, array and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill import settings
from siftmill.catalog import query
from siftmill.catalog import views as V
from siftmill.functions import parsing, text
from siftmill.operators import filters
from siftmill.session import spread


@query("p01_rename", "SELECT doc_id, n_chars AS labels, md5(text) AS text, lang AS input FROM documents")
def p01_rename(spark, d):
    docs = V.table(spark, d, "documents").select(
        "doc_id", F.col("n_chars").alias("full_dist"), F.md5("text").alias("text"),
        F.col("lang").alias("input"),
    )
    return filters.standard_names(docs)


@query(
    "p02_evolve",
    "SELECT doc_id, lang, CAST(NULL AS DOUBLE) AS negative, CAST(NULL AS VARCHAR) AS author "
    "FROM documents",
)
def p02_evolve(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    grown = filters.ensure_columns(
        docs, {"lang": "string", "emotion_scores": parsing.SCORES, "author": "string"}
    )
    slim = filters.drop_columns(grown, "source", "n_chars", "emotion_label")
    return slim.select("doc_id", "lang", F.col("emotion_scores.negative"), "author")


@query(
    "p03_date_range",
    f"""WITH {V.POSTS}, raw AS (SELECT post_id, CASE WHEN doc_id % 11 = 0 THEN 'n/a'
      ELSE CAST(CAST(created_utc AS BIGINT) AS VARCHAR) END AS created_utc FROM posts)
    SELECT post_id, CAST(TRY_CAST(created_utc AS DOUBLE) AS BIGINT) AS second FROM raw
    WHERE TRY_CAST(created_utc AS DOUBLE) BETWEEN 1627776000 AND 1661990400""",
)
def p03_date_range(spark, d):
    raw = V.posts(spark, d).select(
        "post_id",
        F.when(F.col("doc_id") % 11 == 0, "n/a")
        .otherwise(F.col("created_utc").cast("long").cast("string")).alias("created_utc"),
    )
    return filters.in_period(raw).select(
        "post_id", F.col("created_utc").cast("double").cast("long").alias("second")
    )


@query(
    "p04_valid_body",
    f"""WITH {V.POSTS} SELECT post_id, md5(selftext) AS body FROM posts
    WHERE lower(selftext) NOT IN ('nan', 'none', '', '[removed]', '[deleted]')""",
)
def p04_valid_body(spark, d):
    kept = filters.valid_body(V.posts(spark, d), "selftext")
    return kept.select("post_id", F.md5("selftext").alias("body"))


@query(
    "p05_quality_filter",
    f"""WITH {V.POSTS} SELECT post_id, {V.tokens_sql('selftext')} AS tokens FROM posts
    WHERE {V.strip_sql('selftext')} <> '' AND NOT contains(selftext, '[removed]')
      AND NOT contains(selftext, '[deleted]') AND {V.tokens_sql('selftext')} >= 20""",
)
def p05_quality_filter(spark, d):
    kept = filters.quality_body(spread(V.posts(spark, d), "post_id"), "selftext")
    return kept.select("post_id", V.long(text.token_count(F.col("selftext"))).alias("tokens"))


@query(
    "p06_min_length",
    f"""WITH {V.POSTS} SELECT post_id, length({V.strip_sql('selftext')}) AS n FROM posts
    WHERE length({V.strip_sql('selftext')}) > 5""",
)
def p06_min_length(spark, d):
    kept = filters.longer_than(V.posts(spark, d), "selftext", 5)
    return kept.select("post_id", V.long(F.length(text.strip(F.col("selftext")))).alias("n"))


@query("p07_drop_flagged", "SELECT doc_id, quality FROM labels WHERE NOT (toxic = 1)")
def p07_drop_flagged(spark, d):
    rows = V.table(spark, d, "labels").withColumn("example_very_unclear", F.col("toxic") == 1)
    return filters.drop_flagged(rows).select("doc_id", "quality")


@query(
    "p08_language",
    f"""WITH {V.CHATS} SELECT conv_id, turn FROM chats
    WHERE language = 'English' AND text IS NOT NULL""",
)
def p08_language(spark, d):
    return filters.in_language(V.chats(spark, d)).select("conv_id", "turn")


@query(
    "p09_binary_label",
    f"""WITH {V.VECTORS}, tagged AS (
      SELECT vec_id, 'mental_health_posts' AS dataset_type FROM vectors WHERE binary_label = 1
      UNION ALL SELECT vec_id, 'safe_posts' FROM vectors WHERE binary_label = 0)
    SELECT vec_id, dataset_type,
      CASE WHEN contains(dataset_type, 'mental_health') THEN 1 ELSE 0 END AS binary_label
    FROM tagged""",
)
def p09_binary_label(spark, d):
    rows = V.vectors(spark, d).select("vec_id", F.col("binary_label").alias("b"))
    tagged = filters.tag_source(rows.where("b = 1"), "mental_health_posts").unionByName(
        filters.tag_source(rows.where("b = 0"), "safe_posts")
    )
    return tagged.select(
        "vec_id", "dataset_type",
        filters.binary_label(F.col("dataset_type")).alias("binary_label"),
    )


@query(
    "p10_safe_cast",
    """WITH raw AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' || user_id
        WHEN event_id % 7 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS s FROM events)
    SELECT event_id, coalesce(TRY_CAST(s AS INTEGER), 0) AS score,
      TRY_CAST(s AS INTEGER) AS or_null FROM raw""",
)
def p10_safe_cast(spark, d):
    raw = V.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("user_id").cast("string")))
        .when(F.col("event_id") % 7 == 0, "")
        .otherwise(F.col("user_id").cast("string")).alias("s"),
    )
    return raw.select(
        "event_id",
        parsing.to_int(F.col("s")).alias("score"),
        parsing.to_int(F.col("s"), None).alias("or_null"),
    )


@query(
    "p11_defaults",
    """SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE 'p' || d.doc_id END,
        'file_' || d.doc_id) AS post_id,
      coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS author, '' AS title
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def p11_defaults(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id")
    labels = V.table(spark, d, "labels").select("doc_id", "quality")
    raw = docs.join(labels, "doc_id", "left")
    own = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    return raw.select(
        "doc_id",
        F.coalesce(own, filters.composite_id(F.lit("file"), "doc_id")).alias("post_id"),
        F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("author"),
        F.lit("").alias("title"),
    )


@query(
    "p12_clean_class",
    f"""SELECT doc_id, {V.strip_sql("'  ' || source || chr(9)")} AS clean_subreddit
    FROM documents""",
)
def p12_clean_class(spark, d):
    raw = F.concat(F.lit("  "), F.col("source"), F.lit("\t"))
    return V.table(spark, d, "documents").select(
        "doc_id", text.strip(raw).alias("clean_subreddit")
    )


@query(
    "p13_strip_nul",
    """SELECT doc_id, md5(replace(substr(text, 1, 3) || chr(0) || substr(text, 4) || chr(0),
        chr(0), '')) AS body, length(text) AS n FROM documents""",
)
def p13_strip_nul(spark, d):
    raw = V.table(spark, d, "documents").select(
        "doc_id",
        F.concat(
            F.substring("text", 1, 3), F.lit("\0"), F.expr("substr(text, 4)"), F.lit("\0")
        ).alias("text"),
    )
    return filters.strip_nul(raw).select(
        "doc_id", F.md5("text").alias("body"), V.long(F.length("text")).alias("n")
    )


@query(
    "p14_composite_id",
    "SELECT source || '_' || doc_id AS post_id, lang || '_' || n_chars AS other_id FROM documents",
)
def p14_composite_id(spark, d):
    return V.table(spark, d, "documents").select(
        filters.composite_id("source", "doc_id").alias("post_id"),
        filters.composite_id("lang", "n_chars").alias("other_id"),
    )


@query(
    "p15_preview",
    f"""WITH {V.VECTORS} SELECT d.doc_id,
      substr(replace(d.text, chr(10), ' '), 1, 78) AS line,
      substr(replace(d.text, chr(10), ' '), 1, 58) AS short_line,
      printf('%.1f%%', round(v.pos_score, 6) * 100 + 0.0000001) AS conf
    FROM documents d JOIN vectors v ON d.doc_id = v.vec_id""",
)
def p15_preview(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    scored = docs.join(
        V.vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "pos_score"), "doc_id"
    )
    return scored.select(
        "doc_id",
        text.preview(F.col("text")).alias("line"),
        text.preview(F.col("text"), 58).alias("short_line"),
        text.percent(F.round("pos_score", 6) + 0.000000001).alias("conf"),
    )


@query(
    "p16_ascii_filter",
    r"""SELECT doc_id FROM documents WHERE length(text) > 0
      AND length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / length(text) < 0.2""",
)
def p16_ascii_filter(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.where(text.mostly_ascii(F.col("text"))).select("doc_id")


@query(
    "p17_score_filters",
    f"""WITH {V.VECTORS}, risk AS (SELECT * FROM vectors WHERE binary_label = 1),
    flagged AS (SELECT *, pos_score > 0.7 AND neg_score < 0.3 AS bad FROM risk)
    SELECT vec_id, CAST(neg_score > 0.5 AS INTEGER) AS sad, CAST(pos_score > 0.5 AS INTEGER)
      AS happy FROM flagged
    WHERE NOT bad OR (SELECT count(*) FROM flagged WHERE NOT bad) = 0""",
)
def p17_score_filters(spark, d):
    risk = V.vectors(spark, d).where("binary_label = 1")
    return filters.drop_happy_risk(risk).select(
        "vec_id",
        (F.col("neg_score") > settings.EMOTION_FLAG).cast("int").alias("sad"),
        (F.col("pos_score") > settings.EMOTION_FLAG).cast("int").alias("happy"),
    )


@query(
    "t01_sentences",
    f"""WITH s AS (SELECT doc_id, {V.sentences_sql('text')} AS sents FROM documents)
    SELECT doc_id, unnest(range(1, len(sents) + 1)) AS pos, unnest(sents) AS sentence FROM s""",
)
def t01_sentences(spark, d):
    docs = spread(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    split = docs.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("p", "sentence"))
    return split.select("doc_id", V.long(F.col("p") + 1).alias("pos"), "sentence")


@query(
    "t02_windows",
    f"""WITH s AS (SELECT doc_id, {V.sentences_sql('text')} AS sents FROM documents),
    w AS (SELECT doc_id, 1 AS stride, unnest({V.windows_sql('sents', 3, 1)}) AS win FROM s
      UNION ALL SELECT doc_id, 2, unnest({V.windows_sql('sents', 3, 2)}) FROM s)
    SELECT doc_id, stride, md5(win) AS win, length(win) AS n FROM w""",
)
def t02_windows(spark, d):
    docs = spread(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id")

    def rows(stride: int):
        made = text.bind(text.sentences(F.col("text")), lambda s: text.windows(s, 3, stride))
        return docs.select("doc_id", F.lit(stride).alias("stride"), F.explode(made).alias("win"))

    return rows(1).unionByName(rows(2)).select(
        "doc_id", "stride", F.md5("win").alias("win"), V.long(F.length("win")).alias("n")
    )


@query(
    "t03_chunks",
    f"""WITH {V.chunks_sql('documents', 'doc_id', 'text', trimmed=False)}
    SELECT doc_id, md5(chunk) AS chunk, tokens FROM chunks""",
)
def t03_chunks(spark, d):
    docs = spread(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    made = docs.select("doc_id", F.explode(text.chunks(F.col("text"))).alias("c"))
    return made.select(
        "doc_id", F.md5("c.chunk").alias("chunk"), V.long(F.col("c.tokens")).alias("tokens")
    )


@query("t04_token_count", f"SELECT doc_id, {V.tokens_sql('text')} AS tokens FROM documents")
def t04_token_count(spark, d):
    docs = spread(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", V.long(text.token_count(F.col("text"))).alias("tokens"))


@query(
    "t05_chunk_rows",
    f"""WITH {V.POSTS}, {V.chunks_sql('posts', 'post_id, author', 'selftext')}
    SELECT post_id, author, chunk_id, md5(chunk) AS input, tokens AS input_tokens FROM chunks""",
)
def t05_chunk_rows(spark, d):
    posts = spread(V.posts(spark, d), "post_id")
    rows = filters.chunk_rows(posts, "selftext", ["post_id", "author"])
    return rows.select(
        "post_id", "author", V.long(F.col("chunk_id")).alias("chunk_id"),
        F.md5("input").alias("input"), V.long(F.col("input_tokens")).alias("input_tokens"),
    )


@query(
    "t06_parse_vector",
    """WITH raw AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'bad'
        WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(to_json(embedding) AS VARCHAR) END AS s, embedding FROM embeddings)
    SELECT vec_id, len(embedding) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first,
      round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM raw WHERE s IS NOT NULL AND s <> 'bad'""",
)
def t06_parse_vector(spark, d):
    raw = V.table(spark, d, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, "bad")
        .when(F.col("vec_id") % 11 == 0, F.lit(None))
        .otherwise(F.to_json("embedding")).alias("s"),
    )
    read = raw.select("vec_id", parsing.parse_vector(F.col("s")).alias("v")).where("v IS NOT NULL")
    return read.select(
        "vec_id", V.long(F.size("v")).alias("width"),
        V.six(F.col("v")[0]).alias("first"), V.six(F.element_at("v", -1)).alias("last"),
    )



@query(
    "t07_parse_labels",
    """SELECT vec_id, CASE vec_id % 7 WHEN 0 THEN 'joy|w' || label WHEN 1 THEN 'love|w' || label
        WHEN 2 THEN 'fear|w' || label WHEN 3 THEN 'w' || label ELSE '' END AS labels,
      CASE WHEN vec_id % 7 < 3 THEN 2 WHEN vec_id % 7 = 3 THEN 1 ELSE 0 END AS n FROM embeddings""",
)
def t07_parse_labels(spark, d):
    raw = V.table(spark, d, "embeddings").select("vec_id", label_text().alias("s"))
    read = raw.select("vec_id", parsing.parse_labels(F.col("s")).alias("l"))
    return read.select("vec_id", F.array_join("l", "|").alias("labels"), F.size("l").alias("n"))


def label_text():
    """One label list in each of the forms that occur in stored tables."""
    own = F.concat(F.lit("w"), F.col("label").cast("string"))
    kind = F.col("vec_id") % 7
    return (
        F.when(kind == 0, F.concat(F.lit('["joy","'), own, F.lit('"]')))
        .when(kind == 1, F.concat(F.lit('"[\\"love\\",\\"'), own, F.lit('\\"]"')))
        .when(kind == 2, F.concat(F.lit("['fear', '"), own, F.lit("']")))
        .when(kind == 3, F.concat(F.lit('"'), own, F.lit('"')))
        .when(kind == 4, "bad")
        .when(kind == 5, "[]")
    )


@query(
    "t08_emotion_score",
    f"""WITH {V.VECTORS} SELECT vec_id,
      round(CASE WHEN vec_id % 3 = 0 THEN CASE WHEN pos_score > 0.5 THEN 1.0 ELSE 0.0 END
        WHEN vec_id % 5 = 0 THEN 0.0 ELSE pos_score END, 6) AS positive,
      round(CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE neg_score END, 6) AS negative FROM vectors""",
)
def t08_emotion_score(spark, d):
    ident = F.col("vec_id")
    raw = V.vectors(spark, d).select(
        "vec_id",
        F.when(ident % 3 == 0, F.lit(None))
        .when(ident % 5 == 0, F.to_json(F.struct(F.col("neg_score").alias("negative"))))
        .otherwise(F.to_json(F.struct(
            F.col("neg_score").alias("negative"), F.col("pos_score").alias("positive")
        ))).alias("scores"),
        F.when(F.col("pos_score") > 0.5, F.array(F.lit("positive")))
        .otherwise(F.array().cast("array<string>")).alias("predicted"),
    )
    read = parsing.read_scores(F.col("scores"))
    return raw.select(
        "vec_id",
        V.six(parsing.emotion_score(read, F.col("predicted"), "positive")).alias("positive"),
        V.six(parsing.emotion_score(read, F.col("predicted"), "negative")).alias("negative"),
    )


@query(
    "t09_active_labels",
    """SELECT vec_id, array_to_string(list_filter([CASE WHEN label % 2 = 0 THEN 'joy' END,
        CASE WHEN label % 3 = 0 THEN 'love' END, CASE WHEN label > 5 THEN 'sadness' END],
        lambda x: x IS NOT NULL), '|') AS active FROM embeddings""",
)
def t09_active_labels(spark, d):
    wide = V.table(spark, d, "embeddings").select(
        "vec_id",
        (F.col("label") > 5).cast("int").alias("sadness"),
        (F.col("label") % 2 == 0).cast("int").alias("joy"),
        (F.col("label") % 3 == 0).cast("int").alias("love"),
    )
    found = parsing.active_labels(wide, settings.EMOTIONS)
    return wide.select("vec_id", F.array_join(found, "|").alias("active"))


@query(
    "t10_truncate",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{V.TOKEN}')[1:512] AS kept FROM documents)
    SELECT doc_id, len(kept) AS n, md5(array_to_string(kept, ' ')) AS kept FROM t""",
)
def t10_truncate(spark, d):
    docs = spread(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    cut = docs.select("doc_id", text.truncate_tokens(F.col("text")).alias("k"))
    return cut.select(
        "doc_id", V.long(F.size("k")).alias("n"), F.md5(F.array_join("k", " ")).alias("kept")
    )


@query(
    "t11_target_labels",
    """WITH l AS (SELECT vec_id, ['w' || label, CASE WHEN label % 2 = 0 THEN 'joy' ELSE 'zeal' END,
        CASE WHEN label % 3 = 0 THEN 'fear' ELSE 'caring' END, 'w' || label] AS all_l FROM embeddings),
    k AS (SELECT vec_id, list_filter(all_l, lambda x: x IN ('joy', 'fear')) AS kept FROM l)
    SELECT vec_id, array_to_string(kept, '|') AS kept FROM k WHERE len(kept) > 0""",
)
def t11_target_labels(spark, d):
    own = F.concat(F.lit("w"), F.col("label").cast("string"))
    rows = V.table(spark, d, "embeddings").select(
        "vec_id",
        F.array(
            own,
            F.when(F.col("label") % 2 == 0, "joy").otherwise("zeal"),
            F.when(F.col("label") % 3 == 0, "fear").otherwise("caring"),
            own,
        ).alias("all_l"),
    )
    wanted = settings.POSITIVE_EMOTIONS + settings.NEGATIVE_EMOTIONS
    kept = rows.select("vec_id", parsing.keep_labels(F.col("all_l"), wanted).alias("k"))
    return kept.where(F.size("k") > 0).select("vec_id", F.array_join("k", "|").alias("kept"))
