"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siftmill.llm import (
    ann,
    collocations,
    id_files,
    lexical_search,
    license_scan,
    packing,
    quality,
    secret_scan,
    sentence_pieces,
    simhash,
    token_count,
    topk,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@_query("op1_topk", """
WITH whole AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id,
           CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM whole a JOIN whole b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


@_query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


@_query("op3_ann")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0)


@_query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


@_query("op5_token_count")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_documents(spark, sf_dir))


@_query("op6_sentence_pieces")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(_documents(spark, sf_dir))


@_query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


@_query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_documents(spark, sf_dir), _labels(spark, sf_dir))


@_query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir), _labels(spark, sf_dir))


@_query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


@_query("op11_lexical_search", r"""
WITH held AS (
    SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents
), whole AS (
    SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM held WHERE len(t) > 0
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), words AS (
    SELECT place, doc_id, len(t) AS n, unnest(t) AS term FROM held
), postings AS (
    SELECT place, doc_id, n, term, count(*) AS tf FROM words
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(whole.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM postings, whole GROUP BY term
), scored AS (
    SELECT a.item_id, p.place, p.doc_id, CAST(sum(w.w * (
        (1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * whole.n) // whole.l)))) AS BIGINT) AS score
    FROM asked a JOIN postings p ON p.term = a.term JOIN weights w ON w.term = a.term, whole
    GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(_documents(spark, sf_dir))
    return lexical_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.round_trip(_documents(spark, sf_dir))


@_query("op13_collocations", r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), cut AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), sizes AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM cut GROUP BY lang
), starts AS (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM cut, (SELECT unnest(range(1, 6)) AS k)
), counted AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM starts GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, c.k, unnest(range(1, c.k)) AS j, string_split(c.phrase, ' ') AS w
    FROM counted c WHERE c.k >= 2
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, s.n,
           CAST((1000 * c.a::HUGEINT * s.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM cuts c JOIN sizes s ON s.lang = c.lang
    JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
    JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), alone AS (
    SELECT b.* FROM best b WHERE NOT EXISTS (
        SELECT 1 FROM counted o WHERE o.lang = b.lang AND length(o.phrase) > length(b.phrase)
        AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.f >= 100 * b.a)
), ranked AS (
    SELECT *, row_number() OVER (
        PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM alone
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
