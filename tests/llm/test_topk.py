import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.llm import queries, topk


def _brute(rows, k, every):
    good = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [2, 40, 3000, 2**30, 2**40])
def test_block_against_brute_force(spread):
    rng = np.random.default_rng(spread % 97)
    x = rng.integers(-spread, spread, (700, 9))
    x[50:90] = x[5]
    ids = rng.permutation(700)
    q = np.concatenate([x[:20], rng.integers(-spread, spread, (20, 9)), np.zeros((1, 9), int)])
    own = np.concatenate([ids[:20], np.full(21, -1)])
    for i, (found, scores) in enumerate(topk.best_of_block(ids, x, own, q, 5)):
        exact = [sum(int(a) * int(b) for a, b in zip(row, q[i])) for row in x]
        want = sorted((-s, int(j)) for s, j in zip(exact, ids) if j != own[i])[:5]
        assert [(-int(s), int(j)) for s, j in zip(scores, found)] == want


def test_blocks_smaller_than_k():
    x = np.array([[1, 2], [3, 4]])
    got = topk.best_of_block(np.array([7, 8]), x, np.array([7]), x[:1], 5)
    assert got[0][0].tolist() == [8] and got[0][1].tolist() == [11]


def test_rows(spark):
    rows = [(i, [float(i % 7) / 7, -0.3, (i * i % 11) / 11]) for i in range(100)]
    rows += [(200, None), (201, [0.1, None, 0.2]), (202, [math.nan, 0.0, 0.0]), (203, [math.inf, 0.0, 0.0]), (204, []), (None, [0.1, 0.2, 0.3]), (250, [0.0, 0.0, 0.0]), (300, [1.0, 2.0]), (301, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 score", "2 rank", "3 row", "4 part")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=17, query_rows=2).collect()))
    assert got == _brute(rows, 5, 50)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [0.5])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0, k=3).collect()))
    assert got == sorted([(0, 1, 1, 131072), (0, 2, 1, 131072), (0, 3, 2, 32768)] * 2)


def test_query(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = queries.QUERIES["op1_topk"](spark, small).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == _brute(rows, 5, 50)
