import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.llm import ann, queries


def _brute(rows, k, every):
    """{query: [(distance, id)] of its k nearest}, every row once per id and vector."""
    good = {
        (i, tuple(v)) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    ids = [i for i, _ in good]
    x = np.array([v for _, v in good], float)
    out = {}
    for i, v in good:
        if i % every == 0:
            far = np.sqrt(((x - np.array(v, float)) ** 2).sum(axis=1))
            out[i] = sorted((d, j) for d, j in zip(far.tolist(), ids) if j != i)[:k]
    return out


def _found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def _same(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [j for _, j in got[q]] == [j for _, j in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-12, atol=1e-12)


def test_lists_are_balanced_and_walks_find_them():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(4000, 8)), rng.normal(size=(2000, 8)) * 0.05 + 3])
    centroids = ann.balanced_centroids(x, 40)
    index = ann.Index.over(centroids, degree=8)
    sizes = np.bincount([h[0] for h in index.homes(x)], minlength=40)
    assert sizes.max() < 4 * sizes.mean()
    right = 0
    for q in x[::200]:
        far = np.sqrt(((centroids - q) ** 2).sum(axis=1))
        want = set(np.flatnonzero(far <= 1.3 * far.min()).tolist())
        got = set(index.visits(q, 1.3).tolist())
        assert got <= set(np.flatnonzero(far <= 1.3 * far[list(got)].min() + 1e-9).tolist())
        right += want == got
    assert right >= 27


def test_boundary_vectors_are_replicated():
    centroids = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 10.0]])
    index = ann.Index.over(centroids)
    homes = index.homes(np.array([[0.5, 0.0], [0.0, 0.1], [0.0, 9.0]]))
    assert [set(h.tolist()) for h in homes] == [{0, 1}, {0}, {2}]


def test_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]
    rows += [(400, None), (500, [0.0] * 4), (600, [0.1, None, 0.2, 0.3]), (700, [math.nan] * 4), (800, [math.inf, 0.0, 0.0, 0.0]), (900, []), (None, [1.0] * 4), (100, rows[100][1]), (7, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 score", "2 rank", "3 row", "4 key", "5 list")
    _same(_found(ann.neighbours(df, F.col("vec_id") % 100 == 0)), _brute(rows, 10, 100))
    assert ann.neighbours(df.where("false"), F.lit(True)).count() == 0
    assert ann.neighbours(df, F.lit(False)).count() == 0
    alone = ann.neighbours(df.where("vec_id < 3"), F.col("vec_id") == 0)
    assert alone.count() == 2


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(1, 4)]
    rows = [(0, [0.0, 1e-9])] + [(i, [float((-1) ** i), 0.0]) for i in range(40, 0, -1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == list(range(1, 11))


def test_many_lists_still_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = _found(ann.neighbours(df, F.col("vec_id") % 100 == 0, list_rows=60, sample=2000))
    want = _brute(rows, 10, 100)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def _whole(rows, every=100):
    """Brute force among vectors of the query's own length."""
    return {
        q: found for width in {len(v) for _, v in rows}
        for q, found in _brute([r for r in rows if len(r[1]) == width], 10, every).items()
    }


def test_far_queries_and_every_length_are_answered_in_full(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 16)))]
    for i, far in enumerate((60.0, -80.0, 400.0, 1e5)):
        rows[i * 100] = (i * 100, (rng.normal(size=16) + far).tolist())
    rows += [(4000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 5)))]
    rows += [(5000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(15, 2)))]
    rows += [(6000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(4, 3)))]
    rows += [(7000, [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = _found(ann.neighbours(df, F.col("vec_id") % 100 == 0, list_rows=60, sample=2000))
    want = {q: found for q, found in _whole(rows).items() if found}
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    assert 7000 not in got and len(got[6000]) == 3
    for q in (5000, 6000):
        _same({q: got[q]}, {q: want[q]})
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(len({j for _, j in got[q]} & {j for _, j in want[q]}) >= 8 for q in (0, 100, 200, 300))


def test_floats_give_the_scores_of_their_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(250, 8)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    _same(_found(ann.neighbours(df, F.col("vec_id") % 50 == 0)), _brute(rows, 10, 50))


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_query_recall(spark, scale):
    folder = f"/root/testdata/{scale}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, want = _found(queries.QUERIES["op3_ann"](spark, folder)), _brute(rows, 10, 100)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    x = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert all(abs(d - np.linalg.norm(x[q] - x[j])) < 1e-12 for d, j in found)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
