"""Neighbour search against brute force: cells, blocks, copies, ties and edges."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftmill.operators import knn


def brute(queries, refs, k, exclude_self=False):
    def unit(rows):
        m = np.array([v for _, v in rows], float)
        s = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(s > 0, s, 1)

    sims = unit(queries) @ unit(refs).T
    out = {}
    for row, (q, _) in enumerate(queries):
        pairs = sorted((-round(sims[row, c], 9), r) for c, (r, _) in enumerate(refs))
        out[q] = [r for _, r in pairs if not (exclude_self and r == q)][:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>"
    )


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["rid"])
    return out


def clustered(n, d=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    return [(i, (centres[i % 6] + 0.3 * rng.normal(size=d)).astype(np.float32)) for i in range(n)]


@pytest.mark.parametrize(
    "options", [{}, {"block_rows": 16}, {"cells": 6, "block_rows": 16}, {"cells": 20, "block_rows": 5}]
)
def test_exact(spark, options):
    rows = clustered(150)
    df = frame(spark, rows)
    assert found(knn.knn(df, df, 7, **options)) == brute(rows, rows, 7)


def test_two_tables_and_payload(spark):
    refs, queries = clustered(90, seed=5), [(1000 + i, v) for i, v in clustered(40, seed=6)]
    ref = frame(spark, refs).withColumn("label", (F.col("vec_id") % 4).cast("int"))
    got = knn.knn(frame(spark, queries), ref, 5, carry=["label"], cells=5, block_rows=10)
    assert found(got) == brute(queries, refs, 5)
    assert all(r["label"] == r["rid"] % 4 for r in got.collect())


@pytest.mark.parametrize("cells", [None, 4])
def test_group_of_copies(spark, cells):
    """A third of the rows holds the same vector; ties go to the lower id."""
    rows = clustered(80)
    rows += [(500 - i, rows[0][1]) for i in range(40)]
    df = frame(spark, rows).repartition(5)
    for exclude in (False, True):
        got = knn.knn(df, df, 6, exclude_self=exclude, cells=cells, block_rows=16)
        assert found(got) == brute(rows, rows, 6, exclude)


def test_ties_between_different_vectors(spark):
    """Integer vectors with many equal similarities at the edge."""
    rows = [(i, [1.0 if j == i % 4 else 0.0 for j in range(4)] + [float(i // 4 % 2)]) for i in range(40)]
    rows = [(39 - i, v) for i, v in rows]
    df = frame(spark, rows)
    assert found(knn.knn(df, df, 9, block_rows=8)) == brute(rows, rows, 9)


def test_few_references_and_zero_vector(spark):
    rows = clustered(5) + [(9, np.zeros(8))]
    df = frame(spark, rows)
    got = found(knn.knn(df, df, 50))
    assert all(len(v) == 6 for v in got.values())
    density = {r["qid"]: r["density"] for r in knn.density(df, k=50).collect()}
    assert density[9] == 0.0


def test_null_vectors_are_left_out(spark):
    df = frame(spark, clustered(10)).unionByName(
        spark.createDataFrame([(77, None)], "vec_id long, embedding array<float>")
    )
    got = found(knn.knn(df, df, 3))
    assert 77 not in got and all(77 not in v for v in got.values())


def test_bounds_hold_on_spread_vectors(spark, medium):
    df = spark.read.parquet(f"{medium}/embeddings.parquet")
    assert found(knn.knn(df, df, 10, cells=12, block_rows=64)) == found(knn.knn(df, df, 10))


def test_trained_pivots_skip_zero_vectors(spark):
    df = frame(spark, clustered(60) + [(99, np.zeros(8))])
    pivots = knn.trained_pivots(df, "embedding", 6)
    rows = clustered(60) + [(99, np.zeros(8))]
    assert found(knn.knn(df, df, 5, pivots=pivots, block_rows=8)) == brute(rows, rows, 5)


def test_recall_of_cells(spark, medium):
    df = spark.read.parquet(f"{medium}/embeddings.parquet")
    exact = found(knn.knn(df, df, 10))
    pivots = knn.trained_pivots(df, "embedding", 16)
    recalls = []
    for nprobe in (2, 8, 16):
        near = found(knn.knn(df, df, 10, pivots=pivots, nprobe=nprobe))
        recalls.append(np.mean([len(set(near[q]) & set(exact[q])) / 10 for q in exact]))
    assert recalls[0] < recalls[1] < recalls[2] == 1.0
    assert recalls[0] > 0.3


def test_soft_labels_sum_to_one(spark):
    rows = clustered(60)
    df = frame(spark, rows).withColumn("class_idx", (F.col("vec_id") % 6).cast("int"))
    classes = df.select("class_idx").distinct()
    lone = df.unionByName(
        spark.createDataFrame([(99, None, 0)], "vec_id long, embedding array<float>, class_idx int")
    )
    shares = knn.soft_labels(lone, df, 5, 0.5, classes=classes)
    sums = {r["qid"]: r["s"] for r in shares.groupBy("qid").agg(F.sum("p").alias("s")).collect()}
    assert len(sums) == 61 and all(abs(s - 1) < 1e-9 for s in sums.values())
    assert shares.where("qid = 99").count() == 6
    arrays = knn.soft_label_arrays(shares, 6).collect()
    assert all(len(r["soft_label"]) == 6 and abs(sum(r["soft_label"]) - 1) < 1e-9 for r in arrays)


def test_risk_score(spark):
    rows = clustered(50)
    df = frame(spark, rows).withColumn("binary_label", (F.col("vec_id") % 2).cast("int"))
    got = {r["qid"]: r["risk"] for r in knn.risk_score(df, df, 7, exclude_self=True).collect()}
    near = brute(rows, rows, 7, True)
    table = dict(rows)
    for q, ids in near.items():
        d = [1 - float(np.dot(table[q], table[r]) / np.linalg.norm(table[q]) / np.linalg.norm(table[r]))
             for r in ids]
        w = [1 / (x + 1e-6) for x in d]
        want = sum(a * (r % 2) for a, r in zip(w, ids)) / sum(w)
        assert abs(got[q] - want) < 1e-4


def rows_from_python(df):
    """Rows that Python workers hand back in the plan of a collected table."""
    seen, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        held = node.metrics().get("pythonNumRowsReceived")
        seen += held.get().value() if held.isDefined() else 0
    return seen


def test_a_comparison_returns_a_list_per_query(spark):
    """However many references there are: not k rows for every block of them."""
    rows = clustered(400)
    df = frame(spark, rows)
    near = knn.knn(df, df, 7, block_rows=16)
    assert found(near) == brute(rows, rows, 7)
    near.collect()
    assert 0 < rows_from_python(near) <= 400


@pytest.mark.parametrize("held_bytes", [knn._Part.held_bytes, 1])
def test_part_meets_its_references_as_a_stream(monkeypatch, held_bytes):
    """Small batches, two parts, ties, copies; what no query holds is forgotten on the way."""
    monkeypatch.setattr(knn._Part, "held_bytes", held_bytes)
    rng = np.random.default_rng(7)
    vecs = [[float(x) for x in rng.integers(-1, 2, 3)] for _ in range(60)]
    copies = [int(c) for c in rng.integers(1, 4, 60)]
    items = [[{"id": 10 * i + c} for c in range(n)] for i, n in enumerate(copies)]
    batches = []
    for part in (0, 3):
        names = {"part": [part] * 60, "key": [str(i) for i in range(60)], "vec": vecs}
        batches.append({**names, "side": [0] * 60, "tau": [-2.0] * 60, "items": [None] * 60})
        batches += [
            {"part": [part] * 7, "key": [None] * 7, "vec": vecs[s : s + 7], "side": [1] * 7,
             "tau": [None] * 7, "items": items[s : s + 7]}
            for s in range(part, 56, 7)
        ]
    schema = pa.schema([
        ("part", pa.int32()), ("side", pa.int32()), ("key", pa.string()),
        ("vec", pa.list_(pa.float64())), ("tau", pa.float64()),
        ("items", pa.list_(pa.struct([("id", pa.int64())]))),
    ])
    made = [pa.RecordBatch.from_pydict(b, schema=schema) for b in batches]
    lists = [r for b in knn._best_of_parts(5)(made) for r in b.to_pylist()]
    assert len(lists) == 120
    unit = [np.array(v) / (np.linalg.norm(v) or 1.0) for v in vecs]
    for number, got in enumerate(lists):
        refs = range(0, 56) if number < 60 else range(3, 59)
        sims = {i: round(float(unit[int(got["qkey"])] @ unit[i]), 9) for i in refs}
        want = sorted((-sims[i], x["id"]) for i in refs for x in items[i])[:5]
        rows = sorted((round(n["away"], 9), x["id"]) for n in got["near"] for x in n["items"])
        assert [x + 0.0 for x, _ in rows[:5]] == [x + 0.0 for x, _ in want]
        assert len(got["near"]) <= 5
