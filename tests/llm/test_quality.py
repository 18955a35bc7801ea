import random
import zlib

import numpy as np
import pytest

from siftmill.llm import quality, queries


def _corpus(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("abcdeorstln", k=rng.randint(2, 8))) for _ in range(rng.randint(15, 80))]
        good = int(i % 4 != 0)
        if not good:
            kind = i % 3
            words = [w.upper() + "!!" for w in words] if kind == 0 else [f"{w} |" for w in words] if kind == 1 else [w for w in words[:6] for _ in range(9)]
        rows.append((i, " ".join(words), good))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = _corpus(500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_held_out_accuracy(tables):
    docs, labels, rows = tables
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r["held_out"]} == held
    assert sum(got[i]["predicted"] == y for i, _, y in rows if i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_held_out_labels_are_not_read(tables):
    docs, labels, _ = tables
    lies = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - quality ELSE quality END quality")
    one = {r["doc_id"]: r["score"] for r in quality.judge(docs, labels).collect()}
    two = {r["doc_id"]: r["score"] for r in quality.judge(docs, lies).collect()}
    assert one == two


def test_shortcut_is_the_average_of_vectors():
    """The score added up by words is the softmax of the output over the averaged vectors."""
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(quality.BUCKETS, 4))
    output = rng.normal(size=(2, 5))
    apart = output[1] - output[0]
    model = quality.Model(vectors @ apart[:-1], float(apart[-1]))
    for text in ("", "one", "du du du du", "Ein Satz, mit WORTEN!! und | ###", "x" * 300 + " é"):
        at, share = quality.text_features(text)
        hidden = share.astype(float) @ vectors[at] if len(at) else np.zeros(4)
        logits = output[:, :-1] @ hidden + output[:, -1]
        want = 1 / (1 + np.exp(logits[0] - logits[1]))
        assert abs(model.score(text) - want) < 1e-5
        assert model.score(text) == model.score(text)


def test_number_of_features():
    words = ["a", "bc", "é", "!!", "x" * 90]
    assert quality.features_in(words) == sum(len(quality.features_of(w)) for w in words)


def test_training_descends():
    rows = [(y, *quality.text_features(t)) for _, t, y in _corpus(200)]
    before = quality.train(rows, steps=1, rate=0.0)
    after = quality.train(rows)

    def loss(vectors, output):
        total = 0.0
        for y, at, share in rows:
            z = output[:, :-1] @ (share @ vectors[at]) + output[:, -1]
            total += np.log(np.exp(z - z.max()).sum()) + z.max() - z[y]
        return total / len(rows)

    assert loss(*after) < 0.5 * loss(*before)


def test_rows(spark, tables):
    _, labels, _ = tables
    df = spark.createDataFrame(
        [(1, None, 1), (1, None, 1), (2, "", 2), (None, "a bc " * 20_000, 3), (5, "y" * 200_000, 4)],
        "doc_id long, text string, predicted int",
    )
    got = quality.judge(df, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert quality.judge(df.where("false"), labels).count() == 0
    assert {r["score"] for r in quality.judge(df, labels.where("false")).collect()} == {0.5}


def test_query(spark, medium):
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_quality"](spark, medium).collect()}
    assert len(got) == spark.read.parquet(f"{medium}/documents.parquet").count()
    marked = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    held = [i for i in marked if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == marked[i] for i in held) >= 0.93 * len(held)
