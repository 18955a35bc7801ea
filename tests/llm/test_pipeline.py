"""The pipeline against a version in plain Python, stage by stage, and on odd documents."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tokenizers

from siftmill.llm import quality, queries, secret_scan, simhash, toxicity
from siftmill.llm.labelled import learning_row


def _components(fps):
    """Index of the first member for each of `fps`, by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def _plain(spark, folder):
    """{doc_id: text} of the documents that reach the last stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for module, modulus, held, good in ((toxicity, 3, 1, lambda s: s < 0.7), (quality, 4, 2, lambda s: s >= 0.7)):
        left = docs.where(docs.doc_id.isin(list(rows)))
        model = module.fit(left, labels, learn=learning_row("doc_id", modulus, held))
        rows = {i: t for i, t in rows.items() if good(model.scores([t])[0])}
    ids = sorted(rows)
    roots = _components([simhash.fingerprint(rows[i]) for i in ids])
    first = {}
    for i, root in zip(ids, roots):
        first.setdefault(root, i)
    return {i: secret_scan.masked(rows[i]) for i in first.values()}


def test_against_plain_version(spark, small):
    want = _plain(spark, small)
    got = queries.QUERIES["pipeline"](spark, small).collect()
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mine, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        mine[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(mine) == set(want) and 0 < len(want) < 200
    for i, text in want.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        parts = [ids[a:a + 2048] for a in range(0, len(ids), 2048)]
        assert sorted(mine[i]) == [(n, 2048 * n, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for n, p in enumerate(parts)]
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048


@pytest.fixture(scope="module")
def odd(spark):
    text = "a plain text about nothing in particular that nobody needs to read " * 5
    rows = [
        (1, text, "en", "s", 5), (1, text, "en", "s", 5), (None, text + "more", None, None, None), (2, None, None, "s", 0),
        (3, "", "de", "s", 0), (4, "word " * 60_000, "en", "t", 1), (5, f"password=abcdefgh {text}", "en", "t", 9), (5, "other words stand here now", "en", "t", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_documents(spark, small, odd, name, stage):
    got = stage(spark, odd, small)
    if name != "packing":
        assert got.schema.simpleString() == odd.schema.simpleString()
    rows = got.collect()
    if name in ("toxicity", "quality"):
        every = [tuple(r) for r in odd.collect()]
        assert all(tuple(r) in every for r in rows)
    if name == "near_duplicates":
        texts = [r["text"] or "" for r in rows]
        assert len({simhash.fingerprint(t) for t in texts}) == len(rows)
    if name == "secrets":
        assert len(rows) == 8 and sum((r["text"] or "").startswith("[SECRET]") for r in rows) == 1
    if name == "packing":
        assert sum(r["piece"] == 0 for r in rows) == 8
    assert stage(spark, odd.where("false"), small).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "secrets", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in queries.QUERIES
