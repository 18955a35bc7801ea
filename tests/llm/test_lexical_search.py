import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftmill.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(_terms(text))
    made = []
    for item, terms in asked.items():
        found = []
        for (i, counts), n in zip(held, sizes):
            score = 0
            for term in terms & set(counts):
                df = sum(term in c for _, c in held)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                m = 100 - 90 + 90 * n * n_docs // n_terms
                score += weight * (1_000_000_000 * counts[term] // (1000 * counts[term] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        found.sort()
        made += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(found[:k], 1)]
    return made


def _corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "Straße", "ÉTÉ", "日本", "x1", *(f"w{i}" for i in range(150))]
    weights = [30, 20, 5, 5, 3, 3, *(20 / (i + 1) for i in range(150))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) + "!" for _ in range(n)]
    texts[3] = texts[1]
    return [(i * 7 % n, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block,shard_bytes,items", [(64, 8 << 20, 512), (2, 3000, 4)])
def test_brute_force(spark, monkeypatch, block, shard_bytes, items):
    """Many shards, blocks and blocks of items; equal documents, null ids and texts."""
    docs = _corpus(400, 1) + [(None, "w3 w4 the"), (9, "w3 w4 the"), (9, "w3 w4 the"), (8, None), (7, ""), (6, "... !")]
    asked = [(1, "the W3, w4"), (2, "of the été"), (2, "w140 w3"), (3, ""), (4, None), (5, "unknown"), (None, "w7 日本"),
             (6, "w3 w3 w3"), (7, " ".join(f"w{i}" for i in range(150)))]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, term int, shard string")
    queries = spark.createDataFrame(asked, "item_id long, text string")
    monkeypatch.setattr(lexical_search, "ITEMS", items)
    index = lexical_search.build(df, shard_bytes=shard_bytes, block=block)
    want = sorted(brute(docs, asked, 10), key=str)
    assert sorted((tuple(r) for r in lexical_search.search(index, queries).collect()), key=str) == want
    monkeypatch.setattr(lexical_search, "HELD_TERMS", 5)
    got = lexical_search.search(index, queries).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for rows in (df, df.where("false")):
        assert lexical_search.search(lexical_search.build(rows), items).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lexical_search.search(lexical_search.build(one), items.where("false")).count() == 0


def _postings(texts, terms, block):
    ids, counts = list(range(len(texts))), [Counter(_terms(t)) for t in texts]
    n_docs, n_terms = len(texts), sum(sum(c.values()) for c in counts)
    lists, own = lexical_search._shard(0, ids, [t.encode() for t in texts], n_docs, n_terms, block)
    m = np.array(own.column("m")[0].as_py())
    made = []
    for row in lists.to_pylist():
        if row["term"] in terms:
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
            made.append(lexical_search.Postings(
                weight, *(np.array(row[n], np.int32) for n in ("last", "best", "doc_ends", "tf_ends")),
                *(np.frombuffer(row[n], np.uint8) for n in ("doc_data", "tf_data")), m,
            ))
    return made


def test_blocks_are_rejected_before_decompression():
    """Common terms are not essential once the rare one has filled the list of the best."""
    rng = random.Random(4)
    texts = [" ".join(["the", "of"] * rng.randint(1, 9) + ["rare"] * (2 * (i % 200 == 0))) for i in range(6000)]
    made = _postings(texts, {"the", "of", "rare"}, 16)
    docs, scores = lexical_search.best_of(made, len(texts), 10)
    want = brute(list(enumerate(texts)), [(1, "the of rare")], 10)
    assert list(zip(docs.tolist(), scores.tolist())) == [(d, s) for _, _, d, s in want]
    blocks = {len(x.last): len(x.open) for x in made}
    assert len(blocks) == 2
    common = max(blocks)
    assert blocks[common] < common / 5


def test_growing_ranges_do_not_change_the_result(monkeypatch):
    texts = [t for _, t in _corpus(900, 8)]
    terms = {"the", "of", "w1", "w2", "w90", "日本"}
    want = brute(list(enumerate(texts)), [(1, " ".join(terms))], 7)
    for first in (1, 16, 5000):
        monkeypatch.setattr(lexical_search, "_FIRST_RANGE", first)
        docs, scores = lexical_search.best_of(_postings(texts, terms, 4), len(texts), 7)
        assert list(zip(docs.tolist(), scores.tolist())) == [(d, s) for _, _, d, s in want]
