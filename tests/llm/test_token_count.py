import random

import public_tokenizers
import pytest
import tokenizers
from texts import TEXTS

from siftmill.llm import queries
from siftmill.llm.token_count import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def _want(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(library):
    assert Counter(PATH)(TEXTS) == _want(library, TEXTS)


def test_random_texts(library):
    rng = random.Random(4)
    letters = "abcdeéÉ \n\t'.,!0123456789stremvlßñ日٣² ́"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(400)]
    texts.append("".join(rng.choices("etaoinshr", k=20000)))
    assert Counter(PATH)(texts) == _want(library, texts)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("siftmill.llm.token_count.REMEMBERED", 3)
    made = Counter(PATH)
    assert [made([t])[0] for t in TEXTS] == _want(library, TEXTS)


def test_rows(spark):
    df = spark.createDataFrame(
        [(1, None, 5), (1, "", 5), (2, "a " * 1500, 6), (None, "x", 7)], "doc_id long, text string, n_tokens int"
    )
    got = sorted(map(tuple, token_counts(df).collect()), key=str)
    n = _want(tokenizers.Tokenizer.from_file(PATH), ["a " * 1500])[0]
    assert got == sorted([(1, 0, 0, False), (1, 0, 0, False), (2, 3000, n, True), (None, 1, 1, False)], key=str)
    assert token_counts(df.where("false")).count() == 0


def test_query(spark, small, library):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = _want(library, [r["text"] for r in rows])
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.QUERIES["op5_token_count"](spark, small).collect()}
    assert got == {r["doc_id"]: (len(r["text"].encode()), n, n > 1024) for r, n in zip(rows, want)}
