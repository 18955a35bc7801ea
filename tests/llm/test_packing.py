import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from texts import TEXTS

from siftmill.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def _check(rows, texts, library, size=2048):
    """Every document whole, its pieces right, every sequence gapless; the number of sequences."""
    sequences = defaultdict(list)
    mine = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        mine[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for ident, text in texts.items():
        ids = _ids(library, text)
        parts = [ids[i:i + size] for i in range(0, len(ids), size)]
        want = [(n, n * size, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for n, p in enumerate(parts)]
        assert sorted(mine[ident]) == want
    assert set(mine) == set(texts)
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences)


def test_encoder_equals_the_library(library):
    texts = TEXTS + ["<|ENDOFTEXT|> x", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ É É", "a b c"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert packing.Encoder(PATH)(texts) == want


def test_encoder_forgets(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    made = packing.Encoder(PATH)
    for text in TEXTS:
        assert made([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6.3, 1.0, 30000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    made = packing.plan(counts)
    used = np.zeros(2049, np.int64)
    for pattern, n in made:
        assert n > 0 and sum(pattern) <= 2048
        np.add.at(used, list(pattern), n)
    assert (used == counts).all()
    best = -(-int((np.arange(2049) * counts).sum()) // 2048)
    assert sum(n for _, n in made) <= best * 1.002 + 1


def test_plan_of_odd_histograms():
    for some in ({}, {2048: 7}, {1: 5000}, {1500: 10}, {1024: 3, 1025: 3}, {700: 3, 648: 1, 2000: 2, 48: 2}):
        counts = np.zeros(2049, np.int64)
        for k, n in some.items():
            counts[k] = n
        used = np.zeros(2049, np.int64)
        for pattern, n in packing.plan(counts):
            assert sum(pattern) <= 2048
            np.add.at(used, list(pattern), n)
        assert (used == counts).all()


def test_repeats_are_a_least_squares_fit():
    counts = np.zeros(65, np.int64)
    counts[[10, 20, 22, 32, 44, 54, 64]] = [50, 20, 30, 90, 10, 50, 5]
    patterns = packing._patterns(np.flatnonzero(counts), 64)
    x = packing.fit_repeats(patterns, counts, 3000)
    matrix = np.zeros((65, patterns.shape[1]))
    for row in patterns:
        np.add.at(matrix, (row, np.arange(len(row))), 1)
    matrix[0] = 0
    slope = matrix.T @ (matrix @ x - counts)
    assert (x >= 0).all() and slope.min() > -1e-3 and abs(slope[x > 1e-3]).max() < 1e-3


def test_rows(spark, library):
    texts = {1: "a b c", 2: None, 3: "", 4: "word " * 5000, 5: "two words", 6: "!" * 3}
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in texts.items()], "doc_id long, text string, length int, offset int")
    assert _check(packing.pack(df).collect(), texts, library) == 3
    twice = spark.createDataFrame([(None, "x"), (None, "x"), (8, "y"), (8, "y"), (8, "z z")], "doc_id long, text string")
    got = packing.pack(twice).collect()
    assert sorted(r["offset"] for r in got) == [0, 3, 5, 7, 9] and len({r["sequence_id"] for r in got}) == 1
    assert packing.pack(df.where("false")).count() == 0


def test_query(spark, small, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_packing"](spark, small).collect()
    n = _check(rows, texts, library)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


def test_plain_texts_are_not_searched_for_odd_characters(library, monkeypatch):
    """ASCII texts need no search; others are searched as before, and the ids are the library's."""
    searched = []

    class Odd:
        def search(self, text, odd=packing._ODD):
            searched.append(text)
            return odd.search(text)

    monkeypatch.setattr(packing, "_ODD", Odd())
    texts = ["Plain TEXT\nand \t\x01 more", "", "İstanbul Ünder", "日本 A"]
    made = packing.Encoder(PATH)(texts)
    for text, ids in zip(texts, made, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert searched == texts[2:]
