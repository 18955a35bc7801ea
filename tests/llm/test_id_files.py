import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import TEXTS

from siftmill.llm import id_files, queries, simple8b
from siftmill.llm.token_count import _FAST, _ODD


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(
    st.just(0), st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2 ** 32 - 1),
    st.integers(2 ** 59, 2 ** 64 - 1),
), max_size=400), st.sampled_from([1, 7, 64, 1024]))
def test_numbers_come_back(values, block):
    coded = simple8b.encode(np.array(values, np.uint64), block)
    assert simple8b.decode(coded).tolist() == values
    assert len(coded.word_at) - 1 == -(-len(values) // block)


def _greedy(values):
    """Words of one block, one after another: the selector with room for most of what follows."""
    rooms = [(240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
             (4, 15), (3, 20), (2, 30), (1, 60)]
    at, words = 0, 0
    while at < len(values):
        for n, width in rooms:
            if all(v < 1 << width for v in values[at:at + n]):
                at += n
                break
        else:
            at += 1
        words += 1
    return words


def test_words_are_as_few_as_greedy_coding_needs():
    rng = np.random.default_rng(1)
    values = (2 ** rng.uniform(0, 17, 5000)).astype(np.uint64) * (rng.random(5000) < 0.7)
    values[1000:2000] = 0
    coded = simple8b.encode(values)
    want = [_greedy(values[i:i + 1024].tolist()) for i in range(0, 5000, 1024)]
    assert np.diff(coded.word_at.astype(int)).tolist() == want


def test_layout_of_a_word():
    coded = simple8b.encode(np.array([5, 2 ** 63, 1], np.uint64))
    assert coded.words.tolist() == [15 << 60 | 5, 1 << 60, 2 << 60 | 1]
    assert coded.escapes.tolist() == [2 ** 63]


def test_file_and_ranges():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_000, 10_000).astype("<u4")
    file = id_files.from_bytes(id_files.to_bytes(ids, [None, 3, 9], np.array([10, 10, 10_000])))
    assert file.doc_ids == [None, 3, 9] and file.ends.tolist() == [10, 10, 10_000]
    for i, j in ((0, 0), (0, 10_000), (1023, 1025), (5000, 5001), (9990, 10_000)):
        assert file.ids(i, j).tolist() == ids[i:j].tolist()
    data = bytearray(id_files.to_bytes(ids, [1], np.array([10_000])))
    data[-30] ^= 1
    with pytest.raises(ValueError):
        id_files.from_bytes(bytes(data))


def _library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = TEXTS + [" ".join(TEXTS), "Das Ärgernis: 12 Äpfel,\n\nl'été…", "a \n b\t \n\n  c  "]
    want = [np.array(e.ids, "<u4").tobytes() for e in _library().encode_batch(texts, add_special_tokens=False)]
    encode = id_files.encoder(path)
    assert encode(texts) == want and encode(texts) == want


_PARTS = ["'", "'s", "'re", "'ll", "'v", "'d", " ", "  ", "\t", "\n", "a", "sé", "é", "ɏ", "ll", "7", "12", "!", "-'",
          "", "Das", "e", "m"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PARTS), max_size=12).map("".join), min_size=1, max_size=5))
def test_cut_is_that_of_the_pattern(texts):
    assert not any(map(_ODD.search, texts))
    raw = "".join(t + "\0" for t in texts).encode()
    starts = [*id_files._starts(raw).tolist(), len(raw)]
    got = [raw[i:j].decode() for i, j in zip(starts, starts[1:])]
    assert got == [p for t in texts for p in [*_FAST.findall(t), "\0"]]
    encoder = id_files.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    made = encoder.library.encode_batch(texts, add_special_tokens=False)
    assert encoder(texts) == [np.array(e.ids, "<u4").tobytes() for e in made]


class _Counting(dict):
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_only_distinct_pre_tokens_are_looked_up():
    encoder = id_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.known = _Counting()
    texts = ["the same few words, again and again. " * 2_000] * 3 + ["other <|endoftext|> words ☃", ""]
    want = [np.array(e.ids, "<u4").tobytes() for e in _library().encode_batch(texts, add_special_tokens=False)]
    assert encoder(texts) == want
    assert encoder.known.asked < 100


def _want(rows):
    """Digests of (doc_id, text) rows in order, by the library alone."""
    library, start, made = _library(), 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        made.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return made


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_token_files"](spark, small).collect()
    assert sorted(map(tuple, got)) == _want(sorted(map(tuple, rows)))


def test_rows(spark, tmp_path):
    rows = [(5, "b"), (None, None), (1, ""), (3, "long text " * 30_000), (3, "long text " * 30_000), (2, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, start int, part string")
    files = id_files.write(df, folder=str(tmp_path / "ids"), file_ids=1000)
    got = sorted((tuple(r) for r in id_files.read_digests(files).collect()), key=lambda r: r[1])
    assert got == _want(sorted(rows, key=lambda r: (r[0] is not None, r[0])))
    held = files.collect()
    assert sum(r["n_docs"] for r in held) == 6
    # Only the files that the table names count.
    (tmp_path / "ids" / "part-000000-00000-99.ids").write_bytes(b"left by a lost task")
    assert id_files.read_digests(files).count() == 6
    assert id_files.round_trip(df.where("false")).count() == 0


def test_documents_of_one_id_and_text_are_spread(spark):
    df = spark.range(2000).selectExpr("CAST(4 AS LONG) doc_id", "repeat('same words ', 20) text")
    files = id_files.write(df)
    assert files.select("part").distinct().count() > 1
    got = sorted((r["start"], r["n_tokens"]) for r in id_files.read_digests(files).collect())
    assert [s for s, _ in got] == [i * got[0][1] for i in range(2000)]
