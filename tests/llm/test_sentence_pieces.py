import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from texts import TEXTS

from siftmill.llm import queries, sentence_pieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
MORE = ["▁a▁b", " a", "  a  ", "def f(x):\n    return x+1  # 12345", "a " + " " * 40 + "b", "<s>x</s> <0x0A>", "ééé ÉÀ ß", "𝒳 ☃ ⁇ ‍", "3.14159, 2²"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return S.Codec(PATH)


def test_equals_the_library(library, codec):
    for text in TEXTS + MORE:
        ids = np.frombuffer(codec.encode(text), "<u4")
        assert ids.tolist() == library.encode(text), text
        assert codec.decode(ids) == library.decode(ids.tolist()), text


def test_units_are_short_and_whole_texts_if_pieces_cross(codec):
    assert codec.unit.findall(" Two words, 3²x") == [" Two", " words", ",", " 3²", "x"]
    assert S.unit_pattern(["a", "b.c"]).findall("a b.c") == ["a b.c"]


def test_random_texts(library, codec, monkeypatch):
    rng = random.Random(6)
    for letters in ("etaoinshrdlu ", "ab ", "abcé, .\n1(2)_", "ññß日 aeiou\t"):
        for _ in range(150):
            text = "".join(rng.choices(letters, k=rng.randint(1, 150)))
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text)
    monkeypatch.setattr(S, "REMEMBERED", 3)
    text = "".join(rng.choices("etaoinshrdlu", k=3000)) + " tail"
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text)


def test_texts_that_begin_alike(library):
    rng = random.Random(9)
    made = S.Codec(PATH)
    parts = ["er", "tion", "☃", "un", "é", "ver", "sch", "a", "th"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(40)) for _ in range(60)]
    got = [np.frombuffer(raw, "<u4").tolist() for raw in made.encode_all(texts)]
    assert got == library.encode(texts)
    for text in texts[:10]:
        assert made._unit_ids(" " + text.replace(" ", "")) == made.encode(text.replace(" ", ""))


def test_bytes_that_are_no_text(library, codec):
    ids = [codec.byte_ids[b] for b in (0xFF, 0x41, 0xC3)] + library.encode("x")
    assert codec.decode(np.array(ids)) == library.decode(ids)


def _best(text, pieces, scores):
    """All segmentations by recursion."""
    best = [(0.0, ())] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = pieces.get(text[start:end])
            if piece is not None and best[start] is not None:
                value = best[start][0] + scores[piece]
                if best[end] is None or value > best[end][0] + 1e-12:
                    best[end] = (value, best[start][1] + (piece,))
    return best[-1][0]


def test_unigram_scores_are_the_best():
    rng = random.Random(7)
    words = list("abc") + sorted({"".join(rng.choices("abc", k=rng.randint(2, 5))) for _ in range(40)})
    pieces = {w: i for i, w in enumerate(words)}
    scores = [-rng.uniform(1, 3) * len(w) ** 0.5 for w in words]
    for _ in range(200):
        text = "".join(rng.choices("abc", k=rng.randint(1, 120)))
        made = list(S.viterbi(text, pieces, 5, lambda _, p: scores[p]))
        assert "".join(text[a:b] for _, a, b in made) == text
        assert all(words[p] == text[a:b] for p, a, b in made)
        assert abs(sum(scores[p] for p, _, _ in made) - _best(text, pieces, scores)) < 1e-9


def test_the_window_is_bounded():
    """Ids are settled while the text is still being read."""
    seen = []

    class Watched(str):
        def __getitem__(self, at):
            seen.append(at.stop if isinstance(at, slice) else at)
            return str.__getitem__(self, at)

    text = Watched("ab" * 5000)
    gaps = [max(seen) - end for _, _, end in S.viterbi(text, {"a": 0, "b": 1, "ab": 2}, 2, lambda _, p: -1.0)]
    assert max(gaps) <= 8 and len(gaps) == 5000


def test_rows(spark, library):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "ab c", 2), (None, "z" * 100_000, 3)], "doc_id long, text string, n_pieces int")
    got = sorted(map(tuple, S.digests(df).collect()), key=str)
    want = []
    for i, t in [(1, ""), (1, ""), (2, "ab c"), (None, "z" * 100_000)]:
        raw = np.array(library.encode(t), "<u4").tobytes()
        want.append((i, len(raw) // 4, 0, zlib.crc32(raw), zlib.crc32(t.encode()), True))
    assert got == sorted(want, key=str)
    assert S.digests(df.where("false")).count() == 0


def test_query(spark, small, library):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.QUERIES["op6_sentence_pieces"](spark, small).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(rows[r["doc_id"]])
        assert r["n_pieces"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["round_trip"] and r["decoded_crc32"] == zlib.crc32(rows[r["doc_id"]].encode())


def test_commits_on_documents(small, codec):
    """Ids of the tables' own units are settled while the stream is read, never further back than
    the longest unit and the window."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{small}/documents.parquet").column("text").to_pylist() if t][:60]
    units = list(dict.fromkeys(u for t in texts for u in codec.unit.findall(" " + t)))
    stream = "".join(u.replace(" ", S.SPACE) + codec.between for u in units)
    read, commits, settled = [0], 0, 0

    class Watched(str):
        def __getitem__(self, at):
            read[0] = max(read[0], at.stop if isinstance(at, slice) else at + 1)
            return str.__getitem__(self, at)

    before = -1
    for _, start, end in codec.steps(Watched(stream)):
        assert start == settled and read[0] - end <= 4 * codec.longest + max(map(len, units))
        commits += read[0] != before
        before, settled = read[0], end
    assert settled == len(stream) and commits >= len(units) > 1000
    assert codec._units(units) == {u: codec._unit_ids(u) for u in units}


def test_units_that_hold_the_mark_between_units(library):
    made = S.Codec(PATH)
    texts = [f"a{made.between}b {made.between}", made.between * 3, "x" * 200 + made.between + "y" * 200]
    parts = [made.unit.findall(" " + t) for t in texts]
    assert [b"".join(made._units(p)[u] for u in p) for p in parts] == [made.encode(t) for t in texts]
