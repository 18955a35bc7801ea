import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftmill.llm import simhash
from siftmill.llm.components import components


def _plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [
    "", " \n", "One", "one TWO", "a b c", "a b c d e a b c", "É é x y z Z q", "x " * 500,
])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _plain(text)


def test_long_text_crosses_blocks(monkeypatch):
    text = " ".join(str(random.Random(1).random()) for _ in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text) == whole == _plain(text)


def test_code_is_perfect():
    words = np.random.default_rng(0).integers(0, 1 << 23, 20000)
    index = simhash.codeword_index(words)
    assert index.min() >= 0 and index.max() < 4096
    leaders = simhash._leaders()
    assert len(set(leaders.tolist())) == 2048
    assert np.bitwise_count(leaders).max() == 3
    assert {len(set(r)) for r in simhash._fuzzy(words, 23)[0].tolist()} == {1, 6}


def test_keys_meet_at_every_error_pattern():
    rng = random.Random(3)
    for _ in range(600):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << bit
        both = np.array([x, y], np.uint64).view(np.int64)
        made = simhash.fuzzy_keys(both)
        home = set(made["key"][made["home"] & (made["fp"] == both[0])].tolist())
        probe = set(made["key"][~made["home"] & (made["fp"] == both[1])].tolist())
        assert home & probe


def _brute(rows):
    ids = [i for i, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = [_plain(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, f"{fps[i]:016x}", least.get(find(i))) for i, k in enumerate(ids)), key=str)


def test_near_duplicates_small(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 9
    rows = [(i, base + "x" * (i % 4)) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n "), (53, "alone"), (53, "alone"), (None, base), (7, "else here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 key", "2 fp", "'z' component_id")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert got == _brute(rows)
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_query_against_brute_force(spark, small):
    from siftmill.llm import queries
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, queries.QUERIES["op10_simhash"](spark, small).collect()), key=str)
    assert got == _brute(rows)


def test_links_of_a_dense_group(spark):
    rng = random.Random(5)
    base = rng.getrandbits(63)
    values = {base} | {base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 3))) for _ in range(150)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {tuple(r) for r in simhash.links(df).collect()}
    want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}
    assert got == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5), (7, 6)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}
    assert components(df.where(F.lit(False))).count() == 0


def test_deduplicate(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 9
    rows = [(i, base + "x" * (i % 3), "a") for i in range(30, 10, -1)]
    rows += [(11, base, "again"), (None, base, "b"), (None, "no id and no copy at all", "c"), (None, "no id and no copy at all", "d"), (5, None, "e"), (4, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = simhash.deduplicate(df)
    kept = got.collect()
    assert got.columns == df.columns
    groups = {(simhash.fingerprint(r["text"] or "")) for r in kept}
    want = _brute([(i, t) for i, t, _ in rows])
    assert len(kept) == len({c if c is not None else f for _, f, c in want}) and len(groups) == len(kept)
    assert {r["doc_id"] for r in kept} == {c for _, _, c in want}
    assert simhash.deduplicate(df.where("false")).count() == 0
