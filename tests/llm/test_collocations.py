import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmill.llm import collocations, varint


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1) | st.integers(0, 300)))
def test_varint_comes_back(values):
    data, ends = varint.encode(np.array(values, np.uint64))
    assert varint.decode(data).tolist() == values
    assert (ends[-1] if values else 0) == len(data)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=60), max_size=6), st.integers(2, 9))
def test_every_frequent_key_survives_merging(slices, threshold):
    """Summaries of slices, merged in a tree, keep every key that reaches the threshold."""
    mass = sum(map(len, slices))
    whole = collocations.MisraGries(mass // threshold + 1)
    for i in range(0, len(slices), 2):
        part = collocations.MisraGries(mass // threshold + 1)
        for values in slices[i:i + 2]:
            keys, counts = np.unique(np.array(values, np.uint64), return_counts=True)
            part.merge(keys, counts)
        whole.merge(part.keys, part.counts, part.error)
    assert len(whole.keys) <= mass // threshold + 1 and whole.error < threshold
    true = Counter(v for values in slices for v in values)
    assert {k for k, n in true.items() if n >= threshold} <= set(whole.may_reach(threshold).tolist())
    for key, n in zip(whole.keys.tolist(), whole.counts.tolist()):
        assert n <= true[key] <= n + whole.error


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, threshold, first):
    seen, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", _lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    seen.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    made = []
    for lang, counts in seen.items():
        often = {p: n for p, n in counts.items() if n >= threshold and len(p) > 1}
        rows = []
        for p, a in often.items():
            cuts = [(1000 * a * sizes[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(
                len(q) > len(p) and 100 * n >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                for q, n in often.items()
            )
            if not inside:
                rows.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        made += [(lang, i, p, a, x, y, sizes[lang], s) for i, (s, a, p, x, y) in enumerate(rows[:first], 1)]
    return sorted(made)


def _texts(n, seed=3):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "é", "GAMMA", "x=1", "日本", "d e", "the", "of"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "! "]
    return ["".join(rng.choice(words[: rng.randint(1, 9)]) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
            for _ in range(n)]


@pytest.mark.parametrize("threshold,first,table_bits", [(3, 50, 28), (20, 2000, 12), (1, 10, 14)])
def test_brute_force(spark, threshold, first, table_bits):
    """Also with a table of survivors so small that it is full."""
    texts = _texts(300)
    langs = ["en", "", None, "und", "de"]
    rows = [(langs[i % 5], t) for i, t in enumerate(texts)] + [("en", None), (None, None), ("fr", "a b c")]
    rows += [("de", "The same " * 5000)] * 3
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, a int, rank int")
    got = collocations.collocations(df, threshold, first, table_bits=table_bits)
    assert sorted(map(tuple, got.collect())) == brute(rows, threshold, first)


def test_few_bits_and_many_partitions(spark, monkeypatch):
    """Counters are given up in the merging tasks, and the result stays exact."""
    rng = random.Random(5)
    names = [f"w{i}" for i in range(3000)]
    rows = [("en", " ".join(rng.choices(names, k=200)) + " hot pair. " * 3) for _ in range(200)]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "_TOGETHER", 2000)
    monkeypatch.setattr(collocations, "_WAITING", 1000)
    table, _, _ = collocations.survivors(df, 100, together=2000)
    kept = int(np.unpackbits(table).sum())
    assert 3 <= kept < 2000
    got = collocations.collocations(df, 100)
    assert [tuple(r)[:4] for r in got.collect()] == [("en", 1, "hot pair", 600)]


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    one = spark.createDataFrame([(None, None)], "lang string, text string")
    assert collocations.collocations(one).count() == 0


def test_products_pass_64_bits(spark):
    """The score is exact where a * n and l * r need more than 64 bits."""
    counts = [("en", "", 0, 10 ** 13), ("en", "a", 1, 4 * 10 ** 11 + 1), ("en", "b", 1, 3 * 10 ** 11 + 7),
              ("en", "a b", 2, 2 * 10 ** 11 + 3)]
    frame = spark.createDataFrame(counts, "lang string, phrase string, words int, a long")
    got = spark.createDataFrame([("en", "x")], "lang string, text string")
    original = collocations.phrase_counts
    collocations.phrase_counts = lambda *a, **k: frame
    try:
        row = collocations.collocations(got).collect()[0]
    finally:
        collocations.phrase_counts = original
    assert row["score"] == 1000 * counts[3][3] * 10 ** 13 // (counts[1][3] * counts[2][3])
