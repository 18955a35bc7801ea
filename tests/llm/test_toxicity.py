import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftmill.llm import queries, toxicity
from siftmill.llm.labelled import learning_row, sample_rows

RUDE = ["grumble", "snarl", "blech", "harrumph"]


def _corpus(n, rude_every=4, seed=1):
    rng = random.Random(seed)
    names = ["".join(rng.choices("aeioustrnl", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(names, k=rng.randint(20, 120))
        toxic = int(i % rude_every == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = _corpus(600)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_held_out_accuracy(tables):
    docs, labels, rows = tables
    got = {r["doc_id"]: r for r in toxicity.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    right = sum(got[i]["predicted"] == y for i, _, y in rows if i in set(held))
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels, _ = tables
    lies = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END toxic")
    one = {r["doc_id"]: r["score"] for r in toxicity.judge(docs, labels).collect()}
    two = {r["doc_id"]: r["score"] for r in toxicity.judge(docs, lies).collect()}
    assert one == two


def plain_model(rows, discount):
    """Per class the probabilities of words and bigrams, counted in plain Python from (text, y)."""
    df, made = Counter(), []
    for text, _ in rows:
        df.update(set(toxicity.words_of(text)))
    total = sum(df.values()) + 0.5 * (len(df) + 1)

    def shared(w):
        return (df[w] + 0.5) / total

    for y in (0, 1):
        pairs, context, before = Counter(), Counter(), Counter()
        for text in {t for t, label in rows if label == y}:
            words = toxicity.words_of(text)
            pairs.update(set(zip(words, words[1:])))
        for (a, b), n in pairs.items():
            context[a] += n
            before[b] += 1
        mass = sum(before.values())
        left = sum(min(n, discount) for n in before.values()) / mass if mass else 1.0
        made.append((pairs, context, before, mass or 1, left))

    def word(y, w):
        _, _, before, mass, left = made[y]
        return max(before[w] - discount, 0) / mass + left * shared(w)

    def pair(y, a, b):
        pairs, context, *_ = made[y]
        if not context[a]:
            return word(y, b)
        used = sum(max(n - discount, 0) for (x, _), n in pairs.items() if x == a) / context[a]
        return max(pairs[a, b] - discount, 0) / context[a] + (1 - used) * word(y, b)

    return word, pair, df


def _labelled(n, seed):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(12)] + ["É", "x1"]
    rows = [(" ".join(rng.choices(names[: 4 + 5 * (i % 3)], k=rng.randint(0, 25))), [0, 1, None][i % 3])
            for i in range(n)]
    rows += [("you vile", 1)] * 5 + [(f"you vile z{i}", 1) for i in range(8)] + [("", 0), ("!!", 1)]
    return rows + [("same words here", 0)] * 30


@pytest.mark.parametrize("discount", [0.75, 2.0, 5.0])
@pytest.mark.parametrize("small_parts", [False, True])
def test_ratios_against_plain_counts(spark, monkeypatch, discount, small_parts):
    """Every word and bigram has the ratio of two Kneser-Ney models counted in plain Python; copies
    of a text count once, and other slices and partitions give the same."""
    rows = _labelled(120, 5)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if y is not None], "doc_id long, toxic int")
    if small_parts:
        monkeypatch.setattr(toxicity, "_PART_BYTES", 8)
        docs = docs.repartition(7)
    parted = toxicity._parted(docs, labels, "toxic", F.lit(True))
    model = toxicity._models(*toxicity.entries(toxicity.counts(parted, discount), discount))[2]
    word, pair, df = plain_model(rows, discount)
    rng = random.Random(2)
    vocabulary = [*df, "never", "seen"]
    for _ in range(60):
        words = [w for x in rng.choices(vocabulary, k=12) for w in toxicity.words_of(x)] + ["you", "vile"]
        assert model.ratios(["", " ".join(words), "x", ""])[1].tolist() == [0, len(words), 1, 0]
        want = [math.log(word(1, words[0]) / word(0, words[0]))]
        want += [math.log(pair(1, a, b) / pair(0, a, b)) for a, b in zip(words, words[1:])]
        assert model.ratios([" ".join(words)])[0] == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("discount", [0.75, 3.0])
def test_classes_are_distributions(discount):
    """The plain model that the ratios are compared with adds up to one over all words."""
    word, pair, df = plain_model(_labelled(120, 6), discount)
    for y in (0, 1):
        assert math.isclose(sum(word(y, w) for w in [*df, "unknown"]), 1, rel_tol=1e-9)
        for a in ("w0", "you", "w9", "unknown"):
            assert math.isclose(sum(pair(y, a, w) for w in [*df, "unknown"]), 1, rel_tol=1e-9)


def test_bigrams_of_one_class_say_more_than_their_words(spark):
    """`you vile` stands in toxic texts only, both words alone in either class."""
    rows = [(f"you vile n{i} text", 1) for i in range(40)] + [(f"you kind n{i} vile", 0) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, discount=0.75)
    together, apart = model.ratios(["you vile"])[0][1], model.ratios(["other vile"])[0][1]
    assert together > apart + 1


def test_a_model_too_large_to_hold_is_an_error(spark, tables, monkeypatch):
    docs, labels, _ = tables
    monkeypatch.setattr(toxicity, "HELD_ENTRIES", 3)
    with pytest.raises(ValueError):
        toxicity.fit(docs, labels)


def test_rows(spark, tables):
    _, labels, _ = tables
    df = spark.createDataFrame(
        [(1, None, 1), (1, None, 1), (2, "", 2), (None, "grumble " * 20_000, 3), (5, "!!! ...", 4)],
        "doc_id long, text string, predicted int",
    )
    got = toxicity.judge(df, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert toxicity.judge(df.where("false"), labels).count() == 0
    empty = toxicity.judge(df, labels.where("false")).collect()
    assert len({round(r["score"], 9) for r in empty}) == 1 and not any(r["predicted"] for r in empty)


def test_sample_is_bounded(spark, tables):
    docs, labels, _ = tables
    twice = labels.unionByName(labels)
    rows, shares = sample_rows(docs.select("doc_id", "text"), twice, "toxic", learning_row("doc_id", 3, 1), 20)
    got = rows.collect()
    assert len(got) == 40 and sum(r["y"] for r in got) == 20
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in got)
    assert sum(shares) == sum(1 for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1)


def test_query(spark, medium):
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_toxicity"](spark, medium).collect()}
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    assert len(got) == docs.count()
    marked = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    held = [i for i in marked if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == marked[i] for i in held) >= 0.947 * len(held)
    toxic = [i for i in held if marked[i]]
    assert sum(got[i]["predicted"] for i in toxic) >= 0.65 * len(toxic)
