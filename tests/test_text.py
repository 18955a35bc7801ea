"""Sentence windows against a plain statement of the rule."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmill.functions import parsing, text

TOKEN = re.compile(r"\w+|[^\w\s]")


def plain_sentences(body):
    """Walk over the text: three dots are kept, any other run of .!? ends a sentence."""
    out, now, i = [], "", 0
    while i < len(body):
        if body.startswith("...", i):
            now += "..."
            i += 3
        elif body[i] in ".!?":
            while i < len(body) and body[i] in ".!?" and not body.startswith("...", i):
                now += body[i]
                i += 1
            out.append(now)
            now = ""
        else:
            now += body[i]
            i += 1
    out.append(now)
    return [s.strip() for s in out if s.strip()]


def plain_chunks(body, size, stride, least):
    parts = plain_sentences(body)
    if not parts:
        return []
    if len(parts) <= size:
        made = [" ".join(parts)]
    else:
        made = [" ".join(parts[i : i + size]) for i in range(0, len(parts) - size + 1, stride)]
    kept = [c for c in made if len(TOKEN.findall(c)) >= least]
    return kept or [body]


EDGES = [
    "Wait... what. Yes!! No?", "a.... b. c. d. e.", "", "   ", "one", "... . !", "?...x", "?....x",
    "..!...y", ".....z......", "No end here", "a. b. c. d. e. f. g. h.",
    "  blank ends . \t next\n\nline. ", "<ELLIPSIS> and <SPLIIT> are words. Yes.", "\x01\x02. x",
    "　wide . blanks .",
]


def run(spark, bodies, size, stride, least):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, t string")
    made = df.select("i", text.chunks(F.col("t"), size, stride, least).alias("c")).collect()
    return {r["i"]: [(c["chunk"], c["tokens"]) for c in r["c"]] for r in made}


def test_edges(spark):
    for size, stride, least in [(3, 1, 20), (3, 1, 3), (3, 2, 2), (1, 1, 1), (5, 1, 4)]:
        got = run(spark, EDGES, size, stride, least)
        for i, body in enumerate(EDGES):
            want = plain_chunks(body, size, stride, least)
            assert [c for c, _ in got[i]] == want, (body, size, stride, least)
            assert [n for _, n in got[i]] == [len(TOKEN.findall(c)) for c in want]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab .!?\n", max_size=60), min_size=1, max_size=40))
def test_random_texts(spark, bodies):
    got = run(spark, bodies, 3, 1, 5)
    for i, body in enumerate(bodies):
        assert [c for c, _ in got[i]] == plain_chunks(body, 3, 1, 5)


def test_stride_one_covers_all_sentences(spark):
    body = " ".join(f"word{i} more words here." for i in range(30))
    got = " ".join(c for c, _ in run(spark, [body], 3, 1, 1)[0])
    assert all(f"word{i} " in got for i in range(30))


def test_rows_are_trimmed_and_numbered(spark):
    from siftmill.operators.filters import chunk_rows

    df = spark.createDataFrame([(1, "  short text \n"), (2, "  "), (3, None)], "i int, t string")
    got = [tuple(r) for r in chunk_rows(df, "t", ["i"]).collect()]
    assert got == [(1, 1, "short text", 2)]


def test_null_and_long(spark):
    df = spark.createDataFrame([(None,), ("x" * 200_000,), ("... " * 50_000,)], "t string")
    rows = [r["n"] for r in df.select(F.size(text.chunks(F.col("t"))).alias("n")).collect()]
    assert rows == [0, 1, 1]


def test_label_forms(spark):
    forms = [
        ('["joy","x"]', ["joy", "x"]), ('"[\\"joy\\"]"', ["joy"]), ("['joy']", ["joy"]),
        ('"joy"', ["joy"]), ("bad", []), (None, []), ("[]", []), ('""', []), ("[1", []),
    ]
    df = spark.createDataFrame([(f,) for f, _ in forms], "s string")
    got = [r[0] for r in df.select(parsing.parse_labels(F.col("s"))).collect()]
    assert got == [want for _, want in forms]


def test_vector_forms(spark):
    forms = [
        ("[1, 2.5]", [1.0, 2.5]), ("(1, 2)", [1.0, 2.0]), ("bad", None), (None, None),
        ('[1, "a"]', None), ("[1, null]", None), ("1", None),
    ]
    df = spark.createDataFrame([(f,) for f, _ in forms], "s string")
    got = [r[0] for r in df.select(parsing.parse_vector(F.col("s"))).collect()]
    assert got == [want for _, want in forms]


def test_percent_ties_to_even(spark):
    df = spark.createDataFrame([(0.8125,), (0.5,), (0.12345,)], "x double")
    assert [r[0] for r in df.select(text.percent(F.col("x"))).collect()] == ["81.2%", "50.0%", "12.3%"]
