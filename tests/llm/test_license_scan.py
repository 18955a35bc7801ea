import random
import re

import pytest

from siftmill.llm import license_scan as L, queries
from siftmill.llm.license_rules import rules

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = [
        (i, label) for phrase, label in L.PHRASES for i in range(len(words))
        if words[i:i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def _labels(text):
    return [d.rule.label for d in L.detections(text.lower())]


@pytest.mark.parametrize("text, want", [
    ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
    ("Released under the MIT License.", ["mit"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", ["lgpl-2.1"]),
    ("see the GNU Affero General Public License", ["agpl"]),
    ("all rights reserved", ["proprietary"]),
    ("cc by 4.0 and cc by-sa 3.0", ["cc-by", "cc-by-sa"]),
    ("nothing to see, permit licensees", []),
    ("Copyright (c) 2020 X. BSD 3-Clause License", ["copyright", "bsd-3-clause"]),
    ("", []),
])
def test_labels(text, want):
    assert _labels(text) == want


NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache-2.0", "Apache License\n                           Version 2.0, January 2004"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software"),
    ("gpl-2.0", "under the terms of the GNU General\nPublic License version 2"),
]


@pytest.mark.parametrize("label, text", NOTICES)
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- ", ";; ", "    ", "\t"])
def test_broken_lines(label, text, mark):
    for words in (text, text.replace(" ", "\n"), text.replace(" ", "  ")):
        body = "\r\n".join(mark + line for line in ["é intro", *words.split("\n"), "", "end"])
        found = [d for d in L.detections(body.lower()) if d.rule.label == label]
        assert found, body
        first, last = found[0].rule.pattern.search(L._one_blank(text.lower())[0])[0].split()[::len(found[0].rule.pattern.search(L._one_blank(text.lower())[0])[0].split()) - 1]
        got = body.lower()[found[0].start:found[0].end]
        assert got.startswith(first) and got.endswith(last)


@pytest.mark.parametrize("text, want", [
    ("// SPDX-License-Identifier: MIT\nint x;", ["mit"]),
    ("/* SPDX-License-Identifier: ISC */", ["isc"]),
    ("SPDX-License-Identifier: Zlib\n", ["zlib"]),
    ("SPDX-License-Identifier: NCSA\n", ["ncsa"]),
    ("SPDX-License-Identifier: OpenSSL\n", ["openssl"]),
    ("SPDX-License-Identifier: PostgreSQL\n", ["postgresql"]),
    ("SPDX-License-Identifier: MIT-0\n", ["mit-0"]),
    ("SPDX-License-Identifier: MIT-CMU\n", []),
    ("we use zlib and openssl with postgresql\nkomm mit\nuns", []),
])
def test_plain_identifiers(text, want):
    assert _labels(text) == want


def test_rules_have_keywords_that_gate_only():
    assert len(rules()) > 200 and len({r.order for r in rules()}) == len(rules())
    texts = ["licensed under the apache license, version 2.0", "gnu lesser general public license v2.1", "cc-by-nc-sa-4.0", "zlib license; mpl-2.0"]
    for text in texts:
        for rule in rules():
            if rule.pattern.search(text):
                assert any(k in text for k in rule.keywords), rule


def test_no_detection_lies_in_a_stronger_one():
    text = "licensed under the gnu general public license, version 2.0; mit license; licensed under the mit license " * 3
    found = L.detections(text)
    for a in found:
        for b in found:
            assert a is b or not (b.start <= a.start and a.end <= b.end)
    assert {d.rule.label for d in found} == {"gpl-2.0", "mit"}


def test_base_phrases_at_random():
    rng = random.Random(2)
    parts = ["gnu", "General", "public", "LICENSE", "apache", "cc", "by", "mit", "é", "x1", "ccby", "by2"]
    gaps = [" ", "\n", " - ", "_", "'", "\x00", "  "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(0, 14)))
        raw = text.encode().lower()
        starts = L.word_starts(raw)
        places = L.base_places(raw, starts)
        at = [p for p, _ in places]
        got = (len(starts), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert got == _brute(text)


def test_rows(spark):
    df = spark.createDataFrame(
        [(1, None, "a"), (1, None, "a"), (2, "MIT License cc by", None), (None, "z " * 80_000 + "Apache License", "b")],
        "doc_id long, text string, labels string",
    )
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) for r in L.scan(df).collect()}
    assert got == {(1, 0, 0, None, None, ""), (2, 4, 2, 0, 2, "cc-by,mit"), (None, 80_002, 1, 80_000, 80_000, "apache")}
    assert L.scan(df).count() == 4 and L.scan(df.where("false")).count() == 0


def test_query(spark, small):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.QUERIES["op4_license_scan"](spark, small).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _brute(rows[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
