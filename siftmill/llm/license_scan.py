"""License detection in whole texts by ordered signature rules.

Rules read the text with every gap, line ends with their comment marks among them, as one blank; an
offset map leads back. A keyword prefilter opens the rules that can match at all. Every match is a detection with an
interval; detections are taken in order of rule priority, and one that lies
inside an accepted interval is suppressed: `apache license` inside `licensed under the apache
license, version 2.0` says nothing new. Fixed base phrases are counted beside it by words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftmill.llm.common import map_batches, table_of, whole_texts
from siftmill.llm.license_rules import Rule, keyword_index, rules

# Base phrases and their labels; a word is a run of digits, a-z and non-ASCII bytes.
PHRASES = (
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# What a base phrase alone is worth.
PHRASE_STRENGTH = 0.5
_WORD, _GAP = rb"[0-9a-z\x80-\xff]", rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_BASE = tuple(
    (phrase.split()[0].encode(), label, re.compile(
        rb"(?<!" + _WORD + rb")" + _GAP.join(phrase.encode().split()) + rb"(?!" + _WORD + rb")"
    ))
    for phrase, label in PHRASES
)
_IS_WORD = np.array(
    [0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)], np.int8
)
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
    ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string()),
])


# A gap that is not one blank: marks at the end of a line, line ends, marks at the start of the next.
_MARKS = r"(?://+[!/]?|/?\*+[/!]?|#+!?|;+|--+|%+|>+|\|+|!+|<!--|\.\.|\(\*|\bdnl\b|\brem\b|')"
_LINES = re.compile(
    rf"(?:(?:[^\S\n]+(?:\*+/?|#+|\|+|;+|\\|-->|\*\)))?[^\S\n]*\n[^\S\n]*(?:{_MARKS}(?=\s)[^\S\n]*)*)+"
    r"|[^\S\n]{2,}|[^\S\n ]"
)


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: Rule


def _one_blank(low: str) -> tuple[str, np.ndarray, np.ndarray]:
    """(text, ends, shifts): gaps as one blank; a place from ends[i] on stood shifts[i] later."""
    pieces, ends, shifts = [], [0], [0]
    at = made = 0
    for m in _LINES.finditer(low):
        pieces.append(low[at:m.start()])
        made += m.start() - at + 1
        at = m.end()
        ends.append(made)
        shifts.append(at - made)
    pieces.append(low[at:])
    return " ".join(pieces), np.array(ends), np.array(shifts)


def detections(low: str) -> list[Detection]:
    """What is left of all matches in a lower-cased text after suppression, in text order."""
    flat, ends, shifts = _one_blank(low)
    found = _flat_detections(flat)
    if len(ends) == 1 or not found:
        return found

    def back(places: list[int]) -> np.ndarray:
        return places + shifts[np.searchsorted(ends, places, "right") - 1]

    # No rule ends in a gap, so an end is one behind the last character.
    starts = back([d.start for d in found]).tolist()
    stops = (back([d.end - 1 for d in found]) + 1).tolist()
    return [Detection(a, b, d.rule) for a, b, d in zip(starts, stops, found, strict=True)]


def _flat_detections(low: str) -> list[Detection]:
    opened = sorted({i for word, orders in keyword_index().items() if word in low for i in orders})
    kept: list[Detection] = []
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in opened:
        rule = rules()[i]
        # Matches of one rule do not overlap, so only those of earlier rules can suppress them.
        found = [Detection(m.start(), m.end(), rule) for m in rule.pattern.finditer(low)]
        if not found:
            continue
        at = np.searchsorted(starts, [d.start for d in found], "right") - 1
        kept += [d for d, j in zip(found, at, strict=True) if j < 0 or reach[j] < d.end]
        kept.sort(key=lambda d: d.start)
        starts = np.array([d.start for d in kept], np.int64)
        reach = np.maximum.accumulate(np.array([d.end for d in kept], np.int64))
    return sorted(kept, key=lambda d: (d.start, d.end, d.rule.order))


def base_places(raw: bytes, starts: np.ndarray) -> list[tuple[int, str]]:
    """(word number, label) of all places of the base phrases in lower-cased UTF-8."""
    found = []
    for gate, label, pattern in _BASE:
        if gate in raw:
            at = [m.start() for m in pattern.finditer(raw)]
            found += zip(np.searchsorted(starts, at).tolist(), [label] * len(at), strict=True)
    return found


def word_starts(raw: bytes) -> np.ndarray:
    """Byte offsets where the words of lower-cased UTF-8 start."""
    inside = _IS_WORD[np.frombuffer(raw, np.uint8)]
    return np.flatnonzero(np.diff(inside, prepend=0) == 1)


def scan(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    A-Z are lower-cased first. Base phrases give n_base, the smallest and largest start of one in
    words (null without any) and base_labels; labels add those of the rules; score is the strongest
    signature of a text, 0 without any; spans lists label:start:end of the rules in code points.
    Null texts count as empty; repeated rows and null ids stay; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {n: [] for n in _SCHEMA.names[1:]}
        for t in batch.column("text").to_pylist():
            raw = t.encode().lower()
            low = raw.decode()
            starts = word_starts(raw)
            places = base_places(raw, starts)
            found = detections(low)
            base = sorted({label for _, label in places})
            strengths = [d.rule.strength for d in found] + [PHRASE_STRENGTH] * bool(places)
            rows["n_words"].append(len(starts))
            rows["n_base"].append(len(places))
            rows["first_word"].append(min((p for p, _ in places), default=None))
            rows["last_word"].append(max((p for p, _ in places), default=None))
            rows["base_labels"].append(",".join(base))
            rows["labels"].append(",".join(sorted({*base, *(d.rule.label for d in found)})))
            rows["score"].append(max(strengths, default=0.0))
            rows["spans"].append(",".join(f"{d.rule.label}:{d.start}:{d.end}" for d in found))
        return table_of({"doc_id": batch.column("doc_id"), **rows}, _SCHEMA)

    return map_batches(
        whole_texts(docs, ident, text), run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, spans string",
    )
