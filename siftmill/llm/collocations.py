"""Phrase collocations by mergeable Misra-Gries summaries, one per hash partition.

1. Each slice of texts is summarised: the hashes of all its phrases with their counts, cut into
   partitions of the hash range and shuffled as compressed blocks.
2. Each partition merges the summaries of all slices into one of more than mass / threshold counters.
   A counter is off by less than the threshold, so every frequent phrase survives, and a hash that
   two phrases share only lets more survive. Survivors become bits of a table of fixed size.
3. A second pass counts exactly what has its bit set, by words and not by hashes. The beginning of a
   frequent phrase is frequent, so a phrase is only looked at where its beginning survived.

Everything after that is joins over the frequent phrases.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.llm import varint
from siftmill.llm.common import slices_by_size, stored

LONGEST = 5
THRESHOLD = 100
FIRST = 2000
# Phrase occurrences that one merging task takes, about: 2 to 3 bytes each.
_TOGETHER = 16 << 20
# Distinct hashes held beside the counters while summaries are merged.
_WAITING = 4 << 20
# Bits by which partitions are fewer in the second pass.
_FEWER = 4
# Bits of the table of survivors: 32 MB, whatever the input. A fuller table lets more phrases into
# the second pass, which counts them and drops them.
TABLE_BITS = 28
SLICE_BYTES = 8 << 20
# A hot word begins or ends many phrases; its lookups are spread over so many keys.
_SALTS = 16
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_LETTERS = bytes(range(0x41, 0x5B))
_PLAIN = bytes.maketrans(_LETTERS + _SEPARATORS + b"\t", _LETTERS.lower() + b"." * len(_SEPARATORS) + b" ")
_MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SUMMARY = pa.schema([("part", pa.int32()), ("mass", pa.int64()), ("summary", pa.binary())])
_BLOCK = pa.schema([
    ("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary()),
])
_COUNTS = pa.schema([
    ("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64()),
])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(word numbers, words): 0 stands between two pieces and behind the last."""
    numbers = _Numbers({b".": 0})
    cut = b".".join(texts).translate(_PLAIN).replace(b".", b" . ").split()
    ids = np.zeros(len(cut) + LONGEST, np.int64)
    ids[:len(cut)] = np.fromiter(map(numbers.__getitem__, cut), np.int64, len(cut))
    return ids, list(numbers)


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _longer(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    keys = keys * _MIX
    return (keys ^ (keys >> np.uint64(29))) + more


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(32))) * _LAST
    return keys >> np.uint64(64 - bits)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    texts: dict[str, list[bytes]] = {}
    column = batch.column("text").cast(pa.binary())
    for lang, text in zip(batch.column("lang").to_pylist(), column.to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    for lang, found in texts.items():
        yield lang, *_numbered(found)


def _hashes(batch: pa.RecordBatch, bits: int) -> np.ndarray:
    """Sorted hashes of every phrase occurrence of one to LONGEST words."""
    made = []
    for lang, ids, words in _by_lang(batch):
        own = _word_hashes(words, lang)
        at = np.flatnonzero(ids)
        keys = own[ids[at]]
        made.append(_top(keys, bits))
        for more in range(1, LONGEST):
            inside = ids[at + more] != 0
            at = at[inside]
            keys = _longer(keys[inside], own[ids[at + more]])
            made.append(_top(keys, bits))
    found = np.concatenate(made) if made else np.zeros(0, np.uint64)
    found.sort()
    return found


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _summaries(batch: pa.RecordBatch, bits: int, parts: int) -> pa.RecordBatch | None:
    """The slice's summary of each partition: differences of sorted hashes, and counts above one."""
    found = _hashes(batch, bits)
    if not len(found):
        return None
    starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    counts, keys = np.diff(np.r_[starts, len(found)]), found[starts]
    part = (keys >> np.uint64(bits - parts)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    steps = np.r_[keys[:1], np.diff(keys)]
    steps[first] = keys[first] - (part[first].astype(np.uint64) << np.uint64(bits - parts))
    data, ends = varint.encode(steps)
    often = np.flatnonzero(counts > 1)
    last = np.r_[first[1:], len(keys)]
    sides = np.searchsorted(often, np.r_[first, len(keys)])
    masses = np.diff(np.r_[starts[first], len(found)])
    rows = []
    for n, (i, j) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        here = often[sides[n]:sides[n + 1]]
        marks, _ = varint.encode(np.r_[np.diff(here, prepend=i), counts[here] - 2].astype(np.uint64))
        head = np.array([j - i, len(here), ends[j - 1] - (ends[i - 1] if i else 0)], "<u4")
        body = data[ends[i - 1] if i else 0:ends[j - 1]]
        rows.append(head.tobytes() + body.tobytes() + marks.tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first], pa.int32()), pa.array(masses, pa.int64()), pa.array(rows, pa.binary())],
        schema=_SUMMARY,
    )


def _read_summary(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes from the partition's beginning, counts)."""
    n, more, size = np.frombuffer(data, "<u4", 3).tolist()
    body = np.frombuffer(data, np.uint8, offset=12)
    counts = np.ones(n, np.int64)
    marks = varint.decode(body[size:]).astype(np.int64)
    counts[np.cumsum(marks[:more])] = marks[more:] + 2
    return np.cumsum(varint.decode(body[:size])), counts


class MisraGries:
    """At most `capacity` counters; each is too low by `error` at most, which times the capacity
    stays below what was added."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        """Add another summary, or plain counts."""
        self.keys, self.counts = _summed(np.r_[self.keys, keys], np.r_[self.counts, counts])
        self.error += error
        if len(self.keys) > self.capacity:
            below = len(self.keys) - self.capacity - 1
            least = int(np.partition(self.counts, below)[below])
            on = self.counts > least
            self.keys, self.counts = self.keys[on], self.counts[on] - least
            self.error += least

    def may_reach(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.error >= threshold]


def _survivors(group: pa.Table, threshold: int, bits: int, parts: int, table_bits: int) -> pa.Table:
    """The partition's part of the table of survivors."""
    part = group.column("part")[0].as_py()
    mass = sum(group.column("mass").to_pylist())
    summary = MisraGries(mass // threshold + 1)
    waiting, size = [], 0
    for data in group.column("summary").to_pylist():
        waiting.append(_read_summary(data))
        size += len(waiting[-1][0])
        if size > _WAITING:
            summary.merge(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
            waiting, size = [], 0
    if waiting:
        summary.merge(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
    table = np.zeros(1 << (table_bits - parts), bool)
    table[(summary.may_reach(threshold) >> np.uint64(bits - table_bits)).astype(np.int64)] = True
    return pa.table({
        "part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(table).tobytes()], pa.binary()),
    })


def survivors(
    rows: DataFrame, threshold: int, table_bits: int = TABLE_BITS, together: int = _TOGETHER,
) -> tuple[np.ndarray, int, int]:
    """(table, bits, parts): the bit of each hash that a phrase of at least `threshold` occurrences of
    (lang, text) has, the width of a hash, and how many of its bits name a partition."""
    # A word and its blank take two bytes, and LONGEST phrases begin there.
    size = rows.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    mass = LONGEST * size // 2 + 1
    bits = min(max(table_bits, 32, mass.bit_length() + 2), 60)
    parts = min(max(3, math.ceil(math.log2(mass / together))), table_bits - 3)

    def summarise(batches):
        for batch in slices_by_size(batches, "text", SLICE_BYTES):
            made = _summaries(batch, bits, parts)
            if made is not None:
                yield made

    def reduce(group: pa.Table) -> pa.Table:
        return _survivors(group, threshold, bits, parts, table_bits)

    found = rows.mapInArrow(summarise, "part int, mass long, summary binary")
    made = found.groupBy("part").applyInArrow(reduce, "part int, bits binary").toArrow()
    table = np.zeros(1 << (table_bits - 3), np.uint8)
    width = 1 << (table_bits - parts - 3)
    for part, data in zip(made.column("part").to_pylist(), made.column("bits").to_pylist(), strict=True):
        table[part * width:(part + 1) * width] = np.frombuffer(data, np.uint8)
    return table, bits, parts


def _is_set(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = (hashes >> np.uint64(bits - (len(table).bit_length() + 2))).astype(np.int64)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _exact(batch: pa.RecordBatch, table: np.ndarray, bits: int, parts: int) -> pa.RecordBatch:
    """Counts of the slice's phrases with their bit set, in one block of each lang and partition of
    the hash range; the empty phrase stands for all words."""
    made: dict[tuple[str, int], tuple[list, list]] = {}

    def add(lang: str, names: list[bytes], keys: np.ndarray, seen: np.ndarray) -> None:
        for part, name, n in zip(_top(keys, parts).tolist(), names, seen.tolist(), strict=True):
            block = made.setdefault((lang, part), ([], []))
            block[0].append(name)
            block[1].append(n)

    for lang, ids, words in _by_lang(batch):
        own = _word_hashes(words, lang)
        at = np.flatnonzero(ids)
        add(lang, [b""], np.zeros(1, np.uint64), np.array([len(at)]))
        at = at[_is_set(table, _top(own, bits), bits)[ids[at]]]
        found, name, seen = np.unique(ids[at], return_inverse=True, return_counts=True)
        keys = own[ids[at]]
        names = [words[i] for i in found.tolist()]
        add(lang, names, own[found], seen)
        for more in range(1, LONGEST):
            inside = ids[at + more] != 0
            at, name = at[inside], name[inside]
            keys = _longer(keys[inside], own[ids[at + more]])
            there = _is_set(table, _top(keys, bits), bits)
            at, keys = at[there], keys[there]
            # The number of the beginning and the next word name a phrase exactly.
            pair = name[there] << 32 | ids[at + more]
            found, first, name, seen = np.unique(
                pair, return_index=True, return_inverse=True, return_counts=True
            )
            names = [
                names[i] + b" " + words[j]
                for i, j in zip((found >> 32).tolist(), (found & 0xFFFFFFFF).tolist(), strict=True)
            ]
            add(lang, names, keys[first], seen)
    columns = ([], [], [], [])
    for (lang, part), (names, seen) in made.items():
        counts = varint.encode(np.array(seen, np.uint64))[0].tobytes()
        for column, value in zip(columns, (part, lang, b"\n".join(names), counts), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK
    )


def _summed_blocks(group: pa.Table, threshold: int) -> pa.Table:
    """The frequent phrases of a partition and the numbers of all words."""
    total: dict[str, Counter] = {}
    for row in group.to_batches():
        for lang, names, counts in zip(*(row.column(n).to_pylist() for n in ("lang", "phrases", "counts")), strict=True):
            held = total.setdefault(lang, Counter())
            seen = varint.decode(np.frombuffer(counts, np.uint8)).tolist()
            for name, n in zip(names.split(b"\n"), seen, strict=True):
                held[name] += n
    rows = [
        (lang, name.decode(), name.count(b" ") + 1 if name else 0, n)
        for lang, held in total.items() for name, n in held.items() if n >= threshold or not name
    ]
    return pa.table(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COUNTS, strict=True)], schema=_COUNTS
    ) if rows else _COUNTS.empty_table()


def phrase_counts(rows: DataFrame, threshold: int = THRESHOLD, table_bits: int = TABLE_BITS) -> DataFrame:
    """(lang, phrase, words, a) of every phrase of one to LONGEST words with at least `threshold`
    occurrences in its lang; the empty phrase of no words counts the lang's words."""
    table, bits, parts = survivors(rows, threshold, table_bits)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    # Survivors are few beside all phrases.
    parts = max(3, parts - _FEWER)

    def count(batches):
        for batch in slices_by_size(batches, "text", SLICE_BYTES):
            yield _exact(batch, shared.value, bits, parts)

    def total(group: pa.Table) -> pa.Table:
        return _summed_blocks(group, threshold)

    blocks = rows.mapInArrow(count, "part int, lang string, phrases binary, counts binary")
    made = blocks.groupBy("part").applyInArrow(total, "lang string, phrase string, words int, a long")
    return stored(made, "phrases")


def _all_salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")


def _looked_up(cuts: DataFrame, parts: DataFrame, part: str, count: str) -> DataFrame:
    """`cuts` with the count of the phrase in column `part`, which is frequent."""
    known = parts.select("lang", F.col("phrase").alias(part), F.col("a").alias(count), _all_salts())
    return cuts.join(known, ["lang", part, "salt"])


def _joined(words: Column, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, first: int = FIRST, lang: str = "lang",
    text: str = "text", table_bits: int = TABLE_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to LONGEST words of each lang.

    A null text is empty, a null lang is `und`; repeated rows count as often as they come; other
    columns are not read; a table without frequent phrases gives no rows. Ties of the score go to the
    more frequent phrase, then to the smaller one by bytes.

    A phrase that lies in a longer one as often as it occurs at all is dropped. It then also lies as
    often in one that is longer by one word, so these alone are compared.
    """
    rows = docs.select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    counts = phrase_counts(rows, threshold, table_bits)
    many = counts.where("words >= 2")
    split = F.split("phrase", " ")
    cuts = many.select(
        "*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
        F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).cast("int").alias("salt"),
    ).select(
        "lang", "phrase", "a", "k", "salt", _joined(split, F.lit(1), F.col("k")).alias("head"),
        _joined(split, F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"),
    )
    parts = counts.where((F.col("words") >= 1) & (F.col("words") < LONGEST))
    found = _looked_up(_looked_up(cuts, parts, "head", "l"), parts, "tail", "r")
    whole = counts.where("words = 0").select("lang", F.col("a").alias("n"), _all_salts())
    # Products of two counts need more than 64 bits.
    score = F.expr(
        "1000 * (CAST(a AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(18, 0)))"
        " div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
    )
    best = found.join(whole, ["lang", "salt"]).select("*", score.cast("long").alias("score")).groupBy(
        "lang", "phrase", "a", "n"
    ).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    shorter = F.explode(F.array(
        _joined(split, F.lit(1), F.col("words") - 1), _joined(split, F.lit(2), F.col("words") - 1)
    ))
    inside = many.where("words >= 3").select("lang", shorter.alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = best.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
