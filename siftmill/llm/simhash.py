"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect (23, 12) Golay code
gives each segment a 12-bit codeword index, and the indices of a segment and of its neighbours at
one bit (one or six different ones) are its fuzzy keys: two segments that differ in at most one bit
share a key, if one side takes the index of the segment itself (home) and the other all of them
(probe). Of three errors over three segments either

* one segment has none and another at most one: key = that segment exactly + a fuzzy index, or
* each has exactly one: key = fuzzy indices of the first two + one half of the third exactly, since
  its one error spoils one half only.

Keys of 30 to 35 bits are joined and the pairs verified by their differing bits, so no link is
lost and every join row that leaves the join is a link between different fingerprints. Copies of a
text share a fingerprint and are one row there.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import map_batches, table_of
from siftmill.llm.components import components
from siftmill.session import durable, shuffle_width

# Words to a shingle, hash seed, differing bits of a link, generator polynomial.
SHINGLE_WORDS = 3
HASH_SEED = 42
LINK_BITS = 3
_GENERATOR = 0b101011100011

# Shingles whose bits are unpacked at once: 4 MB.
_BLOCK = 1 << 16
_PARTS = (("a", 0, 23), ("b", 23, 23), ("c", 46, 18))
_HALF = 9
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """64 bits: bit i is set if it is set in more than half of the shingles' hashes.

    A-Z are lower-cased, ASCII blanks separate words, repeated shingles count each time. Fewer
    words than a shingle are one shingle; no words give 0.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(len(found) - words + 1, 1)
    lows, highs = starts[:n], ends[min(words, len(found)) - 1:]
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        spans = zip(lows[at:at + _BLOCK].tolist(), highs[at:at + _BLOCK].tolist(), strict=True)
        hashes = np.array([digest(line[i:j], seed) for i, j in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * set_bits > n, bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", carry: str | None = None, **options
) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; `carry` names one more
    whole-number column to keep."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fingerprint(t, **options) for t in batch.column("text").to_pylist()]
        signed = np.array(made, np.uint64).view(np.int64)
        columns = {"doc_id": batch.column("doc_id"), "fp": signed}
        if carry:
            columns[carry] = batch.column(carry)
        return table_of(columns, schema)

    schema = _FP.append(pa.field(carry, pa.int64())) if carry else _FP
    texts = docs.select(
        F.col(ident).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
        *([F.col(carry)] if carry else []),
    )
    return map_batches(texts, run, "doc_id long, fp long" + (f", {carry} long" if carry else ""))


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials over GF(2) by the generator: 11 bits."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, _GENERATOR << (bit - 11), 0)
    return rest


@cache
def _leaders() -> np.ndarray:
    """The error of weight 3 or less that belongs to each remainder; the code is perfect."""
    errors = [0] + [
        sum(1 << i for i in spots) for k in (1, 2, 3) for spots in combinations(range(23), k)
    ]
    errors = np.array(errors, np.int64)
    table = np.zeros(1 << 11, np.int64)
    table[_remainder(errors)] = errors
    return table


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the Golay codeword within three bits of each 23-bit word."""
    return (words ^ _leaders()[_remainder(words)]) >> 11


def _fuzzy(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, fresh): per word the indices of itself and of its neighbours at one of `width`
    bits in ascending order, and whether an index is the first of its kind."""
    near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
    found = np.sort(codeword_index(near), axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, fresh


def fuzzy_keys(fps: np.ndarray) -> dict[str, np.ndarray]:
    """(key, fp, home) rows of a batch of fingerprints, as described above."""
    part = {n: (fps >> low) & ((1 << width) - 1) for n, low, width in _PARTS}
    own = {n: codeword_index(part[n]) for n, _, _ in _PARTS}
    near = {n: _fuzzy(part[n], width) for n, _, width in _PARTS}
    keys, rows, home = [], [], []

    def emit(kind: int, values: np.ndarray, at: np.ndarray, is_home: bool) -> None:
        keys.append(values | (kind << 40))
        rows.append(fps[at])
        home.append(np.full(len(at), is_home))

    everyone = np.arange(len(fps))
    kind = 0
    for exact, _, _ in _PARTS:
        for loose in sorted(set(part) - {exact}):
            emit(kind, part[exact] << 12 | own[loose], everyone, True)
            at, which = np.nonzero(near[loose][1])
            emit(kind, part[exact][at] << 12 | near[loose][0][at, which], at, False)
            kind += 1
    pair_fresh = near["a"][1][:, :, None] & near["b"][1][:, None, :]
    at, i, j = np.nonzero(pair_fresh)
    both = near["a"][0][at, i] << 12 | near["b"][0][at, j]
    for half in (part["c"] & ((1 << _HALF) - 1), part["c"] >> _HALF):
        emit(kind, (own["a"] << 12 | own["b"]) << _HALF | half, everyone, True)
        emit(kind, both << _HALF | half[at], at, False)
        kind += 1
    return {"key": np.concatenate(keys), "fp": np.concatenate(rows), "home": np.concatenate(home)}


def _keyed(fps: DataFrame, home: bool) -> DataFrame:
    """(key, fp): the home keys or the probe keys of distinct fingerprints."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fuzzy_keys(batch.column("fp").to_numpy(zero_copy_only=False))
        at = made["home"] == home
        return table_of({"key": made["key"][at], "fp": made["fp"][at]}, _KEYS)

    return map_batches(fps, run, "key long, fp long", rows=2000)


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints `fp` at LINK_BITS or fewer bits."""
    distinct = fps.where(F.col("fp").isNotNull()).select("fp").distinct()
    # Each fingerprint makes about a hundred rows: they are made by all cores, not by the few tasks
    # that the short fingerprints themselves would fill.
    distinct = distinct.repartition(shuffle_width(fps.sparkSession), "fp")
    at_home = _keyed(distinct, True).withColumnRenamed("fp", "x")
    probes = _keyed(distinct, False).withColumnRenamed("fp", "y")
    close = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).between(1, LINK_BITS)
    met = at_home.join(probes.hint("merge"), (at_home["key"] == probes["key"]) & close)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rooted(prints: DataFrame, *first: str) -> DataFrame:
    """(fp, *first, root): for each fingerprint the least values of `first` and its component."""
    known = durable(prints.groupBy("fp").agg(*[F.min(c).alias(c) for c in first]))
    roots = components(links(known))
    placed = known.join(roots, known["fp"] == roots["node"], "left")
    return placed.select("fp", *first, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest id reachable over links of 3 or fewer differing bits, the row's
    own among them; texts without words have fingerprint zero and are linked like any other. Null
    texts count as empty, rows with a null id keep it and get the smallest id that is there (null
    if there is none), repeated rows stay, an empty table gives no rows.
    """
    prints = durable(fingerprints(docs, ident, text))
    placed = _rooted(prints, "doc_id")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest id, of
    rows with one id the first; rows without an id come last.

    `docs` is read twice and numbered by its partitions, so it must be laid out alike both times, as
    tables in files are; make any other frame durable first.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    prints = durable(fingerprints(numbered, ident, text, carry=row))
    first = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col(row).alias("row"))
    placed = _rooted(prints.select("fp", first.alias("first")), "first")
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
