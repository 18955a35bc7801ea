"""Best-fit packing of documents into sequences by non-negative least squares.

Only the histogram of piece lengths, at most `size` numbers, is planned with:

1. all patterns of up to three lengths that fill a sequence exactly are enumerated;
2. their repeat counts are fitted to the histogram by non-negative least squares (accelerated
   projected gradient) and rounded so that running sums are kept, never above what is there;
3. what is left over is packed best-fit, longest first, group by group of equally filled sequences.

The plan says, per length, which ranks go where. Pieces are ranked within their length over hashed
buckets, so a length that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.llm.common import map_batches, table_of, whole_texts
from siftmill.llm.token_count import _ODD
from siftmill.session import durable

SIZE = 2048
END_ID = 0
# Chunks whose ids a worker remembers; beyond it the memory starts anew, the ids are the same.
REMEMBERED = 900_000
_TOGETHER = 500
_ROUNDS = 300
# Pieces of one length in one ranking task, about.
_BUCKET_ROWS = 2_000
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
])
_PLACED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers.

    Blanks and line ends separate pre-tokens in this vocabulary and are dropped, so a text is the
    sequence of its chunks between them. Each distinct chunk goes through the library once, many
    at a time with an added token in between.
    """

    def __init__(self, path: str):
        # A task has one core; threads of the library would only hand its work around.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = tokenizers.Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.mark_id, mark = next(iter(added.items()))
        self.mark = mark.content
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if "<|" not in c]
        groups = [plain[i:i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        groups += [[c] for c in chunks if "<|" in c]
        lines = [self.mark.join(g) for g in groups]
        for group, made in zip(
            groups, self.library.encode_batch_fast(lines, add_special_tokens=False), strict=True
        ):
            ids = np.array(made.ids, "<u4")
            if len(group) == 1:
                self.known[group[0]] = ids.tobytes()
                continue
            raw = ids.tobytes()
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)) * 4
            starts = np.append(0, ends[:-1] + 4)
            for chunk, i, j in zip(group, starts.tolist(), ends.tolist(), strict=True):
                self.known[chunk] = raw[i:j]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.get
        cut = []
        for text in texts:
            # Lower case is part of the vocabulary's own rule; here it saves memory.
            plain = "<|" not in text and (text.isascii() or not _ODD.search(text))
            low = text.lower() if plain else text
            cut.append(low.replace("\n", " ").split(" "))
        result: list[bytes] = [b""] * len(texts)
        late, missing = [], set()
        for i, chunks in enumerate(cut):
            found = list(map(get, chunks))
            if None in found:
                missing.update([c for c, ids in zip(chunks, found, strict=True) if ids is None])
                late.append((i, chunks, found))
            else:
                result[i] = b"".join(found)
        self._learn(list(missing))
        for i, chunks, found in late:
            pairs = zip(chunks, found, strict=True)
            result[i] = b"".join([get(c) if ids is None else ids for c, ids in pairs])
        return result


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(
    docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, ident: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut to `size`."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        idents = batch.column("doc_id").to_pylist()
        rows = []
        made = encoder(path)(batch.column("text").to_pylist())
        for ident_, ids in zip(idents, made, strict=True):
            ids += end
            for n, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at:at + 4 * size]
                rows.append((ident_, n, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = zip(*rows, strict=True)
        return table_of(dict(zip(_PIECES.names, columns, strict=True)), _PIECES)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_batches(whole_texts(docs, ident, text), run, schema)


def _patterns(present: np.ndarray, size: int) -> np.ndarray:
    """(3, n): all multisets of up to three present lengths that add up to `size`; 0 fills up."""
    has = np.zeros(size + 1, bool)
    has[present] = True
    has[0] = True
    made = []
    for a in present.tolist():
        b = np.arange((size - a + 1) // 2, min(a, size - a) + 1)
        b = b[has[b]]
        c = size - a - b
        fits = has[c] & ((b > 0) | (c == 0))
        made.append(np.stack([np.full(fits.sum(), a), b[fits], c[fits]]))
    return np.concatenate(made, axis=1) if made else np.zeros((3, 0), np.int64)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = _ROUNDS) -> np.ndarray:
    """x >= 0 with the least squared distance of the pattern sums from `counts`."""
    n = patterns.shape[1]
    if not n:
        return np.zeros(0)
    inner = counts.astype(float)
    inner[0] = 0
    used = patterns > 0

    def spread(x):
        total = sum(np.bincount(p, x * u, len(inner)) for p, u in zip(patterns, used, strict=True))
        return total

    def gather(r):
        return sum(r[p] * u for p, u in zip(patterns, used, strict=True))

    x = np.ones(n)
    for _ in range(20):
        x = gather(spread(x))
        top = np.linalg.norm(x)
        x /= top
    step = 1 / (1.05 * top)
    x = np.zeros(n)
    ahead, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(ahead - step * gather(spread(ahead) - inner), 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def _rounded(patterns: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple, int]]:
    """Whole repeats whose running sums follow those of x; `left` is lowered by what they take."""
    repeats = np.diff(np.floor(np.append(0.0, np.cumsum(x)) + 0.5)).astype(np.int64)
    plan = []
    for j in np.flatnonzero(repeats > 0).tolist():
        lengths = tuple(int(v) for v in patterns[:, j] if v)
        most = min(int(left[v]) // lengths.count(v) for v in set(lengths))
        n = min(int(repeats[j]), most)
        if n > 0:
            for v in lengths:
                left[v] -= n
            plan.append((lengths, n))
    return plan


def _best_fit(left: np.ndarray, size: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing over counts: equally filled sequences move together."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[tuple, int]]] = {}
    full: list[tuple[tuple, int]] = []

    def put(lengths: tuple, n: int) -> None:
        room = size - sum(lengths)
        if not room:
            full.append((lengths, n))
            return
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((lengths, n))

    for length in range(size, 0, -1):
        need = int(left[length])
        while need:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                # Fresh sequences take as many of this length as fit.
                each = size // length
                if need >= each:
                    put((length,) * each, need // each)
                    need %= each
                if need:
                    put((length,) * need, 1)
                    need = 0
                continue
            room = rooms[at]
            lengths, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            fits = min(room // length, need)
            whole = min(n, need // fits)
            need -= whole * fits
            put(lengths + (length,) * fits, whole)
            if n > whole:
                put(lengths, n - whole)
    return full + [g for room in rooms for g in groups[room]]


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[tuple, int]]:
    """(lengths of a sequence, repeats) for a histogram `counts[length]`, each piece used once.

    The plan has at most as many entries as there are patterns, whatever the size of the corpus.
    """
    left = counts.astype(np.int64).copy()
    patterns = _patterns(np.flatnonzero(left[1:size + 1]) + 1, size)
    made = _rounded(patterns, fit_repeats(patterns, left), left)
    return made + _best_fit(left, size)


def _slots(made: list[tuple[tuple, int]]) -> tuple[np.ndarray, ...]:
    """Sorted (length, first rank) keys and for each the first sequence, and the offset there."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in made:
        offset = 0
        for length in lengths:
            low = taken.get(length, 0)
            rows.append((length << 44 | low, low, sequence, offset))
            taken[length] = low + n
            offset += length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


def pack(
    docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, ident: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    Documents of more than `size` ids, their end id included, are cut into pieces of `size`; no
    other document is. Null and empty texts are the end id alone. Rows with equal or null ids are
    documents of their own; an empty table gives no rows.
    """
    cut = durable(pieces(docs, vocabulary, size, ident, text))
    spark = cut.sparkSession
    found = cut.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(size + 1, np.int64)
    for row in found:
        counts[row["length"]] = row["n"]
    total = int(counts.sum())
    keys, lows, sequences, offsets = _slots(plan(counts, size))
    shared = spark.sparkContext.broadcast((keys, lows, sequences, offsets))

    width = max(1, total // _BUCKET_ROWS)
    names = [f.name for f in _PIECES]
    mixed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width)))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ahead = mixed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = mixed.withColumn("at", F.row_number().over(inside)).join(ahead, ["length", "bucket"])
    slim = ranked.select(*names, (F.col("ahead") + F.col("at") - 1).alias("rank"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, lows, sequences, offsets = shared.value
        length = batch.column("length").to_numpy(zero_copy_only=False)
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, length << 44 | rank, "right") - 1
        columns = {n: batch.column(n) for n in names}
        columns |= {"sequence_id": sequences[at] + rank - lows[at], "offset": offsets[at]}
        return table_of(columns, _PLACED)

    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return map_batches(slim, place, schema, rows=10_000)
