"""SentencePiece encoding and decoding by a streaming Viterbi search.

Characters are read one by one. For every position the search keeps the last piece of the best
segmentation up to there; pieces have a bounded length, so only a window of that length can be
reached again. Whenever the backpointers of all positions in the window run into one boundary, the
ids before it are settled, leave the window and are never looked at again; a character of no piece is
such a boundary. Memory is bounded by the window, not by the text. Texts are cut into units that no
piece crosses; new units of a batch are read as one stream, and a worker remembers their ids.

Two kinds of models score a step. A unigram model adds the piece's score. A merge (BPE) model has no
scores to add: there a segmentation is the encoding exactly if each two neighbouring pieces are, so
a step is allowed if merging the characters of both pieces gives just these two; one segmentation of
each prefix survives.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from siftmill.llm.common import map_batches, table_of, whole_texts

SPACE = "▁"
# Units whose ids, and pairs of pieces whose test, a worker remembers once the search has found them,
# and the longest such unit; the ids do not depend on either.
REMEMBERED = 700_000
_LONGEST_KEPT = 64
_MINUS, _NEVER = float("-inf"), float("inf")
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()),
    ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_()),
])
Step = Callable[[int, int], float]


def viterbi(
    text: str, pieces: dict[str, int], longest: int, step: Step | None = None,
    fits: dict[int, bool] | None = None, width: int = 0, used: set[str] | None = None,
) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the best segmentation, each as soon as it is settled.

    Either `step(before, piece)` is the score of `piece` after the id `before` (-1 at the start), or
    `fits[before * width + piece]` says whether it may follow, and at most one way into each
    position may be allowed. A single character that is no piece is passed over as id -1. `used`
    are the `letters_of(pieces)`.
    """
    base = 0
    score, back, last = [0.0], [0], [-1]
    used = letters_of(pieces) if used is None else used
    get = pieces.get
    size, wide = len(text), 3 * longest
    for end in range(1, size + 1):
        if text[end - 1] not in used:
            # A character of no piece: every path leads through it, so all before it is settled.
            if end - 1 > base:
                yield from _path(base, end - 1, back, last)
            yield -1, end - 1, end
            base, score, back, last = end, [0.0], [0], [-1]
            continue
        best, origin, chosen = _MINUS, end - 1, -1
        low = end - longest
        for start in range(low if low > base else base, end):
            piece = get(text[start:end])
            if piece is None:
                continue
            so_far, before = score[start - base], last[start - base]
            if so_far == _MINUS:
                continue
            if fits is not None:
                if before < 0 or fits[before * width + piece]:
                    best, origin, chosen = 0.0, start, piece
                    break
                continue
            value = so_far + step(before, piece)
            if value > best:
                best, origin, chosen = value, start, piece
        if best == _MINUS and text[end - 1] not in pieces:
            best = score[-1]
        score.append(best)
        back.append(origin)
        last.append(chosen)
        if end - base >= wide:
            met = _meeting(base, end, end - longest + 1, score, back)
            if met > base:
                yield from _path(base, met, back, last)
                cut = met - base
                top = score[cut]
                score = [s - top for s in score[cut:]]
                back, last = back[cut:], last[cut:]
                base = met
    if size > base:
        yield from _path(base, size, back, last)


def _meeting(base: int, end: int, low: int, score: list[float], back: list[int]) -> int:
    """The last boundary on all paths to the positions low..end, which can still be reached."""
    alive = {p for p in range(low, end + 1) if score[p - base] > _MINUS}
    while len(alive) > 1:
        far = max(alive)
        alive.discard(far)
        alive.add(back[far - base])
    return alive.pop()


def letters_of(pieces: Iterable[str]) -> set[str]:
    return set().union(*pieces)


def _path(base: int, end: int, back: list[int], last: list[int]) -> list[tuple[int, int, int]]:
    made = []
    while end > base:
        start = back[end - base]
        made.append((last[end - base], start, end))
        end = start
    return made[::-1]


class _Fits(dict):
    """Whether the second piece of a pair may follow the first, found out once for each pair."""

    def __init__(self, texts: list[str], rank: dict[str, float]):
        self.texts, self.rank = texts, rank

    def __missing__(self, pair: int) -> bool:
        left, right = (self.texts[i] for i in divmod(pair, len(self.texts)))
        if len(self) > REMEMBERED:
            self.clear()
        found = self[pair] = self._apart(left, right)
        return found

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of both never joins the two, best pair first."""
        rank = self.rank.get
        parts, edge = [*left, *right], len(left)
        costs = [rank(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while (low := min(costs)) != _NEVER:
            at = costs.index(low)
            if at == edge - 1:
                return False
            parts[at] += parts.pop(at + 1)
            costs.pop(at)
            edge -= at < edge - 1
            if at:
                costs[at - 1] = rank(parts[at - 1] + parts[at], _NEVER)
            if at < len(costs):
                costs[at] = rank(parts[at] + parts[at + 1], _NEVER)
        return True


def unit_pattern(pieces: Iterable[str]) -> re.Pattern:
    """A pattern for units of a text: blanks and then either letters or other characters.

    A cut is safe where no piece crosses it. Numbers that are no digits count as letters for regular
    expressions and as others in vocabularies; the pattern takes those of the pieces for others. If
    a piece still crosses a cut, the whole text is one unit.
    """
    pieces = list(pieces)
    odd = sorted({c for p in pieces for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()})
    more = "".join(map(re.escape, odd))
    unit = re.compile(rf" *[^\W\d_{more}]+| *(?:[^\w ]|[\d_{more}])+| +")
    return unit if all(unit.findall(p) == [p] for p in pieces) else re.compile(r"(?s).+")


class Codec:
    """Encoder and decoder of one model file with the ids the library gives."""

    def __init__(self, path: str, kind: str = "bpe"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(size)]
        special = [
            model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
            for i in range(size)
        ]
        self.texts = texts
        self.scores = [model.get_score(i) for i in range(size)]
        self.unknown_id = model.unk_id()
        self.byte_ids = {}
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(texts[i][1:-1], 16)] = i
        self.every = {t: i for i, t in enumerate(texts) if not special[i]}
        self.kind = kind
        self.fits = _Fits(texts, {t: -self.scores[i] for t, i in self.every.items()})
        self.known: dict[str, bytes] = {}
        self.pieces = self.every
        if kind == "bpe":
            # A piece that its own characters do not merge into never comes out.
            self.pieces = {t: i for t, i in self.every.items() if self._merged(t) == [t]}
        self.longest = max(map(len, self.pieces), default=1)
        self.used = letters_of(self.pieces)
        # Stands between units: a character of no piece, so that no path leads across.
        self.between = next(c for c in map(chr, range(len(self.used) + 1)) if c not in self.used)
        self.unit = unit_pattern(t.replace(SPACE, " ") for t in self.every)
        self.is_byte = np.zeros(size, bool)
        self.is_byte[list(self.byte_ids.values())] = True
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        shown = ["" if model.is_control(i) else t.replace(SPACE, " ") for i, t in enumerate(texts)]
        if self.unknown_id >= 0:
            shown[self.unknown_id] = " ⁇ "
        self.shown = np.array(shown, object)

    def _merged(self, text: str) -> list[str]:
        """Characters merged pair by pair, the best-scored merged piece first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.every.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _ids(self, found: Iterable[tuple[int, int, int]], text: str) -> bytes:
        ids = []
        for piece, start, end in found:
            if piece >= 0:
                ids.append(piece)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in text[start:end].encode()]
            else:
                ids.append(self.unknown_id)
        return struct.pack(f"<{len(ids)}I", *ids)

    def steps(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(id, start, end) along a text whose blanks are marked, settled ones first."""
        if self.kind == "bpe":
            return viterbi(
                text, self.pieces, self.longest, fits=self.fits, width=len(self.texts), used=self.used
            )
        return viterbi(
            text, self.pieces, self.longest, lambda _, piece: self.scores[piece], used=self.used
        )

    def _unit_ids(self, unit: str) -> bytes:
        text = unit.replace(" ", SPACE)
        return self._ids(self.steps(text), text)

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """The ids of units, read as one stream."""
        texts = [u.replace(" ", SPACE) for u in units]
        stream = "".join([t + self.between for t in texts])
        made, found, at = {}, [], 0
        stop = len(texts[0]) if texts else 0
        for step in self.steps(stream):
            if step[1] < stop:
                found.append(step)
                continue
            made[units[at]] = self._ids(found, stream)
            found, at = [], at + 1
            stop = step[2] + len(texts[at]) if at < len(texts) else 0
        return made

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts, without begin or end."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.get
        result, late, missing = [b""] * len(texts), [], set()
        for i, text in enumerate(texts):
            units = self.unit.findall(" " + text.replace(SPACE, " ")) if text else []
            found = list(map(get, units))
            if None in found:
                missing.update([u for u, ids in zip(units, found, strict=True) if ids is None])
                late.append((i, units, found))
            else:
                result[i] = b"".join(found)
        fresh = self._units(list(missing))
        self.known.update((u, ids) for u, ids in fresh.items() if len(u) <= _LONGEST_KEPT)
        for i, units, found in late:
            result[i] = b"".join([
                ids if ids is not None else fresh[u] for u, ids in zip(units, found, strict=True)
            ])
        return result

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; runs of byte pieces are UTF-8, and the first blank is the encoder's."""
        if not len(ids):
            return ""
        shown = self.shown[ids]
        raw = np.flatnonzero(self.is_byte[ids])
        if len(raw):
            # The bytes of a run become the text of its first piece.
            for run in np.split(raw, np.flatnonzero(np.diff(raw) > 1) + 1):
                piece = bytes(self.byte_of[i] for i in ids[run].tolist())
                shown[run] = ""
                shown[run[0]] = piece.decode("utf-8", "replace")
        return "".join(shown.tolist()).removeprefix(" ")


@cache
def codec(path: str, kind: str = "bpe") -> Codec:
    """One per worker and model."""
    return Codec(path, kind)


def digests(
    docs: DataFrame, model: str | None = None, kind: str = "bpe", ident: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_crc32, round_trip) of every whole text.

    The ids are encoded, checked by crc32 as little-endian unsigned 32-bit numbers, and decoded
    again; round_trip says whether the text came back. `model` is a path that is the same on every
    machine. Null texts count as empty and have no pieces; repeated rows and null ids stay; an empty
    table gives no rows.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = codec(path, kind)
        rows = {n: [] for n in _SCHEMA.names[1:]}
        texts = batch.column("text").to_pylist()
        for t, raw in zip(texts, both.encode_all(texts), strict=True):
            ids = np.frombuffer(raw, "<u4")
            back = both.decode(ids)
            rows["n_pieces"].append(len(ids))
            rows["n_byte_pieces"].append(int(both.is_byte[ids].sum()))
            rows["ids_crc32"].append(zlib.crc32(raw))
            rows["decoded_crc32"].append(zlib.crc32(back.encode()))
            rows["round_trip"].append(back == t)
        return table_of({"doc_id": batch.column("doc_id"), **rows}, _SCHEMA)

    return map_batches(
        whole_texts(docs, ident, text), run,
        "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, "
        "round_trip boolean",
    )
