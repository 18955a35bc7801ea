"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie behind one another in one array of symbol ids. Each round looks up the
merge rank of every neighbouring pair, takes the lowest rank of each pre-token and applies that pair
at all its places in all pre-tokens at once; a pre-token without a mergeable pair leaves with the
number of its surviving symbols. Applying every place of the lowest pair at once is what merging
one by one gives, because a pair that holds a merged symbol ranks behind the merge that made it.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import map_batches, table_of, whole_texts

# Distinct pre-tokens a worker remembers; beyond it the memory starts anew, the counts are the same.
REMEMBERED = 1_000_000
_NONE = np.iinfo(np.int64).max
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
# Characters whose classes any two regex engines agree on; texts with others are cut by the library.
_ODD = re.compile(f"[^\t-\r -\x7e{_LETTERS[6:]}]")
_FAST = re.compile(
    f" ?[{_LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+"
)
_PATTERN_KIND = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
])


def _byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class MergeTable:
    """Merge ranks of a byte-level vocabulary, as sorted pair keys."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = _byte_letters()
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        self.width = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made[order]
        self.made_by_rank = made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of `words`."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        result = sizes.copy()
        owner = np.repeat(np.arange(len(words)), sizes)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = self._pair_ranks(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            low = np.minimum.reduceat(rank, starts)
            result[owner[starts]] = lengths
            lowest = np.repeat(low, lengths)
            open_ = lowest != _NONE
            if not open_.all():
                symbols, owner, rank, lowest = (x[open_] for x in (symbols, owner, rank, lowest))
                if not len(symbols):
                    break
            hit = rank == lowest
            if hit[1:].any() and (hit[1:] & hit[:-1]).any():
                # Places of one pair overlap only in runs of one symbol: every second counts.
                at = np.arange(len(hit))
                begun = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, -1))
                hit &= (at - begun) % 2 == 0
            symbols[hit] = self.made_by_rank[rank[hit]]
            kept = ~np.r_[False, hit[:-1]]
            touched = (hit | np.r_[hit[1:], False] | np.r_[hit[2:], False, False][: len(hit)])[kept]
            symbols, owner, rank = symbols[kept], owner[kept], rank[kept]
            again = np.flatnonzero(touched)
            rank[again] = self._pair_ranks_at(symbols, owner, again)
        return result

    def _pair_ranks(self, symbols, owner) -> np.ndarray:
        return self._pair_ranks_at(symbols, owner, np.arange(len(symbols)))

    def _pair_ranks_at(self, symbols, owner, at) -> np.ndarray:
        """Rank of the pair that starts at each place; none at the last symbol of a pre-token."""
        after = np.minimum(at + 1, len(symbols) - 1)
        inside = (owner[after] == owner[at]) & (after > at)
        return np.where(inside, self.ranks(symbols[at], symbols[after]), _NONE)


class Counter:
    """Token counts of whole texts as the library gives them by default, without added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] is not None or any(
            cut.get(k) != v for k, v in _PATTERN_KIND.items()
        ):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.table = MergeTable(spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]])
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.cut = tokenizers.Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.known: dict[str, int] = {}

    def _pieces(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _FAST.findall(text)
        return [bytes(map(self.byte_of.__getitem__, w)).decode("latin-1") + "\0" for w, _ in self.cut(text)]

    def _split(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, number of added tokens written out in the text)."""
        if self.added is None or not (found := self.added.findall(text)):
            return self._pieces(text), 0
        parts = [p for part in self.added.split(text) if part for p in self._pieces(part)]
        return parts, len(found)

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.get
        totals, late, missing = [0] * len(texts), [], set()
        for i, text in enumerate(texts):
            pieces, extra = self._split(text)
            found = list(map(get, pieces))
            if None in found:
                missing.update(p for p, n in zip(pieces, found, strict=True) if n is None)
                late.append((i, pieces, extra))
            else:
                totals[i] = sum(found) + extra
        words = list(missing)
        # A piece cut by the library is marked by a last zero and holds its bytes as they are.
        raw = [w[:-1].encode("latin-1") if w[-1] == "\0" else w.encode() for w in words]
        if words:
            self.known.update(zip(words, self.table.counts(raw).tolist(), strict=True))
        for i, pieces, extra in late:
            totals[i] = sum(map(get, pieces)) + extra
        return totals


@cache
def counter(path: str) -> Counter:
    """One per worker and vocabulary."""
    return Counter(path)


def token_counts(
    docs: DataFrame, vocabulary: str | None = None, limit: int = 1024, ident: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    `vocabulary` is the path of a byte-level BPE file, the same on every machine (default: the
    installed byte_bpe_50k.json). Null and empty texts have no tokens; strings of added tokens
    inside a text count as one token; rows repeat as they come; an empty table gives no rows.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        return table_of({
            "doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": counter(path)(texts),
        }, _SCHEMA)

    made = map_batches(whole_texts(docs, ident, text), run, "doc_id long, n_bytes long, n_tokens long")
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
