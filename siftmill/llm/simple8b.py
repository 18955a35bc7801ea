"""Simple-8b: word-aligned coding of unsigned numbers.

A word of 64 bits is a selector of 4 bits above 60 bits that hold a varying count of numbers of one
width. Numbers are coded in blocks, each of which begins a word, so blocks can be read alone and all
blocks are written and read together as arrays. A number of more than 60 bits is an escape: its word
holds its place among the block's whole numbers, which are kept beside the words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 1024
_ESCAPE = 1
# Fixed values of the format: numbers a word and bits a number, by selector.
_COUNT = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
_WIDTH = np.array([0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PACKINGS = [s for s in range(16) if s != _ESCAPE]
_LOW = np.uint64((1 << 60) - 1)
# (numbers, numbers of the first of the two runs that make up a run of so many).
_RUNS = [(2, 1), (3, 2), (4, 2), (5, 4), (6, 4), (7, 4), (8, 4), (10, 8), (12, 8), (15, 8), (20, 10), (30, 15), (60, 30),
         (120, 60), (240, 120)]
_BITS = np.array([n.bit_length() for n in range(1 << 16)], np.int8)
_SHORT = np.uint64(0xFFFF)
# Blocks coded together.
_TOGETHER = 512


@dataclass
class Coded:
    """Words and whole numbers, with the first of each per block and the end behind the last."""

    size: int
    words: np.ndarray
    escapes: np.ndarray
    word_at: np.ndarray
    escape_at: np.ndarray
    block: int = BLOCK


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each number; 0 for 0."""
    bits = _BITS[(values & _SHORT).astype(np.uint16)]
    for shift in (16, 32, 48):
        high = values >> np.uint64(shift)
        more = high != 0
        if not more.any():
            break
        bits[more] = _BITS[(high[more] & _SHORT).astype(np.uint16)] + np.int8(shift)
    return bits


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place of each block (rows), the selector that takes most numbers from there on.

    A selector that takes fewer numbers takes wider ones, so the fitting ones are the last of the
    list and the number of others names the first. What lies behind a block has no bits.
    """
    size = bits.shape[1] - 240
    # Widest number among the next n: two runs that are known, laid over each other.
    runs = {1: bits}
    for n, a in _RUNS:
        left, right = runs[a], runs[n - a][:, a:]
        width = min(left.shape[1], right.shape[1])
        runs[n] = np.maximum(left[:, :width], right[:, :width])
    missed = np.zeros((len(bits), size), np.int8)
    for selector in _PACKINGS:
        missed += runs[_COUNT[selector]][:, :size] > _WIDTH[selector]
    return np.array([*_PACKINGS, _ESCAPE], np.int8)[missed]


def _walk(best: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, place, selector) of each word, in order; all blocks step together."""
    begun = np.zeros(best.shape, bool)
    block, at = np.flatnonzero(sizes), np.zeros(int((sizes > 0).sum()), np.int64)
    while len(block):
        begun[block, at] = True
        at = at + _COUNT[best[block, at]]
        on = at < sizes[block]
        block, at = block[on], at[on]
    block, at = np.nonzero(begun)
    return block, at, best[block, at].astype(np.int64)


def _encode_blocks(values: np.ndarray, size: int):
    """(words, words per block, escapes, escapes per block) of whole blocks but for the last."""
    n = -(-len(values) // size)
    table = np.zeros((n, size + 240), np.uint64)
    whole = len(values) // size
    table[:whole, :size] = values[:whole * size].reshape(whole, size)
    table[whole:, :len(values) - whole * size] = values[whole * size:]
    sizes = np.full(n, size)
    sizes[whole:] = len(values) - whole * size
    block, at, selector = _walk(_selectors(_bits(table)), sizes)
    words = selector.astype(np.uint64) << np.uint64(60)
    flat, place = table.ravel(), block * table.shape[1] + at
    for s in _PACKINGS[1:]:
        rows = np.flatnonzero(selector == s)
        if len(rows):
            here, packed = place[rows], np.zeros(len(rows), np.uint64)
            for nth in range(_COUNT[s]):
                packed |= flat[here + nth] << np.uint64(nth * _WIDTH[s])
            words[rows] |= packed
    rows = np.flatnonzero(selector == _ESCAPE)
    wide = np.bincount(block[rows], minlength=n)
    if len(rows):
        words[rows] |= (np.arange(len(rows)) - (np.cumsum(wide) - wide)[block[rows]]).astype(np.uint64)
    return words, np.bincount(block, minlength=n), table[block[rows], at[rows]], wide


def encode(values: np.ndarray, block: int = BLOCK) -> Coded:
    """Any unsigned 64-bit numbers; an empty array has no block."""
    values = np.ascontiguousarray(values, np.uint64)
    step = block * _TOGETHER
    made = [_encode_blocks(values[i:i + step], block) for i in range(0, len(values), step)]
    if not made:
        none = np.zeros(0, np.uint64)
        return Coded(0, none, none, np.zeros(1, np.uint64), np.zeros(1, np.uint64), block)
    words, per_word, escapes, per_escape = (np.concatenate(x) for x in zip(*made, strict=True))
    word_at, escape_at = (np.r_[0, np.cumsum(n)].astype(np.uint64) for n in (per_word, per_escape))
    return Coded(len(values), words, escapes, word_at, escape_at, block)


def decode(coded: Coded, first: int = 0, last: int | None = None) -> np.ndarray:
    """The numbers of blocks `first` up to `last`, not included; all by default."""
    last = len(coded.word_at) - 1 if last is None else last
    size = coded.block
    total = min(coded.size, last * size) - first * size
    if total <= 0:
        return np.zeros(0, np.uint64)
    word_at = coded.word_at[first:last + 1].astype(np.int64)
    words = coded.words[word_at[0]:word_at[-1]]
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = _COUNT[selector]
    before = np.cumsum(held) - held
    per_block = np.diff(word_at)
    begin = before[word_at[:-1] - word_at[0]]
    at = before - np.repeat(begin, per_block)
    place = at + np.repeat(np.arange(last - first) * size, per_block)
    made = np.zeros((last - first) * size, np.uint64)
    payload = words & _LOW
    for s in _PACKINGS[1:]:
        rows = np.flatnonzero(selector == s)
        if not len(rows):
            continue
        step = np.arange(_COUNT[s])
        mask = np.uint64((1 << int(_WIDTH[s])) - 1)
        numbers = (payload[rows, None] >> (step * _WIDTH[s]).astype(np.uint64)) & mask
        to = place[rows, None] + step
        # The last word of a block may hold fewer numbers than its selector has room for.
        inside = at[rows, None] + step < size
        if inside.all():
            made[to] = numbers
        else:
            made[to[inside]] = numbers[inside]
    rows = np.flatnonzero(selector == _ESCAPE)
    if len(rows):
        of = np.repeat(coded.escape_at[first:last].astype(np.int64), per_block)
        made[place[rows]] = coded.escapes[of[rows] + payload[rows].astype(np.int64)]
    return made[:total]
