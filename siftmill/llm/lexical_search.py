"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

The index is a table. A shard holds the documents of one slice of texts, numbered by ascending id,
and has one row per term: postings in compressed blocks, and per block the last document and the
largest score part, that is the score before the term's weight.

A search gathers each shard's rows of the terms asked for. A term's bound is its weight times its
largest part in the shard. Terms whose bounds together do not pass the k-th best score so far are
not essential: only documents of essential lists are candidates, and a block of another list is
decompressed only if its own maximum lets one of them pass. Shards read their documents in growing
ranges, so the k-th score is known early. The best of all shards are merged by a window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.llm import varint
from siftmill.llm.common import slices_by_size, stored, whole_texts
from siftmill.session import small_or_same

FIRST = 10
BLOCK = 64
SHARD_BYTES = 8 << 20
# Items searched together in a shard.
ITEMS = 512
# Rows of terms asked for that are sent to all tasks; more are joined over shards' numbers.
HELD_TERMS = 100_000
_SALTS = 64
# Documents of a shard's first range; each further one is four times as long.
_FIRST_RANGE = 256
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# In UTF-8 every byte of a character outside ASCII belongs to a term.
_PLAIN = bytes(
    b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)
_INDEX = pa.schema([
    ("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("last", pa.list_(pa.int32())),
    ("best", pa.list_(pa.int32())), ("doc_ends", pa.list_(pa.int32())), ("tf_ends", pa.list_(pa.int32())),
    ("doc_data", pa.binary()), ("tf_data", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
    ("m", pa.list_(pa.int64())),
])
_INDEX_SQL = (
    "shard long, term string, df long, last array<int>, best array<int>, doc_ends array<int>, "
    "tf_ends array<int>, doc_data binary, tf_data binary, doc_ids array<long>, m array<long>"
)
_HITS = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Index:
    """The table of shards; the number of documents with a term, and all their terms."""

    table: DataFrame
    documents: int
    terms: int


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def parts_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The score of a posting before its term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _bytes(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _shard(number: int, ids: list, texts: list[bytes], n_docs: int, n_terms: int, block: int):
    """The index rows of one slice; the documents' own row has no term."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    numbers = _Numbers()
    found, sizes = [], []
    for i in order:
        cut = texts[i].translate(_PLAIN).split()
        found.append(np.fromiter(map(numbers.__getitem__, cut), np.int64, len(cut)))
        sizes.append(len(cut))
    # Documents without a term are in no list.
    m = 10 + (90 * np.array(sizes, np.int64) * n_docs) // max(n_terms, 1)
    docs = len(order)
    keys = np.sort(np.concatenate(found) * docs + np.repeat(np.arange(docs), sizes)) if docs else np.zeros(0, int)
    if not len(keys):
        return None
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    tf = np.diff(np.r_[starts, len(keys)])
    term, doc = keys[starts] // docs, keys[starts] % docs
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    df = np.diff(np.r_[first, len(term)])
    # A block starts at each term and at every `block` postings of it.
    place = np.arange(len(term)) - np.repeat(first, df)
    begin = np.flatnonzero(place % block == 0)
    end = np.r_[begin[1:], len(term)]
    best = np.maximum.reduceat(parts_of(tf, m[doc]), begin)
    steps = np.r_[doc[:1], np.diff(doc)]
    steps[first] = doc[first]
    doc_data, doc_ends = varint.encode(steps)
    tf_data, tf_ends = varint.encode(tf)
    blocks = np.r_[0, np.cumsum(-(-df // block))]
    bounds = np.r_[first[1:], len(term)] - 1

    def ends_in_term(ends: np.ndarray) -> np.ndarray:
        """Where each block ends among its term's bytes."""
        before = np.r_[0, ends[bounds][:-1]]
        return ends[end - 1] - np.repeat(before, np.diff(blocks))

    names = list(numbers)
    terms = len(df)
    columns = [
        pa.array(np.full(terms, number)), pa.array([names[t].decode() for t in term[first].tolist()], pa.string()),
        pa.array(df), _lists(blocks, doc[end - 1], pa.int32()), _lists(blocks, best, pa.int32()),
        _lists(blocks, ends_in_term(doc_ends), pa.int32()), _lists(blocks, ends_in_term(tf_ends), pa.int32()),
        _bytes(doc_ends[bounds], doc_data), _bytes(tf_ends[bounds], tf_data),
        pa.nulls(terms, pa.list_(pa.int64())), pa.nulls(terms, pa.list_(pa.int64())),
    ]
    lists = pa.RecordBatch.from_arrays(columns, schema=_INDEX)
    own = pa.RecordBatch.from_pylist(
        [{"shard": number, "doc_ids": [ids[i] for i in order], "m": m.tolist()}], schema=_INDEX
    )
    return lists, own


def build(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES,
    block: int = BLOCK,
) -> Index:
    """The index of all documents. A null text has no term; repeated rows are documents of their
    own; a null id stays one."""
    rows = whole_texts(docs, ident, text)
    terms = F.regexp_count("text", F.lit(_TERM)).cast("long")
    sums = rows.select(terms.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms"))
    found = sums.first()
    n_docs, n_terms = found["docs"], found["terms"] or 0

    def run(batches):
        # A task has fewer than 2 ** 24 shards.
        number = TaskContext.get().partitionId() << 24
        for batch in slices_by_size(batches, "text", shard_bytes):
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            made = _shard(number, ids, texts, n_docs, n_terms, block)
            number += 1
            if made:
                yield from made

    return Index(stored(rows.mapInArrow(run, _INDEX_SQL), "lexical-index"), n_docs, n_terms)


@dataclass
class Postings:
    """One term's list in a shard; blocks are decompressed when asked for and then kept."""

    weight: int
    last: np.ndarray
    best: np.ndarray
    doc_ends: np.ndarray
    tf_ends: np.ndarray
    doc_data: np.ndarray
    tf_data: np.ndarray
    m: np.ndarray
    open: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def block(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, weighted scores)."""
        if n not in self.open:
            i, j = (int(self.doc_ends[n - 1]), int(self.tf_ends[n - 1])) if n else (0, 0)
            docs = np.cumsum(varint.decode(self.doc_data[i:self.doc_ends[n]]).astype(np.int64))
            docs += int(self.last[n - 1]) if n else 0
            tf = varint.decode(self.tf_data[j:self.tf_ends[n]]).astype(np.int64)
            self.open[n] = docs, self.weight * parts_of(tf, self.m[docs])
        return self.open[n]

    def blocks(self, numbers) -> tuple[np.ndarray, np.ndarray]:
        made = [self.block(n) for n in numbers]
        if len(made) == 1:
            return made[0]
        return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def best_of(lists: list[Postings], docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best, higher scores and then smaller numbers first."""
    lists = sorted(lists, key=lambda x: x.weight * int(x.best.max()))
    upto = np.cumsum([x.weight * int(x.best.max()) for x in lists])
    top, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, width = 0, _FIRST_RANGE
    while low < docs:
        high = min(low + width, docs)
        # Numbers ascend, so one that only equals the k-th score comes too late.
        least = int(scores[-1]) if len(scores) == k else 0
        essential = int(np.searchsorted(upto, least, "right"))
        if essential == len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for x in lists[essential:]:
            i, j = np.searchsorted(x.last, [low, high - 1])
            if i == len(x.last):
                continue
            found, part = x.blocks(range(i, min(j + 1, len(x.last))))
            a, b = np.searchsorted(found, [low, high])
            sums[found[a:b] - low] += part[a:b]
        left = np.flatnonzero(sums)
        for n in range(essential - 1, -1, -1):
            left = left[sums[left] + upto[n] > least]
            if not len(left):
                break
            x, rest = lists[n], upto[n - 1] if n else 0
            at = np.searchsorted(x.last, left + low)
            bound = np.append(x.weight * x.best.astype(np.int64), 0)[at]
            possible = sums[left] + bound + rest > least
            left, at = left[possible], at[possible]
            wanted = np.unique(at[at < len(x.last)])
            if len(wanted):
                found, part = x.blocks(wanted.tolist())
                place = np.minimum(np.searchsorted(found, left + low), len(found) - 1)
                sums[left] += np.where(found[place] == left + low, part[place], 0)
        left = left[sums[left] > least]
        top, scores = np.r_[top, left + low], np.r_[scores, sums[left]]
        order = np.lexsort((top, -scores))[:k]
        top, scores = top[order], scores[order]
        low, width = high, width * 4
    return top, scores


def _hits(group: pa.Table, k: int) -> pa.Table:
    """The k best documents of a shard for each item of a block of items."""
    rows = group.to_pylist()
    own = next(r for r in rows if r["term"] is None)
    m, ids = np.array(own["m"], np.int64), own["doc_ids"]
    lists: dict = {}
    for row in rows:
        if row["term"] is None or not row["weight"]:
            continue
        made = Postings(
            row["weight"], *(np.array(row[n], np.int32) for n in ("last", "best", "doc_ends", "tf_ends")),
            *(np.frombuffer(row[n], np.uint8) for n in ("doc_data", "tf_data")), m,
        )
        for item in row["items"]:
            lists.setdefault(item, []).append(made)
    hits = []
    for item, found in lists.items():
        docs, scores = best_of(found, len(m), k)
        hits += [(item, ids[d], s) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
    return pa.table(
        [pa.array(c, f.type) for c, f in zip(zip(*hits, strict=True), _HITS, strict=True)], schema=_HITS
    ) if hits else _HITS.empty_table()


def _asked(index: Index, items: DataFrame, ident: str, text: str) -> tuple[DataFrame, int]:
    """(block, term, weight, items) for the terms that some document holds, and the number of blocks
    that the items are dealt to."""
    found = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(_TERM), F.lit(0))
    wanted = items.select(F.col(ident).cast("long").alias("item"), F.explode(found).alias("term")).distinct()
    # A term has one row a shard; they are counted per task first.
    held = index.table.where("term IS NOT NULL").select("term", "df")
    terms = small_or_same(wanted.select("term").distinct(), HELD_TERMS)
    counts = held.join(terms, "term").groupBy("term").agg(F.sum("df").alias("df"))
    odds = F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double")
    weights = counts.select("term", F.floor(1000 * F.log(odds)).cast("long").alias("weight"))
    blocks = math.ceil(max(items.count(), 1) / ITEMS)
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    # At most ITEMS or so in a list; a null id is one of them.
    together = F.collect_list(F.struct("item")).getField("item").alias("items")
    return wanted.join(weights, "term").groupBy(block, "term", "weight").agg(together), blocks


def search(
    index: Index, items: DataFrame, k: int = FIRST, ident: str = "item_id", text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, scores above 0 only.

    Equal scores go by ascending doc_id, a null id last. Rows with one item_id are one item with the
    terms of all; items without a known term, null texts among them, have no rows.
    """
    asked, blocks = _asked(index, items, ident, text)
    asked = stored(asked, "terms-asked-for")
    held = small_or_same(asked, HELD_TERMS)
    rows = index.table.where("term IS NOT NULL")
    if held is asked:
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("salt")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(_SALTS)))
        rows = rows.join(asked.select("*", salts), ["term", "salt"]).drop("salt")
    else:
        rows = rows.join(held, "term")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    own = index.table.where("term IS NULL").select("*", every)
    met = rows.unionByName(own, allowMissingColumns=True)

    def run(group: pa.Table) -> pa.Table:
        return _hits(group, k)

    hits = met.groupBy("shard", "block").applyInArrow(run, "item_id long, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
