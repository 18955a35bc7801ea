"""Exact top-k by inner product, by sorted lists without random access.

Every dimension is a sorted list, read from the top for a positive query weight and from the bottom
for a negative one, all lists to the same depth. What has been read of a candidate and the last
values read bound its score from both sides. Once the k-th best lower bound is above the upper
bounds of all but a few, the outsiders cannot qualify and the few are resolved by their full scores;
otherwise the lists are read further. Reading a list to a depth means comparing with the value
there, so the bounds of many queries and candidates are products of matrices.

Queries and candidates are cut into blocks; every pair of blocks meets once and keeps k results a
query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.llm.blocks import blocks_for, packed, spread_over, unpacked
from siftmill.llm.common import map_batches, table_of, usable_vectors
from siftmill.session import durable

SCALE = 256
K = 5
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
# Queries whose bounds are held at once: two matrices of this many times BLOCK_ROWS numbers.
_TOGETHER = 256
# Depths as shares of a list, and the share of candidates that may be left to be resolved.
_DEPTHS = (0.125, 0.25, 0.5, 1.0)
_FEW = 1 / 64
_FOUND = pa.schema([
    ("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()),
])


def _exact_type(x: np.ndarray, q: np.ndarray):
    """The narrowest numbers in which no inner product of the blocks can be rounded or overflow."""
    top = [max((abs(int(a.min(initial=0))), abs(int(a.max(initial=0))))) for a in (x, q)]
    most = max(top[0], 1) * max(top[1], 1) * max(x.shape[1], 1)
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def best_of_block(
    ids: np.ndarray, x: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the (ids, scores) of its k best candidates, best first, ties to smaller ids."""
    kind = _exact_type(x, queries)
    x, queries = x.astype(kind), queries.astype(kind)
    n = len(x)
    down = -np.sort(-x, axis=0)
    up = down[::-1]
    low, high = up[0], down[0]
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    result: list = [None] * len(queries)
    waiting = np.arange(len(queries))
    few = max(4 * k, int(n * _FEW))
    for depth in _DEPTHS:
        if not len(waiting):
            break
        read = min(n, max(k, int(n * depth)))
        top, bottom = down[read - 1], up[read - 1]
        if read == n:
            top, bottom = low, high
        # What is unread lies beyond the last value read, but not beyond the list's other end.
        bounds = (
            (np.maximum(x, top), np.minimum(x, bottom)),
            (np.where(x >= top, x, low), np.where(x <= bottom, x, high)),
        )
        later = []
        for start in range(0, len(waiting), _TOGETHER):
            part = waiting[start:start + _TOGETHER]
            upper, lower = (plus[part] @ a.T + minus[part] @ b.T for a, b in bounds)
            mine = ids[None, :] == own[part][:, None]
            for i, q in enumerate(part):
                there = ~mine[i]
                lows = lower[i][there]
                if len(lows) > k:
                    least = np.partition(lows, len(lows) - k)[len(lows) - k]
                    there &= upper[i] >= least
                if there.sum() > few and read < n:
                    later.append(q)
                    continue
                left = np.flatnonzero(there)
                scores = x[left] @ queries[q]
                order = np.lexsort((ids[left], -scores))[:k]
                result[q] = ids[left][order], scores[order]
        waiting = np.array(later, np.int64)
    return result


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, ident: str = "vec_id",
    vec: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row where `is_query` holds.

    Components become floor(scale * x) as long numbers (beyond their range they stay at its end,
    and so does a score). Rows with the query's id are its own and never candidates; repeated rows
    count each. Vectors that are null, empty or hold null or non-finite components and rows without
    an id take no part; vectors meet those of the same length only. `is_query` may use the columns
    vec_id and vec.
    """
    whole = F.transform("vec", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = usable_vectors(vectors, ident, vec, zero=True).select(
        "vec_id", whole.alias("q"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    rows = durable(rows).select("*", F.size("q").alias("width"), F.monotonically_increasing_id().alias("row"))
    total, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    parts, query_parts = blocks_for(total, block_rows), blocks_for(asking, query_rows)
    placed = rows.withColumn("part", spread_over(F.col("row"), parts))
    candidates = packed(placed, ["width", "part"], "vec_id", "q", "candidates").select(
        "width", "candidates", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("asked")
    )
    asked = rows.where("asks").withColumn("asked", spread_over(F.col("row"), query_parts))
    questions = asked.groupBy("width", "asked").agg(
        F.collect_list(F.struct("row", F.col("vec_id").alias("id"), F.col("q").alias("v"))).alias("questions")
    )
    met = candidates.join(questions, ["width", "asked"]).select("candidates", "questions")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {n: [] for n in _FOUND.names}
        numbers = [r.values.field("row").to_numpy(zero_copy_only=False) for r in batch.column("questions")]
        both = zip(unpacked(batch, "candidates"), unpacked(batch, "questions"), numbers, strict=True)
        for (ids, x), (own, queries), number in both:
            for i, (found, scores) in enumerate(best_of_block(ids, x, own, queries, k)):
                rows["query_row"] += [int(number[i])] * len(found)
                rows["query_id"] += [int(own[i])] * len(found)
                rows["vec_id"] += found.tolist()
                rows["score"] += [max(min(int(s), 2**63 - 1), -(2**63)) for s in scores]
        return table_of(rows, _FOUND)

    found = map_batches(met, run, "query_row long, query_id long, vec_id long, score long", rows=1)
    best = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
