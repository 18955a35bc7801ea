"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by k-means that charges crowded lists. Every vector goes to
the list of its nearest centroid, and boundary vectors to further lists too: those whose centroid is
hardly farther, unless a list already chosen lies closer to that centroid than the vector does. A
query finds its centroids by a best-first walk over an in-memory graph of centroids. Its reach is the
distance within which lists hold enough vectors to answer it: that of the nearest list as a rule, more
for a query whose own list is small. It searches the lists within a ratio of its reach, so it is
answered in full wherever enough candidates exist. Lists and the queries that visit them meet block by
block; vectors travel with their postings, and distances are computed exactly on the original ones.

Each vector length has an index of its own; a length with no more vectors than a list should hold is
one list, that is, searched exactly.

Equal vectors are one entry with their lowest ids, so a vector that a third of the rows share is as
cheap as any other; every query row gets its own answer from that of its vector.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.llm.blocks import spread_over, unpacked
from siftmill.llm.common import map_batches, table_of, usable_vectors
from siftmill.session import durable, listed

K = 10
# The index is fitted on at most so many vectors; every vector is indexed.
SAMPLE = 20_000
# Vectors in a list, about; the sample bounds the number of lists to SAMPLE / SAMPLE_PER_LIST.
LIST_ROWS = 256
SAMPLE_PER_LIST = 8
REPLICAS = 4
# A vector is replicated to lists within this ratio of its nearest centroid's distance.
BOUNDARY = 1.08
# The ratio that a query visits is the least that would find this share of neighbours in the sample.
RECALL = 0.975
_TRIED = 256
APART = 0.3
DEGREE = 24
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
SEED = 42
_FOUND = pa.schema([
    ("asker", pa.int64()), ("row", pa.int64()), ("first_id", pa.int64()), ("score", pa.float64()),
])
# Vectors compared with all centroids at once.
_SLICE = 2048


def _assigned(x: np.ndarray, centroids: np.ndarray, price: np.ndarray) -> np.ndarray:
    cost = (centroids * centroids).sum(axis=1) + price
    return np.concatenate([
        (cost - 2 * x[i:i + _SLICE] @ centroids.T).argmin(axis=1) for i in range(0, len(x), _SLICE)
    ])


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """k-means on `x` in which a list costs more the more it holds, so that none grows large.

    In each round lists far above their share are halved across the direction they extend most in,
    and the emptiest lists give up their centroids for that.
    """
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    fair = len(x) / lists
    price = np.zeros(lists)
    spread = (x * x).sum(axis=1).mean() - (x.mean(axis=0) ** 2).sum()
    for _ in range(rounds):
        best = _assigned(x, centroids, price)
        held = np.bincount(best, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, best, x)
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
        price = 0.5 * price + 0.05 * spread * (held / fair - 1)
        crowded = np.argsort(-held, kind="stable")
        for full, empty in zip(crowded, crowded[::-1], strict=True):
            if held[full] <= 2 * fair or held[empty] > fair / 2:
                break
            own = x[best == full]
            axis = own.var(axis=0).argmax()
            high = own[:, axis] > np.median(own[:, axis])
            if high.any():
                centroids[full], centroids[empty] = own[~high].mean(axis=0), own[high].mean(axis=0)
                price[full] = price[empty] = 0.0
    return centroids


@dataclass
class Index:
    """Centroids, their neighbourhood graph and where walks begin."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    # Vectors whose nearest centroid it is, per list; not yet known: any list holds enough.
    held: np.ndarray
    ratio: float = 1.0

    @classmethod
    def over(cls, centroids: np.ndarray, degree: int = DEGREE) -> Index:
        """Each centroid is tied to its nearest ones and to the next by number, which connects all."""
        n = len(centroids)
        squares = (centroids * centroids).sum(axis=1)
        far = squares[:, None] - 2 * centroids @ centroids.T + squares
        np.fill_diagonal(far, np.inf)
        near = np.argsort(far, axis=1)[:, : min(degree, max(n - 1, 0))]
        ring = (np.arange(n)[:, None] + 1) % n
        entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        return cls(centroids, np.concatenate([near, ring], axis=1), entries, np.full(n, np.inf))

    def calibrate(
        self, x: np.ndarray, total: int, k: int, boundary: float, most: int, recall: float
    ) -> None:
        """Set the ratio by the nearest neighbours of some sampled vectors among all of them.

        In a larger table neighbours are nearer than in its sample, so the ratio is on the safe side.
        Lists are taken to hold what their sampled vectors are of the `total`.
        """
        first = np.array([h[0] for h in self.homes(x, boundary, 1)])
        self.held = np.bincount(first, minlength=len(self.centroids)) * (total / len(x))
        every = np.arange(len(self.centroids))
        q = x[:_TRIED]
        squares = (x * x).sum(axis=1)
        needed = []
        for i, one in enumerate(q):
            far = squares - 2 * x @ one
            far[i] = np.inf
            near = np.argpartition(far, min(k, len(x) - 1))[: min(k, len(x) - 1)]
            gap = np.sqrt(((self.centroids - one) ** 2).sum(axis=1))
            reach = self._reach(gap, every, k + 1)
            for homes in self.homes(x[near], boundary, most):
                needed.append(gap[homes].min() / max(reach, 1e-300))
        wide = float(np.quantile(needed, recall)) * (1 + 1e-9) if needed else 1.0
        self.ratio = max(wide, 1.0)

    def _reach(self, far: np.ndarray, lists: np.ndarray, need: int) -> float:
        """The distance within which the nearest `lists` hold `need` vectors; infinite if none does."""
        order = np.argsort(far, kind="stable")
        enough = int(np.searchsorted(np.cumsum(self.held[lists][order]), need))
        return float(far[order[enough]]) if enough < len(order) else np.inf

    def visits(self, q: np.ndarray, ratio: float | None = None, need: int = 1) -> np.ndarray:
        """Lists to search for `q`: a best-first walk that goes on while it meets centroids within
        `ratio` of its reach, the distance within which lists hold `need` vectors. All lists, if
        they hold fewer."""
        ratio = self.ratio if ratio is None else ratio

        def measure(at):
            gap = self.centroids[at] - q
            return np.sqrt((gap * gap).sum(axis=1))

        met = np.zeros(len(self.centroids), bool)
        met[self.entries] = True
        start = measure(self.entries)
        queue = list(zip(start.tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(queue)
        reach = self._reach(start, self.entries, need)
        found = {int(c): float(d) for c, d in zip(self.entries, start, strict=True)}
        while queue:
            distance, at = heapq.heappop(queue)
            if distance > max(ratio * reach, self._patience(reach, ratio)):
                break
            fresh = self.graph[at]
            fresh = np.unique(fresh[~met[fresh]])
            if not len(fresh):
                continue
            met[fresh] = True
            far = measure(fresh)
            for d, c in zip(far.tolist(), fresh.tolist(), strict=True):
                found[c] = d
                heapq.heappush(queue, (d, c))
            if far.min() < reach:
                known = np.fromiter(found, np.int64, len(found))
                reach = self._reach(np.fromiter(found.values(), float, len(found)), known, need)
        return np.array(sorted(c for c, d in found.items() if d <= ratio * reach), np.int64)

    @staticmethod
    def _patience(reach: float, ratio: float) -> float:
        """Nodes a little beyond the ratio are walked through as well: they may lead to nearer ones."""
        return (1 + 1.5 * (ratio - 1)) * reach

    def homes(self, x: np.ndarray, ratio: float = BOUNDARY, most: int = REPLICAS) -> list[np.ndarray]:
        """The lists of each vector: the nearest, and for boundary vectors up to `most` in all."""
        c = self.centroids
        squares = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
        far = np.sqrt(np.maximum(squares, 0))
        width = min(len(c), 4 * most)
        order = np.argsort(far, axis=1)[:, :width]
        homes = []
        for i, near in enumerate(order):
            chosen = [near[0]]
            reach = ratio * far[i, near[0]]
            for at in near[1:]:
                if len(chosen) == most or far[i, at] > reach:
                    break
                gap = c[chosen] - c[at]
                if np.sqrt((gap * gap).sum(axis=1)).min() > APART * far[i, at]:
                    chosen.append(at)
            homes.append(np.array(chosen))
        return homes


def _content(vec: str) -> Column:
    """128 bits that name a vector."""
    return F.concat(F.hex(F.xxhash64(vec)), F.lit("-"), F.hex(F.xxhash64(F.lit(SEED), F.col(vec))))


def _entries(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids, first_id, key): one row per different vector with its `keep` lowest ids.

    The rank is cut before the shuffle too, so a task sends at most `keep` rows of a vector.
    """
    low = F.row_number().over(W.partitionBy("key").orderBy("vec_id"))
    few = rows.withColumn("place", low).where(F.col("place") <= keep)
    return few.groupBy("key").agg(
        F.any_value("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"),
        F.min("vec_id").alias("first_id"),
    )


def fit(
    entries: DataFrame, total: int, k: int = K, sample: int = SAMPLE, list_rows: int = LIST_ROWS,
    boundary: float = BOUNDARY, replicas: int = REPLICAS, recall: float = RECALL,
) -> Index:
    """An index from the `sample` of the `total` entries with the lowest seeded hash of their vector."""
    # Hashed as doubles: floats and their doubles give one index.
    wide = F.transform("vec", lambda v: v.cast("double"))
    drawn = entries.orderBy(F.xxhash64(F.lit(SEED + 1), wide), "key").limit(sample).select("vec")
    x = _matrix(drawn.toArrow().column("vec").combine_chunks())
    lists = max(1, min(total // list_rows, len(x) // SAMPLE_PER_LIST))
    index = Index.over(balanced_centroids(x, lists))
    index.calibrate(x, total, k, boundary, replicas, recall)
    return index


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(np.float64)


def _nearest(first: np.ndarray, x: np.ndarray, q: np.ndarray, k: int):
    """Per query the (places, distances) of its k nearest rows of a block, by exact distances, ties
    to the smaller first id."""
    squares = (x * x).sum(axis=1)
    rough = squares - 2 * q @ x.T + (q * q).sum(axis=1)[:, None]
    # Rounding of the product form, far above what it can be.
    slack = 1e-9 * (squares.max(initial=0.0) + (q * q).sum(axis=1).max(initial=0.0)) + 1e-300
    for i in range(len(q)):
        if len(x) > k:
            edge = np.partition(rough[i], k - 1)[k - 1]
            near = np.flatnonzero(rough[i] <= edge + slack)
        else:
            near = np.arange(len(x))
        gap = x[near] - q[i]
        score = np.sqrt((gap * gap).sum(axis=1))
        order = np.lexsort((first[near], score))[:k]
        yield near[order], score[order]


def neighbours(
    vectors: DataFrame, is_query: Column, k: int = K, ident: str = "vec_id", vec: str = "embedding",
    recall: float = RECALL, boundary: float = BOUNDARY, replicas: int = REPLICAS,
    sample: int = SAMPLE, list_rows: int = LIST_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where `is_query` holds.

    score is the Euclidean distance of the original vectors, ties go to smaller ids. Rows with the
    query's id are its own; of rows with one id and one vector one counts, and query rows with one
    id and one vector are one query. Vectors that are null, empty, zero or hold null or non-finite
    components and rows without an id take no part; vectors meet those of the same length only. A
    query gets fewer than k rows only if there are fewer candidates. `sample` is shared among the
    lengths in proportion to their vectors, with `list_rows` vectors of each at least; more than
    10,000 lengths with more than `list_rows` vectors each are an error. `is_query` may use the
    columns vec_id and vec.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, ident, vec)
    if vectors.schema[vec].dataType.elementType.typeName() == "float":
        # Half the bytes to move; tasks compute with doubles, which hold the same numbers.
        rows = rows.withColumn("vec", F.transform("vec", lambda x: x.cast("float")))
    rows = rows.withColumn("key", _content("vec"))
    # A query leaves out its own id, so one more is kept of a vector and of the vectors found.
    keep = k + 1
    entries = durable(_entries(rows.dropDuplicates(["key", "vec_id"]), keep)).select(
        "*", F.size("vec").alias("width"), F.monotonically_increasing_id().alias("row")
    )
    asking = rows.where(F.coalesce(is_query, F.lit(False))).select("key", "vec_id").distinct()
    widths = entries.groupBy("width").agg(F.count("*").alias("n"))
    large = {r["width"]: r["n"] for r in listed(widths.where(F.col("n") > list_rows))}
    every = sum(large.values())
    made = {
        width: fit(
            entries.where(F.col("width") == width), n, k, max(list_rows, sample * n // every),
            list_rows, boundary, replicas, recall,
        )
        for width, n in large.items()
    }

    def with_lists(source: DataFrame, choose) -> DataFrame:
        """The rows with `lists`, what `choose` (index, vectors) gives; one list without an index."""
        indexes = spark.sparkContext.broadcast(made)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            width = batch.column("width").to_numpy(zero_copy_only=False)
            lists = [[0]] * len(width)
            for w in np.unique(width).tolist():
                if w in indexes.value:
                    own = np.flatnonzero(width == w)
                    x = _matrix(batch.column("vec").take(pa.array(own)))
                    for at, some in zip(own.tolist(), choose(indexes.value[w], x), strict=True):
                        lists[at] = some
            return batch.append_column("lists", pa.array(lists, pa.list_(pa.int32())))

        kind = source.select("width", "row", "first_id", "vec")
        vectors = kind.schema["vec"].dataType.simpleString()
        return durable(map_batches(
            kind, run, f"width int, row long, first_id long, vec {vectors}, lists array<int>", rows=2000
        ))

    postings = with_lists(entries, lambda index, x: index.homes(x, boundary, replicas))
    # A vector's first list is that of its nearest centroid; the indexes bound the rows collected.
    main = postings.where(F.col("width").isin(list(made))).groupBy("width", F.col("lists")[0].alias("list"))
    counts = main.agg(F.count("*").alias("n")).toArrow().to_pylist()
    for index in made.values():
        index.held = np.zeros(len(index.centroids))
    for c in counts:
        made[c["width"]].held[c["list"]] = c["n"]
    askers = entries.join(asking.select("key").distinct(), "key", "left_semi")
    wanted = with_lists(askers, lambda index, x: [index.visits(q, need=keep) for q in x])

    def blocks(placed: DataFrame, size: int, items: str, part: str) -> DataFrame:
        """(width, list, part, items): the lists with vectors, a long one in parts of about `size`."""
        each = placed.select("width", "row", "first_id", "vec", F.explode("lists").alias("list"))
        long = each.groupBy("width", "list").agg(F.count("*").alias("n")).where(F.col("n") > size)
        # Only lists of an index can be long, so there are no more rows than centroids.
        parts = long.select("width", "list", F.ceil(F.col("n") / size).cast("int").alias("parts"))
        full = each.join(F.broadcast(parts), ["width", "list"], "left")
        item = F.struct(F.col("row").alias("id"), "first_id", F.col("vec").alias("v"))
        number = spread_over(F.col("row"), F.coalesce("parts", F.lit(1)))
        return full.groupBy("width", "list", number.alias(part)).agg(F.collect_list(item).alias(items))

    met = blocks(postings, BLOCK_ROWS, "candidates", "part").join(
        blocks(wanted, QUERY_ROWS, "questions", "asked"), ["width", "list"]
    ).select("candidates", "questions")

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {n: [] for n in _FOUND.names}
        firsts = [r.values.field("first_id").to_numpy(zero_copy_only=False) for r in batch.column("candidates")]
        for (ids, x), (own, q), first in zip(
            unpacked(batch, "candidates"), unpacked(batch, "questions"), firsts, strict=True
        ):
            x, q = x.astype(np.float64), q.astype(np.float64)
            for i, (near, score) in enumerate(_nearest(first, x, q, keep)):
                found["asker"] += [int(own[i])] * len(near)
                found["row"] += ids[near].tolist()
                found["first_id"] += first[near].tolist()
                found["score"] += score.tolist()
        return table_of(found, _FOUND)

    schema = "asker long, row long, first_id long, score double"
    # A replicated vector is found in several lists with one score.
    near = map_batches(met, search, schema, rows=1).distinct()
    best = F.row_number().over(W.partitionBy("asker").orderBy("score", "first_id", "row"))
    # Every vector stands for at least one id, so the `keep` nearest ids are among these.
    near = near.withColumn("place", best).where(F.col("place") <= keep)
    ids = near.join(entries.select("row", "ids"), "row").select(
        "asker", "score", F.explode("ids").alias("vec_id")
    )
    few = F.row_number().over(W.partitionBy("asker").orderBy("score", "vec_id"))
    answers = ids.withColumn("place", few).where(F.col("place") <= keep)
    answers = answers.groupBy("asker").agg(
        F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found")
    )
    own = F.filter("found", lambda f: f["vec_id"] != F.col("query_id"))
    named = answers.join(entries.select(F.col("row").alias("asker"), "key"), "asker")
    answered = asking.select("key", F.col("vec_id").alias("query_id")).join(named, "key")
    placed = answered.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "f"))
    return placed.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"),
        F.col("f.score").alias("score"),
    )
