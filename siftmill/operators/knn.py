"""k nearest neighbours by inner product of unit vectors, as a partitioned join.

Rows with the same vector are collapsed first, so a group of copies costs one comparison. The
reference side is laid out in cells around pivots. A task holds at most `block_rows` queries and
reads the references of the cells they visit as a stream, so neither what it holds nor what it
returns grows with the references. Exact search learns from the nearest cells what k neighbours
reach and visits all cells whose bound reaches that too; `nprobe` stops after that many cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill import settings
from siftmill.operators.ranking import positions, take_seeded
from siftmill.session import durable, small_or_same

# Cells made without being asked for; a request is never lowered.
USUAL_CELLS = 4096
BLOCK_ROWS = 8192
# Above the rounding error of an angle near zero, about 1e-8.
_SLACK = 1e-6
# Below every similarity.
_LEAST = -2.0
# Tasks of one comparison at most; further parts share them.
_WIDTH = 10_000


def _content_key(vec: str):
    """128 bits of content hash, the same for rows that hold the same vector."""
    first = F.xxhash64(F.col(vec))
    second = F.xxhash64(F.lit(settings.SEED), F.col(vec))
    return F.concat(F.hex(first), F.lit("-"), F.hex(second))


def _distinct_vectors(df: DataFrame, ident: str, vec: str, carry: Sequence[str], keep: int):
    """(key, rid, vec, items): one row per distinct vector with its `keep` lowest ids.

    `rid` is the lowest of them and names the vector from here on.

    The rank filter is applied before the shuffle as well, so a vector with many copies sends
    at most `keep` rows per task.
    """
    keyed = df.where(F.col(vec).isNotNull()).select(
        _content_key(vec).alias("key"),
        F.struct(F.col(ident).alias("id"), *[F.col(c) for c in carry]).alias("item"),
        F.col(vec).alias("vec"),
    )
    rank = F.row_number().over(W.partitionBy("key").orderBy("item.id"))
    few = keyed.withColumn("r", rank).where(F.col("r") <= keep)
    return few.groupBy("key").agg(
        F.min("item.id").alias("rid"),
        F.any_value(F.when(F.col("r") == 1, F.col("vec")), F.lit(True)).alias("vec"),
        F.sort_array(F.collect_list("item")).alias("items"),
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows in double precision; zero rows stay zero."""
    chunk = column.combine_chunks()
    if isinstance(chunk, pa.ChunkedArray):
        chunk = pa.concat_arrays(chunk.chunks)
    rows = len(chunk)
    flat = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    made = flat.reshape(rows, -1) if rows else flat.reshape(0, 1)
    size = np.sqrt((made * made).sum(axis=1, keepdims=True))
    return made / np.where(size > 0, size, 1.0)


_SLICE = 1024
# Queries compared at once with a batch of references.
_ROWS = 256


def _slices(batches):
    """Tables of at most _SLICE rows, so that a score matrix stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            yield pa.Table.from_batches([batch.slice(start, _SLICE)])


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest entries per row; the lower column wins a tie at the edge."""
    width = scores.shape[1]
    if width <= k:
        return np.tile(np.arange(width), (scores.shape[0], 1))
    cols = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(scores, cols, axis=1).min(axis=1, keepdims=True)
    tied = np.nonzero((scores >= edge).sum(axis=1) > k)[0]
    if len(tied):
        cols[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :k]
    return cols


class _Part:
    """The queries of one part and the best `k` references met so far, lowest id first.

    Of the references only the items of those that some query holds are kept.
    """

    held_bytes = 64 << 20

    def __init__(self, number: int, k: int):
        self.number, self.k = number, k
        self.asked: list[pa.RecordBatch] = []
        self.queries = None

    def ask(self, rows: pa.RecordBatch) -> None:
        self.asked.append(rows.select(["key", "vec", "tau"]))

    def _begin(self) -> None:
        rows = pa.Table.from_batches(self.asked)
        self.asked = []
        self.keys = rows.column("key").combine_chunks()
        self.queries = _matrix(rows.column("vec"))
        self.odd = np.isnan(self.queries).any()
        tau = rows.column("tau").to_numpy()
        self.floor = np.where(tau > _LEAST, tau - _SLACK, -np.inf)
        self.sims = np.full((len(rows), self.k), -np.inf)
        self.held = np.full((len(rows), self.k), -1)
        self.items, self.stored, self.limit = [], 0, self.held_bytes

    def meet(self, rows: pa.RecordBatch) -> None:
        """Compare the queries with references that follow those before in id order."""
        if self.queries is None:
            if not self.asked:
                return
            self._begin()
        ref = _matrix(pa.chunked_array([rows.column("vec")]))
        self.items.append(rows.column("items"))
        odd = self.odd or np.isnan(ref).any()
        for start in range(0, len(self.queries), _ROWS):
            part = slice(start, start + _ROWS)
            scores = self.queries[part] @ ref.T
            if odd:
                scores = np.nan_to_num(scores, nan=_LEAST)
            self._take(part, scores)
        self.stored += len(rows)
        if sum(a.nbytes for a in self.items) > self.limit:
            self._forget()

    def _take(self, part: slice, scores: np.ndarray) -> None:
        """Let scores above the lowest one held take its place; of equal ones the earlier stays."""
        sims, held = self.sims[part], self.held[part]
        better = scores > np.maximum(sims.min(axis=1), self.floor[part])[:, None]
        row, col = np.divmod(np.flatnonzero(better), better.shape[1])
        if not len(row):
            return
        hit, row, found = np.unique(row, return_inverse=True, return_counts=True)
        place = np.arange(len(row)) - np.repeat(np.cumsum(found) - found, found)
        new_sims = np.full((len(hit), found.max()), -np.inf)
        new_held = np.full(new_sims.shape, -1)
        new_sims[row, place] = scores[hit[row], col]
        new_held[row, place] = self.stored + col
        both = np.hstack([sims[hit], new_sims])
        best = np.sort(_top(both, self.k), axis=1)
        sims[hit] = np.take_along_axis(both, best, axis=1)
        held[hit] = np.take_along_axis(np.hstack([held[hit], new_held]), best, axis=1)

    def _needed(self) -> np.ndarray:
        """Which held references have less than k rows strictly before them, counting copies."""
        sizes = np.concatenate([a.value_lengths().to_numpy() for a in self.items] + [[0]])
        order = np.argsort(-self.sims, axis=1, kind="stable")
        sims = np.take_along_axis(self.sims, order, axis=1)
        rows = sizes[np.take_along_axis(self.held, order, axis=1)]  # -1 reads the last, 0
        before = np.cumsum(rows, axis=1) - rows
        first = np.tile(np.arange(self.k), (len(sims), 1))
        first[:, 1:][sims[:, 1:] == sims[:, :-1]] = 0
        before = np.take_along_axis(before, np.maximum.accumulate(first, axis=1), axis=1)
        needed = np.zeros(sims.shape, bool)
        np.put_along_axis(needed, order, before < self.k, axis=1)
        return needed & (self.held >= 0)

    def _forget(self) -> None:
        self.held[~self._needed()] = -1
        used = np.unique(self.held[self.held >= 0])
        self.items = [pa.concat_arrays(self.items).take(pa.array(used))]
        self.held = np.where(self.held < 0, -1, np.searchsorted(used, self.held))
        self.stored = len(used)
        self.limit = max(self.held_bytes, 2 * self.items[0].nbytes)

    def lists(self):
        """(qkey, near) per query that holds a reference; `away` is the negative similarity."""
        if self.queries is None:
            return
        self.queries = None
        needed = self._needed()
        items = pa.concat_arrays(self.items)
        for start in range(0, len(needed), _SLICE):
            part = slice(start, start + _SLICE)
            row, col = np.nonzero(needed[part])
            if not len(row):
                continue
            sims = self.sims[part][row, col]
            sims[sims == _LEAST] = np.nan
            asked, ends = np.unique(row, return_index=True)
            near = pa.StructArray.from_arrays(
                [pa.array(-sims), items.take(pa.array(self.held[part][row, col]))], ["away", "items"]
            )
            ends = pa.array(np.append(ends, len(row)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [self.keys.take(pa.array(start + asked)), pa.ListArray.from_arrays(ends, near)],
                ["qkey", "near"],
            )


def _best_of_parts(k: int):
    """Per part its queries, then its references as a stream; one list of the best k per query."""

    def run(batches):
        now = None
        for batch in batches:
            kind = batch.column("part").to_numpy() * 2 + batch.column("side").to_numpy()
            cuts = np.nonzero(np.diff(kind))[0] + 1
            for start, end in zip([0, *cuts], [*cuts, len(kind)]):
                if start == end:
                    continue
                number, side = divmod(int(kind[start]), 2)
                if now is None or now.number != number:
                    if now is not None:
                        yield from now.lists()
                    now = _Part(number, k)
                rows = batch.slice(start, end - start)
                now.meet(rows) if side else now.ask(rows)
        if now is not None:
            yield from now.lists()

    return run


def _compare(left: DataFrame, right: DataFrame, parts: int, slices: int, k: int) -> DataFrame:
    """(qkey, near): the best k per query of queries (part, key, vec, tau) against the references
    (part, rid, vec, items) of the same part.

    A part is one task, which holds its queries and reads its references one batch after the
    other, so what it holds and what it returns does not grow with the references. `slices` cuts
    the references of every part where there are fewer parts than tasks; a query then has a list
    a slice.
    """
    if slices > 1:
        left = left.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        right = right.withColumn("slice", F.pmod(F.xxhash64("rid"), F.lit(slices)).cast("int"))
        left, right = (
            df.withColumn("part", F.col("part") * slices + F.col("slice")) for df in (left, right)
        )
    near = T.StructType(
        [
            T.StructField("away", T.DoubleType()),
            T.StructField("items", right.schema["items"].dataType),
        ]
    )
    made = T.StructType(
        [T.StructField("qkey", T.StringType()), T.StructField("near", T.ArrayType(near))]
    )
    asked = left.select("part", F.lit(0).alias("side"), "key", "vec", "tau")
    met = right.select("part", F.lit(1).alias("side"), "vec", "rid", "items")
    width = max(1, min(_WIDTH, parts * slices))
    both = asked.unionByName(met, allowMissingColumns=True)
    laid = both.repartitionById(width, F.pmod("part", F.lit(width)).cast("int"))
    ordered = laid.sortWithinPartitions("part", "side", "rid").drop("rid")
    return ordered.mapInArrow(_best_of_parts(k), made)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """One list per query, nearest first, of at most k distinct vectors."""
    lists = found.groupBy("qkey").agg(F.flatten(F.collect_list("near")).alias("near"))
    return lists.select("qkey", F.slice(F.sort_array("near"), 1, k).alias("near"))


def _with_plan(df: DataFrame, plan: pa.Table) -> DataFrame:
    """Add `first` and `salts` of the row's cell; one row per cell."""
    if plan.num_rows == 1:
        one = plan.to_pylist()[0]
        return df.where(F.col("cell") == one["cell"]).withColumns(
            {c: F.lit(one[c]) for c in ("first", "salts")}
        )
    return df.join(F.broadcast(df.sparkSession.createDataFrame(plan)), "cell")


def _in_part(df: DataFrame, plan: pa.Table) -> DataFrame:
    """Queries with the part that their cell and key name."""
    salt = F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")
    return _with_plan(df, plan).withColumn("part", F.col("first") + salt)


def _in_every_part(df: DataFrame, plan: pa.Table) -> DataFrame:
    """References once for every part of their cell."""
    parts = F.sequence("first", F.col("first") + F.col("salts") - 1)
    return _with_plan(df, plan).select("rid", "vec", "items", F.explode(parts).alias("part"))


def _plan(loads: dict[int, int], n_ref: int, block_rows: int, tasks: int):
    """First part and number of parts per cell from its queries; parts and slices in all.

    Fewer query rows than a block make more tasks, but each of them reads its own copy of the
    references, so there is a floor.
    """
    share = math.ceil(sum(loads.values()) / tasks)
    query_rows = max(1, min(block_rows, max(share, block_rows // 16)))
    cells = sorted(loads)
    salts = np.array([max(1, math.ceil(loads[c] / query_rows)) for c in cells], np.int32)
    parts = int(salts.sum())
    slices = min(math.ceil(tasks / max(1, parts)), math.ceil(n_ref / block_rows))
    plan = pa.table(
        {
            "cell": pa.array(cells, pa.int32()),
            "first": pa.array((np.cumsum(salts) - salts).astype(np.int32)),
            "salts": pa.array(salts),
        }
    )
    return plan, parts, max(1, slices)


def _counts(df: DataFrame) -> dict[int, int]:
    """Rows per cell; there are as many as pivots, which one matrix holds."""
    rows = df.groupBy("cell").agg(F.count("*").alias("n")).collect()
    return {r["cell"]: r["n"] for r in rows}


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot and the angle to it for every vector."""

    def run(batches):
        for table in _slices(batches):
            scores = _matrix(table.column("vec")) @ pivots.T
            cell = scores.argmax(axis=1)
            best = scores[np.arange(len(scores)), cell]
            angle = np.arccos(np.clip(best, -1.0, 1.0))
            yield from table.append_column("cell", pa.array(cell.astype(np.int32))).append_column(
                "angle", pa.array(angle)
            ).to_batches()

    fields = [f for f in rows.schema.fields]
    schema = T.StructType(
        [*fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    )
    return rows.mapInArrow(run, schema)


def _visit(queries, pivots, sizes, radius, k, nprobe, carry: Sequence[str]):
    """`carry` and the cells to visit, an array per query row.

    Without `tau`: nearest cells until they hold k vectors, or `nprobe` cells. With it: all cells
    whose best possible similarity reaches `tau`.
    """
    bounded = "tau" in queries.columns

    def run(batches):
        for table in _slices(batches):
            scores = _matrix(table.column("vec")) @ pivots.T
            if bounded:
                angle = np.arccos(np.clip(scores, -1.0, 1.0))
                bound = np.cos(np.maximum(0.0, angle - radius[None, :]))
                floor = table.column("tau").to_numpy()[:, None] - _SLACK
                # No bound holds for a vector with a component that is no number.
                near = (bound >= floor) | np.isnan(bound)
            else:
                order = np.argsort(-scores, axis=1, kind="stable")
                if nprobe:
                    first = np.arange(scores.shape[1])[None, :] < nprobe
                    first = np.broadcast_to(first, scores.shape)
                else:
                    first = (np.cumsum(sizes[order], axis=1) - sizes[order]) < k
                near = np.zeros(scores.shape, bool)
                np.put_along_axis(near, order, first, axis=1)
            near &= sizes[None, :] > 0
            ends = np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32)
            cells = pa.ListArray.from_arrays(
                pa.array(ends), pa.array(np.nonzero(near)[1].astype(np.int32))
            )
            yield from table.select(list(carry)).append_column("cells", cells).to_batches()

    schema = T.StructType(
        [*[queries.schema[c] for c in carry], T.StructField("cells", T.ArrayType(T.IntegerType()))]
    )
    return queries.mapInArrow(run, schema)


def _spread_pivots(refs: DataFrame, cells: int) -> np.ndarray:
    """`cells` distinct vectors in hash order; they reach the driver, as pivots do."""
    table = refs.orderBy("key").limit(cells).select("vec").toArrow()
    return _matrix(table.column("vec"))


def sampled_pivots(
    df: DataFrame, key: str, vec: str, cells: int, seed: int = settings.SEED
) -> np.ndarray:
    """The vectors of a seeded sample of rows, which does not depend on the engine."""
    rows = take_seeded(df.select(key, vec), key, cells, seed=seed)
    return _matrix(rows.orderBy(key).select(vec).toArrow().column(vec))


def trained_pivots(
    df: DataFrame, vec: str, cells: int, seed: int = settings.SEED, iterations: int = 10
) -> np.ndarray:
    """Centroids of a k-means run over the unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # The cosine distance is not defined for zero vectors.
    some = df.where(F.exists(vec, lambda x: x != 0))
    made = some.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(
        k=cells, seed=seed, maxIter=iterations, distanceMeasure="cosine"
    ).fit(made)
    centres = np.vstack(model.clusterCenters())
    size = np.sqrt((centres * centres).sum(axis=1, keepdims=True))
    return centres / np.where(size > 0, size, 1.0)


def _search(queries, refs, k, cells, nprobe, pivots, block_rows) -> DataFrame:
    """(qkey, near): lists of the best k distinct reference vectors per distinct query vector, or
    fewer where their copies make k rows. A query may have more than one list."""
    spark = refs.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    n_ref = refs.count()
    if pivots is None:
        wanted = cells or max(1, min(USUAL_CELLS, n_ref // (4 * block_rows)))
        if wanted > 1 and n_ref > wanted:
            pivots = _spread_pivots(refs, wanted)
    vectors = queries.select("key", "vec")
    unbounded = F.lit(_LEAST).alias("tau")
    if pivots is None or n_ref == 0:
        plan, parts, slices = _plan({0: queries.count()}, n_ref, block_rows, tasks)
        zero = F.lit(0).cast("int").alias("cell")
        return _compare(
            _in_part(vectors.select("*", unbounded, zero), plan),
            _in_every_part(refs.select("*", zero), plan), parts, slices, k,
        )
    placed = durable(_assign(refs.select("rid", "vec", "items"), pivots))
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("a")).collect()
    sizes = np.zeros(len(pivots), np.int64)
    radius = np.zeros(len(pivots))
    for row in stats:
        sizes[row["cell"]], radius[row["cell"]] = row["n"], row["a"]
    visits = _visit(vectors, pivots, sizes, radius, k, nprobe, ["key", "vec"])
    near = visits.select("key", "vec", unbounded, F.explode("cells").alias("cell"))
    plan, parts, slices = _plan(_counts(near), int(sizes.max()), block_rows, tasks)
    found = _compare(_in_part(near, plan), _in_every_part(placed, plan), parts, slices, k)
    if nprobe:
        return found
    # k rows at least as similar as `tau` are known; a cell that cannot reach it holds no neighbour.
    sims = F.transform("near", lambda x: F.struct(x["away"].alias("away"), F.size(x["items"]).alias("rows")))
    reached = _merged(found.select("qkey", sims.alias("near")), k).select(
        "qkey", _reached(k).alias("tau")
    )
    bounded = vectors.join(reached, vectors["key"] == reached["qkey"], "left").select(
        "key", "vec", F.coalesce("tau", F.lit(_LEAST)).alias("tau")
    )
    homed = durable(_assign(bounded, pivots))
    plan, parts, slices = _plan(_counts(homed), n_ref, block_rows, tasks)
    asked = _in_part(homed, plan)
    # Queries of one part are neighbours: the part reads every cell that one of them visits.
    wanted = _visit(asked, pivots, sizes, radius, k, None, ["part"])
    pairs = small_or_same(wanted.select("part", F.explode("cells").alias("cell")).distinct())
    met = placed.join(pairs, "cell").select("rid", "vec", "items", "part")
    return _compare(asked, met, parts, slices, k)


def _reached(k: int):
    """The similarity that k rows of a list reach, or one below all if it holds fewer."""
    rows = F.aggregate("near", F.lit(0), lambda n, x: n + x["rows"])
    return F.when(rows >= k, F.nanvl(-F.element_at("near", -1)["away"], F.lit(_LEAST))).otherwise(
        F.lit(_LEAST)
    )


def knn(
    query: DataFrame,
    ref: DataFrame,
    k: int = settings.NEIGHBOURS,
    *,
    qid: str = "vec_id",
    rid: str = "vec_id",
    vec: str = "embedding",
    carry: Sequence[str] = (),
    exclude_self: bool = False,
    cells: int | None = None,
    nprobe: int | None = None,
    pivots: np.ndarray | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(qid, rid, *carry, sim, rank): the k most similar reference rows of every query row.

    `carry` names columns of the reference that come along, so that no join by neighbour id is
    needed afterwards. Ties go to the lower id. With `exclude_self` a row is not its own
    neighbour.
    """
    keep = k + 1 if exclude_self else k
    refs = durable(_distinct_vectors(ref, rid, vec, carry, keep))
    keyed = query.where(F.col(vec).isNotNull()).select(
        F.col(qid).alias("qid"), _content_key(vec).alias("key"), F.col(vec).alias("vec")
    )
    queries = refs if query is ref else durable(
        keyed.groupBy("key").agg(F.any_value("vec").alias("vec"))
    )
    found = _search(queries, refs, keep, cells, nprobe, pivots, block_rows)
    # Neighbours by distinct vector become neighbours by row: what a list holds beyond `keep` rows
    # is a last vector's copies or tied with it.
    rows = F.flatten(F.transform("near", lambda n: F.transform(
        n["items"], lambda x: F.struct(n["away"].alias("away"), x.alias("item"))
    )))
    lists = _merged(found, keep).select(
        "qkey", F.slice(F.sort_array(rows), 1, keep).alias("near")
    )
    # One row per distinct query vector meets its copies; a hot key is split by the skew join.
    rows = keyed.select("qid", "key").join(lists, keyed["key"] == lists["qkey"])
    near = F.col("near")
    if exclude_self:
        near = F.filter(near, lambda x: x["item"]["id"] != F.col("qid"))
    out = rows.select("qid", F.posexplode(F.slice(near, 1, k)).alias("pos", "hit"))
    return out.select(
        "qid",
        F.col("hit.item.id").alias("rid"),
        *[F.col(f"hit.item.{c}").alias(c) for c in carry],
        (-F.col("hit.away")).alias("sim"),
        (F.col("pos") + 1).alias("rank"),
    )


def density(
    query: DataFrame, ref: DataFrame | None = None, k: int = settings.NEIGHBOURS, **options
) -> DataFrame:
    """(qid, density): mean similarity to the k nearest rows; a row counts itself by default."""
    near = knn(query, query if ref is None else ref, k, **options)
    return near.groupBy("qid").agg(F.avg("sim").alias("density"))


def dense(df: DataFrame, densities: DataFrame, ident: str, above: float) -> DataFrame:
    """Rows whose density is strictly above the threshold, with the density added."""
    return df.join(densities.withColumnRenamed("qid", ident), ident).where(
        F.col("density") > above
    )


def hard_negatives(
    safe: DataFrame, risk: DataFrame, k: int, n: int | None = None, **options
) -> DataFrame:
    """(qid, density, rank): safe rows by their mean similarity to the k nearest risk rows.

    The closest row has rank 1; `n` keeps the first n.
    """
    scored = durable(density(safe, risk, k, **options).withColumn("_away", -F.col("density")))
    placed = positions(scored, ["_away", "qid"], name="rank")
    ranked = placed.select("qid", "density", (F.col("rank") + 1).alias("rank"))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def soft_labels(
    query: DataFrame,
    teacher: DataFrame,
    k: int = settings.NEIGHBOURS,
    temperature: float = settings.TEMPERATURE,
    *,
    classes: DataFrame | None = None,
    label: str = "class_idx",
    **options,
) -> DataFrame:
    """(qid, class_idx, p): exp(sim/T) summed over the neighbours of a class, as shares.

    A query without neighbours gets equal shares over `classes` when they are given.
    """
    near = knn(query, teacher, k, carry=[label], **options)
    weight = F.sum(F.exp(F.col("sim") / temperature))
    summed = near.groupBy("qid", label).agg(weight.alias("w"))
    total = F.sum("w").over(W.partitionBy("qid"))
    shares = summed.select("qid", F.col(label).alias("class_idx"), (F.col("w") / total).alias("p"))
    if classes is None:
        return shares
    # Read twice below; the search behind it runs once.
    shares = durable(shares)
    ident = options.get("qid", "vec_id")
    bare = query.select(F.col(ident).alias("qid")).join(shares.select("qid"), "qid", "left_anti")
    held = classes.agg(F.sort_array(F.collect_set(label)).alias("all")).scalar()
    equal = bare.select("qid", held.alias("all")).select(
        "qid",
        F.explode("all").alias("class_idx"),
        (F.lit(1.0) / F.size("all")).alias("p"),
    )
    return shares.unionByName(equal)


def soft_label_arrays(shares: DataFrame, n_classes: int) -> DataFrame:
    """(qid, soft_label): the dense array of length `n_classes` per query."""
    held = shares.groupBy("qid").agg(F.map_from_entries(
        F.collect_list(F.struct("class_idx", "p"))
    ).alias("m"))
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)),
    )
    return held.select("qid", filled.alias("soft_label"))


def risk_score(
    query: DataFrame,
    ref: DataFrame,
    k: int = settings.RISK_NEIGHBOURS,
    *,
    label: str = "binary_label",
    epsilon: float = 1e-6,
    **options,
) -> DataFrame:
    """(qid, risk): share of risk neighbours, weighted by inverse cosine distance."""
    near = knn(query, ref, k, carry=[label], **options)
    weight = 1.0 / (1.0 - F.col("sim") + epsilon)
    return near.groupBy("qid").agg(
        (F.sum(weight * F.col(label)) / F.sum(weight)).alias("risk")
    )
