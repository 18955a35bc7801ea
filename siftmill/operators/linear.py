"""Linear models with many outputs, all fitted together: one pass of the table per step.

A task turns its Arrow batches into matrices and adds up, for all outputs at once, loss and gradient
as products of matrices. The sums of the tasks are added in a few tasks before the driver adds the
last ones, so that the driver receives a number of small matrices that grows with the root of the
shuffle width. The driver keeps the weights only and takes quasi-Newton steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.session import shuffle_width

# Up to this width steps are scaled by the dimensions' covariances, beyond by their variances.
COVARIANCE_WIDTH = 1024
MEMORY = 10
_SUMS = "slot int, sums array<double>"
# (products x weights, targets) -> (loss of all rows, its derivative by the products)
Link = Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]


def logistic(logits: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray]:
    """Independent outputs: every target is the probability of its own label."""
    loss = np.logaddexp(0, logits).sum() - (targets * logits).sum()
    return float(loss), 0.5 * (1 + np.tanh(0.5 * logits)) - targets


def multinomial(logits: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray]:
    """Exclusive outputs: the targets of a row are masses of its classes."""
    top = logits.max(axis=1, keepdims=True)
    grown = np.exp(logits - top)
    total = grown.sum(axis=1, keepdims=True)
    mass = targets.sum(axis=1, keepdims=True)
    loss = (mass * (top + np.log(total))).sum() - (targets * logits).sum()
    return float(loss), mass * grown / total - targets


@dataclass
class Fitted:
    """Weights per output on vectors as they are, and how the fit ended."""

    weights: np.ndarray
    bias: np.ndarray
    rows: int
    gradient: float
    passes: int


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _summed(
    rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int, width: int, outputs: int
) -> np.ndarray:
    """The sum of `fn` (vectors, targets) over all batches, added in two stages."""
    few = max(1, math.isqrt(shuffle_width(rows.sparkSession)))
    schema = pa.schema([("slot", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def one(total: np.ndarray, slot: int) -> pa.RecordBatch:
        columns = [pa.array([slot], pa.int32()), pa.array([total], schema.field("sums").type)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = np.zeros(size), 0
        for batch in batches:
            if batch.num_rows:
                slot = int(batch.column("slot")[0].as_py())
                total += fn(_matrix(batch.column("x"), width), _matrix(batch.column("y"), outputs))
        yield one(total, slot)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += _matrix(batch.column("sums"), size).sum(axis=0) if batch.num_rows else 0
        yield one(total, 0)

    tasks = rows.select("x", "y", F.pmod(F.spark_partition_id(), F.lit(few)).alias("slot"))
    made = tasks.mapInArrow(of_task, _SUMS).repartition(few, "slot").mapInArrow(together, _SUMS)
    return _matrix(made.toArrow().column("sums").combine_chunks(), size).sum(axis=0)


def fit(
    df: DataFrame, vec: str, targets: str, outputs: int, link: Link, penalty: float | None = None,
    iterations: int = 100, tolerance: float = 1e-6,
) -> Fitted:
    """The least mean loss plus half the `penalty` times the squared weights on standardised vectors.

    `targets` is an array of `outputs` numbers. The bias carries no penalty; without a given penalty
    it is one over the rows. A dimension that does not vary has no weight. The fit ends when no
    entry of the mean gradient exceeds `tolerance`, or after `iterations` steps. Rows without vector
    or targets take no part; vectors of different lengths and an empty table are errors.
    """
    rows = df.select(
        F.col(vec).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("y")
    ).where((F.size("x") > 0) & (F.size("y") == outputs)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(rows, outputs, link, penalty, iterations, tolerance)
    finally:
        rows.unpersist()


def _fit(
    rows: DataFrame, outputs: int, link: Link, penalty: float | None, iterations: int, tolerance: float
) -> Fitted:
    some = rows.first()
    if some is None:
        raise ValueError("no row to fit on")
    # Sums are taken around a row of the table, so that large means cancel little.
    origin = np.array(some["x"], float)
    width = len(origin)
    wide = width > COVARIANCE_WIDTH

    def moments(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        x = x - origin
        second = (x * x).sum(axis=0) if wide else (x.T @ x).ravel()
        return np.concatenate([[len(x)], x.sum(axis=0), second])

    sums = _summed(rows, moments, 1 + width + (width if wide else width * width), width, outputs)
    n, mean = sums[0], sums[1 : width + 1] / sums[0]
    if wide:
        spread = np.sqrt(np.maximum(sums[width + 1 :] / n - mean * mean, 0))
    else:
        covariance = sums[width + 1 :].reshape(width, width) / n - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    varies = spread > 1e-12 * np.maximum(np.abs(mean + origin), 1e-300)
    scale = np.where(varies, spread, 1.0)
    centre = mean + origin
    penalty = 1 / n if penalty is None else penalty
    shrink = np.append(np.full(width, penalty), 0.0)

    # The loss curves by at most a quarter of this an output, whatever the weights.
    if wide:
        curve = 0.25 + shrink
        solve = lambda g: g / curve
    else:
        among = np.where(np.outer(varies, varies), covariance / np.outer(scale, scale), 0.0)
        curve = np.zeros((width + 1, width + 1))
        curve[:width, :width], curve[width, width] = 0.25 * among, 0.25
        curve += np.diag(shrink + 1e-9)
        inverse = np.linalg.inv(curve)
        solve = lambda g: g @ inverse

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def step(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.where(varies, (x - centre) / scale, 0.0)
            loss, slope = link(z @ weights[:, :-1].T + weights[:, -1], y)
            return np.concatenate([[loss], (slope.T @ z).ravel(), slope.sum(axis=0)])

        sums = _summed(rows, step, 1 + outputs * (width + 1), width, outputs) / n
        slope = np.column_stack([sums[1 : 1 + outputs * width].reshape(outputs, width), sums[-outputs:]])
        return sums[0] + 0.5 * (shrink * weights**2).sum(), slope + shrink * weights

    weights, gradient, passes = _descend(evaluate, np.zeros((outputs, width + 1)), solve, iterations, tolerance)
    slopes = weights[:, :-1] / scale
    return Fitted(slopes, weights[:, -1] - slopes @ centre, int(n), float(np.abs(gradient).max()), passes)


def _descend(
    evaluate, at: np.ndarray, solve, iterations: int, tolerance: float
) -> tuple[np.ndarray, np.ndarray, int]:
    """Limited-memory quasi-Newton steps from `at`: (point, gradient there, evaluations)."""
    loss, slope = evaluate(at)
    passes, moves = 1, []
    for _ in range(iterations):
        if np.abs(slope).max() <= tolerance:
            break
        way, kept = slope.copy(), []
        for moved, turned in reversed(moves):
            share = (moved * way).sum() / (moved * turned).sum()
            way -= share * turned
            kept.append(share)
        way = solve(way)
        if moves:
            moved, turned = moves[-1]
            way *= (moved * turned).sum() / (turned * solve(turned)).sum()
        for (moved, turned), share in zip(moves, reversed(kept), strict=True):
            way += (share - (turned * way).sum() / (moved * turned).sum()) * moved
        falls, step = -(slope * way).sum(), 1.0
        while True:
            there = at - step * way
            new_loss, new_slope = evaluate(there)
            passes += 1
            # Near the end losses differ by rounding only; there a shorter gradient decides.
            if new_loss <= loss + 1e-4 * step * falls or np.abs(new_slope).max() < 0.5 * np.abs(slope).max():
                break
            step /= 2
            if step < 1e-6:
                return at, slope, passes
        moved, turned = there - at, new_slope - slope
        if (moved * turned).sum() > 1e-300:
            moves = [*moves[1 - MEMORY :], (moved, turned)]
        at, loss, slope = there, new_loss, new_slope
    return at, slope, passes
