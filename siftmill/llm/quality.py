"""Quality by supervised subword embeddings.

A text is the average of learned vectors: of its words as written, of their character n-grams and of
a marker for each word that repeats the one before, all hashed into one table. A linear layer and a
softmax over the average give the classes. Table and layer are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows.

Since the output is linear in the average, a word's part in the score is one number, which workers
remember; scoring a text adds these numbers up.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.common import map_batches, table_of, whole_texts
from siftmill.llm.labelled import judged, learning_row, rows_by_score, sample_rows

CUTOFF = 0.7
# The model is fitted on a bounded sample: at most so many labelled rows of each class.
ROWS_PER_CLASS = 1500
BUCKETS = 1 << 15
WIDTH = 8
NGRAMS = (2, 3)
STEPS = 1200
RATE = 0.5
BATCH = 16
SEED = 42
# Words whose part in the score a worker remembers; the scores do not depend on it.
REMEMBERED = 500_000
_REPEAT = zlib.crc32(b"\0repeat")
# A repeated word counts as much as a word of usual length has features.
_REPEAT_WEIGHT = 12
# The step of the vectors against that of the output layer: a text's gradient is spread over all
# its buckets by shares far below one.
_SPREAD = 50.0
_LONGEST_KEPT = 64
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_ROWS = pa.schema([("y", pa.int64()), ("at", pa.binary()), ("share", pa.binary())])


def features_of(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and of the character n-grams of `<word>`."""
    raw = f"<{word}>"
    found = [zlib.crc32(raw.encode()) % buckets]
    for n in NGRAMS:
        found += [zlib.crc32(raw[i:i + n].encode(), n) % buckets for i in range(len(raw) - n + 1)]
    return found


def features_in(words: list[str]) -> int:
    """How many features the words have; with its marks a word is never shorter than an n-gram."""
    letters = sum(map(len, words))
    return len(NGRAMS) * letters + len(words) * (1 + sum(3 - n for n in NGRAMS))


def text_features(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a whole text; the shares add up to one, a text without words has none."""
    words = text.split()
    found: dict[str, int] = {}
    for word in words:
        found[word] = found.get(word, 0) + 1
    places, times = [_REPEAT % buckets], [float(_REPEAT_WEIGHT * sum(map(eq, words, words[1:])))]
    for word, n in found.items():
        parts = features_of(word, buckets)
        places += parts
        times += [n] * len(parts)
    total = np.bincount(places, times, buckets)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(total.sum(), 1.0)).astype(np.float32)


@dataclass
class Model:
    """Per bucket the log-odds it adds for label 1, and the constant."""

    weight: np.ndarray
    constant: float
    _known: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def _part(self, word: str) -> float:
        return float(self.weight[features_of(word, len(self.weight))].sum())

    def score(self, text: str) -> float:
        words = text.split()
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        parts = list(map(known.get, words))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    word = words[i]
                    part = known.get(word)
                    if part is None:
                        part = self._part(word)
                        if len(word) <= _LONGEST_KEPT:
                            known[word] = part
                    parts[i] = part
        repeats = _REPEAT_WEIGHT * sum(map(eq, words, words[1:]))
        total = sum(parts) + repeats * self.weight[_REPEAT % len(self.weight)]
        mean = total / max(features_in(words) + repeats, 1)
        return float(1 / (1 + np.exp(-np.clip(mean + self.constant, -30, 30))))

    def scores(self, texts: list[str]) -> list[float]:
        return [self.score(t) for t in texts]


def train(
    rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS, width: int = WIDTH,
    steps: int = STEPS, rate: float = RATE, batch: int = BATCH, seed: int = SEED,
) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, output) by stochastic gradient descent on the softmax loss, classes weighted alike.

    `rows` are (label, buckets, shares). The step falls linearly to zero.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    output = np.zeros((2, width), np.float32)
    bias = np.zeros(2, np.float32)
    labels = np.array([y for y, _, _ in rows], np.int64)
    weight = len(rows) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))
    order = np.zeros(0, np.int64)
    for step in range(steps):
        if len(order) < min(batch, len(rows)):
            order = np.concatenate([order, rng.permutation(len(rows))])
        picked, order = order[:batch], order[batch:]
        pace = rate * (1 - step / steps)
        hidden = np.stack([rows[i][2] @ vectors[rows[i][1]] for i in picked])
        logits = hidden @ output.T + bias
        logits -= logits.max(axis=1, keepdims=True)
        share = np.exp(logits)
        share /= share.sum(axis=1, keepdims=True)
        slope = share
        slope[np.arange(len(picked)), labels[picked]] -= 1
        slope *= weight[labels[picked]][:, None] / len(picked)
        back = slope @ output
        output -= pace * slope.T @ hidden
        bias -= pace * slope.sum(axis=0)
        for i, g in zip(picked, back, strict=True):
            vectors[rows[i][1]] -= pace * _SPREAD * rows[i][2][:, None] * g
    return vectors, np.column_stack([output, bias])


def _featured(sample: DataFrame, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The sampled rows as features. Bounded by the rows of the sample times the buckets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [text_features(t, buckets) for t in batch.column("text").to_pylist()]
        return table_of({
            "y": batch.column("y").cast(pa.int64()), "at": [a.tobytes() for a, _ in made],
            "share": [s.tobytes() for _, s in made],
        }, _ROWS)

    ordered = map_batches(
        sample.select("doc_id", "text", "y").repartition("doc_id").sortWithinPartitions("doc_id")
        .select("text", "y"), run, "y long, at binary, share binary",
    )
    made = ordered.toArrow().to_pydict()
    rows = [
        (y, np.frombuffer(a, np.int32), np.frombuffer(s, np.float32))
        for y, a, s in zip(made["y"], made["at"], made["share"], strict=True)
    ]
    # The order of partitions must not matter.
    return sorted(rows, key=lambda r: (r[0], zlib.crc32(r[1].tobytes() + r[2].tobytes())))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", learn=None,
    per_class: int = ROWS_PER_CLASS, buckets: int = BUCKETS, ident: str = "doc_id",
    text: str = "text", **options,
) -> Model:
    """A model from the labelled rows for which the condition `learn` on `labels` holds.

    Classes are trained with equal weight and set to their true shares afterwards. Without labelled
    rows of both classes the shares are all there is to say.
    """
    learn = F.lit(True) if learn is None else learn
    sample, shares = sample_rows(whole_texts(docs, ident, text), labels, label, learn, per_class)
    prior = float(np.log((shares[1] + 1) / (shares[0] + 1)))
    rows = _featured(sample, buckets)
    if len({y for y, _, _ in rows}) < 2:
        return Model(np.zeros(buckets), prior)
    vectors, output = train(rows, buckets, **options)
    apart = output[1] - output[0]
    return Model((vectors @ apart[:-1]).astype(np.float64), float(apart[-1]) + prior)


def scores(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): likelihood of label 1 for every whole text; null texts count as empty.

    Texts without words get the score of the constant; repeated rows and null ids stay; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shared.value.score(t) for t in batch.column("text").to_pylist()]
        return table_of({"doc_id": batch.column("doc_id"), "score": made}, _SCORED)

    return map_batches(whole_texts(docs, ident, text), run, "doc_id long, score double")


def judge(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, cutoff: float = CUTOFF,
    **options,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) with labels of the held-out remainder never read."""
    return judged(docs, labels, fit, scores, modulus, held, cutoff, **options)


def good_rows(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, cutoff: float = CUTOFF,
    ident: str = "doc_id", text: str = "text", **options,
) -> DataFrame:
    """The rows of `docs` whose text is good: its score reaches the cutoff."""
    learn = learning_row("doc_id", modulus, held)
    model = fit(docs, labels, learn=learn, ident=ident, text=text, **options)
    return rows_by_score(docs, model, lambda s: s >= cutoff, text)
