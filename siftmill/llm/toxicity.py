"""Toxicity by class-conditional Kneser-Ney language models.

Word bigram models of toxic and of ordinary texts are learned from all labelled rows:

* a bigram counts once for each distinct text of the class that holds it, so neither copies nor
  repetition inside a text look like evidence;
* bigrams back off to words, which count once for each different word before them in the class;
* words back off to one distribution for both classes: the number of documents that hold a word,
  over all documents, labelled or not.

Each class keeps its own discounted mass, so a context that only one class knows has a weight there
and backs off in the other. A text's evidence is the difference of its two length-normalised
log-likelihoods and its most telling word, which a long text cannot dilute. A logistic function of
the two, fitted on cross-fitted training rows and set to the classes' true shares, is the score.

Words are 48-bit hashes throughout. Slices of texts send their counts as compressed blocks, one of
each partition of the hash range; no string travels, and nothing longer than a bigram. Words and
bigrams that no class counts above the discount give no evidence of their own, so only the others
are part of the model that the tasks hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm import varint
from siftmill.llm.common import map_batches, slices_by_size, stored, table_of, whole_texts
from siftmill.llm.labelled import (
    judged,
    learning_row,
    marked_rows,
    rows_by_score,
    sample_rows,
)
from siftmill.session import small_or_same

CUTOFF = 0.7
# The weights of the logistic function are fitted on at most so many labelled rows of each class.
ROWS_PER_CLASS = 4000
# With more labelled rows than that, documents meet their labels in a shuffled join.
HELD_LABELS = 1_000_000
# Words and bigrams of a model that tasks can hold: 40 bytes each, of three models. More are an error.
HELD_ENTRIES = 12_000_000
# Estimated discounts (1 to 3) leave the many words of one or two places as noise; README has both
# results.
DISCOUNT = 5.0
SLICE_BYTES = 8 << 20
# Bytes of text whose counts one merging task takes, about.
_PART_BYTES = 16 << 20
_HASH_BITS = 48
_TOKEN = re.compile(r"[^\W_]+")
_BLOCK = pa.schema([("part", pa.int32()), ("pairs", pa.bool_()), ("data", pa.binary())])
_NUMBERS = [f"n{i}" for i in range(6)] + [f"c{i}" for i in range(4)] + ["df"]
_COUNTS = pa.schema([("h", pa.int64()), ("a", pa.int64()), *((n, pa.int64()) for n in _NUMBERS)])
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) >> (64 - _HASH_BITS)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of two arrays of word hashes."""
    keys = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


@dataclass
class Model:
    """Log ratios of words and of bigrams by hash, and the weights of the logistic function.

    `own` is a word's ratio after a context that neither class knows, `back` what a context adds to
    it for a bigram that is not listed, `leads` whether it begins a listed one; unlisted words have
    the ratio `rest`.
    """

    words: np.ndarray
    own: np.ndarray
    back: np.ndarray
    leads: np.ndarray
    pairs: np.ndarray
    ratio: np.ndarray
    rest: float
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def ratios(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the log ratio of each word of all texts after the one before it, words of each text)."""
        ids, sizes, words = numbered(texts)
        hashes = np.array([word_hash(w) for w in words], np.int64)
        at = np.searchsorted(self.words, hashes)
        found = np.append(self.words, -1)[at] == hashes
        at[~found] = len(self.words)
        ratios = np.append(self.own, self.rest)[at][ids].astype(float)
        back, leads = np.append(self.back, 0.0)[at], np.append(self.leads, False)[at]
        inside = np.ones(len(ids), bool)
        inside[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        # Contexts that lead a listed bigram are also the only ones that change what follows.
        here = np.flatnonzero(inside)
        here = here[leads[ids[here - 1]]]
        ratios[here] += back[ids[here - 1]]
        if len(self.pairs):
            keys = pair_keys(hashes[ids[here - 1]], hashes[ids[here]])
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            ratios[here] = np.where(self.pairs[place] == keys, self.ratio[place], ratios[here])
        return ratios, sizes

    def evidence(self, texts: list[str]) -> np.ndarray:
        """(mean log ratio, log ratio of the most toxic word) of each text, zero without words."""
        ratios, sizes = self.ratios(texts)
        made = np.zeros((len(texts), 2))
        some = sizes > 0
        if some.any():
            starts = (np.cumsum(sizes) - sizes)[some]
            made[some, 0] = np.add.reduceat(ratios, starts) / sizes[some]
            made[some, 1] = np.maximum.reduceat(ratios, starts)
        return made

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.weights[0] + self.evidence(texts) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word numbers of all texts behind one another, words of each text, words)."""
    numbers = _Numbers()
    cut = [np.array([numbers[w] for w in words_of(t)], np.int64) for t in texts]
    sizes = np.array([len(c) for c in cut], np.int64)
    return np.concatenate(cut) if cut else np.zeros(0, np.int64), sizes, list(numbers)


def text_fold(text: str = "text") -> Column:
    """0 or 1, the same for equal texts."""
    return F.pmod(F.xxhash64(F.lit(7), F.col(text)), F.lit(2)).cast("int")


def _parted(docs: DataFrame, labels: DataFrame, label: str, learn) -> DataFrame:
    """(text, part) of all documents. `part` is 2 * fold + class for one document of each labelled
    text, null for the others."""
    marked = small_or_same(marked_rows(labels, label, learn), HELD_LABELS)
    key = F.xxhash64("text").alias("key")
    part = (2 * text_fold() + F.col("y")).cast("int").alias("part")
    there = docs.join(marked, "doc_id").select("doc_id", key, part)
    first = stored(there.groupBy("key", "part").agg(F.min("doc_id").alias("doc_id")), "labelled-texts")
    rows = docs.select("doc_id", "text", key)
    return rows.join(small_or_same(first, HELD_LABELS), ["doc_id", "key"], "left").select("text", "part")


def _sorted_blocks(part: np.ndarray, pairs: bool, first: np.ndarray, wide: np.ndarray | None, more: list):
    """Rows of (part, pairs, data): hashes `first` ascend in each part; `wide` are hashes as they
    are, `more` small numbers."""
    ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True][: len(part)]) + 1
    for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
        steps = np.r_[first[i], np.diff(first[i:j])]
        numbers = varint.encode(np.concatenate([steps, *(m[i:j] for m in more)]))[0].tobytes()
        raw = b"" if wide is None else np.ascontiguousarray(
            wide[i:j].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        ).tobytes()
        yield int(part[i]), pairs, np.array([j - i], "<u4").tobytes() + raw + numbers


def _read_block(data: bytes, pairs: bool) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    at = 4
    columns = []
    if pairs:
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
        columns.append(raw.view("<u8").ravel().astype(np.int64))
        at += 6 * n
    numbers = varint.decode(np.frombuffer(data, np.uint8, offset=at)).astype(np.int64).reshape(-1, n)
    return np.cumsum(numbers[0]), *columns, *numbers[1:]


def _part_of(first: np.ndarray, split: np.ndarray, bits: int, splits: int) -> np.ndarray:
    """Range of the first hash, and the share of it that another hash falls into."""
    return (first >> (_HASH_BITS - bits)) * splits + split % splits


def _blocks(texts: list[str], parts: list[int | None], bits: int, splits: int) -> list[tuple]:
    """A slice's counts: bigrams by second word (with the first one, count and part), and words (with
    documents that hold them, whether a labelled one does, and bigrams they begin in each part)."""
    ids, sizes, words = numbered(texts)
    if not len(ids):
        return []
    hashes = np.array([word_hash(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    part = np.array([-1 if p is None else p for p in parts])
    held = np.unique(ids * len(texts) + doc)
    df = np.bincount(held // len(texts), minlength=len(hashes))
    judged_ = np.bincount((held // len(texts))[part[held % len(texts)] >= 0], minlength=len(hashes)) > 0
    on = (doc[1:] == doc[:-1]) & (part[doc[1:]] >= 0)
    pairs, which = np.unique(ids[:-1][on] << 32 | ids[1:][on], return_inverse=True)
    once = np.unique(which * len(texts) + doc[1:][on])
    seen, counts = np.unique((once // len(texts)) * 4 + part[once % len(texts)], return_counts=True)
    a, b, p = pairs[seen // 4] >> 32, pairs[seen // 4] & 0xFFFFFFFF, seen % 4
    begun = [np.bincount(a[p == i], counts[p == i], len(hashes)).astype(np.int64) for i in range(4)]
    rows = []
    place = _part_of(hashes, np.zeros_like(hashes), bits, splits)
    order = np.lexsort((hashes, place))
    rows += _sorted_blocks(
        place[order], False, hashes[order], None, [x[order] for x in (df * 2 + judged_, *begun)]
    )
    place = _part_of(hashes[b], hashes[a], bits, splits)
    order = np.lexsort((hashes[b], place))
    rows += _sorted_blocks(
        place[order], True, hashes[b][order], hashes[a][order], [(counts * 4 + p)[order]]
    )
    return rows


def _merged(group: pa.Table, discount: float) -> pa.Table:
    """Exact counts of a partition: words of labelled texts, kept bigrams, and one row of totals."""
    found: dict[bool, list] = {True: [], False: []}
    for pairs, data in zip(group.column("pairs").to_pylist(), group.column("data").to_pylist(), strict=True):
        found[pairs].append(_read_block(data, pairs))
    made = []

    def add(h, a, **columns) -> None:
        size = len(h)
        none = pa.nulls(size, pa.int64())
        made.append(pa.table({
            "h": pa.array(h, pa.int64()), "a": none if a is None else pa.array(a, pa.int64()),
            **{n: pa.array(columns.get(n, np.zeros(size, np.int64)), pa.int64()) for n in _NUMBERS},
        }, schema=_COUNTS))

    if found[True]:
        b, a, packed = (np.concatenate(x) for x in zip(*found[True], strict=True))
        order = np.lexsort((a, b))
        b, a, part, count = b[order], a[order], packed[order] & 3, packed[order] >> 2
        first = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (a[1:] != a[:-1])])
        k = [np.add.reduceat(np.where(part == i, count, 0), first) for i in range(4)]
        b, a = b[first], a[first]
        words = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        n = [np.add.reduceat((x > 0).astype(np.int64), words) for x in (*k, k[0] + k[2], k[1] + k[3])]
        add(b[words], None, **{f"n{i}": x for i, x in enumerate(n)})
        kept = np.maximum(k[0] + k[2], k[1] + k[3]) > discount
        add(b[kept], a[kept], **{f"c{i}": x[kept] for i, x in enumerate(k)})
    if found[False]:
        h, packed, *begun = (np.concatenate(x) for x in zip(*found[False], strict=True))
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        df = np.add.reduceat(packed[order] >> 1, first)
        on = np.add.reduceat(packed[order] & 1, first) > 0
        begun = {f"c{i}": np.add.reduceat(x[order], first)[on] for i, x in enumerate(begun)}
        add(h[first][on], None, df=df[on], **begun)
        made.append(pa.table(
            {n: [{"n0": len(first), "df": int(df.sum())}.get(n, None if n in "ha" else 0)] for n in _COUNTS.names},
            schema=_COUNTS,
        ))
    return pa.concat_tables(made) if made else _COUNTS.empty_table()


def counts(rows: DataFrame, discount: float) -> DataFrame:
    """(h, a, n0..n5, c0..c3, df) of (text, part), kept as a table.

    Rows without `a` add up to a word's counts: words before it in each part and, n4 and n5, in each
    class; bigrams that it begins in each part; documents. Rows with `a` are bigrams (a, h) and their
    texts in each part, c0..c3. Rows without `h` add up to the number of words and the sum of df.
    """
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    wanted = max(8, 1 << int(size // _PART_BYTES).bit_length())
    # A word may follow any other, so ranges of words are split by the word before.
    splits = min(max(2, wanted // 64), wanted // 4)
    bits = (wanted // splits).bit_length() - 1

    def count(batches):
        for batch in slices_by_size(batches, "text", SLICE_BYTES):
            made = _blocks(*(batch.column(n).to_pylist() for n in ("text", "part")), bits, splits)
            if made:
                yield table_of(dict(zip(_BLOCK.names, zip(*made, strict=True), strict=True)), _BLOCK)

    def merge(group: pa.Table) -> pa.Table:
        return _merged(group, discount)

    blocks = rows.mapInArrow(count, "part int, pairs boolean, data binary")
    schema = "h long, a long, " + ", ".join(f"{n} long" for n in _NUMBERS)
    return stored(blocks.groupBy("part").applyInArrow(merge, schema), "toxicity-counts")


def _of_model(prefix: str, m: int, y: int) -> Column:
    """Counts of class `y` over one fold, or over both (2)."""
    if m < 2:
        return F.col(f"{prefix}{2 * m + y}")
    return F.col(f"n{4 + y}") if prefix == "n" else F.col(f"{prefix}{y}") + F.col(f"{prefix}{2 + y}")


def entries(counted: DataFrame, discount: float) -> tuple[DataFrame, DataFrame, list[float]]:
    """(words, pairs, rest): the log ratios of both folds' models and of the whole one.

    words: (h, own0..2, back0..2); pairs: (a, h, ratio0..2); `rest` is the ratio of other words.
    """
    single = counted.where("h IS NOT NULL AND a IS NULL").groupBy("h").agg(
        *[F.sum(n).alias(n) for n in _NUMBERS]
    )
    models = [(m, y) for m in range(3) for y in (0, 1)]
    zero, d = F.lit(0.0), F.lit(float(discount))
    sums = single.agg(
        *[F.coalesce(F.sum(_of_model("n", m, y)), F.lit(0)).alias(f"s{m}{y}") for m, y in models],
        *[F.coalesce(F.sum(F.least(_of_model("n", m, y), d)), zero).alias(f"l{m}{y}") for m, y in models],
    ).first()
    whole = counted.where("h IS NULL").agg(F.sum("n0").alias("words"), F.sum("df").alias("df")).first()
    mass = {k: max(float(sums[f"s{k[0]}{k[1]}"]), 1.0) for k in models}
    # A class without any count leaves all its mass to the shared backoff.
    left = {k: sums[f"l{k[0]}{k[1]}"] / mass[k] if sums[f"s{k[0]}{k[1]}"] else 1.0 for k in models}
    total = (whole["df"] or 0) + 0.5 * ((whole["words"] or 0) + 1)
    shared = (F.col("df") + 0.5) / total
    double = counted.where("a IS NOT NULL").select("a", "h", *[f"c{i}" for i in range(4)])
    over = {k: F.greatest(_of_model("c", *k) - d, zero) for k in models}
    used = double.groupBy("a").agg(*[F.sum(over[k]).alias(f"u{k[0]}{k[1]}") for k in models])
    probability = {
        k: F.greatest(_of_model("n", *k) - d, zero) / mass[k] + left[k] * shared for k in models
    }
    speaks = F.greatest(*[_of_model("n", *k) for k in models]) > d
    joined = single.join(used.withColumnRenamed("a", "h"), "h", "left").na.fill(0.0)
    after = {
        (m, y): F.when(_of_model("c", m, y) > 0, 1 - F.col(f"u{m}{y}") / _of_model("c", m, y)).otherwise(F.lit(1.0))
        for m, y in models
    }
    words = joined.select(
        "h", (speaks | (F.greatest(*[F.col(f"u{m}{y}") for m, y in models]) > 0)).alias("listed"),
        *[probability[k].alias(f"p{k[0]}{k[1]}") for k in models],
        *[after[k].alias(f"w{k[0]}{k[1]}") for k in models],
        *[_of_model("c", *k).alias(f"t{k[0]}{k[1]}") for k in models],
    )
    words = stored(words, "toxicity-words")
    context = words.select(F.col("h").alias("a"), *[f"{x}{m}{y}" for x in "wt" for m, y in models])
    last = words.select("h", *[f"p{m}{y}" for m, y in models])
    met = double.join(context, "a").join(last, "h")

    def ratio(m: int) -> Column:
        of = [
            F.when(F.col(f"t{m}{y}") > 0, over[m, y] / F.col(f"t{m}{y}")).otherwise(zero)
            + F.col(f"w{m}{y}") * F.col(f"p{m}{y}") for y in (0, 1)
        ]
        return (F.log(of[1]) - F.log(of[0])).cast("float").alias(f"ratio{m}")

    def logs(x: str, name: str) -> list[Column]:
        return [(F.log(f"{x}{m}1") - F.log(f"{x}{m}0")).cast("float").alias(f"{name}{m}") for m in range(3)]

    listed = words.where("listed").select("h", *logs("p", "own"), *logs("w", "back"))
    rest = [float(np.log(left[m, 1] / left[m, 0])) for m in range(3)]
    return listed, stored(met.select("a", "h", *[ratio(m) for m in range(3)]), "toxicity-pairs"), rest


def _models(words: DataFrame, pairs: DataFrame, rest: list[float]) -> list[Model]:
    """The models of both folds and the whole one, held by the driver and sent to all tasks."""
    size = words.count() + pairs.count()
    if size > HELD_ENTRIES:
        raise ValueError(f"a model of {size} words and bigrams is more than a task should hold; raise the discount")
    ones, twos = words.toArrow(), pairs.toArrow()

    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy()

    order = np.argsort(column(ones, "h"))
    hashes = column(ones, "h")[order]
    leads = np.isin(hashes, column(twos, "a"))
    keys = pair_keys(column(twos, "a"), column(twos, "h"))
    by_key = np.argsort(keys)
    return [
        Model(
            hashes, column(ones, f"own{m}")[order], column(ones, f"back{m}")[order], leads, keys[by_key],
            column(twos, f"ratio{m}")[by_key], rest[m],
        ) for m in range(3)
    ]


def _evidence(sample: DataFrame, models: list[Model]) -> np.ndarray:
    """(y, mean, top) of each sampled row by the model that did not see its fold."""
    shared = sample.sparkSession.sparkContext.broadcast(models[:2])
    kind = pa.schema([("y", pa.int64()), ("mean", pa.float64()), ("top", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, folds = batch.column("text").to_pylist(), batch.column("fold").to_pylist()
        both = [shared.value[1 - f].evidence(texts) for f in (0, 1)]
        made = np.where(np.array(folds)[:, None] == 0, *both)
        columns = {"y": batch.column("y").cast(pa.int64()), "mean": made[:, 0], "top": made[:, 1]}
        return table_of(columns, kind)

    rows = map_batches(sample.select("text", "y", "fold"), run, "y long, mean double, top double")
    made = rows.toArrow()
    return np.column_stack([made.column(n).to_numpy().astype(float) for n in kind.names])


def _logistic(rows: np.ndarray, shares: list[int], ridge: float = 1e-2) -> np.ndarray:
    """Weights of (1, mean, top), rows weighted to the classes' true shares; Newton steps."""
    y, x = rows[:, 0], np.column_stack([np.ones(len(rows)), rows[:, 1:]])
    drawn = np.array([(y == 0).sum(), (y == 1).sum()], float)
    if not drawn.all():
        # One class alone, or none: its share is all there is to say.
        rate = (shares[1] + 1) / (sum(shares) + 2)
        return np.array([np.log(rate / (1 - rate)), 0.0, 0.0])
    weight = (np.array(shares) / drawn)[y.astype(int)]
    w = np.zeros(x.shape[1])
    hold = ridge * np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - hold @ w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + hold + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w += move / max(1.0, np.abs(move).max() / 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", learn=None,
    per_class: int = ROWS_PER_CLASS, discount: float = DISCOUNT, ident: str = "doc_id",
    text: str = "text",
) -> Model:
    """A model from the labelled rows for which the condition `learn` on `labels` holds.

    The language models learn from all of them and the shared backoff from all documents; the weights
    of the logistic function from at most `per_class` rows of each class. Nothing but the text and
    the label of a row is read. Without labelled rows every text gets the score one half.
    """
    learn = F.lit(True) if learn is None else learn
    docs = whole_texts(docs, ident, text)
    *halves, model = _models(*entries(counts(_parted(docs, labels, label, learn), discount), discount))
    sample, shares = sample_rows(docs, labels, label, learn, per_class)
    model.weights = _logistic(_evidence(sample.withColumn("fold", text_fold()), halves), shares)
    return model


def scores(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): likelihood of label 1 for every whole text; null texts count as empty.

    Texts without words have no evidence and get the score of none; repeated rows and null ids
    stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = shared.value.scores(batch.column("text").to_pylist())
        return table_of({"doc_id": batch.column("doc_id"), "score": made}, _SCORED)

    return map_batches(whole_texts(docs, ident, text), run, "doc_id long, score double")


def judge(
    docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, cutoff: float = CUTOFF,
    **options,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) with labels of the held-out remainder never read.

    A row with a null id is not held out.
    """
    return judged(docs, labels, fit, scores, modulus, held, cutoff, **options)


def without_toxic(
    docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, cutoff: float = CUTOFF,
    ident: str = "doc_id", text: str = "text", **options,
) -> DataFrame:
    """The rows of `docs` whose text is not toxic: its score is below the cutoff."""
    learn = learning_row("doc_id", modulus, held)
    model = fit(docs, labels, learn=learn, ident=ident, text=text, **options)
    return rows_by_score(docs, model, lambda s: s < cutoff, text)
