"""Compile a training set from a snapshot of embedded chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.functions import parsing
from siftmill.operators import knn, sampling, sets
from siftmill.operators.filters import binary_label, drop_happy_risk, ensure_columns
from siftmill.operators.identity import numbered
from siftmill.operators.ranking import seeded_hash
from siftmill.session import durable
from siftmill.sources import sinks


STAGES = (
    "all", "train", "risk", "risk_calm", "risk_clean", "safe", "safe_sad", "safe_happy",
    "safe_neutral", "final_train", "test",
)


@dataclass(frozen=True)
class CompileOptions:
    neighbours: int = settings.NEIGHBOURS
    label_neighbours: int = settings.NEIGHBOURS
    risk_density: float = settings.RISK_DENSITY
    safe_density: float = settings.SAFE_DENSITY
    high: float = settings.HIGH_EMOTION
    low: float = settings.LOW_EMOTION
    flag: float = settings.EMOTION_FLAG
    temperature: float = settings.TEMPERATURE
    test_share: float = settings.TEST_SHARE
    seed: int = settings.SEED
    # Neighbour search: exact by default; `nprobe` makes it approximate.
    cells: int | None = None
    nprobe: int | None = None


@dataclass
class Compiled:
    """`rows` (key, copy_id, row_id, side, label, subreddit, class_idx) without vectors, `shares`
    (row_id, class_idx, p), the class dictionary, the risk classes and the row counts.

    `row_id` is a struct of the key and the copy."""

    rows: DataFrame
    shares: DataFrame
    classes: DataFrame
    risk_classes: DataFrame
    funnel: DataFrame


def _watched(df: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """The rows kept durable, and how many of them meet each condition, from the same pass."""
    seen = Observation()
    sums = [F.count_if(met).alias(name) for name, met in counts.items()]
    kept = durable(df.observe(seen, *sums))
    return kept, seen.get


def with_scores(snapshot: DataFrame) -> DataFrame:
    """A stored snapshot with the columns that `compile_sets` reads.

    The label follows from the table a row came from unless it is there already. Scores are a
    struct or JSON text; without them a predicted label counts as 1.
    """
    grown = ensure_columns(
        snapshot, {"emotion_scores": parsing.SCORES, "predicted_emotions": "array<string>"}
    )
    is_text = grown.schema["emotion_scores"].dataType.typeName() == "string"
    scores = parsing.read_scores(F.col("emotion_scores")) if is_text else F.col("emotion_scores")
    made = grown.withColumns({
        "pos_score": parsing.emotion_score(scores, F.col("predicted_emotions"), "positive"),
        "neg_score": parsing.emotion_score(scores, F.col("predicted_emotions"), "negative"),
    })
    if "binary_label" in snapshot.columns:
        return made
    return made.withColumn("binary_label", binary_label(F.col("dataset_type")))


def compile_sets(
    snapshot: DataFrame, key: str = "vec_id", vec: str = "embedding",
    options: CompileOptions = CompileOptions(),
) -> Compiled:
    """Author split, emotion filter, density filter, balanced safe rows, soft labels.

    `snapshot` holds a key that names its rows (`operators.identity.numbered` makes one), the
    vector, author, subreddit, binary_label, pos_score and neg_score. Vectors stay out of splits
    and draws and are joined for the searches only. The row counts are taken by the passes that
    write the stages.
    """
    o = options
    spark = snapshot.sparkSession
    vectors = snapshot.select(key, vec)
    # A row without a class stays, under a class of its own.
    meta = snapshot.select(
        key, "author", F.coalesce("subreddit", F.lit(settings.NO_CLASS)).alias("subreddit"),
        "binary_label", "pos_score", "neg_score",
    )
    classes = sets.class_index(meta, "subreddit")
    in_train, everything = F.col("side") == "train", F.lit(True)
    split, first = _watched(
        sampling.author_split(meta, share=o.test_share, seed=o.seed).join(classes, "subreddit"),
        {"all": everything, "train": in_train, "risk": in_train & (F.col("binary_label") == 1),
         "test": ~in_train},
    )
    train = split.where(in_train)

    def with_density(rows: DataFrame) -> DataFrame:
        found = knn.density(
            sets.gather(rows.select(key), vectors, key), k=o.neighbours, qid=key, rid=key, vec=vec,
            cells=o.cells, nprobe=o.nprobe,
        )
        return rows.join(found.withColumnRenamed("qid", key), key)

    risk = train.where("binary_label = 1")
    calm, second = _watched(
        drop_happy_risk(risk, high=o.high, low=o.low), {"risk_calm": everything}
    )
    clean, third = _watched(
        with_density(calm).where(F.col("density") > o.risk_density), {"risk_clean": everything}
    )
    neutral_ok = F.col("density") > o.safe_density
    sad, happy = F.col("sad"), F.col("happy")
    safe, fourth = _watched(
        with_density(train.where("binary_label = 0"))
        .withColumn("sad", F.col("neg_score") > o.flag)
        .withColumn("happy", F.col("pos_score") > o.flag),
        {"safe": everything, "safe_sad": sad, "safe_happy": happy,
         "safe_neutral": ~sad & ~happy & neutral_ok},
    )
    drawn = sampling.balanced_safe(
        safe, F.lit(third["risk_clean"]), key, neutral_ok, seed=o.seed
    )

    narrow = [key, "copy_id", "side", "binary_label", "subreddit", "class_idx"]
    test = split.where("side = 'test'").withColumn("copy_id", F.lit(0))
    rows, last = _watched(
        clean.withColumn("copy_id", F.lit(0)).select(*narrow)
        .unionByName(drawn.select(*narrow))
        .unionByName(test.select(*narrow))
        .withColumn("row_id", F.struct(F.col(key).alias("key"), "copy_id")),
        {"final_train": in_train},
    )
    full = rows.select("row_id", key, "side", "class_idx").join(vectors, key)
    teacher = full.where("side = 'train'")
    search = dict(
        k=o.label_neighbours, temperature=o.temperature, qid="row_id", rid="row_id", vec=vec,
        classes=classes, cells=o.cells, nprobe=o.nprobe,
    )
    shares = knn.soft_labels(teacher, teacher, **search).unionByName(
        knn.soft_labels(full.where("side = 'test'"), teacher, **search)
    )
    risk_classes = sets.positive_classes(meta, classes, "subreddit", "binary_label")
    counts = {**first, **second, **third, **fourth, **last}
    funnel = spark.createDataFrame([(n, counts[n]) for n in STAGES], "stage string, rows long")
    return Compiled(rows, shares, classes, risk_classes, funnel)


def compiled_rows(made: Compiled, texts: DataFrame, key: str, side: str, seed: int = settings.SEED):
    """(text, label, soft_label, subreddit) of one side in seeded order, for the writer.

    `texts` holds the key and the column `input`. Soft labels are arrays over all classes.
    """
    width = made.classes.count()
    arrays = knn.soft_label_arrays(made.shares, width).withColumnRenamed("qid", "row_id")
    rows = made.rows.where(F.col("side") == side).join(texts.select(key, "input"), key)
    mixed = rows.join(arrays, "row_id").orderBy(seeded_hash("row_id", seed), "row_id")
    return mixed.select("input", "binary_label", "soft_label", "subreddit")


_SIDES = ("train", "test")
_CLASSES = "subreddit string, class_idx int"
_SETS = "text string, label int, soft_label array<double>, subreddit string"


def write_sets(
    made: Compiled, texts: DataFrame, key: str, folder: str, seed: int = settings.SEED
) -> None:
    """Both sides as Parquet and the class dictionary and risk classes as JSON, below `folder`."""
    for side in _SIDES:
        sinks.write_compiled(compiled_rows(made, texts, key, side, seed), f"{folder}/{side}")
    sinks.write_side_table(made.classes.select("subreddit", "class_idx"), f"{folder}/classes")
    sinks.write_side_table(
        made.risk_classes.select("subreddit", "class_idx"), f"{folder}/risk_classes"
    )


@dataclass
class WrittenSets:
    """What `write_sets` wrote: `rows` (side, text, label, soft_label, subreddit), the class
    dictionary and the risk classes (subreddit, class_idx)."""

    rows: DataFrame
    classes: DataFrame
    risk_classes: DataFrame


def read_sets(spark: SparkSession, folder: str) -> WrittenSets:
    """The sets and side tables below `folder`; a side without rows is an empty one."""
    sides = [
        spark.read.schema(_SETS).parquet(f"{folder}/{side}").withColumn("side", F.lit(side))
        for side in _SIDES
    ]
    return WrittenSets(
        sets.union_all(*sides),
        sinks.read_side_table(spark, f"{folder}/classes", _CLASSES),
        sinks.read_side_table(spark, f"{folder}/risk_classes", _CLASSES),
    )


def compile_snapshot(
    path: str, folder: str, spark: SparkSession, order=("post_id",),
    options: CompileOptions = CompileOptions(),
) -> WrittenSets:
    """From a stored snapshot to the written sets: rows numbered in `order`, labels from their
    tables, scores from scores or predicted labels, split, filters, balance, soft labels, files."""
    stored = numbered(spark.read.schema(sinks.SNAPSHOT).parquet(path), order, "row")
    scored = with_scores(stored)
    write_sets(compile_sets(scored, "row", options=options), stored, "row", folder, options.seed)
    return read_sets(spark, folder)
