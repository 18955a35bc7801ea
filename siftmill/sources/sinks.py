"""Writers: append, replace by version, keyed update, snapshot, side tables, reuse."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.operators.filters import ensure_columns

SNAPSHOT = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("dataset_type", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField(
            "emotion_scores",
            T.StructType(
                [T.StructField("negative", T.DoubleType()), T.StructField("positive", T.DoubleType())]
            ),
        ),
        T.StructField("predicted_emotions", T.ArrayType(T.StringType())),
    ]
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at `path`."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is stored as a folder of files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def append_valid(df: DataFrame, path: str, vector: str = "embedding") -> None:
    """Append the rows that have a vector."""
    df.where(F.col(vector).isNotNull()).write.mode("append").parquet(path)


def remaining(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the sink does not hold yet: where an interrupted job goes on."""
    spark = df.sparkSession
    if not exists(spark, path):
        return df
    return df.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")


def after_rows(df: DataFrame, order: str, done: int) -> DataFrame:
    """Rows that follow the first `done` rows in order."""
    from siftmill.operators.ranking import positions

    placed = positions(df.select(order), [order], name="_pos")
    later = placed.where(F.col("_pos") >= done).select(F.col(order).alias("_order"))
    return df.join(later, F.col(order).eqNullSafe(F.col("_order")), "left_semi")


def version(path: str, n: int) -> str:
    return f"{path}/v={n}"


def replace(df: DataFrame, path: str, n: int) -> DataFrame:
    """Write version n of a table and read it back; earlier versions stay for their readers."""
    target = version(path, n)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def updated(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The table with `columns` taken from `changes` where they hold the key."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(new, key, "left")
    return joined.select(
        *[
            F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of `schema`: missing ones null, others dropped, types cast."""
    grown = ensure_columns(df, {f.name: f.dataType.simpleString() for f in schema.fields})
    return grown.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables in one snapshot, each row tagged with its table."""
    for tag, df in tables.items():
        tagged = as_schema(df.withColumn("dataset_type", F.lit(tag)), SNAPSHOT)
        tagged.write.mode("append").option("compression", "snappy").parquet(path)


def compiled(df: DataFrame) -> DataFrame:
    """(text, label, soft_label, subreddit) of a compiled set."""
    picked = [
        F.col("input").alias("text"),
        F.col("binary_label").cast("int").alias("label"),
        F.col("soft_label"),
    ]
    if "subreddit" in df.columns:
        picked.append(F.col("subreddit"))
    return df.select(*picked)


def write_compiled(df: DataFrame, path: str) -> None:
    compiled(df).write.parquet(path)


def write_side_table(df: DataFrame, path: str) -> None:
    """A small table as one JSON file."""
    df.repartition(1).write.json(path)


def read_side_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def materialised(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at `path`, building and writing it first if it is not there."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_silver(df: DataFrame, path: str) -> None:
    """Silver labels with a distribution; rows that were not scored are left out."""
    df.where(F.size("full_dist") > 0).write.parquet(path)
