"""Input tables and intermediate folders of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get texts in Arrow batches of a few MB: 10,000 long texts at once would fill their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session; where none is set (tests) a folder in /tmp is used.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files of an execution go as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there and a lost executor costs nothing.

    The shuffle files behind the table go when it is written, so a chain of large shuffles never holds all of them.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = shared_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster sizes by its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the number's decimal text modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
