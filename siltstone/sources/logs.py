"""Log sources and request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.features import FEATURES
from siltstone.functions.normalize import SPACE, trim_space

STATUSES = ["pending", "processing", "waiting_parser", "completed", "failed"]


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One log per file; files of white space alone are no logs."""
    return nonempty(spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw_log"))


def nonempty(df: DataFrame, raw: str = "raw_log") -> DataFrame:
    return df.where(F.col(raw).rlike(f"[^{SPACE[1:-1]}]"))


def split_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One log per line of a pasted text, trimmed, blank lines left out."""
    lines = df.select(*keep, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "raw_log"))
    return lines.withColumn("raw_log", trim_space(F.col("raw_log"))).where("raw_log <> ''")


def new_requests(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))


def decoded(payload: Column) -> Column:
    """Bytes as text; invalid UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(payload.cast("string"))


def append_requests(df: DataFrame, path: str) -> None:
    """Adds df's logs to a request table as pending ones."""
    new_requests(df).write.mode("append").parquet(path)


def message_body(fingerprint: Column, raw_log: Column, features: Column) -> Column:
    """A queue message that asks for a rule."""
    return F.to_json(F.struct(fingerprint.alias("hash"), raw_log.alias("raw_log"), features.alias("features")))


def messages(df: DataFrame, body: str = "body") -> DataFrame:
    """hash, raw_log and features of queue messages beside df's other columns; broken JSON and empty hashes are dropped."""
    m = df.withColumn("_m", F.from_json(body, f"hash string, raw_log string, features {FEATURES}"))
    names = ("hash", "raw_log", "features")
    return m.where("coalesce(_m.hash, '') <> ''").select(*(c for c in df.columns if c not in (body, *names)), *(F.col(f"_m.{n}") for n in names))


def new_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Users to add: e-mail addresses that the table does not have yet."""
    return seen.dropDuplicates(["email"]).join(users, "email", "left_anti")
