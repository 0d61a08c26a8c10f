"""Corpus preparation: stages over documents, each written as Parquet and reread by the next.

1. language   texts that language ID rejects (no letter, or far from every learned language) go
2. duplicates one document, the one with the smallest id, of each group of near copies stays (five words, 0.8)
3. repeats    bytes of 200-byte strings that also start elsewhere go; n_chars follows; no document is dropped
4. packing    what is left is tokenised and packed into sequences of 2048 tokens

Defined results: ids are whole numbers or texts, in their own order; documents without an id are not compared with others
in stage 2 and stay; rows that share an id are compared like any others, and of those with the same text too one stays;
without any labelled row stage 1 keeps every text that has a letter; extra columns of any names come through all stages but
the last; n_chars is set anew where there is such a column; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siltstone.llm import langid, near_duplicates, packing, suffix_dedup
from siltstone.llm.queries import tokenizer_path
from siltstone.llm.tables import shared_dir


def rows(docs: DataFrame) -> DataFrame:
    """row (all columns as one, so that no name meets another), doc_id and text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")


def columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of `row`."""
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, F.lit(True))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = langid.predict(rows(docs), model).where("not rejected")
    return columns(known, docs)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        place = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.expr("9223372036854775808")).cast("string"), 20, "0")  # strings in the order of the ids
    else:
        place = F.concat(F.col("doc_id").cast("string"), F.lit("\0"))
    keyed = rows(docs).withColumn("uid", F.concat(place, F.hex(F.xxhash64("text"))))
    found = near_duplicates.near_duplicates(keyed.where("uid is not null"), "uid", k=5, num=80, den=100)
    kept = found.where("uid = component_id").select("uid").distinct()
    once = keyed.join(kept, "uid", "left_semi").dropDuplicates(["uid"])
    return columns(once.select("row").unionByName(keyed.where("uid is null").select("row")), docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language), ("duplicates", duplicates), ("repeats", repeats), ("packing", pack)]

#: SQL has no n-gram vectors, suffix order or packing: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
