"""A training corpus in five stages, each the full output of an operator over its predecessor's rows.

Language ID drops documents of no or of ambiguous language; of each group of near copies one document
stays; documents that hold a test item go; sources are mixed to their target words, in whole copies;
what is left is dealt into shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginmill.llm import decontaminate, jaccard, langid, mixing, sharding, shared

SHARDS = 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one language: texts without letters, and those that decode to two languages about as well, go.

    A document without lang gets the language that was found. The model learns from labelled documents
    alone, and not from those held out.
    """
    shared.bound_batches(spark)
    model = langid.train(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    found = langid.identify(docs, model).where("lang_pred <> 'und' and not ambiguous")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares shingles of five words with similarity 0.8 or more."""
    shared.bound_batches(spark)
    return jaccard.one_of_each(docs, k=5, num=80)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item."""
    shared.bound_batches(spark)
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target words; a document comes as often as the mix takes it."""
    shared.bound_batches(spark)
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row, with what identifies it; rows of one document are interchangeable."""
    shared.bound_batches(spark)
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", "n_chars", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    return sharding.shard_rows(rows, SHARDS)


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("benchmark_copies", benchmark_copies), ("mix", mix), ("shard", shard)]

#: Language ID, alignment and the draws of the shuffle aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    folder = shared.work_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = shared.written(stage(spark, docs, sf_dir), folder, f"{k}-{name}")
        if k:
            shared.drop(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
