"""Corpus pipeline: five stages over ``documents``, each written as Parquet and
read again as the next one's input.

language       documents whose language the CRF cannot tell go
near_copies    of documents whose SimHash fingerprints link, the least doc_id stays
decontaminate  documents that hold a copy of a benchmark item go
mixing         a document stays as often as the weighted fair queue takes it
tokens         token ids in fixed-width blocks; one row per document of the mix

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.llm import decontaminate, language_crf, mixing, simhash, token_pack
from riskfold.session import checkpoint_dir, ship_package

# SQL can express neither the language model nor the tokenizer
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return language_crf.keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mix takes; the row itself travels as a
    struct, so its columns cannot clash with those of the mix."""
    ship_package(spark)
    lean = docs.select("doc_id", "source", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("__row"))
    taken = mixing.mix(lean).where("copies > 0")
    # array_repeat's copies are numbers: the text is not copied before the explode
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        *(F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    # the workers still hold memory of the stages before: half the usual cache
    return token_pack.tokenize(docs, *token_pack.default_tokenizer(), cache_entries=token_pack.CACHE_ENTRIES // 2)


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminated),
          ("mixing", mixed), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
