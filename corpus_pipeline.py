"""From raw documents to token ids: quality rules, near duplicates, benchmark leaks, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
documents. All stages but the last return the columns they were given; where a stage changes a text, ``n_chars`` follows.

Weighted samples, an FM-index, recursive decoding and BPE merges can't, so
``ORACLE_SQL`` is None and the tests hold every stage against a plain version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intake_spark.llm import bpe, decontaminate, near_dup, quality_rules, secrets
from intake_spark.llm.tables import small_batches, table
from intake_spark.session import shared_dir


def _measured(new: DataFrame) -> DataFrame:
    if "n_chars" not in new.columns:
        return new
    return new.withColumn("n_chars", F.char_length("text").cast(new.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id."""
    small_batches(spark)
    return near_dup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    small_batches(spark)
    return _measured(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also encoded ones, give way to a mark."""
    small_batches(spark)
    return _measured(secrets.hide(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text that they decode to, with the id of the document."""
    small_batches(spark)
    coded = bpe.coded(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark leaks", benchmark_leaks),
          ("secrets", hide_secrets), ("token ids", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
