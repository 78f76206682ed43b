"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, with the
columns it got; the last returns the packed token pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetcheck.llm import decontamination, packing, quality, secrets, simhash
from packetcheck.llm.common import table
from packetcheck.session import BATCH_BYTES, remove_dir, scratch, shared_dir, tuned


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (0.8 of the distinct five-word shingles in common)
    one row, that with the smallest doc_id."""
    tuned(spark, BATCH_BYTES)
    return simhash.keep_first(docs, simhash.near_copies(docs, shingle=5, similarity=0.8))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with values replaced in their texts unless they are widely copied examples."""
    tuned(spark, BATCH_BYTES)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048 tokens."""
    tuned(spark, BATCH_BYTES)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack_tokens),
]

#: Trained models and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        # what a stage stores on the way, and what the stage before left, end with it
        with scratch(spark):
            left = stage(spark, docs, sf_dir)
            left.write.parquet(path)
        if before:
            remove_dir(spark, before)
        docs, before = spark.read.schema(left.schema).parquet(path), path
    return docs
