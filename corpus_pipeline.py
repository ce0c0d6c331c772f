"""The document pipeline: each stage works on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and
read again, so a stage's work is done once and survives lost executors.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, near_dup, quality, secrets
from textloom.llm.common import shared_dir, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Stages on word shingles take five words and a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of those that are not held out."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return near_dup.keep_one(docs, SHINGLE, PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets hidden."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, lang, source, n_tokens) of every document."""
    ids = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, keep=("lang", "source"))
    return ids.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scan", hide_secrets),
    ("byte-level BPE", tokenize),
]

#: Learned models, sketches and merges of byte pairs are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for at, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
    return docs
