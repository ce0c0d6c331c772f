"""The opN_ queries of this subpackage, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, fingerprint, licenses, near_dup, oracles, quality, secrets, sharding, toxicity, warc
from textloom.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"
SHARDS = 8


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents have no paths: source, language and hundreds of ids stand for directories
    path = licenses.tree_path(F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 100), F.col("doc_id"))
    return licenses.scan(table(spark, sf_dir, "documents"), path)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), spans=True)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_licenses, op3_decontaminate, op4_toxicity, op5_secrets, op6_sharding, op7_warc, op8_fingerprint, op9_quality, op10_near_dup)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
