"""The queries of this subpackage, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidera.llm import language_id, lattice_hash, local_descriptors, mil_quality, mixing, prob_minhash, secret_ledger, sentencepiece_codec, substring_dedup, url_filter
from sidera.llm.common import durable, remove, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector: pairs grow with the square of a group."""
    return lattice_hash.groups(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with one stored ledger: half of the versions, then all, of which only what is unseen is scanned."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    secret_ledger.scan_stored(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), folder)
    rows = durable(secret_ledger.scan_stored(docs, folder))
    remove(spark, folder)
    return rows


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs), keep=("lang",)).withColumn("kept", ~F.col("rejected"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has pictures: each embedding is drawn as one. One row a picture: pairs grow with the square of a group."""
    return local_descriptors.groups(local_descriptors.pictures(table(spark, sf_dir, "embeddings")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.decide(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(table(spark, sf_dir, "documents"), mixing.tempered())


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.groups(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mil_quality.classify(docs, mil_quality.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_embedding_near_dedup, op3_substring_dedup, op4_secret_scans, op5_language_id, op6_media_columns, op7_url_filters, op8_mixing, op9_minhash_near_dedup, op10_quality_classifier)}
ORACLES: dict[str, str] = {"op2_embedding_near_dedup": lattice_hash.oracle(), "op4_secret_scans": secret_ledger.oracle(), "op7_url_filters": url_filter.oracle()}
