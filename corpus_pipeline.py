"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sidera.llm import language_id, mixing, prob_minhash, secret_ledger, sentencepiece_codec
from sidera.llm.common import remove, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told are dropped."""
    return language_id.stage(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return prob_minhash.stage(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the stored ledger lacks are scanned, and secrets found are replaced in the text; all documents stay."""
    return secret_ledger.stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are drawn at target weights, each source's size to the power mixing.TEMPERATURE, so that a hot source weighs less than its size."""
    return mixing.stage(docs, weights=mixing.tempered())


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, checked by decoding them, beside the columns lang and source where there are such."""
    return sentencepiece_codec.encode(docs, keep=tuple(c for c in ("lang", "source") if c in docs.columns))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses neither the fitted classifier nor the hashed signatures nor the draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir.

    Stages are written to a folder of this run's own in the shared one; a stage's files go when the next one's are
    written. Those of the last stage are what is returned, so they stay for their reader.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        at = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs
