"""Corpus pipeline: documents to piece ids, each stage written as Parquet and read again.

Order: documents whose language is not told are left out, one document of each
group of near duplicates stays, documents that hold benchmark items are left
out, secrets are masked, and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, langid, pieces, secret_scan, wide_simhash
from tessera.llm.common import new_folder

MODEL = public_tokenizers.path("piece_bpe_32k.model")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the language model, learned from the labelled rows, doesn't reject."""
    return langid.keep_identified(docs, langid.fit(docs, fold=None))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles of similarity 0.8 or more connect."""
    return wide_simhash.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage near a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their secrets masked."""
    return secret_scan.mask_secrets(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids of each row."""
    return pieces.encode(docs, MODEL)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]

# no stage can be said in SQL; tests/llm/test_pipeline.py holds them against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave of ``sf_dir``'s documents."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for nth, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{nth}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
