"""Corpus pipeline: civil, distinct, uncontaminated, redacted documents as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, neardup, secrets, toxicity
from tessera.llm.kit import Scratch

STAGES = [
    ("toxicity", toxicity.keep_civil),
    ("minhash_near_dedup", neardup.keep_one),
    ("decontaminate", decontaminate.drop_leaks),
    ("secret_scan", secrets.redact),
    ("bpe_encode", bpe.encode_corpus),
]
#: Hashing, a fitted model and tokenizers have no SQL; tests/llm/test_pipeline.py checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and reread."""
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tmp.park(stage(spark, docs, sf_dir), name)
    return docs
