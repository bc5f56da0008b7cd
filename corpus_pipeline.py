"""A training-text pipeline over ``documents``: each stage reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespool.llm import contextpii, crossparse, curvepack, latentleaks, simhash
from tracespool.llm.catalog import EOS, tokenizer_path
from tracespool.plans.layout import settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that the labelled documents teach, go."""
    return crossparse.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase with its answer, go."""
    return latentleaks.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; no document goes."""
    return contextpii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with the token ids (little-endian, 4 bytes each) and their CRC-32."""
    pieces = curvepack.pack(docs, tokenizer_path(), EOS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("language_id", language), ("simhash_dedup", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packing)]
ORACLE_SQL = None  # fingerprints, models and tokens cannot be said in SQL; tests/llm/test_pipeline.py has the plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs)
    return docs
