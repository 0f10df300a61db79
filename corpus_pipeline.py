"""A training-data pipeline of five operators; each stage is written as Parquet and read again by the next.

quality      drops documents that the rule ensemble scores below 0.7
near_dups    keeps one document of each group with similar sets of five-word shingles (0.8 or more)
leaks        drops documents that contain a benchmark item, also with other names and numbers
pii          replaces personal data in the texts
pieces       samples SentencePiece segmentations: doc_id, n_tokens, ids, lossless
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import op1_templates, op4_quality, op5_pii, op7_pieces, op8_minhash
from sluice.llm.queries import _vocabulary
from sluice.llm.shared import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), limit=0.7)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_minhash.keep_one(docs, width=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_pii.redact(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_pieces.encode(docs, _vocabulary("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_dups", near_dups), ("leaks", leaks), ("pii", pii), ("pieces", piece_ids)]
#: The quality stage fits a model, so no SQL gives these rows; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        if hasattr(before, "scratch_path"):
            scratch.drop(before)
    return docs
