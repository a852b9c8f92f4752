"""Training-corpus pipeline: each stage is one operator over all that the stage before kept.

Stages take (spark, docs, sf_dir). All but the last return the columns of `docs`; the last returns the pieces of packed
sequences. Empty tables pass through; what a stage does with nulls and repeated rows is said in its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm import decontaminate, neighbours, packing, repetition, weighted_minhash
from tarnwick.llm.common import materialize, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or repeat too much go; null and empty texts do. Repeated rows are judged alike."""
    return repetition.passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be of quality 1 go; the labels of the tables' folder are learned from."""
    return neighbours.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; of rows with one id, one; rows without id all stay."""
    return weighted_minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages to the contract's share go, by their texts, whatever their ids."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]
#: SQL can't express the tokenizer, the sampling or the vectors; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of the documents that all stages keep. Each stage is written once and read by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        made = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        docs = before = made
    return STAGES[-1][1](spark, docs, sf_dir)
