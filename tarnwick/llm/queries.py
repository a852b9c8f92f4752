"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm import decontaminate, deleted_interpolation, html_text, neighbours, oracles, packing, prefix_forest, repetition, simple8b, toxicity, treaps, turn_repair, url_rules, weighted_minhash
from tarnwick.llm.common import table


def op1_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents`: each row's class of near copies, by its smallest id."""
    return weighted_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents`: base figures of every whole text, and whether the rules keep it."""
    return repetition.repetition_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "rules.*").drop("longest_repeat", "covered_fraction")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages`: host, path, rule and verdict of every url."""
    return url_rules.judge_urls(table(spark, sf_dir, "pages")).drop("n_candidates", "pattern")


def op4_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages`: the main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` against `benchmark`: words that stand in passages of items, and whether they are too many."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop("item_ids", "spans")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents`: toxicity of every text, learned from `labels` outside the held-out quarter."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, labels).drop("passages")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents`: quality of every text, learned from `labels` outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return neighbours.score_quality(docs.select("doc_id", "text"), labels).select("doc_id", "vote.*")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents`: the pieces of all texts in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents`: log10 probability of every text, learned outside the held-out seventh."""
    return deleted_interpolation.score(table(spark, sf_dir, "documents"))


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents`: what the written segments hold of every text, read back."""
    return simple8b.tokenize_to_segments(table(spark, sf_dir, "documents"))


def op11_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest `embeddings` of each whose id is divisible by 50, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return prefix_forest.search(prefix_forest.build(vectors), vectors.filter("vec_id % 50 = 0"))


def op12_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best `documents` of each `benchmark` item, from treaps of all terms of all documents."""
    return treaps.search(treaps.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_turn_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations`, damaged by the contract's rule and repaired at least cost: one row a conversation."""
    return turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")), dropped_col="dropped")


QUERIES = {f.__name__: f for f in (op1_weighted_minhash, op2_repetition, op3_url_rules, op4_host_suffix_array, op5_decontaminate, op6_toxicity, op7_neighbours, op8_packing, op9_deleted_interpolation, op10_simple8b, op11_prefix_forest, op12_inverted_treaps, op13_turn_matrices)}
ORACLES = oracles.ORACLES
