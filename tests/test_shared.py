"""Kept tables are deleted when they are let go; an index follows its collection's files."""

import os

from pyspark.sql import functions as F

from tarnwick.api import Engine
from tarnwick.plans import text_queries
from tarnwick.sources import shared


def test_forget(spark):
    shared.forget(spark)
    one, two = shared.stored(spark.range(3), "one"), shared.stored_buckets(spark.range(3), "two", "id")
    assert one.count() == two.count() == 3
    paths = list(shared._KEPT)
    assert shared.forget(spark) == 2 and not shared._KEPT
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)
    text_queries._INDEXES.clear()  # it read what was deleted
    text_queries._BLOCKS.clear()


def test_an_index_follows_its_files(spark, tmp_path):
    """The same path and file name with other contents is another index."""
    for words in ("alpha beta", "gamma delta"):
        folder = f"{tmp_path}/t"
        spark.createDataFrame([(1, words), (2, "common " + words)], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        got = {r["term"] for r in text_queries.term_stats(spark, folder).collect()}
        assert got == {*words.split(), "common"}


def test_engine_sees_changes_of_others(spark, tmp_path):
    path = f"{tmp_path}/c"
    engine, asked = Engine(spark), spark.createDataFrame([(1, "needle")], "qid int, text string")
    found = []
    for word in ("hay", "needle"):
        rows = [(k, f"some text number {k} with {word if k == 3 else 'straw'} in it") for k in range(8)]
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path)
        spark.read.parquet(path).createOrReplaceTempView("changing")
        found.append({r["doc_id"] for r in engine.query(asked, "changing").collect()})
    assert found == [set(), {3}]
    assert {(r["collection"], r["n_chunks"], r["status"]) for r in engine.stats(["changing", "nowhere"]).collect()} == {("changing", 8, "ok"), ("nowhere", 0, "not_ingested")}
