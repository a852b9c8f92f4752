"""What the hybrid queries shuffle, spill and write as the documents grow: a few rows a document, however many ask."""

import pytest
from pyspark.sql import functions as F

from tarnwick.plans import QUERIES, text_queries

#: Queries that share words with every document, and documents of the smaller folder.
ASKED, DOCS = 60, 1500


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Two folders, the second with twice the documents; nothing else differs."""
    made = []
    for n in (DOCS, 2 * DOCS):
        d = tmp_path_factory.mktemp("grown")
        i = F.col("id")
        docs = spark.range(n).repartition(2).select(i.alias("doc_id"), F.concat(F.lit("number n"), i, F.lit(" common w"), i % 7, F.lit(" w"), i % 11).alias("text"), F.concat(F.lit("src"), i % 20).alias("source"))
        docs.write.parquet(f"{d}/documents.parquet")
        spark.range(ASKED).select(i.alias("item_id"), F.concat(F.lit("common w"), i % 7).alias("text")).write.parquet(f"{d}/benchmark.parquet")
        spark.range(100).select(i.alias("vec_id"), F.array(F.sin(i).cast("float"), F.cos(i).cast("float")).alias("embedding")).write.parquet(f"{d}/embeddings.parquet")
        made.append(str(d))
    return made


def moved(spark, run):
    """Rows that `run` shuffles and writes, and bytes that it spills."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return [found.apply(j) for j in range(found.size())]

    before = max((s.stageId() for s in stages()), default=-1)
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = [s for s in stages() if s.stageId() > before]
    return sum(s.shuffleWriteRecords() + s.outputRecords() for s in new), sum(s.diskBytesSpilled() for s in new)


@pytest.mark.parametrize("name", ["hybrid_topk", "final_topn", "score_floor", "dynamic_floor_v2"])
def test_rows_moved_grow_with_documents_alone(spark, grown, monkeypatch, name):
    """Of a further document there are its row in the index and its own terms, not a row for each query that shares a word with it."""
    monkeypatch.setattr(text_queries, "_INDEXES", {})  # the index is part of the job
    (few, spilled), (many, more) = (moved(spark, lambda: QUERIES[name](spark, d).collect()) for d in grown)
    assert spilled == more == 0
    assert many - few < 10 * DOCS
