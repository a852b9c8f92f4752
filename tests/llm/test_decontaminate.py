"""What the aggregation of hits holds: a few values a hit, never the words of its document."""

from tarnwick.llm import decontaminate


def spilled(spark, run):
    """Bytes of memory that `run` had to spill, and what it returns."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return [found.apply(j) for j in range(found.size())]

    before = max((s.stageId() for s in stages()), default=-1)
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.memoryBytesSpilled() for s in stages() if s.stageId() > before), out


def test_words_are_not_held_with_the_hits(spark):
    """Beyond 128 documents a task sorts its hits; with 2000 words in each of 400,000 hits that was more than the session's memory."""
    passage = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(k, f"{passage} " * 40) for k in range(200)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    held, found = spilled(spark, lambda: decontaminate.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect())
    assert sorted(map(tuple, found)) == [(k, 2000, 2000, 1, True) for k in range(200)]
    assert held == 0
