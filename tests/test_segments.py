"""Segments against full rebuilds: ten batches with replacements, deletes and merges; readers of older versions."""

import random

from tarnwick.operators import index
from tarnwick.operators.segments import SegmentedIndex


def rows(made, queries):
    found = sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in index.search(made, queries, 5).collect())
    t = made.totals.first()
    return found, (t["n_docs"], t["n_tokens"]), sorted(map(tuple, made.terms.select("term", "df").collect()))


def test_ten_batches(spark, tmp_path):
    pick = random.Random(8)
    text = lambda: " ".join(pick.choices(["alpha", "beta", "gamma", "delta", "rare1", "rare2"], [9, 6, 4, 3, 1, 1], k=pick.randrange(0, 12)))
    queries = spark.createDataFrame([(1, "alpha rare1"), (2, "beta gamma delta"), (3, "rare2")], "item_id int, text string")
    kept, made, merges, old = {}, SegmentedIndex(spark, f"file://{tmp_path}/i", fan=3), 0, None
    for k in range(10):
        batch = {pick.randrange(60): text() for _ in range(8)}
        kept |= batch
        made.add(spark.createDataFrame(list(batch.items()), "doc_id long, text string"))
        if k % 3 == 1:
            gone = pick.sample(sorted(kept), 3)
            made.delete(spark.createDataFrame([(g,) for g in [*gone, 999]], "id long"))
            kept = {d: t for d, t in kept.items() if d not in gone}
        if k == 4:
            old = (made.table.version().number, dict(kept))
        merges += made.merge() is not None
    docs = lambda some: index.build(spark.createDataFrame(list(some.items()), "doc_id long, text string"))
    assert rows(made.index(), queries) == rows(docs(kept), queries)
    assert rows(made.index(old[0]), queries) == rows(docs(old[1]), queries)
    assert merges >= 3 and len([s for s in made._segments(made.table.version()) if not s["deletes"]]) <= 5


def test_added_during_a_merge(spark, tmp_path):
    """A document that is deleted or replaced while its segment is merged stays so."""
    df = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    made = SegmentedIndex(spark, f"file://{tmp_path}/i", fan=2)
    made.add(df((1, "one aa"), (2, "two")))
    made.add(df((3, "three"), (4, None)))
    write = made.table.write_part

    def slow(rows):
        made.table.write_part = write
        part = write(rows)
        made.delete(spark.createDataFrame([(3,)], "id long"))
        made.add(df((1, "uno")))
        return part

    made.table.write_part = slow
    made.merge()
    got = {r["doc_id"]: r["dl"] for r in made.index().lengths.collect()}
    assert got == {1: 1, 2: 1, 4: 0}


def test_empty(spark, tmp_path):
    made = SegmentedIndex(spark, f"file://{tmp_path}/i")
    assert made.merge() is None and made.index().totals.first()["n_docs"] == 0
    made.add(spark.createDataFrame([], "doc_id long, text string"))
    assert made.index().postings.count() == 0
