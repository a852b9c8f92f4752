"""Findings of the third round: rows that the tables of the tests do not have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import index, retrieval
from tarnwick.plans import ORACLES, QUERIES

#: Lines that look like headings, a page of one short section, and more pages than an extractor takes by default.
TEXTS = [
    "4355709550244650 Mentoi ment de ouier\nsecond line of it\nthird line of it",
    "41.244.73.125 Another line that looks like a heading\n12\n13\n14\n15",
    "Annex B (normative): An annex of its own\nrest\nrest again\nand again",
    "7 A line that looks like a heading\n" + "and more of it " * 14,
    "x" * 61,
    "\n".join(["a page"] * 700),
]


@pytest.fixture()
def odd(spark, tmp_path):
    spark.createDataFrame([(4 * k, t, "en", "src1") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    urls = ["http://a.b/1", "http://a.b/c", "http://a.b/c", "http://a.b/3", "http://a.b/c"]
    spark.createDataFrame([(k, u) for k, u in zip((3, 2, 4, 6, 8), urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["clause_boundaries", "clause_chunks", "clause_chunks_v1", "narrative_sections", "extract_chain", "seen_upsert_ignore"])
def test_odd_rows(spark, odd, same, name):
    d, con = odd
    same(QUERIES[name](spark, d), con.execute(ORACLES[name]).fetch_df())


def test_exact_hits_joins_few(spark):
    """Of a value that many ids have, `limit` ids are joined with those who ask for it."""
    corpus = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("v").alias("source"))
    targets = spark.range(300).select(F.col("id").alias("qid"), F.lit("source").alias("field"), F.lit("v").alias("value"))
    found = retrieval.exact_hits(corpus, targets, ["source"])
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # nothing is cut after the join
    got = found.groupBy("doc_id").count().orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(k, 300) for k in range(5)]


def test_evidence_rounds_doubles(spark):
    scores = [1.005, 1.015, 2.675, -1.005, 0.125, 4.0]
    rows = spark.createDataFrame([(k, 1, "d", "t", s) for k, s in enumerate(scores)], "qid int, rank int, citation string, text string, score double")
    got = {r["qid"]: r["evidence"].split("score=")[1].split(")")[0] for r in retrieval.evidence_block(rows).collect()}
    want = duckdb.sql("SELECT " + ", ".join(f"printf('%.2f', round(CAST({s} AS DOUBLE), 2))" for s in scores)).fetchall()[0]
    assert tuple(got[k] for k in range(len(scores))) == want


def test_terms_counted_once(spark):
    """A search reads the terms twice; that counts no postings again."""
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta"), (3, None)], "doc_id long, text string")
    made = index.build(docs)
    plan = index.with_idf(made)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "vectors" not in plan
    assert sorted((r["term"], r["df"]) for r in made.terms.collect()) == [("alpha", 1), ("beta", 2)]
