"""Facade: health, statistics, collections, ingest and query, as DataFrames over many queries at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import scoring
from tarnwick.functions.text import chunk_id_v1, clause_numbers, clean_text, validate_citations_v2
from tarnwick.operators import chunk, expand, feed, index, models, retrieval, vector
from tarnwick.sources import store
from tarnwick.sources.shared import fingerprint


@dataclass(frozen=True)
class Settings:
    """Defaults of retrieval and ingest; every field can be set from the environment by `from_env`."""

    vector_weight: float = 0.65
    bm25_weight: float = 0.35
    top_k: int = 30
    top_n: int = 8
    chunk_size: int = 1200
    chunk_overlap: int = 200
    ttl_days: int = 90
    max_terms: int = 40

    @classmethod
    def from_env(cls, env: dict[str, str]) -> Settings:
        import dataclasses

        kinds = {"int": int, "float": float}
        return cls(**{f.name: kinds[f.type](env[f.name.upper()]) for f in dataclasses.fields(cls) if f.name.upper() in env})


class Engine:
    """Retrieval over named collections of chunks (doc_id, text, embedding, and metadata columns).

    embed: a function from a text column to a vector column, of chunks and of queries alike.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None, embed=models.hashed_embedding):
        self.spark, self.settings, self.embed, self.indexes = spark, settings or Settings(), embed, {}

    def health(self) -> DataFrame:
        return self.spark.createDataFrame([("ok", self.spark.version)], "status string, spark string")

    def stats(self, expected: list[str]) -> DataFrame:
        """collection, n_chunks, status."""
        have = {t.name for t in self.spark.catalog.listTables()}
        absent = self.spark.createDataFrame([(n, 0, "not_ingested") for n in expected if n not in have], "collection string, n_chunks long, status string")
        counted = [self.spark.table(n).agg(F.count(F.lit(1)).alias("n_chunks")).select(F.lit(n).alias("collection"), "n_chunks", F.lit("ok").alias("status")) for n in expected if n in have]
        return reduce(DataFrame.unionByName, counted, absent)

    def ingest(self, docs: DataFrame, collection: str, reset: bool = False) -> int:
        """Clean, chunk by clauses and add what the collection lacks; returns how many chunks were added. docs: name, text."""
        s = self.settings
        cleaned = docs.select("name", clean_text(F.col("text")).alias("text"))
        made = cleaned.select("name", F.posexplode(chunk.clause_chunks(F.col("text"), F.col("name"), s.chunk_size, s.chunk_overlap)).alias("idx", "c"))
        new = made.select(chunk_id_v1(F.col("name"), F.col("idx")).alias("doc_id"), "name", "c.text", "c.section_number", "c.section_heading").withColumn("ingested_at", F.current_timestamp()).withColumn("ingested_epoch", scoring.epoch_seconds(F.current_timestamp()))
        if not reset and self.spark.catalog.tableExists(collection):
            new = new.join(self.spark.table(collection).select("doc_id"), "doc_id", "left_anti")
        new = new.withColumn("embedding", self.embed(F.col("text")))  # of what is new alone
        seen = Observation()
        store.save_collection(new.observe(seen, F.count(F.lit(1)).alias("n")), collection, reset)
        self.indexes.pop(collection, None)
        return seen.get["n"]

    def query(self, queries: DataFrame, collection: str, source: str = "3gpp", scorer=models.overlap_score) -> DataFrame:
        """(qid, rank, doc_id, text, score, confidence, stage) for each of `queries` (qid, text); blank queries are left out.

        Exact metadata hits, vector and BM25 hits of the expanded query, merge by the weights of the settings, rerank by
        `scorer` on the original query, floors, final cut. A collection without vectors has no vector hits. Queries may
        bring their vectors in a column `embedding`.
        """
        s, corpus = self.settings, self.spark.table(collection)
        asked = queries.filter(F.trim("text") != "").select("qid", F.col("text").alias("query"))
        expanded = asked.select("qid", expand.expand_v2(F.col("query"), s.max_terms).alias("text"))
        state = fingerprint(self.spark, corpus.inputFiles())  # a collection may be changed by others
        if self.indexes.get(collection, (None, None))[0] != state:
            self.indexes[collection] = (state, index.build(corpus))
        hits = index.search(self.indexes[collection][1], expanded, s.top_k, id_col="qid")
        side = lambda df, near, words, stage: df.select("qid", "doc_id", near.alias("vector_score"), words.alias("bm25_score"), F.lit(stage).alias("stage"))
        zero, text = F.lit(0.0), corpus.select("doc_id", "text")
        words = side(hits, zero, F.col("bm25"), 1)
        near = words.limit(0)
        if "embedding" in corpus.columns:
            own = queries.filter(F.trim("text") != "").select("qid", "embedding") if "embedding" in queries.columns else expanded.select("qid", self.embed(F.col("text")).alias("embedding"))
            near = side(vector.knn(corpus.select("doc_id", "embedding"), own, s.top_k, "doc_id"), F.col("score"), zero, 1)
        fields = [f for f in ("parameter_name", "mo_class", "mo_path", "section_number") if f in corpus.columns]
        exact = hits.select("qid", "doc_id").limit(0)
        if fields:
            exact = retrieval.exact_hits(corpus, retrieval.entity_targets(asked.withColumnRenamed("query", "text")), fields).select("qid", "doc_id").distinct()
        heads = text.select("doc_id", F.left("text", F.lit(100)).alias("text"))
        merged = retrieval.merge(side(exact, zero, F.lit(1.0), 0), near, words, heads=heads, vector_weight=s.vector_weight, bm25_weight=s.bm25_weight)
        merged = retrieval.best(merged.drop("text"), s.top_k).join(text, "doc_id").join(asked, "qid")
        ranked = retrieval.rerank(merged, scorer, s.top_k).withColumn("score", F.col("rerank_score"))
        kept = retrieval.final(retrieval.discard_v2(ranked, scoring.floor_of(F.lit(source))), s.top_n)
        return kept.select("qid", "rank", "doc_id", "text", "score", scoring.row_confidence(F.col("score")).alias("confidence"), "stage")

    def answer_parts(self, found: DataFrame, queries: DataFrame, source: str = "3gpp", generation: int = 2) -> DataFrame:
        """(qid, prompt, confidence, n_evidence) from the rows of query(): what a generator and the reader of its answer need."""
        asked = queries.select("qid", F.col("text").alias("query"))
        cited = found.withColumn("citation", F.concat(F.lit("chunk "), F.col("doc_id").cast("string")))
        panel = retrieval.panel_confidence(found).join(found.groupBy("qid").agg(F.count("*").alias("n_evidence")), "qid")
        made = retrieval.evidence_block(cited).join(asked, "qid").join(panel, "qid")
        return made.select("qid", models.prompt(F.lit(source), F.col("query"), F.col("evidence"), generation).alias("prompt"), "confidence", "n_evidence")

    def checked(self, answers: DataFrame, evidence: DataFrame) -> DataFrame:
        """(qid, answer): answers (qid, answer) less the references that the evidence (qid, evidence) does not hold."""
        both = answers.join(evidence, "qid")
        return both.select("qid", validate_citations_v2(F.col("answer"), clause_numbers(F.col("evidence"))).alias("answer"))

    def query_sources(self, queries: DataFrame, collections: dict[str, str], **options) -> DataFrame:
        """query() over several collections, by source: the same columns and `source`, ranked within each."""
        return reduce(DataFrame.unionByName, (self.query(queries, name, source, **options).withColumn("source", F.lit(source)) for source, name in collections.items()))

    def purge_seen(self, seen: DataFrame, now=None, at: str = "inserted_at") -> tuple[DataFrame, DataFrame]:
        """(what stays, what goes) of a seen-set: rows go after the settings' days."""
        cutoff = (F.current_timestamp() if now is None else now) - F.make_dt_interval(days=F.lit(self.settings.ttl_days))
        return feed.purge(seen, cutoff, at)
