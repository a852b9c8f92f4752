"""Queries over candidates: exact, vector and BM25 hits of every benchmark item, merged, filtered, ranked and formatted."""

from pyspark.sql import functions as F

from tarnwick.functions import scoring
from tarnwick.operators import ivf, models, retrieval, vector
from tarnwick.plans.registry import query, quoted, table
from tarnwick.plans.text_queries import _ASKED_SQL, _FOUND_SQL, _NAMES_SQL, _PARTS, BM25_SQL, _named, search, tokens_sql
from tarnwick.functions import vocab as V
from tarnwick.sources.shared import stored

# -- candidates: item i asks for source 'src(i % 20)' exactly, and its vector is that of vec_id i -----------------

_KNN_SQL = "round(greatest(0, list_inner_product(q.e, v.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e))), 6)"
CANDIDATES_SQL = f"""{BM25_SQL},
targets AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS value FROM benchmark),
exact AS (SELECT qid, doc_id FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS n FROM targets JOIN documents ON source = value) WHERE n <= 5),
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT * FROM (SELECT qid, vec_id AS doc_id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS n
  FROM (SELECT b.item_id AS qid, v.vec_id, {_KNN_SQL} AS s FROM benchmark b JOIN vecs q ON b.item_id = q.vec_id, vecs v)) WHERE n <= 30),
cand AS (SELECT qid, doc_id, text, CAST(0 AS DOUBLE) AS vector_score, CAST(1 AS DOUBLE) AS bm25_score, 0 AS stage, 0 AS p FROM exact JOIN documents USING (doc_id)
  UNION ALL SELECT qid, doc_id, text, s, 0, 1, 1 FROM near JOIN documents USING (doc_id)
  UNION ALL SELECT qid, doc_id, text, 0, bm25, 1, 2 FROM hits JOIN documents USING (doc_id)),
merged AS (SELECT qid, arg_min(doc_id, p * 1000000000 + doc_id) AS doc_id, arg_min(stage, p * 1000000000 + doc_id) AS stage, arg_min(text, p * 1000000000 + doc_id) AS text,
  max(vector_score) AS vector_score, max(bm25_score) AS bm25_score FROM cand GROUP BY qid, left(text, 100)),
hybrid AS (SELECT *, round(CASE WHEN stage = 0 THEN greatest(0.65 * vector_score + 0.35 * bm25_score, 0.95) ELSE 0.65 * vector_score + 0.35 * bm25_score END, 8) AS hybrid_score FROM merged),
ranked AS (SELECT *, round(hybrid_score * 10 - 4, 7) AS score FROM hybrid)"""


def _exact_and_near(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    targets = items.select(F.col("item_id").alias("qid"), F.lit("source").alias("field"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("value"))
    vecs = table(spark, d, "embeddings")
    asked = items.select(F.col("item_id").alias("qid")).join(vecs, F.col("qid") == F.col("vec_id")).select("qid", "embedding")
    row = lambda df, v, b, s: df.select("qid", "doc_id", v.alias("vector_score"), b.alias("bm25_score"), F.lit(s).alias("stage"))
    zero, one = F.lit(0.0), F.lit(1.0)
    exact = row(retrieval.exact_hits(docs, targets, ["source"]), zero, one, 0)
    near = row(vector.knn(vecs, asked).withColumnRenamed("vec_id", "doc_id"), F.col("score"), zero, 1)
    return exact, near


def _parts(spark, d):
    words = search(spark, d).select("qid", "doc_id", F.lit(0.0).alias("vector_score"), F.col("bm25").alias("bm25_score"), F.lit(1).alias("stage"))
    return *_exact_and_near(spark, d), words


def _heads(spark, d):
    return table(spark, d, "documents").select("doc_id", F.left("text", F.lit(100)).alias("text"))


def _whole(spark, d, found):
    """Whole texts for what is left of the candidates."""
    return found.drop("text").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def candidates(spark, d):
    """Merged candidates, with a score that stands for a reranker's logit: 10 x hybrid - 4. Their texts are heads."""
    return retrieval.merge(*_parts(spark, d), heads=_heads(spark, d)).withColumn("score", F.round(F.col("hybrid_score") * 10 - 4, 7))


_VECTOR_SQL = (
    f"""WITH vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT qid, vec_id, score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS n
 FROM (SELECT q.vec_id AS qid, v.vec_id, {_KNN_SQL} AS score FROM vecs q, vecs v WHERE q.vec_id % 50 = 0)) WHERE n <= 30"""
)


@query(_VECTOR_SQL)
def vector_topk(spark, d):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    vecs = table(spark, d, "embeddings")
    return vector.knn(vecs, vecs.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"))


@query(_VECTOR_SQL)
def vector_ivf(spark, d):
    """The answer of vector_topk through the inverted file, all lists probed."""
    v = table(spark, d, "embeddings")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return ivf.search(ivf.build(v), asked)


@query(f"WITH {CANDIDATES_SQL} SELECT qid, doc_id, vector_score, bm25_score, stage FROM merged")
def hybrid_merge(spark, d):
    return retrieval.merge(*_parts(spark, d), heads=_heads(spark, d)).select("qid", "doc_id", "vector_score", "bm25_score", "stage")


@query(f"WITH {CANDIDATES_SQL} SELECT qid, doc_id, hybrid_score FROM hybrid")
def hybrid_score(spark, d):
    return candidates(spark, d).select("qid", "doc_id", "hybrid_score")


@query(f"WITH {CANDIDATES_SQL} SELECT qid, doc_id, hybrid_score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, doc_id) AS n FROM hybrid) WHERE n <= 30")
def hybrid_topk(spark, d):
    from tarnwick.operators.index import top

    return top(candidates(spark, d), 30, by="hybrid_score").select("qid", "doc_id", "hybrid_score", "rank")


_OVERLAP_SQL = f"""{CANDIDATES_SQL}, few AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, doc_id) AS o FROM hybrid) WHERE o <= 30),
pair AS (SELECT qid, doc_id, stage, hybrid_score, n, list_distinct({tokens_sql('b.text')}) AS own, list_distinct({tokens_sql('left(d.text, 512)')}) AS other FROM few JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = qid),
again AS (SELECT qid, doc_id, stage, CASE WHEN n > 1 THEN CAST(round(10 * len(list_intersect(own, other)) / greatest(len(own), 1) - 5, 6) AS DOUBLE) ELSE hybrid_score END AS rerank_score FROM pair)"""


@query(f"WITH {_OVERLAP_SQL} SELECT * FROM (SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN stage = 0 THEN 0 ELSE 1 END, rerank_score DESC, doc_id) AS INTEGER) AS rank, rerank_score FROM again) WHERE rank <= 8")
def rerank_topn(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    scored = retrieval.rerank(_whole(spark, d, retrieval.best(candidates(spark, d))).join(queries, "qid"), models.overlap_score)
    return retrieval.final(scored, 8, "rerank_score").select("qid", "doc_id", "rank", "rerank_score")


@query(f"WITH {CANDIDATES_SQL} SELECT qid, doc_id, source_label, score FROM (SELECT *, CASE qid % 3 WHEN 0 THEN '3gpp' WHEN 1 THEN 'hedex' ELSE 'other' END AS source_label FROM ranked) WHERE score >= CASE source_label WHEN '3gpp' THEN -3.0 WHEN 'hedex' THEN -2.0 ELSE -2.5 END")
def score_floor(spark, d):
    c = candidates(spark, d).withColumn("source_label", _label())
    return c.filter(F.col("score") >= scoring.floor_of(F.col("source_label"))).select("qid", "doc_id", "source_label", "score")


def _label():
    return F.when(F.col("qid") % 3 == 0, "3gpp").when(F.col("qid") % 3 == 1, "hedex").otherwise("other")


_LABEL_SQL = "CASE qid % 3 WHEN 0 THEN '3gpp' WHEN 1 THEN 'hedex' ELSE 'other' END"
_FLOOR_SQL = "CASE qid % 3 WHEN 0 THEN -3.0 WHEN 1 THEN -2.0 ELSE -2.5 END"


@query(
    f"""WITH {CANDIDATES_SQL}, cold AS (SELECT qid, list(score ORDER BY score) FILTER (stage <> 0) AS s FROM ranked GROUP BY qid)
SELECT qid, doc_id, CAST(greatest({_FLOOR_SQL}, coalesce(s[greatest(0, CAST(floor(len(s) * 30 / 100) AS INTEGER) - 1) + 1], {_FLOOR_SQL})) AS DOUBLE) AS floor FROM ranked JOIN cold USING (qid)"""
)
def dynamic_floor_v1(spark, d):
    c = candidates(spark, d).withColumn("exact", F.col("stage") == 0)
    return retrieval.floor_v1(c, _label()).select("qid", "doc_id", "floor")


_KEPT_SQL = f"""floored AS (SELECT * FROM ranked WHERE stage = 0 OR score >= {_FLOOR_SQL}),
cuts AS (SELECT qid, count(*) FILTER (stage <> 0) AS n, quantile_cont(score, 0.3) FILTER (stage <> 0) AS p30 FROM floored GROUP BY qid),
kept AS (SELECT floored.* FROM floored JOIN cuts USING (qid) WHERE stage = 0 OR n <= 4 OR score >= p30),
final AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN stage = 0 THEN 0 ELSE 1 END, score DESC, doc_id) AS INTEGER) AS rank FROM kept) WHERE rank <= 8)"""


def _final(spark, d):
    return retrieval.final(retrieval.discard_v2(candidates(spark, d), scoring.floor_of(_label())))


@query(f"WITH {CANDIDATES_SQL}, {_KEPT_SQL} SELECT qid, doc_id, score FROM kept")
def dynamic_floor_v2(spark, d):
    return retrieval.discard_v2(candidates(spark, d), scoring.floor_of(_label())).select("qid", "doc_id", "score")


@query(f"WITH {CANDIDATES_SQL}, {_KEPT_SQL} SELECT qid, doc_id, stage, rank, score FROM final")
def final_topn(spark, d):
    return _final(spark, d).select("qid", "doc_id", "stage", "rank", "score")


@query(
    f"""WITH {CANDIDATES_SQL}, {_KEPT_SQL}
SELECT qid, doc_id, rank, CASE WHEN qid % 3 = 0 THEN 'TS 38.' || (300 + doc_id % 90) || ' §' || source || ' — ' || left(lang || ' ' || source, 50) ELSE 'HedEx | ' || source || ' | ' || lang END AS citation,
 CAST(least(100, greatest(0, trunc((score + 5) / 10 * 100))) AS INTEGER) AS confidence FROM final JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id)"""
)
def format_result(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    f = _final(spark, d).join(docs, "doc_id")
    meta = {
        "spec_id": F.concat(F.lit("TS 38."), (F.col("doc_id") % 90 + 300).cast("string")),
        "section_number": F.col("source"),
        "section_heading": F.concat_ws(" ", "lang", "source"),
        "source": F.col("source"),
        "parameter_name": F.col("lang"),
        "mo_path": F.lit(""),
    }
    return f.select("qid", "doc_id", "rank", retrieval.citation(_label(), meta).alias("citation"), scoring.row_confidence(F.col("score")).alias("confidence"))


@query(f"WITH {CANDIDATES_SQL}, {_KEPT_SQL}, per AS (SELECT qid, least(100.0, greatest(0.0, (avg(score) FILTER (rank <= 3) + 5) / 10 * 100)) AS base, min(stage) AS s FROM final GROUP BY qid) SELECT qid, CAST(round(CASE WHEN s = 0 THEN greatest(base, 75.0) ELSE base END, 6) AS DOUBLE) AS confidence FROM per")
def panel_confidence(spark, d):
    return retrieval.panel_confidence(_final(spark, d))


@query(f"WITH {CANDIDATES_SQL}, {_KEPT_SQL} SELECT qid, string_agg('[E' || rank || '] doc ' || doc_id || ' (score=' || printf('%.2f', round(score, 2)) || ')' || chr(10) || left(text, 800), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS evidence FROM final GROUP BY qid")
def evidence_block(spark, d):
    return _evidence(spark, d)


def _evidence(spark, d):
    return retrieval.evidence_block(_whole(spark, d, _final(spark, d)).withColumn("citation", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))))


_EVIDENCE_SQL = "string_agg('[E' || rank || '] doc ' || doc_id || ' (score=' || printf('%.2f', round(score, 2)) || ')' || chr(10) || left(d.text, 800), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)"
_PROMPT_SQL = " ".join(f"WHEN '{name}' THEN {quoted([text])}" for (name, of), text in models.PROMPTS.items() if of == 2)


@query(
    f"""WITH {CANDIDATES_SQL}, {_KEPT_SQL}, ev AS (SELECT qid, {_EVIDENCE_SQL} AS evidence FROM final JOIN documents d USING (doc_id) GROUP BY qid)
SELECT qid, md5(replace(replace(replace(CASE {_LABEL_SQL} {_PROMPT_SQL} ELSE {quoted([models.PROMPT])} END, '{{kind}}', {_LABEL_SQL}), '{{query}}', text), '{{evidence}}', evidence)) AS prompt_md5 FROM ev JOIN benchmark ON item_id = qid"""
)
def prompt_build(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    made = models.prompt(_label(), F.col("text"), F.col("evidence"), 2)
    return _evidence(spark, d).join(asked, "qid").select("qid", F.md5(made.cast("binary")).alias("prompt_md5"))


_MATCHES_SQL = f"""{CANDIDATES_SQL}, {_KEPT_SQL}, matched AS (SELECT *, CASE WHEN stage = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'exact' ELSE 'exact_contains' END ELSE 'vector' END AS match_type FROM final)"""


def _matched(spark, d):
    kind = F.when(F.col("stage") != 0, "vector").when(F.col("doc_id") % 2 == 0, "exact").otherwise("exact_contains")
    return _final(spark, d).withColumn("match_type", kind)


@query(f"WITH {_MATCHES_SQL} SELECT qid, count(*) FILTER (match_type IN ('exact', 'exact_contains')) AS n_exact, count(*) FILTER (match_type = 'vector') AS n_vector FROM matched GROUP BY qid")
def match_type_counts(spark, d):
    exact = scoring.is_exact(F.col("match_type"))
    return _matched(spark, d).groupBy("qid").agg(F.count_if(exact).alias("n_exact"), F.count_if(~exact).alias("n_vector"))


_ENGINE_SQL = f"""{BM25_SQL}, vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT * FROM (SELECT qid, vec_id AS doc_id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS n
  FROM (SELECT b.item_id AS qid, v.vec_id, {_KNN_SQL} AS s FROM benchmark b JOIN vecs q ON b.item_id = q.vec_id, vecs v JOIN documents ON vec_id = doc_id)) WHERE n <= 30),
cand AS (SELECT qid, doc_id, s AS v, 0 AS b, 1 AS p FROM near UNION ALL SELECT qid, doc_id, 0, bm25, 2 FROM hits),
merged AS (SELECT qid, arg_min(doc_id, p * 1000000000 + doc_id) AS doc_id, max(v) AS v, max(b) AS b FROM cand JOIN documents USING (doc_id) GROUP BY qid, left(text, 100)),
hybrid AS (SELECT qid, doc_id, 1 AS stage, round(0.65 * v + 0.35 * b, 8) AS hybrid_score FROM merged),
{_OVERLAP_SQL[len(CANDIDATES_SQL) + 2:]},
ranked AS (SELECT *, rerank_score AS score FROM again), {_KEPT_SQL.replace(_FLOOR_SQL, '-3.0')}"""


@query(f"WITH {_ENGINE_SQL} SELECT qid, rank, doc_id, score, CAST(least(100, greatest(0, trunc((score + 5) / 10 * 100))) AS INTEGER) AS confidence, stage FROM final")
def engine_answer(spark, d):
    """The facade's whole request path over documents and their vectors, without expansion: items bring their own vectors."""
    from tarnwick.api import Engine, Settings

    docs, vecs = table(spark, d, "documents"), table(spark, d, "embeddings")
    # a collection is a table of its own: its parts are joined once
    stored(docs.join(vecs.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select("doc_id", "text", "embedding"), "collection").createOrReplaceTempView("engine_documents")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text").join(vecs.select(F.col("vec_id").alias("qid"), "embedding"), "qid", "left")
    found = Engine(spark, Settings(max_terms=0)).query(items, "engine_documents")
    return found.select("qid", "rank", "doc_id", "score", "confidence", "stage")


#: Items that also name a clause, a topic or a parameter, and documents that have clauses and parameters.
_ASKED_ITEMS_SQL = "asked_items AS (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' §5.3.' || item_id % 7 || '.2 at handover' WHEN 1 THEN ' VonrHoTimer' || item_id % 5 || ' of vonr' ELSE '' END AS text FROM benchmark)"
_FULL_SQL = f"""{_ASKED_ITEMS_SQL}, {_FOUND_SQL.replace(_ASKED_SQL, "asked AS (SELECT item_id AS qid, text FROM asked_items)")},
used AS (SELECT qid, term, o FROM (SELECT qid, term, o, row_number() OVER (PARTITION BY qid ORDER BY o) AS n FROM found JOIN asked USING (qid) WHERE NOT contains(lower(text), lower(term))) WHERE n <= 40),
expanded AS (SELECT asked.qid AS item_id, text || coalesce(' ' || string_agg(term, ' ' ORDER BY o), '') AS text FROM asked LEFT JOIN used USING (qid) GROUP BY asked.qid, text),
{BM25_SQL.replace("FROM benchmark", "FROM expanded")}, vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
meta AS (SELECT doc_id, 'section_number' AS field, '5.3.' || doc_id % 7 || '.2' AS value FROM documents UNION ALL SELECT doc_id, 'parameter_name', 'VonrHoTimer' || doc_id % 5 FROM documents),
targets AS (SELECT DISTINCT qid, 'parameter_name' AS field, unnest(regexp_extract_all(text, '{V.CAMEL_QUERY}')) AS value FROM asked UNION SELECT DISTINCT qid, 'section_number', unnest(regexp_extract_all(text, '{V.SECTION_QUERY}', 1)) FROM asked),
exact AS (SELECT DISTINCT qid, doc_id FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid, field, value ORDER BY doc_id) AS n FROM targets JOIN meta USING (field, value)) WHERE n <= 5),
near AS (SELECT * FROM (SELECT qid, vec_id AS doc_id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS n
  FROM (SELECT b.item_id AS qid, v.vec_id, {_KNN_SQL} AS s FROM benchmark b JOIN vecs q ON b.item_id = q.vec_id, vecs v JOIN documents ON vec_id = doc_id)) WHERE n <= 30),
cand AS (SELECT qid, doc_id, 0 AS v, 1 AS b, 0 AS stage, 0 AS p FROM exact UNION ALL SELECT qid, doc_id, s, 0, 1, 1 FROM near UNION ALL SELECT qid, doc_id, 0, bm25, 1, 2 FROM hits),
merged AS (SELECT qid, arg_min(doc_id, p * 1000000000 + doc_id) AS doc_id, arg_min(stage, p * 1000000000 + doc_id) AS stage, max(v) AS v, max(b) AS b FROM cand JOIN documents USING (doc_id) GROUP BY qid, left(text, 100)),
hybrid AS (SELECT qid, doc_id, stage, round(CASE WHEN stage = 0 THEN greatest(0.65 * v + 0.35 * b, 0.95) ELSE 0.65 * v + 0.35 * b END, 8) AS hybrid_score FROM merged),
{_OVERLAP_SQL[len(CANDIDATES_SQL) + 2:].replace("benchmark b", "asked_items b")},
ranked AS (SELECT *, rerank_score AS score FROM again), {_KEPT_SQL.replace(_FLOOR_SQL, '-3.0')}"""


@query(f"WITH {_FULL_SQL} SELECT qid, rank, doc_id, score, CAST(least(100, greatest(0, trunc((score + 5) / 10 * 100))) AS INTEGER) AS confidence, stage FROM final")
def engine_full(spark, d):
    """The facade's request path with all its stages: expansion, exact hits by parameter and clause, vectors, BM25, rerank, floors."""
    from tarnwick.api import Engine

    docs, vecs = table(spark, d, "documents"), table(spark, d, "embeddings")
    key = F.col("doc_id")
    docs = docs.select("doc_id", "text", F.concat(F.lit("5.3."), (key % 7).cast("string"), F.lit(".2")).alias("section_number"), F.concat(F.lit("VonrHoTimer"), (key % 5).cast("string")).alias("parameter_name"))
    stored(docs.join(vecs.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left"), "collection").createOrReplaceTempView("engine_full_documents")
    item = F.col("item_id")
    more = F.when(item % 3 == 0, F.concat(F.lit(" §5.3."), (item % 7).cast("string"), F.lit(".2 at handover"))).when(item % 3 == 1, F.concat(F.lit(" VonrHoTimer"), (item % 5).cast("string"), F.lit(" of vonr"))).otherwise("")
    items = table(spark, d, "benchmark").select(item.alias("qid"), F.concat("text", more).alias("text")).join(vecs.select(F.col("vec_id").alias("qid"), "embedding"), "qid", "left")
    return Engine(spark).query(items, "engine_full_documents").select("qid", "rank", "doc_id", "score", "confidence", "stage")


@query(
    rf"""WITH {_NAMES_SQL}, cited AS (SELECT id, text || '; TS 38.310 §5.3.7, §7.7.7.7 and §5.3' AS answer, text FROM named),
ok AS (SELECT *, list_transform(regexp_extract_all(text, '{V.CLAUSE_REF_3}'), lambda x: replace(replace(x, '§', ''), ' ', '')) AS allowed, regexp_extract_all(answer, '{V.CLAUSE_REF_3}') AS found FROM cited),
judged AS (SELECT *, list_transform(found, lambda m: CASE WHEN list_contains(allowed, replace(replace(m, '§', ''), ' ', '')) THEN m ELSE '[§ref]' END) AS made FROM ok)
SELECT id AS qid, {_PARTS('answer', V.CLAUSE_REF_3, 'made')} AS answer FROM judged"""
)
def engine_checked(spark, d):
    """Answers less the references that their evidence does not hold, through the facade."""
    from tarnwick.api import Engine

    named = _named(spark, d).select(F.col("id").alias("qid"), F.col("text").alias("evidence"))
    answers = named.select("qid", F.concat("evidence", F.lit("; TS 38.310 §5.3.7, §7.7.7.7 and §5.3")).alias("answer"))
    return Engine(spark).checked(answers, named)


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS ingested_epoch FROM orders")
def epoch_seconds(spark, d):
    """Whole seconds since 1970, as ingest stamps its rows."""
    return table(spark, d, "orders").select("o_orderkey", scoring.epoch_seconds(F.col("o_orderdate")).alias("ingested_epoch"))


_SCORE_LABEL = "CASE WHEN s >= 0.8 THEN 'High' WHEN s >= 0.65 THEN 'Medium' WHEN s >= 0.45 THEN 'Low' ELSE 'Not found' END"


@query(
    f"""WITH {_MATCHES_SQL}, per AS (SELECT qid, round(1 / (1 + exp(-0.6 * max(score))), 6) AS s, array_to_string(list_sort(list_distinct(list(match_type))), ', ') AS kinds,
  array_to_string(list_sort(list_distinct(list(source) FILTER (rank <= 2))), ', ') AS files FROM matched JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY qid)
SELECT qid, upper({_LABEL_SQL}) || ' — ' || {_SCORE_LABEL} AS label, CASE WHEN s >= 0.45 THEN 'hit' ELSE 'miss' END AS cls,
 'score ' || printf('%.2f', round(s, 2)) || ' | ' || {_SCORE_LABEL} || ' | match=' || kinds || ' | ' || files AS detail FROM per"""
)
def pipeline_trace(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    per = _matched(spark, d).join(docs, "doc_id").groupBy("qid").agg(
        F.round(scoring.sigmoid(F.max("score")), 6).alias("s"),
        F.array_join(F.array_sort(F.collect_set("match_type")), ", ").alias("kinds"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("rank") <= 2, F.col("source")))), ", ").alias("files"),
    )
    label = scoring.confidence_label(F.col("s"))
    detail = F.concat(F.lit("score "), F.format_string("%.2f", F.round("s", 2)), F.lit(" | "), label, F.lit(" | match="), "kinds", F.lit(" | "), "files")
    return per.select("qid", F.concat(F.upper(_label()), F.lit(" — "), label).alias("label"), F.when(F.col("s") >= 0.45, "hit").otherwise("miss").alias("cls"), detail.alias("detail"))


@query(
    f"""WITH {CANDIDATES_SQL}, every AS (SELECT qid, doc_id, 'exact' AS match_type, 0 AS priority FROM exact UNION ALL SELECT qid, doc_id, 'vector', 1 FROM near JOIN documents USING (doc_id))
SELECT qid, doc_id, match_type FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY priority) AS n FROM every) WHERE n = 1"""
)
def merge_by_id_v1(spark, d):
    exact, near = _exact_and_near(spark, d)
    one = exact.select("qid", "doc_id", F.lit("exact").alias("match_type"), F.lit(0).alias("priority"))
    near = stored(near, "near").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    two = near.select("qid", "doc_id", F.lit("vector").alias("match_type"), F.lit(1).alias("priority"))
    return retrieval.merge_by_id(one.unionByName(two)).select("qid", "doc_id", "match_type")


_ASK_SQL = "asks AS (SELECT c_custkey AS qid, CASE c_custkey % 3 WHEN 0 THEN ' src' || (c_custkey % 20) || ' ' WHEN 1 THEN 'rc' || (c_custkey % 20) ELSE 'en' END AS text FROM customer)"
_RULES = [("source", "eq"), ("source", "contains"), ("lang", "eq"), ("lang", "contains")]
_RULES_SQL = " UNION ALL ".join(
    f"SELECT qid, doc_id, '{'exact' if op == 'eq' else 'exact_contains'}' AS match_type, {k} AS priority FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS n FROM asks JOIN documents ON {f'{field} = trim(asks.text)' if op == 'eq' else f'contains({field}, trim(asks.text))'}) WHERE n <= 5"
    for k, (field, op) in enumerate(_RULES)
)


@query(f"WITH {_ASK_SQL}, every AS ({_RULES_SQL}) SELECT qid, doc_id, match_type, priority FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY priority) AS n FROM every) WHERE n = 1")
def exact_match_v1(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    text = F.when(key % 3 == 0, F.concat(F.lit(" src"), (key % 20).cast("string"), F.lit(" "))).when(key % 3 == 1, F.concat(F.lit("rc"), (key % 20).cast("string"))).otherwise("en")
    # few distinct texts: each is answered once, then given to all who ask it
    asks = c.select(key.alias("qid"), text.alias("text"))
    texts = asks.select("text").distinct().withColumn("_t", F.xxhash64("text"))
    found = retrieval.exact_match(table(spark, d, "documents"), texts.select(F.col("_t").alias("qid"), "text"), _RULES).withColumnRenamed("qid", "_t")
    return asks.join(texts, "text").join(found, "_t").select("qid", "doc_id", "match_type", "priority")


@query(
    rf"""WITH {_NAMES_SQL}, t AS (SELECT DISTINCT id AS qid, field, value FROM (
 SELECT id, 'parameter_name' AS field, unnest(regexp_extract_all(text, '{V.CAMEL_QUERY}')) AS value FROM named
 UNION ALL SELECT id, 'mo_class', unnest(regexp_extract_all(text, '{V.OBJECT_QUERY}', 1)) FROM named UNION ALL SELECT id, 'mo_path', unnest(regexp_extract_all(text, '{V.OBJECT_QUERY}', 1)) FROM named
 UNION ALL SELECT id, 'section_number', unnest(regexp_extract_all(text, '{V.SECTION_QUERY}', 1)) FROM named)),
known AS (SELECT s_suppkey AS doc_id, 'parameter_name' AS field, CASE WHEN s_suppkey % 2 = 0 THEN 'VonrHoTimer' || (s_suppkey % 50) ELSE 'TimerLen' END AS value FROM supplier
 UNION ALL SELECT s_suppkey, 'mo_class', CASE s_suppkey % 3 WHEN 0 THEN 'NRCellDU' WHEN 1 THEN 'NRCellCU' ELSE 'Other' END FROM supplier
 UNION ALL SELECT s_suppkey, 'section_number', '5.3.' || (s_suppkey % 50) FROM supplier)
SELECT qid, doc_id, field, value FROM (SELECT qid, doc_id, field, value, row_number() OVER (PARTITION BY qid, field, value ORDER BY doc_id) AS n FROM t JOIN known USING (field, value)) WHERE n <= 5"""
)
def stage0_exact_v2(spark, d):
    s, key = table(spark, d, "supplier"), F.col("s_suppkey")
    corpus = s.select(
        key.alias("doc_id"),
        F.when(key % 2 == 0, F.concat(F.lit("VonrHoTimer"), (key % 50).cast("string"))).otherwise("TimerLen").alias("parameter_name"),
        F.when(key % 3 == 0, "NRCellDU").when(key % 3 == 1, "NRCellCU").otherwise("Other").alias("mo_class"),
        F.concat(F.lit("5.3."), (key % 50).cast("string")).alias("section_number"),
    )
    targets = retrieval.entity_targets(_named(spark, d), id_col="id")
    return retrieval.exact_hits(corpus, targets, ["parameter_name", "mo_class", "section_number"])


# -- labels and routing ------------------------------------------------------------------------------------

_EVENT_LABEL = "CASE WHEN value / 100 >= 0.8 THEN 'High' WHEN value / 100 >= 0.65 THEN 'Medium' WHEN value / 100 >= 0.45 THEN 'Low' ELSE 'Not found' END"


@query(f"SELECT event_id, label, CAST(CASE label WHEN 'High' THEN 88 WHEN 'Medium' THEN 65 WHEN 'Low' THEN 40 ELSE 0 END AS INTEGER) AS shown FROM (SELECT event_id, {_EVENT_LABEL} AS label FROM events)")
def confidence_label(spark, d):
    label = scoring.confidence_label(F.col("value") / 100)
    return table(spark, d, "events").select("event_id", label.alias("label"), scoring.shown_percent(label).alias("shown"))


@query(f"SELECT event_id, event_type <> 'error' AND {_EVENT_LABEL} <> 'Not found' AS has_answer FROM events")
def has_answer(spark, d):
    answer = F.when(F.col("event_type") == "error", "  ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", scoring.has_answer(answer, scoring.confidence_label(F.col("value") / 100)).alias("has_answer"))


@query("SELECT event_id, round(value / 7, 3) AS score, round(value * 1.7137, 1) AS latency FROM events")
def round_score(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.col("value") / 7, 3).alias("score"), F.round(F.col("value") * 1.7137, 1).alias("latency"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'hedex' ELSE '3gpp' END AS source, s_suppkey % 3 = 0 OR s_suppkey % 3 = 1 AS wanted FROM supplier")
def source_route(spark, d):
    key = F.col("s_suppkey")
    collection = F.when(key % 2 == 0, "Huawei_HedEx").otherwise("spec_docs")
    asked = F.when(key % 3 == 0, F.array(F.lit("3gpp"), F.lit("hedex"))).when(key % 3 == 1, F.array(scoring.route(collection))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "supplier").select("s_suppkey", scoring.route(collection).alias("source"), F.array_contains(asked, scoring.route(collection)).alias("wanted"))


