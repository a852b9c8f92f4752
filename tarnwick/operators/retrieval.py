"""Exact metadata hits, candidate merge, floors, final ranking and formatting. Every plan answers all queries at once.

A candidate is (qid, doc_id, text, vector_score, bm25_score, stage); stage 0 is an exact hit, 1 any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import scoring
from tarnwick.functions.text import query_entities
from tarnwick.sources.shared import stored


#: Characters of a query that its matches are found by.
GRAM = 3


def entity_targets(queries: DataFrame, id_col: str = "qid", text_col: str = "text") -> DataFrame:
    """(qid, field, value): what a query's names are compared with; a name may be a class or a path."""
    e = queries.select(F.col(id_col).alias("qid"), query_entities(F.col(text_col)).alias("e"))
    pair = lambda field, values: F.transform(values, lambda x: F.struct(F.lit(field).alias("field"), x.alias("value")))
    every = F.concat(pair("parameter_name", F.col("e.camel")), pair("mo_class", F.col("e.objects")), pair("mo_path", F.col("e.objects")), pair("section_number", F.col("e.sections")))
    return e.select("qid", F.explode(every).alias("t")).select("qid", "t.field", "t.value").distinct()


def exact_hits(corpus: DataFrame, targets: DataFrame, fields: list[str], limit: int = 5, id_col: str = "doc_id") -> DataFrame:
    """(qid, doc_id, field, value): `limit` smallest ids for each target. The corpus is unpivoted, so one equi-join serves all fields.

    Which ids a value has does not depend on who asks, so all but `limit` rows of a value go before the join.
    """
    known = corpus.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select("doc_id", "x.field", "x.value")
    order = Window.partitionBy("field", "value").orderBy("doc_id")
    few = known.filter(F.col("value").isNotNull()).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")
    return targets.join(few, ["field", "value"]).select("qid", "doc_id", "field", "value")


def _grams(column: str, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(column) - n + 1)
    return F.when(F.length(column) >= n, F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def exact_match(corpus: DataFrame, queries: DataFrame, rules: list[tuple[str, str]], limit: int = 5, id_col: str = "doc_id") -> DataFrame:
    """(qid, doc_id, match_type, priority): rules (field, 'eq' or 'contains') in order, `limit` ids each, a document's first rule wins.

    The whole trimmed query is compared. Both are equi-joins: for containment, distinct values meet the queries whose first
    `GRAM` characters stand somewhere in them, and only those are compared. Of a value's ids the `limit` smallest are joined.
    """
    q = queries.select("qid", F.trim("text").alias("_q")).filter("_q <> ''").withColumn("_g", F.left("_q", F.lit(GRAM)))
    parts = []
    for k, (field, op) in enumerate(rules):
        every = corpus.select(F.col(id_col).alias("doc_id"), F.col(field).cast("string").alias("_v"))
        rows = every.withColumn("_k", F.row_number().over(Window.partitionBy("_v").orderBy("doc_id"))).filter(F.col("_k") <= limit).drop("_k")
        if op == "eq":
            hit = q.join(rows, F.col("_q") == F.col("_v"))
        else:
            grams = F.flatten(F.array(*(_grams("_v", n) for n in range(1, GRAM + 1))))
            cut = every.select("_v").distinct().filter("_v <> ''").select("_v", F.explode(F.array_distinct(grams)).alias("_g"))
            pairs = q.select("_q", "_g").distinct().join(cut, "_g").filter(F.contains("_v", "_q")).select("_q", "_v")
            hit = q.join(pairs, "_q").join(rows, "_v")
        first = F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))
        parts.append(hit.select("qid", "doc_id").withColumn("_n", first).filter(F.col("_n") <= limit).select("qid", "doc_id", F.lit("exact" if op == "eq" else "exact_contains").alias("match_type"), F.lit(k).alias("priority")))
    every = reduce(DataFrame.unionByName, parts)
    best = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("priority"))
    return every.withColumn("_n", best).filter("_n = 1").drop("_n")


def merge(exact: DataFrame, vector: DataFrame, bm25: DataFrame, prefix: int = 100, heads: DataFrame | None = None, vector_weight: float = 0.65, bm25_weight: float = 0.35) -> DataFrame:
    """One candidate for each query and text prefix: the first of exact, vector, bm25 (then smallest id) stays, scores are the largest.

    Inputs are candidates; a prefix stands for the text, so pieces that begin alike are one. With `heads` (doc_id, text) the
    inputs have no text and get it there: whole texts need not be shuffled before the winners are known. Candidates are written before
    and after, so that joins with the corpus know how few they are, and broadcast them.
    """
    every = exact.withColumn("_p", F.lit(0)).unionByName(vector.withColumn("_p", F.lit(1))).unionByName(bm25.withColumn("_p", F.lit(2)))
    every = every if heads is None else stored(every, "candidates").join(heads, "doc_id")
    every = every.withColumn("_key", F.left("text", F.lit(prefix)))
    merged = every.groupBy("qid", "_key").agg(
        F.min_by(F.struct("doc_id", "text", "stage"), F.struct("_p", "doc_id")).alias("c"),
        F.max("vector_score").alias("vector_score"),
        F.max("bm25_score").alias("bm25_score"),
    )
    out = merged.select("qid", "c.doc_id", "c.text", "vector_score", "bm25_score", "c.stage")
    return stored(out.withColumn("hybrid_score", F.round(scoring.hybrid(F.col("vector_score"), F.col("bm25_score"), F.col("stage"), vector_weight, bm25_weight), 8)), "merged")


def merge_by_id(candidates: DataFrame) -> DataFrame:
    """(qid, doc_id) once, the row of smallest `priority`: exact hits before vector hits."""
    best = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("priority"))
    return candidates.withColumn("_n", best).filter("_n = 1").drop("_n")


def best(candidates: DataFrame, k: int = 30) -> DataFrame:
    """Each query's k best by hybrid score: the cut before whole texts are fetched."""
    order = Window.partitionBy("qid").orderBy(F.col("hybrid_score").desc(), F.col("doc_id"))
    return candidates.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def rerank(candidates: DataFrame, scorer, k: int = 30, chars: int = 512) -> DataFrame:
    """rerank_score of each query's k best by hybrid score, from scorer(query column, text column).

    A query of one candidate is not scored: it, and a null score, has the hybrid score.
    """
    few = best(candidates, k)
    some = F.count("*").over(Window.partitionBy("qid")) > 1
    few = few.withColumn("_some", some)
    score = F.when(F.col("_some"), scorer(F.col("query"), F.left("text", F.lit(chars))))
    return few.withColumn("rerank_score", F.coalesce(score, F.col("hybrid_score"))).drop("_some")


def floor_v1(scored: DataFrame, source: Column, score: str = "score", key: str = "qid") -> DataFrame:
    """Adds `floor`: the larger of the source's floor and the nearest-rank 30th percentile of the query's non-exact scores."""
    per = scored.groupBy(key).agg(F.sort_array(F.collect_list(F.when(~F.col("exact"), F.col(score)))).alias("_s"))
    at = F.greatest(F.lit(0), F.floor(F.size("_s") * 30 / 100).cast("int") - 1)
    floors = per.select(key, F.get("_s", at).alias("_d"))
    return scored.join(floors, key).withColumn("floor", F.greatest(scoring.floor_of(source), F.coalesce("_d", F.lit(float("-inf"))))).drop("_d")


def discard_v2(scored: DataFrame, floor: Column, score: str = "score", key: str = "qid") -> DataFrame:
    """Non-exact rows below the floor go; of more than four that stay, those below the interpolated 30th percentile go too. Exact rows stay."""
    rest = scored.filter((F.col("stage") == 0) | (F.col(score) >= floor))
    per = Window.partitionBy(key)
    cold = F.when(F.col("stage") != 0, F.col(score))
    rest = rest.withColumn("_n", F.count(cold).over(per)).withColumn("_p", F.percentile(cold, F.lit(0.3)).over(per))
    return rest.filter((F.col("stage") == 0) | (F.col("_n") <= 4) | (F.col(score) >= F.col("_p"))).drop("_n", "_p")


def final(scored: DataFrame, n: int = 8, score: str = "score") -> DataFrame:
    """The n first of each query: exact hits, then by score; `rank` from 1."""
    order = Window.partitionBy("qid").orderBy((F.col("stage") != 0).cast("int"), F.col(score).desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def citation(source: Column, meta: dict[str, Column]) -> Column:
    """'TS x §n — heading' or 'HedEx | source | parameter | path'; empty parts leave out their separators."""
    some = lambda c, before, after="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    spec = F.concat(F.coalesce(meta["spec_id"], F.lit("3GPP")), some(meta["section_number"], " §"), some(F.left(meta["section_heading"], F.lit(50)), " — "))
    table = F.concat(F.lit("HedEx | "), F.coalesce(meta["source"], F.lit("HedEx")), some(meta["parameter_name"], " | "), some(meta["mo_path"], " | "))
    return F.when(source == "3gpp", spec).otherwise(table)


def panel_confidence(scored: DataFrame, boost: bool = True, score: str = "score") -> DataFrame:
    """(qid, confidence): mean of the three first scores on 0 to 100; an exact hit makes it 75 at least."""
    per = scored.groupBy("qid").agg(F.avg(F.when(F.col("rank") <= 3, F.col(score))).alias("_m"), F.max((F.col("stage") == 0).cast("int")).alias("_x"))
    base = scoring.scaled(F.col("_m"))
    return per.select("qid", F.round(F.when((F.col("_x") == 1) & F.lit(boost), F.greatest(base, F.lit(75.0))).otherwise(base), 6).alias("confidence"))


def evidence_block(ranked: DataFrame, chars: int = 800) -> DataFrame:
    """(qid, evidence): '[Ei] citation (score=s)' and the text's start for each hit in rank order. A score is rounded as a double, not by its
    digits: 1.005, which is a little less, gives 1.00."""
    part = F.concat(F.lit("[E"), F.col("rank").cast("string"), F.lit("] "), F.col("citation"), F.lit(" (score="), F.format_string("%.2f", F.round(F.col("score") * 100) / 100), F.lit(")\n"), F.left("text", F.lit(chars)))
    per = ranked.select("qid", F.struct("rank", part.alias("part")).alias("p")).groupBy("qid").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return per.select("qid", F.array_join(F.transform("ps", lambda x: x["part"]), "\n\n---\n\n").alias("evidence"))
