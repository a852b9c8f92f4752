"""Operators against plain restatements, and their properties."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tarnwick.operators import chunk, feed, index, retrieval, vector
from tarnwick.sources import store
from tarnwick.streaming import dedup


def test_bm25(spark):
    texts = ["alpha beta beta", "beta gamma", "alpha alpha alpha delta", "", None, "beta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.qid, r.doc_id): r.score for r in index.score(index.build(docs), spark.createDataFrame([(7, "alpha beta beta")], "item_id long, text string")).collect()}
    lists = [(t or "").split() for t in texts]
    n, avg = len(lists), sum(map(len, lists)) / len(lists)
    df = Counter(w for x in lists for w in set(x))
    raw = {w: math.log(n - df[w] + 0.5) - math.log(df[w] + 0.5) for w in df}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    for k, x in enumerate(lists):
        s = sum(idf[w] * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for w in ["alpha", "beta", "beta"])
        assert got.get((7, k), 0.0) == round(s, 6)
    norm = index.search(index.build(docs), spark.createDataFrame([(7, "alpha beta beta"), (8, "none")], "item_id long, text string"), 2).collect()
    assert [r.rank for r in norm] == [1, 2] and all(0 <= r.bm25 <= 1 for r in norm)


def test_knn_ties_nulls_and_blocks(spark, monkeypatch):
    rows = [(k, [float(k % 5), 1.0]) for k in range(40)] + [(90, None), (91, [1.0])]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = vecs.filter("vec_id in (0, 1, 90)").select(F.col("vec_id").alias("qid"), "embedding")
    cos = lambda a, b: round(max(0.0, sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))), 6)
    wanted = {q: sorted(((-cos(rows[q][1], v), i) for i, v in rows[:40]))[:7] for q in (0, 1)}
    for limit in (1 << 20, 16):  # the second makes a run for each query
        monkeypatch.setattr(vector, "MAX_BROADCAST", limit)
        got = vector.knn(vecs, asked, 7).orderBy("qid", "rank").collect()
        assert [(r.qid, r.vec_id, r.score) for r in got] == [(q, i, -s) for q in (0, 1) for s, i in wanted[q]]
    assert vector.knn(vecs, asked.filter("qid = 90"), 7).count() == 0


def _pack(text, size=1200):
    out, cur = [], ""
    for p in (p.strip() for p in re.split(r"\n{2,}", text)):
        if not p:
            continue
        if len(cur) + len(p) <= size:
            cur = cur + "\n\n" + p if cur else p
        else:
            out += [cur] if len(cur) > 50 else []
            cur = p
    return out + ([cur] if len(cur) > 50 else [])


def _pack_overlap(text, size=1200, overlap=200):
    if len(text) <= size:
        return [text]
    out, cur = [], ""
    for p in text.split("\n\n"):
        if len(cur) + len(p) + 2 <= size:
            cur = (cur + "\n\n" + p).strip() if cur else p
        else:
            out += [cur] if cur else []
            cur = ((cur[-overlap:] if cur else "") + "\n\n" + p).strip()
    return out + ([cur] if cur else [])


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.regexp_replace("text", "\n", "\n\n").alias("t"))
    extra = spark.createDataFrame([("x" * 3000,), ("",), ("a" * 600 + "\n\n" + "b" * 598,), ("a" * 600 + "\n\n" + "b" * 601 + "\n\n\n\nc",)], "t string")
    for r in docs.union(extra).select("t", chunk.pack(F.col("t")).alias("a"), chunk.pack_overlap(F.col("t")).alias("b")).collect():
        assert r.a == _pack(r.t)
        assert r.b == _pack_overlap(r.t)


def test_clause_chunks(spark):
    body = "word " * 60
    long = "\n\n".join("para %d " % k + "text " * 80 for k in range(6))
    doc = f"lost preamble\n1  Alpha head here\n{body}\n1.2  Beta head here\n{long}\n1.2.3.4  Too deep a head\nshort\nAnnex A (normative): Things\n{body}\n2  Tiny clause\nno"
    got = spark.createDataFrame([(doc,)], "t string").select(chunk.clause_chunks(F.col("t"), F.lit("TS 1.2")).alias("c")).first()["c"]
    heads = [(c.section_number, c.section_heading) for c in got]
    assert heads[0] == ("1", "Alpha head here") and got[0].sub_chunk is None
    assert heads[-1] == ("Annex A", "Things")
    assert ("2", "Tiny clause") not in heads  # noise
    assert [c.sub_chunk for c in got if c.section_number == "1.2"] == list(range(sum(h[0] == "1.2" for h in heads)))
    assert all(c.text.startswith(f"[TS 1.2 §{c.section_number}] {c.section_heading}") for c in got)
    assert not any("lost preamble" in c.text for c in got)
    few = spark.createDataFrame([("1  Alpha head here\n" + body,)], "t string").select(chunk.clause_chunks(F.col("t"), F.lit("TS 1.2")).alias("c")).first()["c"]
    assert [c.section_number for c in few] == [None] and few[0].text.startswith("[TS 1.2]\n\n1  Alpha")


def test_sliding_covers_everything(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.text for r in docs.collect()}
    for r in chunk.sliding(docs, min_chars=-1).collect():
        assert whole[r.doc_id][r.chunk_idx * 1000 :].startswith(r.chunk)
    n = docs.select(F.sum(F.ceil(F.length("text") / 1000))).first()[0]
    assert chunk.sliding(docs, min_chars=-1).count() == n


def test_narrative(spark):
    long = "sentence here. " * 10
    t = f"intro\n1.1  First part\n{long}\n2  Second part\nshort"
    got = spark.createDataFrame([(t,), ("tiny",), (long,)], "t string").select(chunk.narrative_sections(F.col("t"), F.lit(3)).alias("s")).collect()
    assert [[x.section for x in r.s] for r in got] == [["1.1 First part"], [], ["page_3"]]


def test_merge_prefers_exact_and_keeps_largest_scores(spark):
    schema = "qid long, doc_id long, text string, vector_score double, bm25_score double, stage int"
    same = "p" * 100
    exact = spark.createDataFrame([(1, 5, same + "a", 0.2, 1.0, 0)], schema)
    near = spark.createDataFrame([(1, 6, same + "b", 0.9, 0.0, 1), (1, 7, "other", 0.5, 0.0, 1)], schema)
    words = spark.createDataFrame([(1, 7, "other", 0.0, 0.4, 1)], schema)
    got = {r.doc_id: (r.vector_score, r.bm25_score, r.stage, r.hybrid_score) for r in retrieval.merge(exact, near, words).collect()}
    assert got == {5: (0.9, 1.0, 0, 0.95), 7: (0.5, 0.4, 1, 0.465)}


def test_floors(spark):
    schema = "qid long, doc_id long, score double, stage int"
    six = spark.createDataFrame([(1, k, float(k), 1) for k in range(1, 7)] + [(1, 9, -99.0, 0)], schema)
    kept = {r.doc_id for r in retrieval.discard_v2(six, F.lit(-3.0)).collect()}
    assert kept == {3, 4, 5, 6, 9}  # the 30th percentile of 1..6 is 2.5; the exact row bypasses
    four = six.filter("doc_id in (1, 2, 3, 4, 9)")
    assert {r.doc_id for r in retrieval.discard_v2(four, F.lit(-3.0)).collect()} == {1, 2, 3, 4, 9}
    floors = retrieval.floor_v1(six.withColumn("exact", F.col("stage") == 0), F.lit("3gpp")).select("floor").distinct().collect()
    assert [r.floor for r in floors] == [1.0]  # nearest rank: the first of six


def test_seen_set(spark):
    items = spark.createDataFrame([(1, " HTTP://A/x "), (2, "http://a/x"), (3, "http://b")], "id long, url string")
    seen = feed.filter_new(items.filter("id = 3"), spark.createDataFrame([], "url_hash string")).select("url_hash", "id")
    new = feed.filter_new(items, seen)
    assert {r.id for r in new.collect()} == {1, 2}  # copies inside a batch stay
    assert {r.id for r in feed.distinct_in_batch(new, "id").collect()} == {1}
    marked = feed.mark_seen(seen, new.select("url_hash", "id"))
    assert marked.count() == 2
    assert feed.mark_seen(marked, new.select("url_hash", "id")).count() == 2


def test_incremental_ingest_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for k, ids in enumerate(([1, 2, 2], [2, 3])):
        spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, text string").parquet(src)
        dedup.incremental_ingest(stream, out, str(tmp_path / "state")).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == ([1, 2] if k == 0 else [1, 2, 3])
    # a new query over the same files adds nothing
    dedup.incremental_ingest(spark.readStream.schema("id long, text string").parquet(src), out, str(tmp_path / "state2")).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"page one " * 80)
    (tmp_path / "b.bin").write_bytes(b"!")

    def extract(content):
        if content == b"!":
            raise ValueError("no pages")
        return [content.decode(), "  ", "tail"]

    good, bad = store.binary_corpus(spark, str(tmp_path), extract, "*.bin")
    assert [r.text.endswith("\n\ntail") for r in good.collect()] == [True]
    assert [r.error for r in bad.collect()] == ["no pages"]
    (tmp_path / "c.txt").write_text("hello\nthere")
    assert [r.text for r in store.text_corpus(spark, str(tmp_path)).collect()] == ["hello\nthere"]


def test_generate_keeps_failures(spark):
    from tarnwick.operators import models

    def load():
        def answer(p):
            if p == "bad":
                raise ValueError("no")
            return p.upper()

        return answer

    got = {r.prompt: (r.answer, r.error) for r in models.generate(spark.createDataFrame([("a",), ("bad",)], "prompt string"), load).collect()}
    assert got == {"a": ("A", None), "bad": (None, "no")}


def test_engine(spark):
    import uuid

    from tarnwick.api import Engine, Settings

    name = "specs_" + uuid.uuid4().hex
    engine = Engine(spark, Settings.from_env({"TOP_N": "3"}))
    body = "The timer starts when the cell sends the message and stops on its answer. " * 6
    doc = "\n".join(f"{k}.1  Clause number {k} about t{k}xx\n{body} t{k}xx" for k in range(1, 6))
    docs = spark.createDataFrame([("TS 38.331", doc)], "name string, text string")
    assert engine.ingest(docs, name, reset=True) == 5
    assert engine.ingest(docs, name) == 0
    got = engine.query(spark.createDataFrame([(1, "what is t3xx in 3.1"), (2, "  ")], "qid long, text string"), name).orderBy("rank").collect()
    assert [r.qid for r in got] == [1] * len(got) and 1 <= len(got) <= 3
    assert got[0].stage == 0 and "t3xx" in got[0].text
    assert {r.collection: r.status for r in engine.stats([name, "none"]).collect()} == {name: "ok", "none": "not_ingested"}
    assert engine.health().first().status == "ok"
    assert {"embedding", "ingested_at"} <= set(spark.table(name).columns)
    # the vector stage and the weights: words that no chunk has, and a vector that one chunk has
    chunk = spark.table(name).orderBy("doc_id").first()
    lost = spark.createDataFrame([(5, "zzzz", chunk.embedding)], "qid long, text string, embedding array<float>")
    seen = engine.query(lost, name, scorer=lambda q, t: F.lit(None).cast("double")).collect()
    assert seen[0].doc_id == chunk.doc_id and abs(seen[0].score - 0.65) < 1e-6
    other = Engine(spark, Settings(vector_weight=0.2, bm25_weight=0.8)).query(lost, name, scorer=lambda q, t: F.lit(None).cast("double")).collect()
    assert abs(other[0].score - 0.2) < 1e-6
    asked = spark.createDataFrame([(1, "what is t3xx in 3.1")], "qid long, text string")
    found = engine.query_sources(asked, {"3gpp": name, "hedex": name})
    assert {r.source for r in found.collect()} == {"3gpp", "hedex"}
    parts = engine.answer_parts(found.filter("source = '3gpp'"), asked).first()
    assert "t3xx" in parts.prompt and "[E1]" in parts.prompt and parts.confidence >= 75 and parts.n_evidence >= 1
    answers, evidence = spark.createDataFrame([(1, "see §5.3.5 and §9.9.9")], "qid long, answer string"), spark.createDataFrame([(1, "as §5.3.5 says")], "qid long, evidence string")
    assert engine.checked(answers, evidence).first().answer == "see §5.3.5 and [§ref]"
    stamps = spark.sql("select 1 as id, timestamp'2024-01-01' as inserted_at union all select 2, timestamp'2024-03-20'")
    assert [r.id for r in engine.purge_seen(stamps, F.lit("2024-04-15").cast("timestamp"))[0].collect()] == [2]
    spark.sql(f"drop table {name}")


def test_vectors_in_blocks(spark, monkeypatch):
    from tarnwick.operators import vector

    rows = [(k, [float((k * 7 + j * j) % 11 - 5) for j in range(8)]) for k in range(60)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = corpus.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "qid")
    whole = sorted(map(tuple, vector.knn(corpus, asked, 5).collect()))
    monkeypatch.setattr(vector, "MAX_BROADCAST", 8 * 8 * 6)
    assert sorted(map(tuple, vector.knn(corpus, asked, 5).collect())) == whole


def test_containment(spark):
    corpus = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, None), (4, "")], "doc_id long, v string")
    asked = spark.createDataFrame([(1, "a b"), (2, " ta "), (3, "beta"), (4, "x"), (5, "  "), (6, "p")], "qid long, text string")
    got = {(r.qid, r.doc_id, r.match_type) for r in retrieval.exact_match(corpus, asked, [("v", "eq"), ("v", "contains")]).collect()}
    assert got == {(1, 1, "exact_contains"), (2, 1, "exact_contains"), (2, 2, "exact_contains"), (3, 2, "exact"), (3, 1, "exact_contains"), (6, 1, "exact_contains")}
    assert retrieval.exact_match(corpus, asked.limit(0), [("v", "contains")]).count() == 0


def test_sinks(spark):
    from tarnwick.sources import sinks

    entry = "struct<title:string,source:string,summary:string,vendors:array<string>,keywords:array<string>>"
    rows = [(7, [("A & B", [("T<1>", "S", "sum", [], ["k1", "k2", "k3"])])])]
    df = spark.createDataFrame(rows, f"number int, sections array<struct<title:string,entries:array<{entry}>>>")
    page = df.select(sinks.issue_html(F.lit("Issue"), F.col("sections")).alias("h"), sinks.issue_html(F.lit("Issue"), F.col("sections"), True).alias("m")).first()
    assert "A &amp; B" in page.h and "T&lt;1&gt;" in page.h and "1 entries" in page.h and '<b class="pill">k2</b><span class="pill">k3</span>' in page.h
    assert "pill" not in page.m
    assert df.select(sinks.issue_urls(F.col("number"), "https://x", "p").alias("u")).first().u.pdf_mobile_url == "https://x/p/issues/issue-007-mobile.pdf"
    assert sinks.next_issue(df).first().number == 8 and sinks.next_issue(df.limit(0)).first().number == 1

    def send(row):
        if row["number"] == 1:
            raise ValueError("refused")
        return f"sent {row['number']}"

    got = {r.number: (r.receipt, r.error) for r in sinks.deliver(spark.createDataFrame([(1,), (2,)], "number int"), send).collect()}
    assert got == {1: (None, "refused"), 2: ("sent 2", None)}
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.path for r in sinks.pending(files, files.filter("path = 'a'")).collect()] == ["b"]
    assert spark.range(1).select(sinks.ticker(F.array(F.lit("x"))).alias("t")).first().t == ["x", "x"]
