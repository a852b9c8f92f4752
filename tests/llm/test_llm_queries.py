"""The registered queries and the pipeline on Spark: SQL, brute force, and odd inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwick.llm import decontaminate, deleted_interpolation, html_text, neighbours, packing, repetition, simple8b, toxicity, url_rules, weighted_minhash
from tarnwick.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0d]+")
CLASH = "doc_id long, text string, _id long, _text string, part string, rules int, vote string, kept string, n_words int, c0 string"
LONG = " ".join(f"word{k}" for k in range(40_000))
ODD_ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, LONG), (6, "same text " * 40), (7, "same text " * 40), (7, "same text " * 40), (9, "É ß 你好 #$%"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 5, "x", "p", 1, "v", "k", 2, "c") for r in ODD_ROWS], CLASH).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, duck, same, name):
    same(QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name]).fetch_df())


def tokenizer():
    from tokenizers import Tokenizer

    from tarnwick.llm.tokenizing import default_path

    return Tokenizer.from_file(default_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_simple8b_query(spark, sf_dir, docs):
    t, at = tokenizer(), 0
    got = {r.doc_id: r for r in QUERIES["op10_simple8b"](spark, sf_dir).collect()}
    for r in docs.sort_values("doc_id").itertuples():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not got


def check_pieces(pieces, wanted, window=4096):
    """Each id lies in one piece, sequences have no gaps, only the last is short."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(wanted)
    for doc, ps in by_doc.items():
        ids, at = wanted[doc], 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or s == len(by_seq) - 1 and at <= window


def test_packing_query(spark, sf_dir, docs):
    t = tokenizer()
    wanted = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.itertuples()}
    check_pieces(QUERIES["op8_packing"](spark, sf_dir).collect(), wanted)


def test_language_model_query(spark, sf_dir, docs):
    got = {r.doc_id: r for r in QUERIES["op9_deleted_interpolation"](spark, sf_dir).collect()}
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    tokens = {r.doc_id: [*WORD.findall(lower(r.text or "")), None] for r in docs.itertuples()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    assert set(got) == set(tokens)
    better = 0.0
    for d, ws in tokens.items():
        g = got[d]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(g.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isfinite(g.score) and g.score < 0
        better += (g.score - g.base_score) * held[d]
    assert better > 0


def test_near_duplicates_query(spark, sf_dir, docs):
    got = {r.doc_id: r.cluster_id for r in QUERIES["op1_weighted_minhash"](spark, sf_dir).collect()}

    def shingles(t):
        w = WORD.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {r.doc_id: shingles(r.text or "") for r in docs.itertuples()}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys, near = sorted(sets), {}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= 0.7:
                near[a, b] = both / len(sets[a] | sets[b])
    for (a, b), j in near.items():
        if j >= 0.85:  # well over the threshold by plain Jaccard: linked
            assert got[a] == got[b]
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    for d in keys:  # nothing is linked that is not connected at 0.7 at least
        assert root(d) == root(got[d])
        assert got[got[d]] == got[d] <= d


def test_clusters_across_blocks(spark):
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):  # a chain: neighbours are alike, the ends are not
        base[k * 2] = f"x{k}"
        rows.append((1000 + k, " ".join(base)))
    rows += [(k, " ".join(f"u{k}v{j}" for j in range(60))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block in (512, 8):
        got = {r.doc_id: r.cluster_id for r in weighted_minhash.near_duplicates(df, block=block).collect()}
        assert {got[1000 + k] for k in range(60)} == {1000}
        assert all(got[k] == k for k in range(20))


def test_toxicity_and_quality_queries(spark, sf_dir):
    for name, modulus, held in (("op6_toxicity", 4, 2), ("op7_neighbours", 5, 0)):
        got = QUERIES[name](spark, sf_dir).toPandas()
        assert sorted(got.columns) == ["doc_id", "held_out", "predicted", "score"]
        assert got.score.between(0, 1).all() and ((got.score >= 0.3) == got.predicted).all()
        assert [zlib.crc32(str(d).encode()) % modulus == held for d in got.doc_id] == got.held_out.tolist()


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (6, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "same text " * 7)], "item_id long, text string")
    n = len(ODD_ROWS)
    r = repetition.repetition_rules(odd)
    assert r.columns[:-1] == odd.columns and r.columns[-1] == "_rules"
    assert {(x.doc_id, x["_rules"].n_words, x["_rules"].kept) for x in r.collect()} == {(1, 0, False), (2, 0, False), (3, 0, False), (4, 3, False), (5, 40_000, True), (6, 80, False), (7, 80, False), (9, 4, False)}
    for lab in (labels, none):
        q = neighbours.score_quality(odd, lab)
        assert q.columns == [*odd.columns, "_vote"] and q.count() == n
        assert toxicity.score_toxicity(odd, lab).count() == n
    c = {(x.doc_id, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in decontaminate.contamination(odd, items).collect()}
    assert c == {(1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 3, 3, 1, True), (5, 40_000, 0, 0, False), (6, 80, 80, 1, True), (7, 80, 80, 1, True), (9, 3, 0, 0, False)}
    assert decontaminate.contamination(odd, items.limit(0)).filter("contaminated").count() == 0
    assert {x.doc_id: x.text for x in decontaminate.remove_spans(odd, items).collect()}[4] == ""
    d = {(x.doc_id, x.cluster_id, x.kept) for x in weighted_minhash.near_duplicates(odd).collect()}
    assert d == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False), (9, 9, True)}
    kept = weighted_minhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(x.doc_id for x in kept.collect()) == [1, 2, 3, 4, 5, 6, 9]
    pieces = packing.pack(odd, window=64).collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.starts_document) and len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    with_ids = packing.pack(odd, window=64, with_ids=True).collect()
    assert all(len(p.ids) == p.length for p in with_ids)
    assert simple8b.tokenize_to_segments(odd).count() == n
    lm = {x.doc_id: x for x in deleted_interpolation.score(odd).collect()}
    assert (lm[1].n_tokens, lm[2].n_tokens, lm[4].n_tokens) == (1, 1, 4)
    for made in (
        repetition.repetition_rules(empty), neighbours.score_quality(empty, labels), toxicity.score_toxicity(empty, labels), decontaminate.contamination(empty, items),
        weighted_minhash.near_duplicates(empty), weighted_minhash.keep_first(empty), packing.pack(empty), simple8b.tokenize_to_segments(empty), deleted_interpolation.score(empty),
    ):
        assert made.count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.cluster_id, r.kept) for r in weighted_minhash.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, True), (None, None, True), (None, None, True)]
    assert weighted_minhash.keep_first(df).count() == 3
    assert packing.pack(df).count() == 3 and deleted_interpolation.score(df).count() == 3
    ids = sorted(((r.doc_id, r.start, r.n_tokens) for r in simple8b.tokenize_to_segments(df).collect()), key=lambda r: r[1])
    assert [r[0] for r in ids] == [None, None, 1] and [r[1] for r in ids] == [0, ids[0][2], ids[0][2] + ids[1][2]]
    words = df.select(F.when(F.col("doc_id").isNotNull(), "x7").alias("doc_id"), "text")  # ids that aren't integers
    assert [r.doc_id for r in simple8b.tokenize_to_segments(words).collect()] == [None] * 3
    labels, items = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for made in (repetition.repetition_rules(df), neighbours.score_quality(df, labels), toxicity.score_toxicity(df, labels), decontaminate.contamination(df, items)):
        assert made.count() == 3


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, _host string, host string, text string"
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "<p>x</p>"), (4, "HTTP://A.Example.NET/en/x?y", "<article>é &amp; b</article>"), (4, "HTTP://A.Example.NET/en/x?y", "<article>é &amp; b</article>"), (None, "://cheap-pills.net/", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame([(*r, "h", "h", "t") for r in rows], schema)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got[4, "HTTP://A.Example.NET/en/x?y"] == ("é & b", 5) and got[1, None] == ("", 0)
    assert html_text.extract(pages, chunk_bytes=1, range_rows=1).count() == len(rows)
    urls = {(r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in url_rules.judge_urls(pages).collect()}
    assert (4, "a.example.net", "/en/x", "example.net/en/", "allow", None) in urls
    assert (1, "", "", None, "allow", None) in urls and (3, "", "", None, "allow", None) in urls
    assert (None, "cheap-pills.net", "/", "net/", "block", r"\bcheap-pills\b") in urls
    assert url_rules.judge_urls(pages.limit(0)).count() == html_text.extract(pages.limit(0)).count() == 0
    assert url_rules.judge_urls(pages, (), ()).filter("verdict = 'allow'").count() == len(rows)


def test_pipeline(spark, sf_dir, docs):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, frame, sf_dir)
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids = {r.doc_id for r in made.select("doc_id").collect()}
        assert ids and (before is None or ids <= before)
        if name == "quality_rules":
            judged = QUERIES["op2_repetition"](spark, sf_dir)
            assert ids == {r.doc_id for r in judged.filter("kept").collect()}
        if name == "decontamination":
            hit = decontaminate.contamination(frame, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated")
            assert ids == before - {r.doc_id for r in hit.collect()}
        frame, before = made, ids
    t = tokenizer()
    wanted = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.itertuples() if r.doc_id in before}
    check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), wanted)


def test_pipeline_of_nothing(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf_dir)
    assert frame.count() == 0
