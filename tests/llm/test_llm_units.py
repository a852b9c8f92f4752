"""Algorithms of the training-data operators against brute force, without Spark."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tarnwick.llm import deleted_interpolation as di
from tarnwick.llm import html_text, neighbours, packed, repetition, simple8b, toxicity, url_rules, weighted_minhash, words
from tarnwick.llm.common import WORD_RE
from tarnwick.llm.tokenizing import Encoder

ODD = ["it's DON'T 'Sword \"'tis <|endoftext|> x<|startoftext|>y ÉCOLE école ΣΑΣ İstanbul 12½ a_b ²x Ⅷ foo\x1cbar a\xa0b c zé́ don't.' ''' 's 'll", "", "  \n\t", "naïve,(hello)…—«oui»", "!!\x1c!! a'b'c'd'e 你好 世界。 ﬁ ǅ ß ẞ \x00 \x85 x\x85y", None, "x" * 5000, "The THE the. " * 300]


def test_words_are_those_of_the_pattern():
    w = words.Words(pa.array(ODD))
    lists = [WORD_RE.findall(t or "") for t in ODD]
    assert w.counts.tolist() == [len(x) for x in lists]
    flat = [x for ws in lists for x in ws]
    assert w.strings(np.arange(len(w))) == flat
    ids = {}
    assert [ids.setdefault(x, h) == h for x, h in zip(flat, w.hashes.tolist(), strict=True)] == [True] * len(flat)
    assert len(set(ids.values())) == len(ids)
    assert words.Words(pa.array(["ÀB cD"]), lower=True).strings([0, 1]) == ["Àb", "cd"]


def test_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 63, 5000, dtype=np.uint64))
    t = words.Table(64)
    for part in np.array_split(keys, 7):
        t.insert(part)
    assert t.lookup(keys).tolist() == list(range(keys.size))
    assert t.lookup(np.array([0xFFFFFFFFFFFFFFFF], np.uint64)).tolist() == [-1]


@pytest.mark.parametrize("limit", [2_000_000, 5])
def test_encoder_equals_the_library(limit):
    from tokenizers import Tokenizer

    from tarnwick.llm.tokenizing import default_path

    e, t = Encoder(limit=limit), Tokenizer.from_file(default_path())
    for _ in range(2):  # the second time from the cache, if it holds
        flat, sizes = e.encode_flat(pa.array(ODD), 7)
        ends = np.cumsum(sizes)
        for k, text in enumerate(ODD):
            assert flat[ends[k] - sizes[k] : ends[k]].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 7]


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 40_000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 2 ** rng.integers(1, 17, n), dtype=np.uint64) if n else np.empty(0, np.uint64)
    for k, x in enumerate((2**60, 2**60 - 1, 2**64 - 1, 0, 2**30)):
        if n > 7 * k:
            v[7 * k] = np.uint64(x)
    w, at = simple8b.encode_words(v)
    assert (simple8b.decode_words(w, at, n) == v).all()
    ids, counts, back = simple8b.unpack_segment(simple8b.pack_segment([3, -1], [n, 0], v))
    assert ids.tolist() == [3, -1] and counts.tolist() == [n, 0] and (back == v).all()
    if n == 60:
        assert simple8b.encode_words(np.zeros(60, np.uint64))[0].size == 1


def test_damaged_segment():
    with pytest.raises(ValueError):
        simple8b.unpack_segment(b"\0" * 64)


def test_repeated_prefixes():
    random.seed(1)
    for _ in range(120):
        docs = [[random.randrange(random.choice([1, 2, 3, 9])) for _ in range(random.randrange(0, 30))] for _ in range(4)]
        m = random.choice([1, 2, 3, 4, 8])
        at, size = repetition.repeated_prefixes(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs]), m)
        wanted, before = {}, 0
        for d in docs:
            for i in range(len(d)):
                best = 0
                for j in range(len(d)):
                    k = 0
                    while i != j and max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                        k += 1
                    best = max(best, k)
                if best >= m:
                    wanted[before + i] = best
            before += len(d)
        assert dict(zip(at.tolist(), size.tolist(), strict=True)) == wanted


def test_suffix_classes():
    random.seed(2)
    for _ in range(200):
        codes = np.array([random.randrange(random.choice([2, 3, 9])) for _ in range(random.randrange(12, 60))], np.int64)
        m = random.choice([1, 2, 3, 5, 8, 10])
        at = np.array(sorted(random.sample(range(codes.size - m + 1), random.randrange(1, codes.size - m + 2))))
        runs = [tuple(codes[i : i + m].tolist()) for i in at]
        assert html_text.suffix_classes(codes, at, m).tolist() == [sorted(set(runs)).index(r) for r in runs]


def test_html_blocks():
    page = (
        '<body><header class="x"><h1>Site</h1></header><div id="sideBar">s</div><main><header><h1>T &amp; x&nbsp;y</h1></header><p>a < b<p>c <b>d</b>e'
        '<div class="comments"><div>no</div>no</div> f <script>if(a<b){"</div>"}</script>g<form>q</form></main>tail'
    )
    texts = lambda p: [t for t, _ in html_text.blocks(p)]
    assert " ".join(t for t, inside in html_text.blocks(page) if inside) == "T & x y a < b c de f g"
    assert [texts(p) for p in (None, "", "<p>x", "<!-- unclosed", "<script>never closed")] == [[], [], ["x"], [], []]
    # marks on paragraphs, items and headings, closed or not
    marked = '<article><p class="cookie-notice">we use cookies<p>one<br>two</p><ul><li class=share>share<li>three</ul><h3 id="comments-title">Comments</h3><dl><dt class="ad">x<dd>four</dl><p class="notice">n<div>five</div></article>'
    assert texts(marked) == ["one", "two", "three", "four", "five"]


def test_maximal_segments():
    random.seed(3)
    for _ in range(200):
        n = random.randrange(1, 14)
        at = sorted(random.sample(range(30), min(n, 12)))
        w = [random.choice([0.5, 1.0, 2.0, 3.0]) for _ in at]
        drift = random.choice([0.1, 0.3, 1.0])
        seq = [-drift] * (at[-1] + 1)
        for p, x in zip(at, w, strict=True):
            seq[p] = x
        best = max(sum(seq[a : b + 1]) for a in range(len(seq)) for b in range(a, len(seq)))
        segments = toxicity.maximal_segments(at, w, drift)
        assert abs(max(s for s, _, _ in segments) - best) < 1e-9
        assert all(abs(s - sum(seq[a : b + 1])) < 1e-9 for s, a, b in segments)
        assert all(x[2] < y[1] for x, y in zip(segments, segments[1:], strict=False))


def test_icws_estimates_weighted_jaccard():
    base = [f"w{k}" for k in range(300)]
    other = base[:]
    for k in random.Random(4).sample(range(300), 12):
        other[k] = f"x{k}"
    idf = weighted_minhash.Idf(np.zeros(0, np.uint64), np.zeros(0), 10, 1e-3)
    doc, h, w = weighted_minhash.shingles(words.Words(pa.array([" ".join(base), " ".join(other)])), idf)
    a, b = (dict(zip(h[doc == k].tolist(), w[doc == k].tolist(), strict=True)) for k in (0, 1))
    keys = a.keys() | b.keys()
    j = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    s = weighted_minhash.samples(doc, h, w, 2, 2000)
    assert abs((s[0] == s[1]).mean() - j) < 0.05


def test_links_spanning_forest():
    idf = weighted_minhash.Idf(np.zeros(0, np.uint64), np.zeros(0), 10, 1e-3)
    a = " ".join(f"w{k}" for k in range(200))
    texts = pa.array([a, a + " tail", "other words that are not alike at all", a + " end", ""])
    found = weighted_minhash.links(texts, np.full(5, 2), np.arange(5), idf, 0.8)
    assert len(found) == 2 and {x for e in found for x in e} == {0, 1, 3}
    assert weighted_minhash.links(texts, np.full(5, 2), np.zeros(5, int), idf, 0.8) == []
    assert weighted_minhash.links(texts, np.array([0, 0, 0, 0, 1]), np.arange(5), idf, 0.8) == []


def test_literal_tokens():
    assert url_rules.literal_tokens(r"\bcheap-pills\b") == ["cheap", "pills"]
    assert url_rules.literal_tokens(r"\bwin-prizes?\b") == ["win"]
    assert url_rules.literal_tokens(r"a|b") == []
    assert url_rules.literal_tokens(r"[?&]action=login\b") == ["login"]


def test_em_recovers_a_mixture():
    rng = np.random.default_rng(0)
    p3, p1 = np.array([0.5, 0.4, 0.1]), np.array([0.05, 0.15, 0.8])
    x = rng.choice(3, 20_000, p=0.7 * p3 + 0.3 * p1)
    keys, counts = np.unique((di._level(p3[x]) * di.LEVELS + di._level(np.zeros(x.size))) * di.LEVELS + di._level(p1[x]), return_counts=True)
    w = di.learn_weights(keys, counts, 1e-6)
    assert np.allclose(w.sum(axis=1), 1) and abs(w[0, 0] - 0.7) < 0.1 and abs(w[0, 2] - 0.3) < 0.1


def test_squeeze():
    x = np.random.default_rng(0).integers(0, 1 << 20, 1000)
    assert (packed.unsqueeze(packed.squeeze(x), 1000) == x).all()


def _auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("label, modulus, held, least", [("toxic", 4, 2, 0.9), ("quality", 5, 0, 0.95)])
def test_held_out_accuracy(label, modulus, held, least):
    pq = pytest.importorskip("pyarrow.parquet")
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    rows = docs.merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas(), on="doc_id")
    out = np.array([zlib.crc32(str(i).encode()) % modulus == held for i in rows.doc_id])
    train, test = rows[~out], rows[out]
    column = pa.array(list(test.text))
    if label == "toxic":
        m = toxicity.fit(list(train.text), list(train.toxic))
        s = np.array([x[0] for k, n in words.slices(column) for x in m.scores(column.slice(k, n))])
    else:
        m = neighbours.Space().fit(list(train.text), list(train.quality))
        s = np.concatenate([m.vote(column.slice(k, n)) for k, n in words.slices(column, rows=512)])
    y = test[label].to_numpy()
    assert _auc(y, s) > least
    assert ((s >= 0.3) == y).mean() > 0.95


def test_classifiers_without_labels():
    m = toxicity.fit([], [])
    assert [x[0] for x in m.scores(pa.array(["a b", None, ""]))] == [0.5] * 3
    s = neighbours.Space().fit(["only one"], [1])
    assert s.vote(pa.array(["x", None])).shape == (2,)
