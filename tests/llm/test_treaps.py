"""Treaps against brute force: their shape, what a walk scores, and the ranking of odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarnwick.llm import treaps
from tarnwick.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def ranked(docs, items, k=10):
    """Scores in plain integers: (item, rank, doc, score)."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 10 + (90 * b.total() * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 8 * m)) for w in set(terms(text)) if b[w])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query(spark, sf_dir, duck, same):
    same(QUERIES["op12_inverted_treaps"](spark, sf_dir), duck.execute(ORACLES["op12_inverted_treaps"]).fetch_df())


def test_terms():
    texts = [None, "", "Abc-DÉF  x1", "--", "é\x7fß", "z" * 100_000 + " end"]
    flat, each = treaps.terms_of(pa.array(texts))
    assert [t.decode() for t in flat.to_pylist()] == [w for t in texts for w in terms(t)]
    assert each.tolist() == [len(terms(t)) for t in texts]


@pytest.mark.parametrize("kind", ["random", "equal", "rising", "falling"])
def test_treaps_are_trees_and_heaps(kind):
    make = {"random": lambda n: np.random.default_rng(n).integers(0, 9, n), "equal": lambda n: np.full(n, 5), "rising": np.arange, "falling": lambda n: np.arange(n)[::-1]}[kind]
    lists = [make(n) for n in (1, 2, 50, 3, 400, 1)]
    bounds = np.cumsum([0, *map(len, lists)])
    docs, impacts = np.concatenate([np.arange(len(x)) * 3 for x in lists]), np.concatenate(lists)
    order, left, size = treaps.preorder(impacts, docs, bounds)
    deepest = 0
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        stack, seen = [(a, -1, 10**9, 10**9, 0)], 0
        while stack:
            at, low, high, most, depth = stack.pop()
            deepest, seen = max(deepest, depth), seen + 1
            d, x = docs[order[at]], impacts[order[at]]
            assert low < d < high and x <= most
            if left[at]:
                stack.append((at + 1, low, d, x, depth + 1))
            if size[at] - 1 - left[at]:
                stack.append((at + 1 + left[at], d, high, x, depth + 1))
        assert seen == z - a == size[a]
    assert kind != "equal" or deepest < 40  # equal impacts make no chain


def test_many_shards_and_blocks(spark):
    pick = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(pick.choices(words, weights=[1 / (j + 1) for j in range(60)], k=pick.randrange(1, 80)))) for k in range(500)]
    docs += [(None, "w1 w2 w50"), (None, None), (7, ""), (7, "w59 w59"), (900, "w3 " * 30_000), *((1000 + k, docs[3][1]) for k in range(40))]
    items = [(k, " ".join(pick.choices(words, k=12))) for k in range(15)] + [(3, "w59 W59 w0"), (None, "w58"), (99, None), (98, "nowhere"), (97, "--")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, CHUNK int").repartition(5)
    i = spark.createDataFrame([(*r, 1.0) for r in items], "item_id long, text string, score double")
    want = ranked(docs, items)
    index = treaps.build(d, shard_bytes=2000, shard_docs=30)
    assert found(treaps.search(index, i)) == want
    assert found(treaps.search(index, i, max_pairs=20)) == want
    assert index.lists.filter("term is null").count() > 10


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treaps.search(treaps.build(d.limit(0)), i).collect() == []
    assert treaps.search(treaps.build(d), i.limit(0)).collect() == []
    assert found(treaps.search(treaps.build(d), i)) == ranked([(1, "a b")], [(1, "a")])


def test_a_walk_prunes():
    """Of many documents with a common term, those that can't be among the best are never scored."""
    rng = np.random.default_rng(0)
    n = 20_000
    common, rare = np.arange(n), np.sort(rng.choice(n, 40, replace=False))
    impacts = [rng.integers(1, 1000, n), rng.integers(500, 1000, 40)]
    docs, flat, bounds = np.concatenate([common, rare]), np.concatenate(impacts), np.array([0, n, n + 40])
    order, left, size = treaps.preorder(flat, docs, bounds)
    walk = treaps.Walk(docs[order], flat[order], left, size, 1, 10, np.zeros(1, np.int64))
    walk.run(np.zeros(2, np.int64), bounds[:2], np.array([10, 1000]), n)
    exact = 10 * impacts[0] + 1000 * np.bincount(rare, weights=impacts[1], minlength=n).astype(np.int64)
    best = np.lexsort((common, -exact))[:10]
    assert walk.doc.tolist() == best.tolist() and walk.score.tolist() == exact[best].tolist()
    assert walk.scored < 500
