"""The hash-prefix forest against brute force: recall, exact scores, copies, odd vectors."""

import math

import numpy as np
import pytest

from tarnwick.llm import prefix_forest
from tarnwick.llm.queries import QUERIES


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


def nearest(vectors, query, k=5):
    """(score, id) of all others, nearest first."""
    scored = [(-cosine(vectors[query], v), i) for i, v in vectors.items() if i != query]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def answers(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in rows}
    got = answers(QUERIES["op11_prefix_forest"](spark, sf_dir))
    assert got.keys() == {i for i in vectors if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        want = nearest(vectors, q)
        hits += len({i for i, _ in want} & {i for i, _ in found})
        assert len(found) == 5 and all(abs(s - cosine(vectors[q], vectors[i])) < 1e-12 for i, s in found)
    assert hits >= 0.9 * 5 * len(got)


@pytest.fixture(scope="module")
def many(spark):
    """12,000 vectors in one partition, so that shards are full, a third of them copies of one."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((12_000, 48)).astype(np.float32)
    x[rng.random(12_000) < 1 / 3] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return x.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)


def test_recall_of_full_shards(many):
    x, df = many
    made = prefix_forest.search(prefix_forest.build(df, shard_rows=3000), df.filter("vec_id % 50 = 0"), visits=0.75, least_visits=0)
    got, unit = answers(made), x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 50):
        s = unit @ unit[q]
        s[q] = -9
        worst = np.sort(s)[-5]
        hits += sum(v >= worst - 1e-9 for _, v in got[q])
    assert hits >= 0.9 * 5 * len(got)
    copy = next(q for q in got if q and (x[q] == x[0]).all())
    same = [k for k in range(len(x)) if (x[k] == x[0]).all() and k != copy][:5]
    assert [i for i, _ in got[copy]] == same  # of copies the smallest ids


def test_ranges_ascend_in_step():
    rng = np.random.default_rng(0)
    trees = np.sort(rng.integers(0, 1 << 32, (4, 500), dtype=np.uint64).astype(np.uint32), axis=1)
    asked = rng.integers(0, 1 << 32, (20, 4), dtype=np.uint64).astype(np.uint32)
    for wanted in (1, 40, 10**9):
        low, high = prefix_forest.ascended(trees, asked, wanted)
        for q in range(20):
            for depth in range(32, -1, -1):
                held = [[k for k in range(500) if int(trees[t, k]) >> (32 - depth) == int(asked[q, t]) >> (32 - depth)] for t in range(4)]
                if sum(map(len, held)) >= min(wanted, 2000):
                    break
            assert [list(range(low[q, t], high[q, t])) for t in range(4)] == held


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.5])]
    rows += [(9, [-1.0, 0.0]), (9, [1.0, 0.1]), (100, [3.0, 4.0, 0.0]), (150, [0.0]), (10, [1e200, 1e200]), (11, [1e-200, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, dims string").repartition(3)
    got = answers(prefix_forest.search(prefix_forest.build(df), df.filter("vec_id % 50 = 0")))
    assert got.keys() == {0, 50, 100}
    assert [i for i, _ in got[0]] == [1, 11, 9, 10, 50]
    assert [i for i, _ in got[50]] == [10, 9, 0, 1, 11]
    assert got[100] == [(8, pytest.approx(0.6))]
    assert prefix_forest.search(prefix_forest.build(df.limit(0)), df).collect() == []
    assert prefix_forest.search(prefix_forest.build(df), df.limit(0)).collect() == []


def test_blocks_of_queries(many):
    _, df = many
    some = df.filter("vec_id < 600")
    forest = prefix_forest.build(some)
    asked = some.filter("vec_id % 50 = 0")
    assert answers(prefix_forest.search(forest, asked, max_bytes=2000)) == answers(prefix_forest.search(forest, asked))
