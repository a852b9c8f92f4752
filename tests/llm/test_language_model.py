"""The language model against a brute-force model that counts every n-gram of every word."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from tarnwick.llm import deleted_interpolation as di

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute_force(texts):
    """Score of each text by the formula, with counts in dictionaries."""
    part = {d: {2: 0, 3: 2}.get(zlib.crc32(str(d).encode()) % 7, 1) for d in texts}
    tokens = {d: [*WORD.findall(t.lower()), "</s>"] for d, t in texts.items()}

    def counts(parts):
        c1, c2, c3, starts = Counter(), Counter(), Counter(), 0
        for d, ws in tokens.items():
            if part[d] in parts:
                starts += 1
                padded = ["<s>", "<s>", *ws]
                c1.update(ws)
                c2.update(zip(padded[1:], padded[2:], strict=False))
                c3.update(zip(padded, padded[1:], padded[2:], strict=False))
        c1_context = c1 + Counter({"<s>": starts})
        return c1, c1_context, c2, c3, sum(c1.values())

    def estimate(d, model):
        c1, before, c2, c3, n = model
        padded = ["<s>", "<s>", *tokens[d]]
        for u, v, w in zip(padded, padded[1:], padded[2:], strict=False):
            pair = c2[u, v]
            context = (pair or max(before[v], 1)) / max(n, 1)
            bucket = int(min(max(math.log2(context) + 20, 0), di.BUCKETS // 2 - 1)) + (di.BUCKETS // 2 if pair else 0)
            yield bucket, c3[u, v, w] / pair if pair else 0.0, c2[v, w] / before[v] if before[v] else 0.0, c1[w] / max(n, 1)

    main, every = counts({1}), counts({1, 2})
    held = Counter()
    for d in tokens:
        if part[d] == 2:
            for b, *f in estimate(d, main):
                held[b, *(int(x) for x in di._level(np.array(f)))] += 1
    keys = sorted(held)
    number = [((b * di.LEVELS + x) * di.LEVELS + y) * di.LEVELS + z for b, x, y, z in keys]
    weights = di.learn_weights(np.array(number, np.int64), np.array([held[k] for k in keys], np.int64), 1 / (len(main[0]) + 1))
    out = defaultdict(float)
    for d in tokens:
        for b, *f in estimate(d, every):
            out[d] += math.log10(float(np.dot(weights[b], [*f, 1 / (len(every[0]) + 1)])))
    return out, every[-1], len(every[3])


@pytest.fixture(scope="module")
def texts():
    """About 400,000 tokens (well above the 250,000 from which n-grams were once dropped), most of rare words in fixed phrases."""
    r = random.Random(5)
    phrases = [" ".join(f"w{r.randrange(30_000)}" for _ in range(6)) for _ in range(12_000)]
    return {d: " ".join(r.choice(phrases) for _ in range(r.randrange(90, 130))) for d in range(700)}


def test_every_ngram_counts(spark, texts):
    wanted, n, trigrams = brute_force(texts)
    assert n > 300_000 and trigrams > 100_000
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for settings in ({}, {"chunk_bytes": 200_000, "range_rows": 20_000}):  # in one piece or in many, the counts are the corpus's
        got = {x.doc_id: x.score for x in di.score(df, **settings).collect()}
        assert got.keys() == wanted.keys()
        assert all(math.isclose(got[d], wanted[d], rel_tol=1e-9) for d in got)


def test_rare_words_have_context(spark):
    """A word of far less than 1e-4 of all tokens keeps its own n-grams: their order counts."""
    r = random.Random(7)
    ids = [d for d in range(900) if zlib.crc32(str(d).encode()) % 7 != 2]
    held = [d for d in range(900) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    rows = [(d, " ".join(f"c{r.randrange(40)}" for _ in range(100))) for d in ids]
    rows += [(d, "zeta kappa sigma lambda") for d in ids[:4]] + [(held[0], "zeta kappa sigma lambda"), (held[1], "lambda sigma kappa zeta")]
    got = {x.doc_id: x.score for x in di.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).filter(F.col("doc_id").isin(held)).collect()}
    assert got[held[0]] > got[held[1]] + 3
