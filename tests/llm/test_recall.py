"""Recall of near duplicates on the given tables: every pair of weighted similarity 0.8 or more, by an exact join over prefixes of shingles."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

from tarnwick.llm import weighted_minhash
from tarnwick.llm.words import Words, slices


def close_pairs(texts: pa.Array, idf, least: float = 0.8) -> list[tuple[int, int]]:
    """All pairs of different shingle sets with weighted Jaccard similarity of `least` or more. Two such sets share a shingle of either's prefix:
    its rarest shingles, up to the share of its weight that they may lack."""
    sets = []
    for k, n in slices(texts):
        doc, h, w = weighted_minhash.shingles(Words(texts.slice(k, n), lower=True), idf)
        cuts = np.searchsorted(doc, np.arange(n + 1))
        sets += [dict(zip(h[a:z].tolist(), w[a:z].tolist(), strict=True)) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    times = defaultdict(int)
    for s in sets:
        for x in s:
            times[x] += 1
    held, found, seen = defaultdict(list), [], {}
    for k, s in enumerate(sets):
        key = frozenset(s.items())
        if not s or key in seen:  # exact copies are linked by text
            continue
        seen[key] = k
        total, left, near = sum(s.values()), sum(s.values()), set()
        for x in sorted(s, key=lambda x: (times[x], x)):
            if left < least * total - 1e-6:
                break
            near.update(held[x])
            held[x].append(k)
            left -= s[x]
        for j in near:
            both = sum(min(w, sets[j].get(x, 0)) for x, w in s.items())
            if both >= (least + 1e-6) * (total + sum(sets[j].values()) - both):
                found.append((j, k))
    return found


def test_recall(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    table = docs.toArrow()
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").combine_chunks()
    pairs = close_pairs(texts, weighted_minhash.document_frequencies(docs, "text", 1e-3))
    of = {r["doc_id"]: r["cluster_id"] for r in weighted_minhash.near_duplicates(docs).collect()}
    caught = sum(of[ids[a]] == of[ids[b]] for a, b in pairs)
    print(f"{caught} of {len(pairs)} pairs")
    assert len(pairs) > 0 and caught >= 0.99 * len(pairs)
