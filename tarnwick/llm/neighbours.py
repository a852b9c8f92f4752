"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A document is a TF-IDF vector over hashed terms: its words, its words' shapes (letters as a or A,
digits as 0, runs collapsed) and a few terms for length and variety. A truncated singular value
decomposition of a bounded labelled sample gives the latent space; the sample's vectors are broadcast, and every
document's cosines with all of them are computed exactly, block by block, as matrix products. The nearest
neighbours vote with their similarity as weight.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import at, crc_bucket, free_name, plain
from tarnwick.llm.labelled import labelled_sample
from tarnwick.llm.words import Table, Words, slices

_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+")
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    return _RUN.sub(r"\1", _DIGIT.sub("0", _LOWER.sub("\x00", _UPPER.sub("A", word)).replace("\x00", "a")))


class Space:
    """Terms, weights and axes of the latent space, and the labelled vectors in it."""

    def __init__(self, dims: int = 4096, rank: int = 32, neighbours: int = 25, limit: int = 600_000):
        self.dims, self.rank, self.neighbours, self.limit = dims, rank, neighbours, limit
        self.table, self.terms = Table(), np.zeros((0, 2), np.int32)
        self.shapes = dims // 4  # shapes have a range of hashes of their own, so that words don't drown them

    def __getstate__(self):
        return self.__dict__ | {"table": Table(), "terms": np.zeros((0, 2), np.int32)}

    def term(self, word: str) -> tuple[int, int]:
        return zlib.crc32(shape(word).encode()) % self.shapes, self.shapes + zlib.crc32(word.lower().encode()) % (self.dims - self.shapes - 64)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Dense term counts (float32), one row a text."""
        words, rows = Words(column), len(column)
        if self.table.n > self.limit:
            self.table, self.terms = Table(), np.zeros((0, 2), np.int32)
        codes = self.table.lookup(words.hashes)
        missing = np.flatnonzero(codes < 0)
        if missing.size:
            new, first = np.unique(words.hashes[missing], return_index=True)
            self.table.insert(new)
            self.terms = np.concatenate([self.terms, np.array([self.term(w) for w in words.strings(missing[first])], np.int32)])
            codes[missing] = self.table.lookup(words.hashes[missing])
        doc = np.repeat(np.arange(rows), words.counts)
        places = self.terms[codes] + (doc * self.dims)[:, None]
        out = np.bincount(places.ravel(), minlength=rows * self.dims).reshape(rows, self.dims).astype(np.float32)
        n = words.counts
        distinct = np.bincount(np.unique(doc * (self.table.n + 1) + codes) // (self.table.n + 1), minlength=rows)
        k = np.arange(rows)
        out[k, self.dims - 64 + np.minimum(15, np.frexp(n)[1])] += 1 + n  # length
        out[k, self.dims - 48 + 15 * distinct // np.maximum(n, 1)] += 1 + n  # share of distinct words
        lines = [[x for x in (t or "").split("\n") if x] for t in column.to_pylist()]
        out[k, self.dims - 32 + np.array([15 * len(set(x)) // len(x) if x else 15 for x in lines], np.int64)] += 1 + n  # of distinct lines
        return out

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        # shares rather than counts, so that short and long texts of a kind are near each other; in place, as it is large
        counts *= 100 / np.maximum(counts[:, : self.shapes].sum(axis=1, keepdims=True), 1)
        np.log1p(counts, out=counts)
        counts *= self.idf
        return counts

    def vectors(self, texts: pa.Array) -> np.ndarray:
        v = self.weigh(self.counts(texts)) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def fit(self, texts: list[str], labels: list[int]) -> Space:
        self.labels = np.array(labels, np.float32)
        self.prior = float((self.labels.sum() + 1) / (len(labels) + 2))
        column = pa.array(texts, pa.string())
        x = np.concatenate([self.counts(column.slice(k, n)) for k, n in slices(column, rows=512)])
        self.idf = np.log((1 + len(texts)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
        x = self.weigh(x)
        rank = min(self.rank, *x.shape) if x.size else 0
        basis = np.random.default_rng(0).standard_normal((self.dims, min(rank + 16, max(1, min(x.shape))))).astype(np.float32)
        for _ in range(4):  # subspace iteration
            q, _ = np.linalg.qr(x @ basis)
            basis = x.T @ q
        _, _, vt = np.linalg.svd(basis.T, full_matrices=False)
        self.axes = np.ascontiguousarray(vt[:rank].T)
        v = x @ self.axes
        self.known = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        return self

    def vote(self, texts: pa.Array, without: np.ndarray | None = None) -> np.ndarray:
        """Share of the nearest neighbours' weight that label 1 has; `without`: own places to leave out, for training rows."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        v = self.vectors(texts)
        near = v @ self.known.T
        if without is not None:
            near[np.arange(len(texts)), without] = -2
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** 8
        score = ((weight * self.labels[top]).sum(axis=1) + 0.5 * self.prior) / (weight.sum(axis=1) + 0.5)
        return np.where(np.abs(v).sum(axis=1) > 0, score, self.prior)


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 5, held_out: int = 0, train_rows: int = 4_000, train_bytes: int = 64_000_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with struct column `vote` (held_out boolean, score double, predicted int); other columns stay as they are.

    Learns from at most `train_rows` labelled documents of `train_bytes` in all, outside the held-out remainder: a bounded
    sample, so the broadcast is `train_rows` x 32 numbers. Empty and null texts are vectors of their length terms alone;
    without labels every score is 0.5. Rows are scored one by one: repeated rows score alike, null ids are scored like
    others, an empty table has no rows, and a very long text is scored whole. If `docs` has a column `vote` in whatever
    case, ours is the last column, `_vote`.
    """
    spark = docs.sparkSession
    space = Space()
    texts, y = labelled_sample(docs, labels, label_col, modulus, held_out, train_rows, id_col, text_col, train_bytes)
    if y:
        space.fit(texts, y)
    else:
        space.labels, space.prior = np.zeros(0, np.float32), 0.5
    shared = spark.sparkContext.broadcast(space)
    numbered, text = plain(docs), at(docs, text_col)

    def apply(batches):
        s = shared.value
        for b in batches:
            for k, n in slices(b.column(text), rows=512):
                cut = b.slice(k, n)
                score = s.vote(cut.column(text)).astype(np.float64)
                made = pa.StructArray.from_arrays([cut.column(b.num_columns - 1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["held_out", "score", "predicted"])
                yield pa.RecordBatch.from_arrays([*cut.columns[:-1], made], [*b.schema.names[:-1], "vote"])

    rows = numbered.withColumn("_held", crc_bucket(F.col(f"c{at(docs, id_col)}"), modulus) == held_out)
    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(numbered.schema)) + ", vote struct<held_out:boolean,score:double,predicted:int>"
    return rows.mapInArrow(apply, schema).toDF(*docs.columns, free_name(docs, "vote"))


def passing(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that score_quality() predicts to be of label 1, with their columns; `options` are its parameters."""
    scored, last = score_quality(docs, labels, **options), f"c{len(docs.columns)}"
    return plain(scored).filter(F.col(f"{last}.predicted") == 1).drop(last).toDF(*docs.columns)
