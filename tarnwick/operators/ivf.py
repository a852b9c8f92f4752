"""Nearest neighbours through an inverted file with residual product codes.

Vectors are filed under the nearest of a few centroids, with a code of their difference from it: a byte for each subspace. A
query probes the lists of its nearest centroids; in each, codes give a shortlist by table look-ups, and the shortlist is
compared exactly. Centroids are learned from all vectors by sums a round; codes from a bounded sample of differences. Long
lists are kept in parts, so that no task gets all of a list that many equal vectors are in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.index import top
from tarnwick.operators.vector import _matrix
from tarnwick.sources.shared import stored, stored_buckets

#: Most centroids, codes of a subspace, sample for codes, rows of a list's part.
MAX_LISTS, CODES, SAMPLE, PART_ROWS = 4096, 256, 16_384, 65_536


@dataclass(frozen=True)
class VectorIndex:
    """lists: (list, part, id, code, vector); centroids (lists, dims), books (subspaces, codes, dims of one), parts of each list."""

    lists: DataFrame
    centroids: np.ndarray
    books: np.ndarray
    parts: np.ndarray

    @property
    def n_lists(self) -> int:
        return len(self.centroids)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(m: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    far = (centroids**2).sum(axis=1) - 2 * (m @ centroids.T)
    if n == 1:
        return far.argmin(axis=1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Plain k-means of a sample, from evenly spaced rows; an empty class keeps its centre."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, c)[:, 0]
        n = np.bincount(own, minlength=len(c))
        for j in range(x.shape[1]):
            c[n > 0, j] = (np.bincount(own, weights=x[:, j], minlength=len(c)) / np.maximum(n, 1))[n > 0]
    return c


def _centroids(rows: DataFrame, dims: int, n_lists: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds over all rows: each task adds up what is nearest to each centroid, Spark adds up the tasks."""
    spark = rows.sparkSession
    c = _unit(_matrix(rows.orderBy(F.xxhash64("id"), "id").limit(n_lists).toArrow().column("vector").combine_chunks(), dims))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(c)

        def sums(batches):
            total, n = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)  # noqa: B023
            for b in batches:
                m = _unit(_matrix(b.column(1), dims))
                own = nearest(m, shared.value)[:, 0]  # noqa: B023
                np.add.at(total, own, m)
                n += np.bincount(own, minlength=len(n))
            some = np.flatnonzero(n)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(some.size + 1) * dims, pa.int32()), pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some), flat, pa.array(n[some])], ["list", "s", "n"])

        added = rows.mapInArrow(sums, "list long, s array<double>, n long").groupBy("list").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(j))) for j in range(dims))).alias("s")).toArrow()
        shared.destroy()
        c = c.copy()
        c[added.column("list").to_numpy()] = _matrix(added.column("s").combine_chunks(), dims) / added.column("n").to_numpy()[:, None]
    return c


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", n_lists: int | None = None, rounds: int = 4, subspace: int = 8) -> VectorIndex:
    """Null vectors, and those of another than the commonest length, are left out. n_lists: else the root of the number of vectors, at most
    MAX_LISTS. An empty table gives an index of no lists."""
    spark = vectors.sparkSession
    shape = vectors.filter(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    kind = vectors.schema[id_col].dataType.simpleString()
    if shape is None or not shape["d"]:
        return VectorIndex(spark.createDataFrame([], f"list int, part int, id {kind}, code binary, vector array<double>"), np.zeros((0, 1)), np.zeros((0, 0, 1)), np.zeros(0, np.int64))
    dims, n = shape["d"], shape["count"]
    rows = vectors.filter(F.size(vector_col) == dims).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    c = _centroids(rows, dims, min(MAX_LISTS, n_lists or max(1, int(n**0.5))), rounds)
    width = next(w for w in range(min(subspace, dims), 0, -1) if dims % w == 0)
    x = _unit(_matrix(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("vector").combine_chunks(), dims))
    x = x - c[nearest(x, c)[:, 0]]
    books = np.stack([_means(x[:, k : k + width], CODES) for k in range(0, dims, width)])
    shared = spark.sparkContext.broadcast((c, books))

    def encode(batches):
        c, books = shared.value
        for b in batches:
            m = _unit(_matrix(b.column(1), dims))
            own = nearest(m, c)[:, 0]
            rest = m - c[own]
            code = np.stack([nearest(rest[:, k * width : (k + 1) * width], book)[:, 0] for k, book in enumerate(books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), pa.array([r.tobytes() for r in code], pa.binary()), b.column(1)], ["list", "id", "code", "vector"])

    filed = stored(rows.mapInArrow(encode, f"list int, id {kind}, code binary, vector array<double>"), "vectors")
    sizes = filed.groupBy("list").count().toArrow()  # a row a list
    parts = np.zeros(len(c), np.int64)
    parts[sizes.column("list").to_numpy()] = -(-sizes.column("count").to_numpy() // PART_ROWS)
    by_list = F.lit(1) if parts.max() <= 1 else F.get(F.array(*map(F.lit, parts.tolist())), F.col("list"))
    cut = filed.withColumn("part", F.pmod(F.xxhash64("id"), by_list).cast("int")).select("list", "part", "id", "code", "vector")
    return VectorIndex(stored_buckets(cut, "lists", "list", "part"), c, books, parts)


def search(index: VectorIndex, queries: DataFrame, k: int = 30, probes: int | None = None, shortlist: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "qid") -> DataFrame:
    """(query_id, id_col, score, rank): cosine, 0 at least, to six places; ties by id.

    probes: lists that a query looks into, else all. shortlist: vectors of a list's part that are compared exactly, by their
    codes' nearness, else all. With neither the answer is that of an exhaustive search.
    """
    spark = index.lists.sparkSession
    kinds = {"q": queries.schema[query_id].dataType.simpleString(), "id": index.lists.schema["id"].dataType.simpleString()}
    schema = f"{query_id} {kinds['q']}, {id_col} {kinds['id']}, score double"
    if not index.n_lists:
        return spark.createDataFrame([], schema + ", rank int")
    dims = index.centroids.shape[1]
    n_probes = min(probes or index.n_lists, index.n_lists)
    shared = spark.sparkContext.broadcast((index.centroids, index.books, index.parts))

    def route(batches):
        """A row for each part of each list that a query looks into."""
        c, _, parts = shared.value
        for b in batches:
            for s in range(0, b.num_rows, 256):
                cut = b.slice(s, 256)
                lists = nearest(_unit(_matrix(cut.column(1), dims)), c, n_probes)
                q = np.repeat(np.arange(len(lists)), lists.shape[1])
                lists = lists.ravel()
                n = parts[lists]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q = pa.array(np.repeat(q, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lists, n).astype(np.int32)), pa.array(part.astype(np.int32)), cut.column(0).take(q), cut.column(1).take(q)], ["list", "part", "q", "qv"])

    asked = queries.filter(F.size(vector_col) == dims).select(F.col(query_id).alias("q"), F.col(vector_col).cast("array<double>").alias("qv"))
    routed = asked.mapInArrow(route, f"list int, part int, q {kinds['q']}, qv array<double>")

    def compare(asked: pa.Table, filed: pa.Table) -> pa.Table:
        c, books, _ = shared.value
        q, v = _unit(_matrix(asked.column("qv").combine_chunks(), dims)), filed.column("vector").combine_chunks()
        qids, ids, out = asked.column("q").combine_chunks(), filed.column("id").combine_chunks(), ([], [], [])
        if len(q) and len(ids):
            m, width = _unit(_matrix(v, dims)), books.shape[2]
            code = np.frombuffer(b"".join(filed.column("code").to_pylist()), np.uint8).reshape(len(ids), -1) if shortlist and shortlist < len(ids) else None
            own = filed.column("list")[0].as_py()
            for s in range(0, len(q), 256):
                block = q[s : s + 256]
                if code is None:
                    near = np.round(np.maximum(block @ m.T, 0), 6)
                else:
                    near = np.full((len(block), len(ids)), -1.0)
                    for j, one in enumerate(block):
                        tables = np.einsum("mcw,mw->mc", books, one.reshape(-1, width))  # of each code, its share of the product
                        rough = one @ c[own] + tables[np.arange(len(books)), code].sum(axis=1)
                        at = np.argpartition(-rough, shortlist)[:shortlist]
                        near[j, at] = np.round(np.maximum(m[at] @ one, 0), 6)
                n = min(k, near.shape[1])
                least = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n]
                a, b = np.nonzero((near >= least[:, None]) & (near >= 0))  # ties at the limit stay, for the final order to settle
                for held, found in zip(out, (a + s, b, near[a, b]), strict=True):
                    held.append(found)
        a, b, score = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table([qids.take(pa.array(a.astype(np.int64))), ids.take(pa.array(b.astype(np.int64))), pa.array(score, pa.float64())], [query_id, id_col, "score"])

    found = routed.groupBy("list", "part").cogroup(index.lists.groupBy("list", "part")).applyInArrow(compare, schema)
    return top(found, k, key=query_id, tie=id_col)
