"""Approximate nearest neighbours by cosine: a hash-prefix forest.

Vectors are indexed in shards of bounded size. A shard's forest has `trees` arrays, each with the long hash string of every
vector in ascending order: bit j of a string says on which side of a random hyperplane through the middle of the sample the
vector lies. A query descends in each tree to its longest matching prefix, then all trees ascend in step: prefixes get
shorter by a bit until their ranges hold as many candidates as wanted. All that the ranges hold is compared exactly, so
no bucket has a cap. Copies of a vector are one entry, with all their ids; a query takes as many as it can use.

Queries are broadcast in blocks of bounded size, and each shard answers with its k nearest, so that nothing but those rows is
shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import materialize, pick
from tarnwick.llm.packed import write_chunks
from tarnwick.llm.words import trim

TREES, BITS = 32, 32
#: Distinct vectors of a shard; rows that the middle is taken from; bytes of queries that a block may have.
SHARD_ROWS, SAMPLE_ROWS, MAX_QUERY_BYTES = 8192, 20_000, 64_000_000
#: Candidates that the trees together are asked for: a share of the shard's vectors, and so many at least. A vector that
#: several trees find counts several times.
VISITS, LEAST_VISITS = 0.75, 4096


@dataclass(frozen=True)
class Forest:
    """shards: (chunk, dims, part, ids, starts, vectors, strings, order); middles: by vector length, where to cut each hyperplane."""

    shards: DataFrame
    middles: dict


@lru_cache(8)
def planes(dims: int) -> np.ndarray:
    """Normals of all hyperplanes, (dims, TREES * BITS): random, orthogonal within blocks of `dims`."""
    rng = np.random.default_rng(dims)
    blocks = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-TREES * BITS // dims))]
    return np.concatenate(blocks, axis=1)[:, : TREES * BITS]


def strings(unit: np.ndarray, middles: dict) -> np.ndarray:
    """Hash strings of unit vectors, (n, TREES) numbers whose first bit is the highest."""
    n, dims = unit.shape
    out = np.empty((n, TREES), np.uint32)
    middle = middles.get(dims, 0.0)
    for k in range(0, n, 4096):
        bits = (unit[k : k + 4096] @ planes(dims)) > middle
        out[k : k + 4096] = np.packbits(bits.reshape(-1, TREES, BITS), axis=2).view(">u4")[:, :, 0]
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id, _v (doubles): rows with an id whose vectors have a direction, all components finite."""
    t = pick(df, _id=id_col, _v=vector_col).filter("_id is not null and size(_v) > 0")
    t = t.select("_id", F.col("_v").cast("array<double>").alias("_v"))
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return t.filter(fine & F.exists("_v", lambda x: x != 0))


def _matrices(batch_ids: pa.Array, column: pa.Array):
    """(length, ids, matrix) of a batch's vectors, by length."""
    sizes = pc.list_value_length(column).to_numpy()
    for d in np.unique(sizes).tolist():
        at = pa.array(np.flatnonzero(sizes == d))
        yield d, batch_ids.take(at), column.take(at).flatten().to_numpy().reshape(-1, d)


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """A forest of all usable vectors. Middles are medians over at most `sample_rows` vectors, those of the least id hashes."""
    t = usable(vectors, id_col, vector_col)
    kind = t.schema["_id"].dataType.simpleString()
    sample = t.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).toArrow()
    middles = {}
    if sample.num_rows:
        for d, _, m in _matrices(sample.column("_id").combine_chunks(), sample.column("_v").combine_chunks()):
            middles[d] = np.median(_unit(m) @ planes(d), axis=0)
    shared = vectors.sparkSession.sparkContext.broadcast(middles)

    def shard(chunk: int, d: int, ids: pa.Array, m: np.ndarray):
        m = np.ascontiguousarray(m + 0.0)  # minus zero is zero
        _, first, of = np.unique(m.view(np.dtype((np.void, m.itemsize * d))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((pc.rank(ids, tiebreaker="first").to_numpy(), of))
        m, starts = m[first], np.searchsorted(of[order], np.arange(first.size + 1))
        s = strings(_unit(m), shared.value)
        by = np.argsort(s, axis=0, kind="stable")
        ordered = np.take_along_axis(s, by, axis=0)
        as_list = lambda x, t: pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), t))
        own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        blob = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([d], pa.int32()), own, as_list(starts, pa.int32()), blob(m), blob(ordered.T.astype("<u4")), blob(by.T.astype("<i4"))], ["chunk", "dims", "ids", "starts", "vectors", "strings", "places"])

    def shards(batches):
        part, k, held = TaskContext.get().partitionId() << 32, 0, {}
        for b in batches:
            for d, ids, m in _matrices(b.column(0), b.column(1)):
                held.setdefault(d, []).append((ids, m))
                if sum(len(x) for x, _ in held[d]) >= shard_rows:
                    ids, m = pa.concat_arrays([x for x, _ in held[d]]), np.concatenate([x for _, x in held.pop(d)])
                    while len(ids) >= 2 * shard_rows:
                        yield shard(part + k, d, ids.slice(0, shard_rows), m[:shard_rows])
                        k, ids, m = k + 1, ids.slice(shard_rows), m[shard_rows:]
                    yield shard(part + k, d, ids, m)
                    k += 1
        for d, parts in held.items():
            yield shard(part + k, d, pa.concat_arrays([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
            k += 1

    made = t.mapInArrow(shards, f"chunk long, dims int, ids array<{kind}>, starts array<int>, vectors binary, strings binary, places binary")
    return Forest(write_chunks(made, "forest"), middles)


def ascended(trees: np.ndarray, asked: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), each (queries, trees): the ranges at the longest prefix at which a query's ranges hold `wanted` together.

    trees: (TREES, n), each ascending; asked: (queries, TREES). Depth is the same in all trees of a query.
    """
    q, n = asked.shape[0], trees.shape[1]
    none, every = np.zeros(q, np.int64), np.full(q, BITS)  # a prefix of none always holds all that there is

    def ranges(depth: np.ndarray):
        span = (np.uint64(1) << (np.uint64(BITS) - depth.astype(np.uint64)))[:, None] - np.uint64(1)
        base = asked.astype(np.uint64) & ~span
        low = np.stack([np.searchsorted(trees[t], base[:, t].astype(np.uint32), "left") for t in range(len(trees))], axis=1)
        high = np.stack([np.searchsorted(trees[t], (base | span)[:, t].astype(np.uint32), "right") for t in range(len(trees))], axis=1)
        return low, high

    least, most = none, every
    while (least < most).any():
        mid = (least + most + 1) // 2
        low, high = ranges(mid)
        enough = (high - low).sum(axis=1) >= min(wanted, n * len(trees))
        least, most = np.where(enough, mid, least), np.where(enough, most, mid - 1)
    return ranges(least)


def search(forest: Forest, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", visits: float = VISITS, least_visits: int = LEAST_VISITS, max_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), id_col, score: of each query its k nearest of those that the forest finds, itself left out.

    score is the cosine in doubles; ties go to the smaller id. Null vectors, and those that are zero, empty or hold null or
    non-finite components take no part on either side, nor do rows without id; vectors only meet others of their length. Rows
    that share an id are one candidate, by its nearest, and one query, by its least vector. Fewer than k candidates are all
    returned; empty tables have no rows. Other columns are not read.
    """
    spark = queries.sparkSession
    kind = forest.shards.schema["ids"].dataType.elementType.simpleString()
    q = usable(queries, id_col, vector_col).groupBy("_id").agg(F.min("_v").alias("_v"))
    size = q.agg(F.sum(F.size("_v") * 8 + 4 * TREES)).first()[0] or 0
    blocks = -(-size // max_bytes) or 1
    if blocks > 1:
        q = materialize(q, "queries")
    answers = [_block(spark, forest, (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b)).toArrow(), k, kind, visits, least_visits) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, answers).groupBy("query_id", "_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("_id").alias(id_col), "score")


def _block(spark, forest: Forest, asked: pa.Table, k: int, kind: str, visits: float, least_visits: int) -> DataFrame:
    by_length = {}
    if asked.num_rows:
        for d, ids, m in _matrices(asked.column("_id").combine_chunks(), asked.column("_v").combine_chunks()):
            by_length[d] = (ids, m + 0.0, strings(_unit(m), forest.middles))
    shared = spark.sparkContext.broadcast(by_length)

    def answer(group: pa.Table) -> pa.Table:
        d = group.column("dims")[0].as_py()
        ids, q, s = shared.value.get(d, (pa.array([]), np.empty((0, d)), np.empty((0, TREES), np.uint32)))
        starts = group.column("starts").combine_chunks().flatten().to_numpy()
        own = group.column("ids").combine_chunks().flatten()
        blob = lambda c, t: np.frombuffer(group.column(c)[0].as_buffer(), t)
        m = blob("vectors", np.float64).reshape(-1, d)
        n = m.shape[0]
        trees, places = blob("strings", "<u4").reshape(TREES, n), blob("places", "<i4").reshape(TREES, n)
        scale = np.abs(m).max(axis=1, keepdims=True)
        unit, q_unit = _unit(m), _unit(q) if len(q) else q
        norms = np.sqrt(((m / scale) ** 2).sum(axis=1))
        wanted = max(least_visits, int(visits * n))
        found: list = [[], [], []]
        for a in range(0, len(ids), 1024):
            low, high = ascended(trees, s[a : a + 1024], wanted)
            for j in range(low.shape[0]):
                near = np.zeros(n, bool)
                for t, (x, y) in enumerate(zip(low[j].tolist(), high[j].tolist(), strict=True)):
                    near[places[t, x:y]] = True
                at = np.flatnonzero(near)
                rough = unit[at] @ q_unit[a + j]
                if at.size > k + 1:  # one may be the query's own
                    limit = np.partition(rough, at.size - k - 1)[at.size - k - 1]
                    at = at[rough >= limit - 1e-9]
                v = q[a + j] / np.abs(q[a + j]).max()
                exact = ((m[at] / scale[at]) * v).sum(axis=1) / (norms[at] * np.sqrt((v * v).sum()))
                me, best = ids[a + j].as_py(), {}
                for i in np.argsort(-exact, kind="stable").tolist():
                    if len(best) >= k and exact[i] < min(best.values()):
                        break
                    e = at[i]
                    taken = 0
                    for other in own.slice(starts[e], starts[e + 1] - starts[e]):
                        other = other.as_py()
                        if other != me and other not in best:
                            best[other] = exact[i]
                            taken += 1
                        if taken == k:
                            break
                for other, x in sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]:
                    found[0].append(me)
                    found[1].append(other)
                    found[2].append(float(x))
        t = own.type
        trim()
        return pa.table([pa.array(found[0], t), pa.array(found[1], t), pa.array(found[2], pa.float64())], ["query_id", "_id", "score"])

    return forest.shards.groupBy("chunk").applyInArrow(answer, f"query_id {kind}, _id {kind}, score double")
