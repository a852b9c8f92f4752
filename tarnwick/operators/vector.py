"""Exact nearest neighbours by cosine: blocked matrix products, partial top-k per task, then one top-k per query."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.index import top
from tarnwick.sources.shared import stored

#: Bytes of query vectors that one broadcast may hold; more queries are answered in several runs over the corpus.
MAX_BROADCAST = 64 << 20


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return values.reshape(-1, dims)


def knn(corpus: DataFrame, queries: DataFrame, k: int = 30, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "qid") -> DataFrame:
    """(query_id, id_col, score, rank): cosine similarity, 0 at least, to six places; ties by id.

    Null vectors, and vectors of other than the queries' length, are left out on either side.
    """
    spark = corpus.sparkSession
    usable = queries.filter(F.col(vector_col).isNotNull())
    shape = usable.select(F.size(vector_col).alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    kinds = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id_col} {corpus.schema[id_col].dataType.simpleString()}, score double"
    if shape is None:
        return spark.createDataFrame([], kinds + ", rank int")
    dims, n = shape["d"], shape["count"]
    per = max(1, MAX_BROADCAST // (8 * dims))
    runs = -(-n // per)
    usable = usable.filter(F.size(vector_col) == dims).select(query_id, vector_col)
    rows = corpus.filter(F.size(vector_col) == dims).select(id_col, vector_col)

    def run(j: int):
        part = usable if runs == 1 else usable.filter(F.pmod(F.xxhash64(query_id), F.lit(runs)) == j)
        block = part.toArrow()
        q = _matrix(block.column(vector_col).combine_chunks(), dims)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((block.column(query_id).combine_chunks(), q))

        def apply(batches):
            ids, matrix = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                v = _matrix(b.column(1), dims)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                for s in range(0, len(ids), 512):
                    near = np.round(np.maximum(matrix[s : s + 512] @ v.T, 0), 6)
                    m = min(k, near.shape[1])
                    least = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m]
                    at, to = np.nonzero(near >= least[:, None])  # ties at the limit stay, for the final order to settle
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + s)), b.column(0).take(pa.array(to)), pa.array(near[at, to])], [query_id, id_col, "score"])

        return rows.mapInArrow(apply, kinds), shared

    if runs == 1:
        return top(run(0)[0], k, key=query_id, tie=id_col)
    done = []
    for j in range(runs):  # one block of queries is held at a time
        found, shared = run(j)
        done.append(stored(top(found, k, key=query_id, tie=id_col), "knn"))
        shared.destroy()
    return reduce(DataFrame.unionByName, done)
