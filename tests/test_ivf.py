"""The inverted file: exhaustive when all lists are probed, recall when few are, odd vectors, lists in parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import ivf, vector


def answers(frame):
    return {(r["qid"], r["rank"]): (r["vec_id"], r["score"]) for r in frame.collect()}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 32))[rng.integers(0, 40, 4000)] + 0.6 * rng.standard_normal((4000, 32))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    return df, df.filter("vec_id % 40 = 0").withColumnRenamed("vec_id", "qid")


def test_all_probes_are_exhaustive(clustered):
    df, q = clustered
    assert answers(ivf.search(ivf.build(df, n_lists=20), q, k=10)) == answers(vector.knn(df, q, 10))


def test_recall_of_few_probes(clustered):
    df, q = clustered
    want, got = answers(vector.knn(df, q, 10)), answers(ivf.search(ivf.build(df, n_lists=40), q, k=10, probes=8, shortlist=100))
    hits = len({(k[0], v[0]) for k, v in want.items()} & {(k[0], v[0]) for k, v in got.items()})
    assert hits >= 0.9 * len(want)
    exact = {(k[0], v[0]): v[1] for k, v in want.items()}
    assert all(exact.get((k[0], v[0]), v[1]) == v[1] for k, v in got.items())


def test_recall_on_the_tables(spark, sf_dir):
    """Vectors without clusters: most lists are needed."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    index = ivf.build(df)
    want = answers(vector.knn(df, q, 10))
    got = answers(ivf.search(index, q, 10, probes=3 * index.n_lists // 4, shortlist=200))
    assert len({(k[0], v[0]) for k, v in want.items()} & {(k[0], v[0]) for k, v in got.items()}) >= 0.9 * len(want)


def test_one_vector_many_times(spark, monkeypatch):
    """A list of many equal vectors is kept in parts."""
    monkeypatch.setattr(ivf, "PART_ROWS", 50)
    rows = [(k, [1.0, 0.0] if k % 3 else [float(k), 1.0]) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ivf.build(df, n_lists=4)
    assert index.parts.max() >= 8
    q = df.filter("vec_id < 9").withColumnRenamed("vec_id", "qid")
    assert answers(ivf.search(index, q, 5)) == answers(vector.knn(df, q, 5))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (6, [0.5, 0.5]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.withColumnRenamed("vec_id", "qid")
    assert answers(ivf.search(ivf.build(df), q, 3)) == answers(vector.knn(df, q, 3))
    assert ivf.search(ivf.build(df.limit(0)), q).collect() == []
    assert ivf.search(ivf.build(df), q.limit(0)).collect() == []
