"""Bounded samples of labelled documents, for operators that fit a classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import crc_bucket, materialize, pick, release

_SPAN = 1 << 30


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, rows: int, id_col: str = "doc_id", text_col: str = "text", text_bytes: int = 64_000_000):
    """(texts, labels) of at most `rows` labelled documents of at most `text_bytes` in all, on the driver.

    Rows whose crc32(id) mod `modulus` is `held_out` are never used. Documents are taken by the value of their ids' hashes, so
    the sample is the same whatever the partitions. Labels of one id that differ count as the larger; of texts of one id
    the least counts; null labels and ids are left out; a null text is empty.
    """
    own = pick(labels, _id=id_col, _y=label_col).select("_id", F.col("_y").cast("int").alias("_y")).dropna()
    own = own.filter(crc_bucket(F.col("_id"), modulus) != held_out).groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_h", F.pmod(F.xxhash64("_id"), F.lit(_SPAN)))
    n = own.count()
    # a tenth more than wanted, and 1,000, as hashes are uneven: ids of a few bytes
    below = _SPAN if n <= rows else min(_SPAN, int(_SPAN * (1.1 * rows + 1000) / n))
    got = pick(docs, _id=id_col, _text=text_col).join(F.broadcast(own.filter(F.col("_h") < below)), "_id")
    got = materialize(got.groupBy("_id", "_h", "_y").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text")), "labelled")
    sizes = got.select("_h", F.octet_length("_text").cast("long").alias("b")).toArrow().sort_by("_h")
    h, upto = sizes.column("_h").to_numpy(), np.cumsum(sizes.column("b").to_numpy())
    fits = int(min(rows, np.searchsorted(upto, text_bytes, side="right")))
    last = int(h[fits]) if fits < h.size else _SPAN
    table = got.filter(F.col("_h") < last).select("_id", "_text", "_y").toArrow().sort_by([("_id", "ascending"), ("_text", "ascending")])
    release(got)
    return table.column("_text").to_pylist(), table.column("_y").to_pylist()


def logistic(x, y, ridge: float = 1e-2, rounds: int = 50):
    """Weights (intercept last) of a ridge logistic regression, by Newton's method."""
    a = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
