"""Counting keys over a whole table, chunk by chunk.

A chunk is one row that holds many texts as packed bytes; chunks are written once, bucketed by their number. A chunk
sends its distinct keys, packed, to ranges of keys; a range adds up what it gets and answers in the order that each
chunk gave. Answers go back to their chunks by a join that leaves the bucketed chunks where they are, so only keys and
counts are shuffled, and no process holds more than a chunk or a range.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwick.llm.common import shared_dir, shuffle_partitions, written


def squeeze(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers below 256^width as compressed byte planes, high bytes together: small numbers cost little."""
    planes = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return pa.Codec("zstd", compression_level=3).compress(planes.tobytes(), asbytes=True)


def unsqueeze(data, n: int, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def write_chunks(df: DataFrame, tag: str) -> DataFrame:
    """`df`, which has a row for each number `chunk`, written to the shared folder in buckets of that number."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(min(shuffle_partitions(spark), 100_000), "chunk").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return written(spark.table(name), path, name)


def key_ranges(spark, n_keys: int, range_rows: int) -> int:
    """Number of ranges of about `range_rows` of the keys: they grow in number, not in size. Ranges are equal steps of the keys."""
    return max(4 * shuffle_partitions(spark), -(-n_keys // range_rows))


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key, in their order: of the key's first 32 bits, as a share of all."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def sent_schema(values: int) -> str:
    return "range int, chunk long, size int, keys binary" + "".join(f", v{k} binary" for k in range(values))


def to_ranges(chunk: int, keys: np.ndarray, values: list[np.ndarray], ranges: int, width: int = 4) -> pa.RecordBatch:
    """A row for each range that a chunk has some of its sorted distinct keys in."""
    of = _range_of(keys, ranges)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if of.size else np.zeros(0, np.int64)
    own = list(zip(of[first].tolist(), first.tolist(), np.append(first[1:], of.size).tolist() if of.size else [], strict=True))
    columns = [pa.array([r for r, _, _ in own], pa.int32()), pa.array([chunk] * len(own), pa.int64()), pa.array([e - a for _, a, e in own], pa.int32())]
    columns.append(pa.array([squeeze(np.diff(keys[a:e], prepend=np.uint64(0)), 8) for _, a, e in own], pa.binary()))
    columns += [pa.array([squeeze(x[a:e], width) for _, a, e in own], pa.binary()) for x in values]
    return pa.RecordBatch.from_arrays(columns, ["range", "chunk", "size", "keys", *(f"v{k}" for k in range(len(values)))])


def gathered(group: pa.Table, values: int, width: int = 4) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a range: (first and last place of each row's keys, distinct keys, number of each sent key, order of the sent keys by
    key, values as sent)."""
    sizes = group.column("size").to_pylist()
    keys = np.concatenate([np.cumsum(unsqueeze(x.as_buffer(), n, 8), dtype=np.uint64) for x, n in zip(group.column("keys"), sizes, strict=True)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first, of = np.flatnonzero(new), np.empty(order.size, np.int64)
    of[order] = np.cumsum(new) - 1
    own = [np.concatenate([unsqueeze(x.as_buffer(), n, width) for x, n in zip(group.column(f"v{k}"), sizes, strict=True)]).astype(np.int64) for k in range(values)]
    return np.cumsum([0, *sizes]).tolist(), keys[first], of, order, own


def totals(of: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Sum of each distinct key's values (exact: float sums of integers below 2^53)."""
    return np.bincount(of, weights=own, minlength=n).astype(np.int64)


def answers(rows: pa.Table, name: str, sizes: str = "size", width: int = 8) -> np.ndarray:
    """What the ranges answered a chunk, in the order of its sorted keys."""
    found = [unsqueeze(x.as_buffer(), n, width) for x, n in zip(rows.column(name), rows.column(sizes).to_pylist(), strict=True)]
    return np.concatenate([np.zeros(0, f"<u{width}"), *found]).astype(np.int64)


def by_range(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(np.argsort(rows.column("range").to_numpy(), kind="stable")))
