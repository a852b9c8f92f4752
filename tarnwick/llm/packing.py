"""Packing: concatenate and cut.

Documents are tokenized where they are and their ids written; the ids alone are shuffled into the order of a hash of the
documents' ids, so that sequences mix and don't depend on how the table is split. Each range is written with offsets local to it;
the ranges' totals (one row each) give global starts by a prefix sum; then every document is cut at multiples of the window. Only the very last sequence has padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import materialize, pick, prefix_starts, release
from tarnwick.llm.tokenizing import encoder
from tarnwick.llm.words import slices, trim


def pack(docs: DataFrame, window: int = 4096, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length, starts_document, ends_document.

    A piece is the part of one document in one sequence. Null and empty texts hold `end_id` alone; repeated rows are
    packed as separate documents, null ids like others; an empty table has no pieces; a very long text is cut into as many
    pieces as it fills sequences. The order is that of a hash of id, then of the tokens' checksum. padded_length is the sequence's length
    in the output: `window`, but for a last sequence whose own length is a power of two, which needs no padding.
    with_ids adds the piece's ids (array<int>), for writing the sequences out. Other columns are not read, whatever their names.
    """
    clean = pick(docs, _id=id_col, _text=text_col).select("_id", F.coalesce("_text", F.lit("")).alias("_text"))
    kind = clean.schema["_id"].dataType.simpleString()

    def tokenize(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for k, n in slices(b.column(1)):
                cut = b.slice(k, n)
                flat, sizes = enc.encode_flat(cut.column(1), end_id)
                flat = flat.astype("<u2" if flat.max() < 65536 else "<u4")
                raw, ends = memoryview(flat.tobytes()), (np.cumsum(sizes) * flat.itemsize).tolist()
                small = [raw[a:e] for a, e in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(sizes), pa.array([zlib.crc32(x) for x in small], pa.int64()), pa.array(small, pa.binary())], ["_id", "doc_tokens", "crc", "ids"])

    def number(batches):
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = b.column(1).to_numpy()
            offsets = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(sizes.size, part, np.int32)), pa.array(offsets), b.column(1), b.column(2)], ["_id", "part", "part_offset", "doc_tokens", "ids"])

    tokens = materialize(clean.mapInArrow(tokenize, f"_id {kind}, doc_tokens long, crc long, ids binary"), "packing-tokens")
    order = [F.xxhash64("_id"), "crc", "doc_tokens", F.monotonically_increasing_id()]  # equal rows may fall into several ranges
    keyed = tokens.select(*(c if isinstance(c, str) else c.alias(f"_o{k}") for k, c in enumerate(order)), "_id", "ids")
    names = ["_o0", "crc", "doc_tokens", "_o3"]
    ranged = keyed.repartitionByRange(*names).sortWithinPartitions(*names).select("_id", "doc_tokens", "ids")
    ids = materialize(ranged.mapInArrow(number, f"_id {kind}, part int, part_offset long, doc_tokens long, ids binary"), "packing")
    release(tokens)
    starts = prefix_starts(ids.select("part", "doc_tokens"), "part", "doc_tokens", "part_start", "all_tokens")
    # one row per partition of the first pass
    placed = ids.join(F.broadcast(starts), "part").select("_id", (F.col("part_start") + F.col("part_offset")).alias("at"), "doc_tokens", "ids", "all_tokens")

    def cut(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                yield pieces(whole.slice(k, 1000))
            trim()

    def pieces(b):
        doc, at, size, every = (b.column(k).to_pylist() for k in (0, 1, 2, 4))
        out: list[list] = [[] for _ in range(11)]
        for d, g, n, blob, total in zip(doc, at, size, b.column(3), every, strict=True):
            blob = blob.as_buffer()
            x = np.frombuffer(blob, "<u2").astype("<u4") if blob.size == 2 * n else np.frombuffer(blob, "<u4")
            raw = memoryview(x.tobytes())
            edges = [0, *range(window - g % window, n, window), n]
            for a, e in zip(edges[:-1], edges[1:], strict=True):
                seq, offset = divmod(g + a, window)
                last = min(window, total - seq * window)
                row = (d, a, e - a, zlib.crc32(raw[4 * a : 4 * e]), n, seq, offset, last if last & (last - 1) == 0 else window, a == 0, e == n, x[a:e].tolist() if with_ids else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        kinds = (b.schema.field(0).type, *(pa.int64(),) * 7, pa.bool_(), pa.bool_(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [f"c{k}" for k in range(11)])

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "starts_document", "ends_document", "ids")
    made = placed.mapInArrow(cut, f"c0 {kind}, " + ", ".join(f"c{k} long" for k in range(1, 8)) + ", c8 boolean, c9 boolean, c10 array<int>").toDF(*names)
    return made if with_ids else made.drop("ids")
