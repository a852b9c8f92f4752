"""Token-ID / binary output: Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and 60 bits of payload; the selector says how many values of
how many bits follow. A value of 61 bits or more is escaped: selector 15, then the value itself in
the next word. Values are cut into blocks of `BLOCK`; a segment carries the word offset of every
block, so all blocks decode side by side in NumPy.

A segment is self-contained bytes, little-endian throughout:
magic "TWS8", version u32, block size u32, documents u64, ids u64, blocks u64, words u64;
then document ids i64 x documents, ids per document u64 x documents, block offsets u64 x blocks, words u64 x words.
Segments are rows of a Parquet dataset (one BINARY column beside its keys), because Spark's writers
reach every store and commit whole tasks; an executor that is lost leaves nothing behind.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import materialize, pick, prefix_starts, shuffle_partitions
from tarnwick.llm.tokenizing import encoder
from tarnwick.llm.words import slices

#: Fixed values: (values in a word, bits of each) for selectors 1 to 14.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK = 1024
CHUNK = 32 * BLOCK
MAGIC = b"TWS8"
HEADER = struct.Struct("<4sIIQQQQ")
#: Stands for a document without an integer id.
NO_ID = -(1 << 63)


def _next(wide: np.ndarray, n: int) -> np.ndarray:
    """For each of n positions, the first of the sorted positions `wide` from there on, else n."""
    return np.repeat(np.append(wide, n).astype(np.int32), np.diff(np.concatenate([[-1], wide, [n - 1]])))


def encode_words(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block) of an array of unsigned integers."""
    v = np.asarray(values, dtype=np.uint64)
    n = v.size
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    if n > CHUNK and CHUNK % block == 0:  # blocks are independent; chunks stay in the processor's cache
        parts = [encode_words(v[k : k + CHUNK], block) for k in range(0, n, CHUNK)]
        before = np.cumsum([0, *(w.size for w, _ in parts[:-1])]).astype(np.uint64)
        return np.concatenate([w for w, _ in parts]), np.concatenate([o + b for (_, o), b in zip(parts, before, strict=True)])
    at = np.arange(n, dtype=np.int32)
    end = np.minimum((at // block + 1) * block, n)
    select = np.full(n, ESCAPE, np.uint8)
    step = np.ones(n, np.int32)
    left = end - at
    if n and v.max() < 1 << 32:
        v32 = v.astype(np.uint32)
    else:
        v32 = v
    for k in range(len(LAYOUTS) - 1, -1, -1):  # wide values first, so that the densest layout that fits stays
        count, bits = LAYOUTS[k]
        wide = np.flatnonzero(v32 >= v32.dtype.type(1 << bits)) if v32.itemsize == 8 or bits < 32 else np.empty(0, np.int64)
        takes = np.minimum(count, left)
        if wide.size:
            reach = np.append(wide, n)[np.searchsorted(wide, at)] if wide.size < n // 64 else _next(wide, n)
            fits = np.flatnonzero(reach - at >= takes)
            if not fits.size:
                break  # denser layouts hold more values of fewer bits
            select[fits] = k + 1
            step[fits] = takes[fits]
        else:
            select[:], step[:] = k + 1, takes
    starts = np.arange(0, n, block, dtype=np.int32)
    cur, live, heads = starts.copy(), np.arange(starts.size), []
    while live.size:  # all blocks advance together
        heads.append(cur[live])
        cur[live] += step[cur[live]]
        live = live[cur[live] < np.minimum((live + 1) * block, n)]
    head = np.sort(np.concatenate(heads))
    sel = select[head]
    size = np.where(sel == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    for k, (count, bits) in enumerate(LAYOUTS, 1):
        own = np.flatnonzero(sel == k)
        if own.size:
            h, p, takes = head[own], place[own], step[head[own]]
            for j in range(count):
                has = takes > j
                if not has.any():
                    break
                words[p[has]] |= v[h[has] + j] << np.uint64(j * bits)
    own = sel == ESCAPE
    words[place[own] + 1] = v[head[own]]
    return words, place[np.searchsorted(head, starts)].astype(np.uint64)


def decode_words(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The `n` values of encode_words; all blocks decode side by side."""
    out = np.zeros(n, np.uint64)
    starts = np.arange(0, n, block, dtype=np.int64)
    ends = np.minimum(starts + block, n)
    at, pos = offsets.astype(np.int64).copy(), starts.copy()
    live = np.arange(starts.size)
    heads, places = [], []
    counts = np.array([0, *(c for c, _ in LAYOUTS), 1], np.int64)
    while live.size:
        w = words[at[live]]
        sel = (w >> np.uint64(60)).astype(np.int64)
        if (sel == 0).any():
            raise ValueError("selector 0 marks a damaged segment")
        heads.append(pos[live].copy())
        places.append(at[live].copy())
        pos[live] += np.minimum(counts[sel], ends[live] - pos[live])
        at[live] += np.where(sel == ESCAPE, 2, 1)
        live = live[pos[live] < ends[live]]
    if not heads:
        return out
    head, place = np.concatenate(heads), np.concatenate(places)
    end = np.minimum((head // block + 1) * block, n)
    w = words[place]
    sel = (w >> np.uint64(60)).astype(np.int64)
    for k, (count, bits) in enumerate(LAYOUTS, 1):
        own = sel == k
        if own.any():
            h, e, x, mask = head[own], end[own], w[own], np.uint64((1 << bits) - 1)
            for j in range(count):
                has = h + j < e
                out[h[has] + j] = (x[has] >> np.uint64(j * bits)) & mask
    own = sel == ESCAPE
    out[head[own]] = words[place[own] + 1]
    return out


def pack_segment(doc_ids, counts, values: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets = encode_words(values, block)
    head = HEADER.pack(MAGIC, 1, block, len(doc_ids), int(values.size), offsets.size, words.size)
    parts = (np.asarray(doc_ids, "<i8"), np.asarray(counts, "<u8"), offsets.astype("<u8"), words.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids per document, ids)."""
    magic, version, block, docs, n, blocks, size = HEADER.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a segment of this format")
    at, out = HEADER.size, []
    for kind, count in (("<i8", docs), ("<u8", docs), ("<u8", blocks), ("<u8", size)):
        out.append(np.frombuffer(data, kind, count, at))
        at += 8 * count
    return out[0], out[1].astype(np.int64), decode_words(out[3], out[2], n, block)


def write_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tokenizer: str | None = None, segment_ids: int = 1_000_000) -> DataFrame:
    """Tokenize in ascending id order and write Simple-8b segments to the shared folder.

    Returns the written dataset: part int, part_offset long (ids of the part before the segment), n_ids long,
    payload binary. Null and empty texts hold the end id alone; rows of one id follow in the order of their texts; a very
    long text is one document of its segment; an empty table gives no segments. The format's ids are integers: an id that
    is null, or not an integer, is written as `NO_ID`, comes first and is read back as null. Other columns are not read.
    """
    spark = docs.sparkSession
    clean = pick(docs, _id=id_col, _text=text_col).select(F.coalesce(F.col("_id").try_cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce("_text", F.lit("")).alias("_text"))
    ordered = clean.repartitionByRange(shuffle_partitions(spark), "_id").sortWithinPartitions("_id", "_text")

    def encode(batches):
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, counts, parts, held = [], [], [], 0

        def flush():
            nonlocal ids, counts, parts, held, before
            row = ([part], [before], [held], [pack_segment(np.concatenate(ids), np.concatenate(counts), np.concatenate(parts))])
            before += held
            ids, counts, parts, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "part_offset", "n_ids", "payload"])

        for b in batches:
            for k, n in slices(b.column(1)):
                cut = b.slice(k, n)
                flat, sizes = enc.encode_flat(cut.column(1), end_id)
                ids.append(cut.column(0).to_numpy())
                counts.append(sizes)
                parts.append(flat)
                held += flat.size
                if held >= segment_ids:
                    yield flush()
        if ids:
            yield flush()

    rows = ordered.mapInArrow(encode, "part int, part_offset long, n_ids long, payload binary")
    return materialize(rows, "simple8b", codec="none")


def read_segments(segments: DataFrame) -> DataFrame:
    """Per document of written segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    starts = prefix_starts(segments.select("part", "n_ids"), "part", "n_ids", "part_start")
    # one row per written part: at most as many as the range partitions of the write
    keyed = segments.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("part_offset")).alias("start"), "payload")

    def decode(batches):
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, counts, values = unpack_segment(payload.as_py())
                raw, cuts = memoryview(values.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(counts)])
                crcs = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(start + cuts[:-1]), pa.array(counts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return keyed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_to_segments(docs: DataFrame, **options) -> DataFrame:
    """Write, read back and digest: the round trip of write_segments and read_segments."""
    return read_segments(write_segments(docs, **options))
