"""Ranked lexical search over inverted treaps.

Documents are indexed in shards of bounded size. In a shard each term has a treap: a search tree by document whose heap order
is the impact of the term in the document, so the root of a subtree has its largest impact. Treaps are stored in preorder,
with the size of each left subtree and of each subtree, which are the places of a node's children. They are built for all
terms of a shard at once: a node's subtree reaches to the next larger impact on either side.

A search walks the treaps of an item's terms together. A range of documents has a node a term, the topmost one inside it, and
the sum of their weighted impacts bounds every score in the range. Ranges that can't enter the top k go, with all their
subtrees; of the others the document of the largest weighted impact is scored exactly and parts the range in two. Ranges of
all items move in step, as arrays. What any k documents score is a bound from the start: the documents of each item's
rarest terms are scored first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import materialize, pick
from tarnwick.llm.decontaminate import words_of
from tarnwick.llm.packed import write_chunks
from tarnwick.llm.words import trim

#: A shard's bytes of text and documents.
SHARD_BYTES, SHARD_DOCS = 8_000_000, 65_536
#: Pairs of item and term that one block of items may have: they are broadcast.
MAX_PAIRS = 500_000
#: Entries (range, term) that move in step; the rest waits.
STEP = 400_000
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Treaps:
    """lists: (chunk, term, docs, impacts, lefts, sizes), and a row with null term and the ids of each shard; n_docs with a
    term, n_terms with repeats."""

    lists: DataFrame
    n_docs: int
    n_terms: int


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, a line feed after each; place after each text)."""
    joined = pc.binary_join_element_wise(pc.coalesce(texts.cast(pa.large_string()), pa.scalar("", pa.large_string())), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    bounds = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    return np.frombuffer(joined.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds[1:] - bounds[0]


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all terms in order, number in each text)."""
    if not len(texts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    data, ends = _bytes_of(texts)
    inside = ~_BETWEEN[data]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    turn = np.concatenate([[0], turn]) if inside[0] else turn
    starts, stops = turn[0::2], turn[1::2]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    return found, np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))


def larger_before(rank: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each place the nearest one before it, in its list, of larger rank; the list's start less one if there is none.

    Places jump over what is known to be smaller until all rest on a larger one. first: where each place's list starts.
    """
    n = rank.size
    p = np.arange(n) - 1
    stop = p < first
    p[stop] = n
    keys = np.append(rank, np.iinfo(np.int64).max)
    todo = np.flatnonzero(keys[p] < rank)
    while todo.size:
        p[todo] = p[p[todo]]
        todo = todo[keys[p[todo]] < rank[todo]]
    return np.where(p == n, first - 1, p)


def preorder(impacts: np.ndarray, docs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, left sizes, subtree sizes) of lists of documents in ascending order, list k being bounds[k] to bounds[k + 1].

    Equal impacts are put in a mixed order, so that they don't make a tree as deep as they are many.
    """
    n = impacts.size
    first, last = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    mixed = (docs.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((mixed, impacts))] = np.arange(n)
    start = larger_before(rank, first) + 1
    stop = n - 1 - larger_before(rank[::-1], (n - last)[::-1])[::-1]
    size, left = stop - start, np.arange(n) - start
    order = np.lexsort((-size, start))
    return order, left[order], size[order]


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> Treaps:
    """The treaps of all terms of all documents. A document's impact is (10^9 tf) div (1000 tf + 8 m), m growing with its
    length over the mean. Null and empty texts are in no treap; repeated rows and rows without id are documents of their own."""
    t = pick(docs, _id=id_col, _text=text_col)
    kind = t.schema["_id"].dataType.simpleString()

    def count(batches):
        n, total = 0, 0
        for b in batches:
            for k, m in _cuts(b.column(1), shard_bytes, shard_docs):
                inside = ~_BETWEEN[(x := _bytes_of(b.column(1).slice(k, m)))[0]]
                begin = np.flatnonzero(np.concatenate([inside[:1], inside[1:] & ~inside[:-1]]))
                each = np.diff(np.searchsorted(begin, np.concatenate([[0], x[1]])))
                n, total = n + int((each > 0).sum()), total + int(each.sum())
            trim()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    sums = t.mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    n_docs, n_terms = sums[0] or 0, sums[1] or 0

    def shard(chunk: int, ids: pa.Array, texts: pa.Array):
        order = pc.array_sort_indices(ids, null_placement="at_start")
        ids, texts = ids.take(order), texts.take(order)
        n = len(ids)
        found, each = terms_of(texts)
        coded = found.dictionary_encode()
        codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        del found, coded
        keys, tf = np.unique(codes * n + np.repeat(np.arange(n), each), return_counts=True)
        of, doc = np.divmod(keys, n)
        m = 10 + (90 * each * n_docs) // max(n_terms, 1)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        bounds = np.searchsorted(of, np.arange(len(names) + 1))
        order, left, size = preorder(impact, doc, bounds)
        doc, impact = doc[order].astype(np.int32), impact[order].astype(np.int32)
        lists = [doc, impact, left.astype(np.int32), size.astype(np.int32)]
        for a in range(0, len(names), 10_000):
            e = min(a + 10_000, len(names))
            offsets = pa.array((bounds[a : e + 1] - bounds[a]).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(x[bounds[a] : bounds[e]])) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(e - a, chunk)), names.slice(a, e - a).cast(pa.binary()), *columns, pa.nulls(e - a, pa.list_(ids.type))], _LISTS)
        none = pa.nulls(1, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, pa.binary()), none, none, none, none, pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)], _LISTS)

    def shards(batches):
        part, k, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0
        for b in batches:
            for a, m in _cuts(b.column(1), shard_bytes // 4, shard_docs // 4):
                cut = b.slice(a, m)
                held.append(cut)
                rows, size = rows + m, size + (pc.sum(pc.binary_length(cut.column(1))).as_py() or 0)
                if size >= shard_bytes or rows >= shard_docs:
                    yield from shard((part << 32) + k, *(pa.concat_arrays([x.column(j) for x in held]) for j in (0, 1)))
                    k, held, size, rows = k + 1, [], 0, 0
                    trim()
        if held:
            yield from shard((part << 32) + k, *(pa.concat_arrays([x.column(j) for x in held]) for j in (0, 1)))
            trim()

    made = t.mapInArrow(shards, f"chunk long, term binary, docs array<int>, impacts array<int>, lefts array<int>, sizes array<int>, ids array<{kind}>")
    return Treaps(write_chunks(made, "treaps"), n_docs, n_terms)


_LISTS = ["chunk", "term", "docs", "impacts", "lefts", "sizes", "ids"]


def _cuts(column: pa.Array, size: int, rows: int):
    """(start, length) of runs of about `size` bytes and at most `rows` rows; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    k, n = 0, len(column)
    while k < n:
        e = min(k + rows, max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, side="right"))))
        yield k, e - k
        k = e


class Walk:
    """The treaps of one shard and the items' terms in it. Entries are (item, root, end of tree, weight), by item."""

    def __init__(self, docs, impacts, lefts, sizes, n_items: int, k: int, least: np.ndarray):
        self.docs, self.impacts, self.lefts, self.sizes, self.k = docs, impacts, lefts, sizes, k
        self.item, self.doc, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.least, self.upto = least.copy(), np.full(n_items, np.iinfo(np.int64).max)
        self.scored = 0

    def down(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The topmost node of each subtree whose document is in [low, high); -1 if there is none."""
        at = at.copy()
        todo = np.flatnonzero(at >= 0)
        while todo.size:
            here = at[todo]
            d = self.docs[here]
            before, after = d < low[todo], d >= high[todo]
            move = before | after
            todo, here, before = todo[move], here[move], before[move]
            left = self.lefts[here]
            there = np.where(before, self.sizes[here] - 1 - left > 0, left > 0)
            at[todo] = np.where(there, here + 1 + np.where(before, left, 0), -1)
            todo = todo[there]
        return at

    def found(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Keep the k best documents of each item, and their worst as what is to be beaten."""
        self.scored += item.size
        good = (score > 0) & ((score > self.least[item]) | (score == self.least[item]) & (doc < self.upto[item]))
        if not good.any():
            return
        item, doc, score = (np.concatenate([a, b[good]]) for a, b in ((self.item, item), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        new = np.concatenate([[True], item[1:] != item[:-1]])
        place = np.arange(item.size) - np.flatnonzero(new)[np.cumsum(new) - 1]
        keep = place < self.k
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]
        full = place[keep] == self.k - 1
        who = self.item[full]
        better = self.score[full] >= self.least[who]
        who = who[better]
        self.least[who], self.upto[who] = self.score[full][better], self.doc[full][better]

    def run(self, item: np.ndarray, root: np.ndarray, weight: np.ndarray, n_docs: int) -> None:
        owners, of = np.unique(item, return_inverse=True)
        waiting = [(owners, np.zeros(owners.size, np.int64), np.full(owners.size, n_docs), of, root, weight)]
        while waiting:
            waiting.extend(self._step(*waiting.pop()))

    def _step(self, item, low, high, of, node, weight):
        """One round over ranges (item, low, high) with entries (of which range, node, weight), sorted by range."""
        gain = weight * self.impacts[node]
        starts = np.searchsorted(of, np.arange(item.size))
        bound = np.add.reduceat(gain, starts)
        live = (bound > self.least[item]) | (bound == self.least[item]) & (low < self.upto[item])
        if not live.any():
            return []
        if not live.all():
            keep = live[of]
            of, node, weight, gain = np.cumsum(live)[of[keep]] - 1, node[keep], weight[keep], gain[keep]
            item, low, high, bound = item[live], low[live], high[live], bound[live]
            starts = np.searchsorted(of, np.arange(item.size))
        later = []
        if of.size > STEP:  # the ranges of highest bounds first
            order = np.argsort(bound, kind="stable")
            counts = np.diff(np.append(starts, of.size))
            n = max(1, item.size - int(np.searchsorted(np.cumsum(counts[order[::-1]]), STEP // 2)))
            n = min(n, item.size - 1) if item.size > 1 else 0
            rest = np.zeros(item.size, bool)
            rest[order[:n]] = True
            if n:
                for part in (rest, ~rest):
                    keep = part[of]
                    later.append((item[part], low[part], high[part], np.cumsum(part)[of[keep]] - 1, node[keep], weight[keep]))
                item, low, high, of, node, weight = later.pop()
                gain = weight * self.impacts[node]
                starts = np.searchsorted(of, np.arange(item.size))
        most = np.maximum.reduceat(gain, starts)
        top = np.flatnonzero(gain == most[of])
        first = top[np.unique(of[top], return_index=True)[1]]
        pivot = self.docs[node[first]].astype(np.int64)
        p, lo, hi = pivot[of], low[of], high[of]
        at = self.down(node, p, p + 1)
        has = at >= 0
        self.found(item, pivot, np.bincount(of[has], weights=weight[has] * self.impacts[at[has]], minlength=item.size).astype(np.int64))
        left, right = self.down(node, lo, p), self.down(node, p + 1, hi)
        both = np.concatenate([left, right])
        keep = both >= 0
        if keep.any():
            of2 = np.concatenate([of, of + item.size])[keep]
            some, of2 = np.unique(of2, return_inverse=True)
            parent, is_right = some % item.size, some >= item.size
            later.append((item[parent], np.where(is_right, pivot[parent] + 1, low[parent]), np.where(is_right, high[parent], pivot[parent]), of2, both[keep], np.concatenate([weight, weight])[keep]))
        return later


def search(index: Treaps, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", id_name: str = "doc_id", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Per item its k best documents of positive score: item_id, rank (from 1), doc_id, score; equal scores by ascending id (nulls
    first, then in any order).

    A term counts once an item. Items without terms that documents hold have no rows; each row of `items` is an item,
    whatever its id. Items are searched in blocks of at most `max_pairs` terms; each block's terms are broadcast.
    """
    spark = items.sparkSession
    t = pick(items, _id=item_id, _text=item_text)
    kind = t.schema["_id"].dataType.simpleString()
    doc_kind = index.lists.schema["ids"].dataType.elementType.simpleString()
    numbered = t.select("_id", F.array_distinct(words_of(F.col("_text"))).alias("terms")).filter(F.size("terms") > 0)
    pairs = numbered.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-pairs // max_pairs) or 1
    if blocks > 1:  # written, so that each item is in one block
        numbered = materialize(numbered.withColumn("_b", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), "items")
    of_block = lambda b: numbered if blocks == 1 else numbered.filter(F.col("_b") == b)
    parts = [_search_block(spark, index, of_block(b).select("_id", "terms").toArrow(), k, kind).withColumn("_n", F.col("_n") + (b << 32)) for b in range(blocks)]
    hits = reduce(DataFrame.unionByName, parts)
    # by score alone first: ids are only fetched for what may be among the k best
    close = hits.withColumn("_r", F.rank().over(Window.partitionBy("_n").orderBy(F.desc("score")))).filter(F.col("_r") <= k)
    ids = index.lists.filter("term is null").select("chunk", "ids")
    named = close.join(ids, "chunk").withColumn("_doc", F.get("ids", F.col("doc").cast("int")))
    order = Window.partitionBy("_n").orderBy(F.desc("score"), F.col("_doc").asc_nulls_first(), "chunk", "doc")
    best = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.col("_id").cast(kind).alias(item_id), "rank", F.col("_doc").cast(doc_kind).alias(id_name), "score")


def _search_block(spark, index: Treaps, asked: pa.Table, k: int, kind: str) -> DataFrame:
    """(_n, _id, chunk, doc, score) of each shard's k best that may be among all shards' k best."""
    item_terms = asked.column("terms").combine_chunks()
    of = np.repeat(np.arange(asked.num_rows), pc.list_value_length(item_terms).to_numpy())
    coded = item_terms.flatten().cast(pa.binary()).dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    wanted = spark.createDataFrame(pa.table({"term": terms, "code": pa.array(np.arange(len(terms)))})) if len(terms) else spark.createDataFrame([], "term binary, code long")
    mine = index.lists.join(F.broadcast(wanted), "term").select("chunk", "code", "docs", "impacts", "lefts", "sizes")
    counted = mine.groupBy("code").agg(F.sum(F.size("docs")).alias("df")).toArrow()
    df = np.zeros(len(terms), np.int64)
    df[counted.column("code").to_numpy()] = counted.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
    use = weight[code] > 0
    of, code = of[use], code[use]
    # the rarest terms of each item, up to a few documents more than k
    order = np.lexsort((df[code], of))
    before = np.cumsum(df[code[order]])
    begins = np.searchsorted(of[order], of[order])
    ahead = before - df[code[order]] - np.where(begins > 0, before[begins - 1], 0)
    rare = np.zeros(of.size, bool)
    rare[order[ahead < 4 * k]] = True
    shared = spark.sparkContext.broadcast((of, code, weight, rare))
    n_items, ids = asked.num_rows, asked.column("_id").combine_chunks()

    def opened(group: pa.Table, least: np.ndarray):
        """(walk, entries' items, roots, weights, rare flags) of a shard."""
        item, term, w, is_rare = shared.value
        docs, impacts, lefts, sizes = (group.column(c).combine_chunks() for c in ("docs", "impacts", "lefts", "sizes"))
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(docs).to_numpy())])
        docs, impacts, lefts, sizes = (x.flatten().to_numpy().astype(np.int64) for x in (docs, impacts, lefts, sizes))
        root = np.full(w.size, -1)
        root[group.column("code").to_numpy()] = starts[:-1]
        here = root[term] >= 0
        item, term, is_rare = item[here], term[here], is_rare[here]
        order = np.argsort(item, kind="stable")
        walk = Walk(docs, impacts, lefts, sizes, n_items, k, least)
        return walk, item[order], root[term][order], w[term][order], is_rare[order]

    def seed(walk, item, root, weight, is_rare) -> None:
        """Score the documents of the rarest terms."""
        size = walk.sizes[root[is_rare]]
        node = np.repeat(root[is_rare], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        both = np.unique(np.repeat(item[is_rare], size) * (int(walk.docs.max()) + 1 if walk.docs.size else 1) + walk.docs[node])
        who, doc = np.divmod(both, int(walk.docs.max()) + 1 if walk.docs.size else 1)
        a, z = np.searchsorted(item, who), np.searchsorted(item, who, side="right")
        for s in range(0, who.size, 4000):
            n = (z - a)[s : s + 4000]
            entry = np.repeat(a[s : s + 4000], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair = np.repeat(np.arange(n.size), n)
            d = doc[s : s + 4000][pair]
            at = walk.down(root[entry], d, d + 1)
            has = at >= 0
            score = np.bincount(pair[has], weights=weight[entry[has]] * walk.impacts[at[has]], minlength=n.size).astype(np.int64)
            walk.found(who[s : s + 4000], doc[s : s + 4000], score)

    def seeds(group: pa.Table) -> pa.Table:
        walk, item, root, w, is_rare = opened(group, np.zeros(n_items, np.int64))
        seed(walk, item, root, w, is_rare)
        return pa.table({"_n": walk.item, "score": walk.score})

    firsts = mine.groupBy("chunk").applyInArrow(seeds, "_n long, score long")
    nth = firsts.withColumn("_r", F.row_number().over(Window.partitionBy("_n").orderBy(F.desc("score")))).filter(F.col("_r") == k).select("_n", "score").toArrow()
    least = np.zeros(n_items, np.int64)
    least[nth.column("_n").to_numpy()] = nth.column("score").to_numpy()
    floor = spark.sparkContext.broadcast(least)

    def walked(group: pa.Table) -> pa.Table:
        walk, item, root, w, is_rare = opened(group, floor.value)
        walk.run(item, root, w, int(walk.docs.max()) + 1 if walk.docs.size else 0)
        return pa.table({"_n": walk.item, "_id": ids.take(pa.array(walk.item)), "chunk": pa.array(np.full(walk.item.size, group.column("chunk")[0].as_py())), "doc": walk.doc, "score": walk.score})

    return mine.groupBy("chunk").applyInArrow(walked, f"_n long, _id {kind}, chunk long, doc long, score long")
