"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words; its weight is its count in the document times the sum of its words' idf, so shared
boilerplate of everyday words counts little. Each of bands x rows samples (s, t) of a document's weighted set is equal
in two documents with the probability of their weighted Jaccard similarity. Documents that agree in all rows of a
band are candidates, and similarity is then computed exactly from the whole texts.

Exact copies are one class from the start. Buckets with the same members are one bucket. A bucket is compared in blocks
of bounded size, each pair of blocks in a task of its own, and gives a spanning forest of its links, so output is linear
in the bucket. A bucket larger than a block is first compared with one member alone; where that connects all of it,
as in a large group of near copies, no more is done. No candidate is dropped whatever a bucket's size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import MAX_KEYS, at, join_hot, materialize, pick, plain, release
from tarnwick.llm.words import Table, Words, mix, slices

SHINGLE = 5
#: Classes of more exact copies than this are hot keys. Texts of pivots are broadcast up to so many bytes.
HOT_COPIES, MAX_PIVOT_BYTES = 4096, 64_000_000
_ODD = np.random.default_rng(7).integers(1 << 62, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def _gamma_table(size: int = 4096) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) e^-x."""
    p = (np.arange(size) + 0.5) / size
    low, high = np.zeros(size), np.full(size, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low


_GAMMA = _gamma_table()
_R, _INV_R, _LOG_C = _GAMMA.astype(np.float32), (1 / _GAMMA).astype(np.float32), np.log(_GAMMA).astype(np.float32)


class Idf:
    """ln(N / df) of words, capped at ln(1 / share): only words of that share of documents need a count."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n_docs: int, share: float):
        self.hashes, self.cap, self.table = hashes, math.log(1 / share), None
        self.values = np.append(np.clip(np.log((1 + n_docs) / (1 + df)), 0.05, self.cap), self.cap).astype(np.float32)

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = Table()
            self.table.insert(self.hashes)
        return self.values[self.table.lookup(hashes)]


def shingles(words: Words, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight), by text; a text of one to four words is one shingle."""
    n, counts = len(words), words.counts
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.float32)
    doc = np.repeat(np.arange(counts.size), counts)
    left = np.cumsum(counts)[doc] - np.arange(n)  # words from here to the end of the text
    weight = idf.of(words.hashes)
    h, w = np.zeros(n, np.uint64), np.zeros(n, np.float32)
    for k in range(SHINGLE):
        has = left > k
        place = np.minimum(np.arange(n) + k, n - 1)
        h += np.where(has, words.hashes[place] * _ODD[k], np.uint64(0))
        w += np.where(has, weight[place], 0)
    whole = (left >= SHINGLE) | (left == counts[doc]) & (counts[doc] < SHINGLE)
    doc, h, w = doc[whole], mix(h[whole]), w[whole]
    key = mix(h + doc.astype(np.uint64) * _ODD[8])
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(first)
    first, times = first[order], times[order]
    return doc[first], h[first], w[first] * times.astype(np.float32)


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, count: int) -> np.ndarray:
    """`count` consistent weighted samples of each text, as hashes of (s, t); 0 for a text without shingles."""
    out = np.zeros((n_docs, count), np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if doc.size else np.empty(0, np.int64)
    bounds, k = np.append(starts, doc.size), 0
    while k < starts.size:  # blocks of texts whose arrays fit the processor's cache
        e = max(k + 1, int(np.searchsorted(bounds, bounds[k] + 16_384, side="right")) - 1)
        a, z = bounds[k], bounds[e]
        hh, lw, inner, owners = h[a:z], np.log(weight[a:z]), starts[k:e] - a, doc[starts[k:e]]
        place = np.arange(z - a, dtype=np.int64)
        for j in range(count):
            x = hh * _ODD[16 + j]
            x ^= x >> np.uint64(32)
            i_r = (x >> np.uint64(52)).astype(np.int32)
            r = _R[i_r]
            beta = ((x >> np.uint64(20)).astype(np.uint32)).astype(np.float32) * np.float32(2.0**-32)
            t = np.floor(lw * _INV_R[i_r] + beta)
            ln_a = _LOG_C[((x >> np.uint64(8)) & np.uint64(4095)).astype(np.int32)] - r * (t - beta + np.float32(1))
            bits = ln_a.view(np.int32)
            ordered = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64)
            best = np.minimum.reduceat((ordered << 32) | place, inner) & 0xFFFFFFFF
            out[owners, j] = mix(hh[best] + t[best].astype(np.int64).view(np.uint64) * _ODD[12]) | np.uint64(1)
        k = e
    return out


def signatures(column: pa.Array, idf: Idf, bands: int, rows: int):
    """(words, hash pair of the word sequence, band hashes) of each text."""
    words = Words(column, lower=True)
    n, counts = len(column), words.counts
    doc, h, weight = shingles(words, idf)
    s = samples(doc, h, weight, n, bands * rows).reshape(n, bands, rows)
    of_band = mix((s * _ODD[2048 : 2048 + rows]).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _ODD[13])
    owner, at = np.repeat(np.arange(n), counts), np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    pair = []
    for k in (14, 15):
        total = np.append(0, np.cumsum(mix(words.hashes + (at + 1).astype(np.uint64) * _ODD[k]), dtype=np.uint64)).astype(np.uint64)
        ends = np.cumsum(counts)
        pair.append((total[ends] - total[ends - counts]).view(np.int64))
    return counts, pair[0], pair[1], of_band.view(np.int64)


def links(texts: pa.Array, sides: np.ndarray, known: np.ndarray, idf: Idf, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links of similarity or more between texts of side 0 and side 1 (side 2: both).

    known: texts with the same number are connected already. Each text's overlaps with all others are computed at once.
    """
    n = len(texts)
    parts = []
    for k, m in slices(texts):
        d, h, w = shingles(Words(texts.slice(k, m), lower=True), idf)
        parts.append((d + k, h, w))
    doc, h, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, place = np.unique(h, return_inverse=True)
    total = np.bincount(doc, weights=weight, minlength=n)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    of, out = np.unique(known, return_inverse=True)[1], []
    own = np.zeros(place.max() + 1 if place.size else 0)
    for x in range(n):
        if sides[x] == 1:
            continue
        others = of != of[x]
        others &= sides != 0 if sides[x] == 0 else np.arange(n) > x
        others &= np.minimum(total, total[x]) >= (similarity - 1e-6) * np.maximum(total, total[x])
        if not total[x] or not others.any():
            continue
        a, z = bounds[x], bounds[x + 1]
        own[place[a:z]] = weight[a:z]
        both = np.bincount(doc, weights=np.minimum(weight, own[place]), minlength=n)
        own[place[a:z]] = 0
        close = both >= (similarity - 1e-6) * (total + total[x] - both)
        for y in np.flatnonzero(close & others).tolist():
            if of[x] != of[y]:
                out.append((x, y))
                of[of == of[y]] = of[x]
    return out


def forest(batches):
    """Of a task's links: each node with the smallest that it is connected to."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    if kind is not None:
        nodes = [x for x in root if root[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["a", "b"])


def connected(edges: DataFrame, rounds: int = 100, few: int = MAX_KEYS) -> DataFrame:
    """(node, label): the smallest node of each component, for nodes other than that; a table of its own, for release().

    Each task first contracts the links that it has. What is left, if no more than `few` links, is contracted by one
    task; else by alternating large and small stars, whose rounds grow as the logarithm of the longest path. A labelling that
    isn't finished after `rounds` is an error.
    """
    kind = edges.schema["a"].dataType.simpleString()
    star = materialize(edges.mapInArrow(forest, f"a {kind}, b {kind}"), "links")
    if star.count() <= few:
        done = materialize(star.coalesce(1).mapInArrow(forest, f"a {kind}, b {kind}").toDF("node", "label"), "components")
        release(star)
        return done
    state = None
    for _ in range(rounds):
        both = star.select("a", "b").union(star.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        before, star = star, materialize(small.filter("a <> b").distinct(), "links")
        release(before)
        new = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components aren't connected after {rounds} rounds")
    done = materialize(star.toDF("node", "label"), "components")
    release(star)
    return done


def document_frequencies(docs: DataFrame, text_col: str, share: float) -> Idf:
    """Idf from the whole corpus. Words of at least `share` of the documents number at most (mean distinct words) / share."""
    texts = pick(docs, _text=text_col)

    def count(batches):
        table, df, docs_n = Table(), np.zeros(0, np.int64), 0
        for b in batches:
            for k, n in slices(b.column(0)):
                words = Words(b.column(0).slice(k, n), lower=True)
                docs_n += n
                codes = table.lookup(words.hashes)
                missing = codes < 0
                if missing.any():
                    table.insert(np.unique(words.hashes[missing]))
                    codes = table.lookup(words.hashes)
                    df = np.append(df, np.zeros(table.n - df.size, np.int64))
                pairs = np.unique(np.repeat(np.arange(n), words.counts) * np.int64(table.n) + codes)
                df += np.bincount(pairs % max(table.n, 1), minlength=df.size)
        used = np.flatnonzero(table.keys)
        keys, df = table.keys[used].view(np.int64), df[table.codes[used]]
        for k in range(0, keys.size, 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 200_000]), pa.array(df[k : k + 200_000])], ["h", "df"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([docs_n], pa.int64())], ["h", "df"])  # no word's hash is 0

    n_docs = docs.count()
    got = texts.mapInArrow(count, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).filter((F.col("h") != 0) & (F.col("df") >= share * n_docs)).toArrow()
    return Idf(got.column("h").to_numpy().view(np.uint64), got.column("df").to_numpy(), n_docs, share)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bands: int = 12, rows: int = 4, share: float = 1e-3, block: int = 512, block_words: int = 1_000_000) -> DataFrame:
    """Per row: id_col, cluster_id (the smallest id of its class), kept (it is that id's), n_words.

    A class is a component of the links of weighted Jaccard similarity of at least `similarity`. Words are compared with A-Z
    in lower case. Null, empty and wordless texts are no copies of anything; rows that share an id are one document, which
    is compared by the least of its texts; a row with a null id has a null cluster and is kept; an empty table has no rows;
    texts of any length are compared whole. Of texts that are equally near nothing is chosen: all links count, and the
    smallest id names the class. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(document_frequencies(docs, text_col, share))
    slim = pick(docs, _id=id_col, _text=text_col)
    kind = slim.schema["_id"].dataType.simpleString()

    def sign(batches):
        for b in batches:
            for k, n in slices(b.column(1)):
                cut = b.slice(k, n)
                counts, h1, h2, of_band = signatures(cut.column(1), idf.value, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(of_band.ravel()))
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(counts), pa.array(h1), pa.array(h2), lists], ["_id", "n_words", "h1", "h2", "bands"])

    signed = materialize(slim.mapInArrow(sign, f"_id {kind}, n_words long, h1 long, h2 long, bands array<long>"), "minhash")
    text_key = ["n_words", "h1", "h2"]
    usable = signed.filter("n_words > 0 and _id is not null")
    copies = materialize(usable.groupBy(*text_key).agg(F.min("_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "minhash-classes")
    placed = copies.select("rep", "n_words", F.posexplode("bands").alias("band", "h"))
    sizes = placed.groupBy("band", "h").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.min("rep").alias("pivot")).filter("n > 1")
    sizes = materialize(sizes, "minhash-sizes")
    # buckets with the same members are one bucket
    buckets = sizes.groupBy("n", "words", "s", "pivot").agg(F.min(F.struct("band", "h")).alias("x")).select("n", "words", "pivot", F.col("x.band").alias("band"), F.col("x.h").alias("h"))
    members = materialize(join_hot(placed.drop("n_words"), buckets, ["band", "h"], sizes.filter(F.col("n") > block)), "minhash-members")
    involved = members.select(F.col("rep").alias("_id")).distinct()
    texts = materialize(slim.join(involved, "_id").join(copies.select(F.col("rep").alias("_id")).distinct(), "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text")), "minhash-texts")

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("rep").combine_chunks()
        found = links(group.column("_text").combine_chunks(), group.column("side").to_numpy(), group.column("known").to_numpy(), idf.value, similarity)
        return pa.Table.from_arrays([ids.take(pa.array([a for a, _ in found], pa.int64())), ids.take(pa.array([b for _, b in found], pa.int64()))], ["a", "b"])

    edge = f"a {kind}, b {kind}"

    def compared(rows: DataFrame, nodes: DataFrame | None) -> DataFrame:
        """Links of buckets, by pairs of blocks of about `block` texts and `block_words` words."""
        blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("words") / block_words)).cast("int")
        own = rows.withColumn("_i", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
        own = own.select("band", "h", "rep", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), F.when(F.col("_i") == F.col("_j"), 2).when(F.col("_i") < F.col("_j"), 0).otherwise(1).alias("side"))
        # numbers of what is connected already; a document by itself has its own
        own = own.join(nodes, own.rep == nodes.node, "left").withColumn("known", F.xxhash64(F.coalesce("label", "rep"))).drop("node", "label") if nodes is not None else own.withColumn("known", F.xxhash64("rep"))
        full = own.join(texts.withColumnRenamed("_id", "rep"), "rep")
        return full.groupBy("band", "h", "i", "j").applyInArrow(compare, edge)

    small = compared(members.filter(F.col("n") <= block), None)
    large = members.filter(F.col("n") > block)
    edges = materialize(small, "minhash-links")
    done = [edges]
    if not large.isEmpty():
        # against one member first: linear in the bucket
        pairs = large.filter("rep <> pivot").select("rep", "pivot").distinct()
        right = texts.toDF("pivot", "_right").join(pairs.select("pivot").distinct(), "pivot", "left_semi")
        small_enough = right.agg(F.coalesce(F.sum(F.octet_length("_right").cast("long") + 64), F.lit(0)).alias("b")).first()["b"] <= MAX_PIVOT_BYTES
        paired = pairs.join(texts.toDF("rep", "_left"), "rep").join(F.broadcast(right) if small_enough else right, "pivot").select("rep", "pivot", "_left", "_right")

        def verify(batches):
            for b in batches:
                keep = []
                for k in range(b.num_rows):
                    pair = pa.concat_arrays([b.column(3).slice(k, 1), b.column(2).slice(k, 1)])
                    if links(pair, np.array([2, 2]), np.array([0, 1]), idf.value, similarity):
                        keep.append(k)
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

        star = materialize(paired.mapInArrow(verify, edge), "minhash-stars")
        edges = edges.union(star)
        nodes = connected(edges)
        done += [star, nodes]
        labelled = large.join(nodes, large.rep == nodes.node, "left").withColumn("label", F.coalesce("label", "rep"))
        mixed = labelled.groupBy("band", "h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("band", "h")
        rest = compared(large.join(mixed, ["band", "h"], "left_semi"), nodes)
        done.append(materialize(rest, "minhash-rest"))
        edges = edges.union(done[-1])
    nodes = connected(edges)
    release(*done, sizes, members, texts)
    final = copies.select(*text_key, "rep").join(nodes, F.col("rep") == F.col("node"), "left").select(*text_key, F.coalesce("label", "rep").alias("cluster_id"))
    judged = join_hot(usable.select("_id", *text_key), final, text_key, copies.filter(F.col("copies") > HOT_COPIES), "left")
    others = signed.filter("n_words = 0 or _id is null").select("_id", *text_key, F.col("_id").alias("cluster_id"))
    out = judged.select("_id", *text_key, "cluster_id").union(others)
    return out.select(F.col("_id").alias(id_col), "cluster_id", F.coalesce(F.col("_id") == F.col("cluster_id"), F.lit(True)).alias("kept"), "n_words")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without near copies, with all columns: of each class the row with the smallest id stays; of rows with one id, one
    stays; rows with null ids all stay."""
    found = near_duplicates(docs, id_col, text_col, **options).filter("kept").select(F.col(id_col).alias("_id")).distinct()
    numbered, own = plain(docs), f"c{at(docs, id_col)}"
    named = numbered.join(found, numbered[own] == found["_id"], "left_semi").dropDuplicates([own])
    return named.unionByName(numbered.filter(F.col(own).isNull())).toDF(*docs.columns)
