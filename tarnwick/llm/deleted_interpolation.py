"""LM scoring: deleted interpolation.

P(w | u v) = l3 f(w | u v) + l2 f(w | v) + l1 f(w) + l0 / (V + 1)

f are maximum-likelihood estimates over the words themselves, and the weights l depend on a bucket of the context's
frequency; they are learned by expectation-maximisation on the counts of a held-out seventh of the training documents,
with f from the rest. Words, bigrams and trigrams are all counted exactly, whatever their frequency.

The corpus is read once and kept as packed chunks. Words and bigrams are counted in a first round; what occurs once in the
whole corpus says so itself, and so does a trigram with a bigram in it that occurs once, so the second round sends only
trigrams whose two bigrams both occur again. No count is lost by that, and no process holds more than a chunk or a range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import at, crc_bucket, materialize, pick, release, tidy
from tarnwick.llm.packed import answers, by_range, gathered, key_ranges, sent_schema, squeeze, to_ranges, totals, unsqueeze, write_chunks
from tarnwick.llm.words import Words, mix, slices, trim

#: Hashes of words are odd, keys of n-grams even; these stand for the end and for the place before a text.
END, BEFORE = np.uint64(2), np.uint64(4)
#: Contexts have BUCKETS of frequency; estimates are counted in LEVELS, STEPS of them for a power of ten.
BUCKETS, LEVELS, STEPS = 32, 48, 4


def gram_keys(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (v w), (u v w) at each token w, with u and v the two tokens before it in its document."""
    one, two, even = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), ~np.uint64(1)
    v = np.empty_like(words)
    v[1:], v[starts] = words[:-1], BEFORE
    u = np.empty_like(words)
    u[1:], u[starts] = v[:-1], BEFORE
    uv = mix(u * one + v * two + np.uint64(11))
    return mix(v * one + words * two + np.uint64(11)) & even, mix(uv + words * one + np.uint64(13)) & even


def estimates(n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, counts: np.ndarray, total: float):
    """(bucket, f3, f2, f1) of each token from the counts of its word, bigram and trigram. counts: tokens of each text."""
    starts = np.cumsum(counts) - counts
    before, pair = np.empty_like(n1), np.empty_like(n2)
    before[1:], pair[1:] = n1[:-1], n2[:-1]
    before[starts], pair[starts] = n1[starts + counts - 1], 0  # texts have one beginning and one end each
    f3 = np.where(pair > 0, n3 / np.maximum(pair, 1), 0)
    f2 = np.where(before > 0, n2 / np.maximum(before, 1), 0)
    context = np.where(pair > 0, pair, np.maximum(before, 1)) / max(total, 1.0)
    bucket = np.clip(np.log2(context) + 20, 0, BUCKETS // 2 - 1).astype(np.int64) + np.where(pair > 0, BUCKETS // 2, 0)
    return bucket, f3, f2, n1 / max(total, 1.0)


def _level(f: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(f > 0, np.clip(-STEPS * np.log10(f), 0, LEVELS - 2), LEVELS - 1).astype(np.int64)


def learn_weights(keys: np.ndarray, counts: np.ndarray, floor: float, rounds: int = 40) -> np.ndarray:
    """Mixture weights of each bucket (l3, l2, l1, l0) from counts of quantised estimates, by expectation-maximisation.

    A bucket without held-out tokens takes the weights of all tokens together.
    """
    value = np.append(10.0 ** (-(np.arange(LEVELS - 1) + 0.5) / STEPS), 0.0)
    f = np.column_stack([value[keys // LEVELS**2 % LEVELS], value[keys // LEVELS % LEVELS], value[keys % LEVELS], np.full(keys.size, floor)])
    bucket, out = keys // LEVELS**3, np.full((BUCKETS, 4), 0.25)

    def run(rows):
        w, x, n = np.full(4, 0.25), f[rows], counts[rows].astype(float)
        for _ in range(rounds if n.size else 0):
            p = x * w
            p /= p.sum(axis=1, keepdims=True)
            w = (p * n[:, None]).sum(axis=0) / n.sum()
            w = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
        return w

    every = run(np.arange(keys.size))
    for b in range(BUCKETS):
        rows = np.flatnonzero(bucket == b)
        out[b] = run(rows) if rows.size else every
    return out


def chunked(docs: DataFrame, id_col: str, text_col: str, modulus: int, held_out: int, chunk_bytes: int) -> DataFrame:
    """The corpus as chunks, written once: chunk, its texts (doc_ids, part, counts, tokens), its words, and its numbers of training tokens."""
    rows = pick(docs, _id=id_col, _text=text_col)
    part = crc_bucket(F.col("_id"), modulus)
    # 0: held out; 2: the part of the training documents that the mixture weights are learned on; 1: the rest
    rows = rows.select("_id", F.when(part == held_out, 0).when(part == (held_out + 1) % modulus, 2).otherwise(1).cast("int").alias("_part"), "_text")
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["chunk", "doc_ids", "part", "counts", "tokens", "words", "n_all", "n_main"]

    def apply(batches):
        task, seq = TaskContext.get().partitionId(), 0
        ids, parts, counts, hashes, held = [], [], [], [], 0

        def flush():
            nonlocal seq, ids, parts, counts, hashes, held
            chunk = (task << 24) + seq
            seq += 1
            part, count, every = np.concatenate(parts), np.concatenate(counts), np.concatenate(hashes)
            words, local, times = np.unique(every, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            place = np.empty(order.size, np.int64)
            place[order] = np.arange(order.size)
            words, local = words[order], place[local]
            all_ids = pa.concat_arrays(ids)
            row = [pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids), pa.array([part.tolist()], pa.list_(pa.int32())), pa.array([count.tolist()], pa.list_(pa.int64()))]
            row += [pa.array([x], pa.binary()) for x in (squeeze(local), words.tobytes())] + [pa.array([int(count[part > 0].sum())]), pa.array([int(count[part == 1].sum())])]
            yield pa.RecordBatch.from_arrays(row, names)
            ids, parts, counts, hashes, held = [], [], [], [], 0
            trim()

        for b in batches:
            for k, n in slices(b.column(2)):
                cut = b.slice(k, n)
                w = Words(cut.column(2), lower=True)
                ids.append(cut.column(0))
                parts.append(cut.column(1).to_numpy())
                counts.append(w.counts + 1)
                hashes.append(np.insert(w.hashes, np.cumsum(w.counts), END))
                held += w.data.size + 64 * n
                if held >= chunk_bytes:
                    yield from flush()
        if ids:
            yield from flush()

    schema = f"chunk long, doc_ids array<{kind}>, part array<int>, counts array<long>, tokens binary, words binary, n_all long, n_main long"
    return write_chunks(rows.mapInArrow(apply, schema), "lm_chunks")


class Chunk:
    """Words and bigrams of a chunk: `keys`, sorted, and the numbers in them of each token's word and bigram."""

    def __init__(self, row: pa.Table):
        self.part, self.counts = (row.column(k).combine_chunks().flatten().to_numpy() for k in ("part", "counts"))
        words = np.frombuffer(row.column("words")[0].as_buffer(), "<u8")
        local = unsqueeze(row.column("tokens")[0].as_buffer(), int(self.counts.sum()))
        self.starts, self.of = np.cumsum(self.counts) - self.counts, np.repeat(self.part, self.counts)
        pairs, self.triples = gram_keys(words[local], self.starts)
        self.keys, at = np.unique(np.concatenate([words, pairs]), return_inverse=True)
        at = at.astype(np.int32)
        self.word, self.pair = at[: words.size][local], at[words.size :]

    def tallies(self, size: int, *places) -> list[np.ndarray]:
        """Per key: how often the chunk has it, has it held out, and has it in the part that weights are learned on."""
        each = lambda part: sum(np.bincount(p if part is None else p[o == part], minlength=size) for p, o in places)
        return [each(None), each(0), each(2)]

    def first(self, told: pa.Table) -> None:
        """Corpus counts of words and bigrams from the first round's answers: `n` and `main` by key, 0 in `n` where the key is
        alone in the corpus; `wanted` marks the tokens whose trigrams are not told by that."""
        self.n = answers(told, "n")
        alone = self.n[self.pair] == 0
        before = np.ones(alone.size, bool)
        before[1:] = alone[:-1]
        before[self.starts] = True  # a text's first token has no trigram of its own
        self.wanted = np.flatnonzero(~alone & ~before)
        self.triples = self.triples[self.wanted]

    def second(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct keys of the wanted trigrams, number of each token's)."""
        return np.unique(self.triples, return_inverse=True)

    def counts_of(self, told: pa.Table, keys_n: np.ndarray, at: np.ndarray, of: np.ndarray, has_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count, count in the main part) of the token places `at`; the latter only where the chunk asked for it."""
        main = np.zeros(keys_n.size, np.int64)
        main[has_weights] = answers(told, "main", "asked")
        n = keys_n[at]
        return np.where(n == 0, of > 0, n - 1), np.where(n == 0, of == 1, main[at])


def _send(first: bool, ranges: int):
    def rows(chunk: Chunk, number: int) -> pa.RecordBatch:
        if first:
            places, keys = ((chunk.word, chunk.of), (chunk.pair, chunk.of)), chunk.keys
        else:
            keys, at = chunk.second()
            places = ((at, chunk.of[chunk.wanted]),)
        made = to_ranges(number, keys, chunk.tallies(keys.size, *places), ranges)
        trim()
        return made

    return rows


def _answered(group: pa.Table) -> pa.Table:
    """Of each key that a chunk sent: `n`, 0 if the corpus has it once and else one more than its training count; `main`, its
    count outside held-out and weights' documents, of keys that the chunk has in the latter; and how many training words the range holds."""
    cuts, keys, of, _, (every, held, weights) = gathered(group, 3)
    asked = weights > 0
    total, held, weights = (totals(of, x, keys.size) for x in (every, held, weights))
    n, main = total - held, total - held - weights
    word = (keys & np.uint64(1) == 1) | (keys == END)
    back_n, back_main = np.where(total == 1, 0, n + 1)[of], main[of]
    ends = list(zip(cuts[:-1], cuts[1:], strict=True))
    some = [back_main[a:e][asked[a:e]] for a, e in ends]
    known = [pa.array([int((word & (x > 0)).sum())] + [0] * (len(ends) - 1), pa.int64()) for x in (n, main)]
    columns = [group.column("chunk"), group.column("range"), group.column("size"), pa.array([squeeze(back_n[a:e], 8) for a, e in ends], pa.binary())]
    columns += [pa.array([x.size for x in some], pa.int32()), pa.array([squeeze(x, 8) for x in some], pa.binary())]
    trim()
    return pa.Table.from_arrays(columns + known, _TOLD_NAMES)


_TOLD_NAMES = ["chunk", "range", "size", "n", "asked", "main", "v_all", "v_main"]
_TOLD = "chunk long, range int, size int, n binary, asked int, main binary, v_all long, v_main long"


def counted(chunks: DataFrame, n_tokens: int, n_main: int, range_rows: int) -> DataFrame:
    """One row a chunk, written once: its texts, the corpus counts of each token's word, bigram and trigram, counts of
    quantised estimates on the part that the mixture weights are learned on, and numbers of known words."""
    spark = chunks.sparkSession
    ranges = key_ranges(spark, 2 * n_tokens, range_rows)
    content = chunks.select("chunk", "part", "counts", "tokens", "words")

    def first(batches):
        send = _send(True, ranges)
        for b in batches:
            for k in range(b.num_rows):
                row = pa.Table.from_batches([b.slice(k, 1)])
                yield send(Chunk(row), row.column("chunk")[0].as_py())

    one = materialize(content.mapInArrow(first, sent_schema(3)).groupBy("range").applyInArrow(_answered, _TOLD), "lm-first")
    tidy(spark)

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left)
        chunk.first(by_range(right))
        return pa.Table.from_batches([_send(False, ranges)(chunk, left.column("chunk")[0].as_py())])

    sent = content.groupBy("chunk").cogroup(one.select("chunk", "range", "size", "n").groupBy("chunk")).applyInArrow(second, sent_schema(3))
    two = materialize(sent.groupBy("range").applyInArrow(_answered, _TOLD), "lm-second")
    tidy(spark)
    told = one.withColumn("round", F.lit(1)).union(two.withColumn("round", F.lit(2)))
    texts = chunks.select("chunk", "doc_ids", "part", "counts", "tokens", "words")
    kind = texts.schema["doc_ids"].dataType.simpleString()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        first, second = (by_range(right.filter(pa.array(right.column("round").to_numpy() == k))) for k in (1, 2))
        chunk = Chunk(left)
        chunk.first(first)
        weights = chunk.tallies(chunk.keys.size, (chunk.word, chunk.of), (chunk.pair, chunk.of))[2] > 0
        both = [chunk.counts_of(first, chunk.n, at, chunk.of, weights) for at in (chunk.word, chunk.pair)]
        del chunk.keys, chunk.n, chunk.word, chunk.pair
        keys, at = chunk.second()
        own = chunk.of[chunk.wanted]
        got = chunk.counts_of(second, answers(second, "n"), at, own, np.bincount(at[own == 2], minlength=keys.size) > 0)
        # a trigram that holds a bigram of one occurrence occurs once, here
        triples = ((chunk.of > 0).astype(np.int64), (chunk.of == 1).astype(np.int64))
        for every, some in zip(triples, got, strict=True):
            every[chunk.wanted] = some
        grams = [squeeze(n, 8) for n in (both[0][0], both[1][0], triples[0])]
        key, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        mine = chunk.of == 2
        if mine.any():
            bucket, *f = estimates(both[0][1][mine], both[1][1][mine], triples[1][mine], chunk.counts[chunk.part == 2], n_main)
            key, times = np.unique(((bucket * LEVELS + _level(f[0])) * LEVELS + _level(f[1])) * LEVELS + _level(f[2]), return_counts=True)
        columns = [left.column(j) for j in ("doc_ids", "part", "counts")] + [pa.array([x], pa.binary()) for x in grams] + [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (key, times)]
        columns += [pa.array([int(first.column(j).to_numpy().sum())]) for j in ("v_all", "v_main")]
        trim()
        return pa.Table.from_arrays(columns, ["doc_ids", "part", "counts", "n1", "n2", "n3", "held_key", "held_n", "v_all", "v_main"])

    schema = f"doc_ids {kind}, part array<int>, counts array<long>, n1 binary, n2 binary, n3 binary, held_key array<long>, held_n array<long>, v_all long, v_main long"
    ready = materialize(texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, schema), "lm-counted")
    release(one, two, chunks)
    return ready


def _runs(batches, tokens: int = 250_000):
    """(ids, part, counts, n1, n2, n3) of runs of about `tokens` tokens, cut between texts, so that work arrays stay small."""
    for b in batches:
        for j in range(b.num_rows):
            ids, part, counts = (b.column(i).slice(j, 1).flatten() for i in range(3))
            part, counts = part.to_numpy(), counts.to_numpy()
            ends, k = np.cumsum(counts), 0
            grams = [unsqueeze(b.column(i)[j].as_buffer(), int(ends[-1]), 8) for i in (3, 4, 5)]
            while k < counts.size:
                before = ends[k - 1] if k else 0
                e = max(k + 1, int(np.searchsorted(ends, before + tokens, side="right")))
                yield ids.slice(k, e - k), part[k:e], counts[k:e], *(x[before : ends[e - 1]].astype(np.int64) for x in grams)
                k = e
        trim()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, chunk_bytes: int = 8_000_000, range_rows: int = 1_000_000) -> DataFrame:
    """Per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id) mod `modulus` is `held_out` are scored but never learned from. Null and empty texts are the end
    token alone; an empty table has no rows; without training rows all counts are 0 and every token is unknown. Repeated
    rows are separate documents. Other columns are not read.
    """
    spark = docs.sparkSession
    chunks = chunked(docs, id_col, text_col, modulus, held_out, chunk_bytes)
    own = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    sums = chunks.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(n) for k, n in ((own, "t"), ("n_all", "n"), ("n_main", "m")))).first()
    n_all, n_main = int(sums["n"]), int(sums["m"])
    ready = counted(chunks, int(sums["t"]), n_main, range_rows)
    s = ready.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("v_all", "v_main"))).first()
    v_all, v_main = int(s["v_all"]), int(s["v_main"])
    # at most BUCKETS x LEVELS^3 = 3.5 million rows of 16 bytes by the layout of the key, whatever the corpus
    pairs = ready.select(F.explode(F.arrays_zip("held_key", "held_n")).alias("h"))
    held = pairs.groupBy(F.col("h.held_key").alias("k")).agg(F.sum("h.held_n").alias("n")).toArrow().sort_by("k")
    weights = learn_weights(held.column("k").to_numpy(), held.column("n").to_numpy(), 1 / (v_main + 1))

    def apply(batches):
        for ids, part, counts, n1, n2, n3 in _runs(batches):
            doc = np.repeat(np.arange(counts.size), counts)
            bucket, f3, f2, f1 = estimates(n1, n2, n3, counts, n_all)
            w = weights[bucket]
            p = w[:, 0] * f3 + w[:, 1] * f2 + w[:, 2] * f1 + w[:, 3] / (v_all + 1)
            base = np.log10((n1 + 1) / (n_all + v_all + 1))
            sums = [np.bincount(doc, weights=x, minlength=counts.size) for x in (n1 > 0, base, np.log10(p))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(part == 0), pa.array(counts), pa.array(sums[0].astype(np.int64)), pa.array(np.full(counts.size, n_all)), pa.array(sums[1]), pa.array(sums[2])], ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[at(docs, id_col)].dataType.simpleString()
    made = ready.select("doc_ids", "part", "counts", "n1", "n2", "n3").mapInArrow(apply, f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return made.withColumnRenamed("_id", id_col)
