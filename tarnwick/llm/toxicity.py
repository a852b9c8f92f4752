"""Toxicity: maximum-scoring segments of token log-odds.

Every letter run of the text is a word here, and so is a piece between white space without letters. A word's weight is
the log-odds that a document holding it is toxic, against the prior, under a chain of Dirichlet priors: the whole word
is shrunk towards its 8-letter prefix, that one towards its 7-letter prefix, and so on up to all documents. Words of
positive weight score it, every other word costs `drift`; the linear-time scan for all maximal scoring segments finds
the passages. Segment scores of unrelated text follow an extreme-value law, P(S >= s) = 1 - exp(-K n e^(-lambda s));
its constants come from clean documents that the weights were not fitted on, and the passages' summed evidence is
calibrated to a probability there.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import crc_bucket, pick
from tarnwick.llm.labelled import labelled_sample, logistic
from tarnwick.llm.words import Table, Words, slices

_LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)


def tokens_of(word: str) -> list[str]:
    """The letter runs of a word, lower-cased ([""] if it has none)."""
    return [m.lower() for m in _LETTERS.findall(word)] or [""]


def maximal_segments(at, weight, drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last position) of a sequence in which the sorted positions `at` score
    `weight` > 0 and each position between them costs `drift`.

    One pass. A candidate is [total before it, total after it, first, last, place of the nearest candidate before it with a
    smaller total before it]; whoever looks for such a candidate goes along these places and skips the others for good.
    """
    total, last, stack = 0.0, -1, []
    for p, w in zip(at, weight, strict=True):
        total -= drift * (p - last - 1)
        seg, last = [total, total + w, p, p, len(stack) - 1], p
        total += w
        while True:
            k = seg[4]
            while k >= 0 and stack[k][0] >= seg[0]:
                k = stack[k][4]
            seg[4] = k
            if k < 0 or stack[k][1] >= seg[1]:
                stack.append(seg)
                break
            seg = [stack[k][0], seg[1], stack[k][2], seg[3], stack[k][4]]
            del stack[k:]
    return [(r - l, a, b) for l, r, a, b, _ in stack]


class Tokens:
    """Numbers for tokens, found by the hashes of the pieces between white space that hold one or more of them."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.table, self.flat, self.ends, self.index, self.names = Table(), np.zeros(0, np.int32), np.zeros(1, np.int64), {}, []

    def numbers(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(number of each token, tokens of each piece)."""
        if max(self.table.n, len(self.names)) > self.limit:
            self.clear()
        codes = self.table.lookup(words.hashes)
        missing = np.flatnonzero(codes < 0)
        if missing.size:
            new, first = np.unique(words.hashes[missing], return_index=True)
            self.table.insert(new)
            got, sizes = [], []
            for w in words.strings(missing[first]):
                own = tokens_of(w)
                for t in own:
                    n = self.index.get(t)
                    if n is None:
                        n = self.index[t] = len(self.names)
                        self.names.append(t)
                    got.append(n)
                sizes.append(len(own))
            self.flat = np.concatenate([self.flat, np.array(got, np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            codes[missing] = self.table.lookup(words.hashes[missing])
        begin, size = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.flat[at], size


def _text_ends(words: Words, sizes: np.ndarray) -> np.ndarray:
    """Where each text's tokens end."""
    return np.append(0, np.cumsum(sizes))[np.cumsum(words.counts)]


def fit_weights(names: list[str], toxic: np.ndarray, clean: np.ndarray, base: float, prior: float = 4.0, least: float = 1.0, min_docs: int = 3) -> tuple[dict[str, float], dict[str, float]]:
    """(weights of words, weights of prefixes) of `least` or more, and words of weight 0 whose prefix alone would have one.

    toxic, clean: documents of each kind that hold each name; base: share of toxic documents.
    """
    hits: dict[str, float] = {}
    seen: dict[str, float] = {}
    for w, t, c in zip(names, toxic.tolist(), clean.tolist(), strict=True):
        if t or c:
            for k in PREFIXES:
                if len(w) <= k:
                    break
                p = w[:k]
                seen[p] = seen.get(p, 0) + t + c
                if t:
                    hits[p] = hits.get(p, 0) + t
    odds = lambda p: math.log(p / (1 - p)) - math.log(base / (1 - base))
    chances: dict[str, float] = {}
    for p in sorted(seen, key=len):
        chances[p] = (hits.get(p, 0) + prior * chances.get(p[:-1], base)) / (seen[p] + prior)
    prefixes = {p: s for p, c in chances.items() if seen[p] >= min_docs and (s := odds(c)) >= least}
    words = {}
    for w, t, c in zip(names, toxic.tolist(), clean.tolist(), strict=True):
        if w and (t or c >= min_docs):
            up = next((chances[w[:k]] for k in reversed(PREFIXES) if len(w) > k), base)
            s = odds((t + prior * up) / (t + c + prior))
            if t and s >= least and (t + c >= min_docs or odds(up) >= least):
                words[w] = s
            elif t + c >= min_docs and any(w[:k] in prefixes for k in PREFIXES if len(w) > k):
                words[w] = 0.0
    return words, prefixes


class Scorer:
    """Positive word weights, and the segments that they form."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float]):
        self.words, self.prefixes, self.tokens, self.weights = words, prefixes, Tokens(), np.zeros(0)

    def __getstate__(self):
        return {"words": self.words, "prefixes": self.prefixes}

    def __setstate__(self, state):
        self.__init__(**state)

    def weight(self, w: str) -> float:
        got = self.words.get(w)
        if got is None:
            got = next((self.prefixes[w[:k]] for k in reversed(PREFIXES) if len(w) > k and w[:k] in self.prefixes), 0.0)
        return got

    def hot(self, column: pa.Array) -> list[tuple[int, list[int], list[float], list[int]]]:
        """Per text: (tokens, positions of tokens with positive weight, their weights, the pieces between white space that hold them)."""
        words = Words(column)
        numbers, sizes = self.tokens.numbers(words)
        if self.weights.size > len(self.tokens.names):
            self.weights = np.zeros(0)  # the numbers began anew
        if self.weights.size < len(self.tokens.names):
            self.weights = np.concatenate([self.weights, [self.weight(w) for w in self.tokens.names[self.weights.size :]]])
        score = self.weights[numbers]
        at = np.flatnonzero(score > 0)
        ends = _text_ends(words, sizes)
        first = np.append(0, ends)[:-1]
        cuts = np.searchsorted(at, np.append(first, numbers.size))
        piece = np.searchsorted(np.cumsum(sizes), at, side="right") - np.repeat(np.cumsum(words.counts) - words.counts, np.diff(cuts))
        local, piece, cuts = (at - np.repeat(first, np.diff(cuts))).tolist(), piece.tolist(), cuts.tolist()
        score = score[at].tolist()
        return [(n, local[a:e], score[a:e], piece[a:e]) for n, a, e in zip((ends - first).tolist(), cuts[:-1], cuts[1:], strict=True)]


class Model:
    def __init__(self, scorer: Scorer, drift: float, rate: float, k: float, weights: np.ndarray):
        self.scorer, self.drift, self.rate, self.k, self.weights = scorer, drift, rate, k, weights

    def features(self, n: int, segments) -> list[float]:
        """Evidence -ln E of the best passage, and the sum over those with E < 1."""
        e = sorted((max(0.0, self.rate * s - math.log(max(self.k * n, 1e-9))) for s, _, _ in segments), reverse=True)
        return [min(e[0], 40.0), math.log1p(sum(e)), math.log1p(sum(s for s, _, _ in segments)), math.log1p(n)] if e else [0.0, 0.0, 0.0, math.log1p(n)]

    def scores(self, column: pa.Array) -> list[tuple[float, list[tuple[float, int, int]]]]:
        """Per text: (probability, significant passages)."""
        out = []
        for n, at, weight, piece in self.scorer.hot(column):
            segments = maximal_segments(at, weight, self.drift)
            z = float(np.dot(self.weights[:-1], self.features(n, segments)) + self.weights[-1])
            of = dict(zip(at, piece, strict=True))
            passages = [(s, of[a], of[z]) for s, a, z in segments if self.k * n * math.exp(-self.rate * s) < 0.05]
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), passages))
        return out


def _rate(hot: np.ndarray, cold: float, drift: float) -> float:
    """lambda of the extreme-value law: the positive root of E[e^(lambda s)] = 1 over tokens of clean text."""
    if not hot.size:
        return 1.0
    f = lambda x: np.exp(np.minimum(x * hot, 50)).sum() + cold * math.exp(-x * drift) - hot.size - cold
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def fit(texts: list[str], labels: list[int]) -> Model:
    """Two folds: each is scored with weights of the other, which fits the law and the calibration; then all weights."""
    y, fold, tokens, own = np.array(labels, float), np.arange(len(texts)) % 2, Tokens(1 << 62), []
    column = pa.array(texts, pa.string())
    for k, n in slices(column):
        words = Words(column.slice(k, n))
        numbers, sizes = tokens.numbers(words)
        own += [np.unique(x) for x in np.split(numbers, _text_ends(words, sizes)[:-1])]
    size = len(tokens.names)
    held = [[np.bincount(np.concatenate([own[i] for i in np.flatnonzero((fold == f) & (y == c))] or [np.zeros(0, np.int64)]), minlength=size) for c in (0, 1)] for f in (0, 1)]
    base = (y.sum() + 1) / (len(y) + 2)
    found: list = [None] * len(texts)
    for f in (0, 1):
        scorer = Scorer(*fit_weights(tokens.names, held[1 - f][1], held[1 - f][0], base))
        rows = np.flatnonzero(fold == f)
        part = column.take(pa.array(rows))
        got = [x for k, n in slices(part) for x in scorer.hot(part.slice(k, n))]
        for i, x in zip(rows, got, strict=True):
            found[i] = x
    scorer = Scorer(*fit_weights(tokens.names, held[0][1] + held[1][1], held[0][0] + held[1][0], base))
    clean = [x for x, t in zip(found, labels, strict=True) if not t]
    hot = np.array([w for _, _, ws, _ in clean for w in ws])
    cold = max(1, sum(n for n, *_ in clean) - hot.size)
    drift = min(0.5, max(0.02, 3 * float(hot.sum()) / cold))  # the mean score of clean text has to be below 0
    rate = _rate(hot, cold, drift)
    # K: clean segments of lambda S > 1 number K n / e
    k = max(sum(rate * s > 1 for n, at, ws, _ in clean for s, _, _ in maximal_segments(at, ws, drift)) * math.e / (cold + hot.size), 1e-6)
    model = Model(scorer, drift, rate, k, np.zeros(5))
    if len(set(labels)) > 1:
        model.weights = logistic(np.array([model.features(n, maximal_segments(at, ws, drift)) for n, at, ws, _ in found]), y)
    else:
        model.weights = np.array([0, 0, 0, 0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 4, held_out: int = 2, train_rows: int = 8_000, train_bytes: int = 64_000_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, held_out, score, predicted, passages (array of struct<score, first, last> in word positions).

    Learns from at most `train_rows` labelled documents of `train_bytes` in all, outside the held-out remainder (bounded
    sample; the model then fits a broadcast whatever the corpus). Null and empty texts have no passage and get the score of
    a text without any. Without usable labels every score is that of the prior. Rows are scored one by one: repeated rows
    score alike, null ids are scored like others, an empty table has no rows, and a very long text is scored whole, in
    time linear in its length. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    texts, y = labelled_sample(docs, labels, label_col, modulus, held_out, train_rows, id_col, text_col, train_bytes)
    model = spark.sparkContext.broadcast(fit(texts, y))
    rows = pick(docs, _id=id_col, _text=text_col).select("_id", (crc_bucket(F.col("_id"), modulus) == held_out).alias("held_out"), "_text")

    def apply(batches):
        m = model.value
        kind = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))
        for b in batches:
            for k, n in slices(b.column(2)):
                cut = b.slice(k, n)
                got = m.scores(cut.column(2))
                score = [s for s, _ in got]
                spans = pa.array([[{"score": s, "first": a, "last": z} for s, a, z in p] for _, p in got], kind)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), spans], ["_id", "held_out", "score", "predicted", "passages"])

    kind = rows.schema["_id"].dataType.simpleString()
    made = rows.mapInArrow(apply, f"_id {kind}, held_out boolean, score double, predicted int, passages array<struct<score:double,first:int,last:int>>")
    return made.withColumnRenamed("_id", id_col)
