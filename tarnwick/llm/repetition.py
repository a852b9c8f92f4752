"""Quality rules: suffix-array repetition.

The suffixes of many documents are sorted together by prefix doubling over word ranks (a rank holds
its document, so suffixes of different documents never meet). Adjacent suffixes' longest common
prefixes give the LCP intervals; at every position the longest prefix that occurs elsewhere in its
document is a maximal repeated substring from there, and the union of those of `min_words` or more is
what repetition covers. Doubling goes on only where suffixes still agree, so text without repeats
costs a few sorts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import WORD_RE, at, free_name, plain
from tarnwick.llm.words import Words, slices

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def repeated_prefixes(codes: np.ndarray, counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lengths) of repeated prefixes, positions ascending.

    codes: word numbers of documents laid end to end; counts: words of each document. A position is given if its suffix
    shares at least `min_words` words with another suffix of its document, with the longest such length.
    """
    n = codes.size
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(counts.size), counts)
    end = np.cumsum(counts)[doc]
    key = doc * (int(codes.max()) + 1) + codes
    rank, group, active = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    base = 1 << (min_words.bit_length() - 1)
    levels, width, sharing = [], 1, np.empty(0, np.int64)
    while True:
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, order.size))
        here = active[order]
        older = group[here]  # where the group of the level before starts in this order
        outer = np.maximum.accumulate(np.where(np.concatenate([[True], older[1:] != older[:-1]]), np.arange(order.size), 0))
        rank = rank.copy()
        rank[here] = older + np.repeat(starts, sizes) - outer
        levels.append((width, rank.astype(np.int32)))
        group = rank
        active = np.sort(here[np.repeat(sizes > 1, sizes)])
        if width == base:
            sharing = active
        if not active.size:
            break
        ahead = active + width
        follow = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + follow
        width *= 2
    sharing = sharing[np.argsort(rank[sharing])]  # the suffix array, where prefixes of `base` words repeat
    if sharing.size < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = sharing[:-1], sharing[1:]
    lcp = np.zeros(a.size, np.int64)
    for width, rank in reversed(levels):
        x, y = a + lcp, b + lcp
        agree = (x < end[a]) & (y < end[b]) & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        lcp += np.where(agree, width, 0)
    longest = np.zeros(sharing.size, np.int64)
    longest[:-1] = lcp
    longest[1:] = np.maximum(longest[1:], lcp)
    hit = longest >= min_words
    at = np.argsort(sharing[hit])
    return sharing[hit][at], longest[hit][at]


def covered(n: int, positions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mask of the union of the spans."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, positions, 1)
    np.add.at(delta, positions + lengths, -1)
    return np.cumsum(delta[:n]) > 0


def repetition_rules(docs: DataFrame, text_col: str = "text", min_words: int = 8, max_covered: float = 0.3, max_longest: int = 40, batch_bytes: int = 1_000_000) -> DataFrame:
    """Adds to each row what repetition finds and the verdict; all columns of `docs` are kept under their names.

    Added: struct column `rules` of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat (long),
    covered_fraction (double), base_failed and kept (boolean). kept is false if the base rules fail, if more than
    `max_covered` of the words are covered by repeats, or if a repeat is longer than `max_longest` words. A null or
    empty text has no words and fails the base rules. Rows are judged one by one: repeated rows get equal results, null
    ids and an empty table change nothing, and a very long text is judged whole, in a slice of its own. If `docs` has a
    column `rules` in whatever case, ours is the last column, `_rules`.
    """
    cols, text = docs.columns, at(docs, text_col)
    fields = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("longest_repeat", pa.int64()), ("covered_fraction", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]

    def judge(column: pa.Array) -> pa.Array:
        words, texts = Words(column), column.to_pylist()
        counts = words.counts
        codes = np.unique(words.hashes, return_inverse=True)[1]
        places, size = repeated_prefixes(codes, counts, min_words)
        doc = np.repeat(np.arange(counts.size), counts)
        n_covered = np.bincount(doc[covered(codes.size, places, size)], minlength=counts.size)
        longest = np.zeros(counts.size, np.int64)
        if places.size:
            np.maximum.at(longest, doc[places], size)
        # code points: bytes that don't continue a character
        first = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        chars = np.bincount(doc, weights=first[words.ends] - first[words.starts], minlength=counts.size).astype(np.int64)
        symbols = [sum(map(t.count, SYMBOLS)) if t else 0 for t in texts]
        dups = []
        for t in texts:
            lines = [x for x in t.split("\n") if WORD_RE.search(x)] if t and "\n" in t else []
            dups.append(len(lines) - len(set(lines)))
        fraction = n_covered / np.maximum(counts, 1)
        failed = (counts < 20) | (100 * n_covered > 30 * counts)
        kept = ~failed & (fraction <= max_covered) & (longest <= max_longest)
        values = (counts, chars, symbols, dups, n_covered, longest, fraction, failed, kept)
        return pa.StructArray.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, fields, strict=True)], [n for n, _ in fields])

    def apply(batches):
        for b in batches:
            for k, n in slices(b.column(b.num_columns - 1), batch_bytes):
                cut = b.slice(k, n)
                yield pa.RecordBatch.from_arrays([*cut.columns[:-1], judge(cut.column(b.num_columns - 1))], [*b.schema.names[:-1], "rules"])

    kinds = ", ".join(f"{n} {'double' if k == pa.float64() else 'boolean' if k == pa.bool_() else 'bigint'}" for n, k in fields)
    numbered = plain(docs)
    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(numbered.schema)) + f", rules struct<{kinds.replace(' ', ':').replace(',:', ',')}>"
    made = numbered.withColumn("_text", F.col(f"c{text}")).mapInArrow(apply, schema)
    return made.toDF(*cols, free_name(docs, "rules"))


def passing(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that repetition_rules() keeps, with their columns; `options` are its parameters."""
    judged = repetition_rules(docs, **options)
    return plain(judged).filter(F.col(f"c{len(docs.columns)}.kept")).drop(f"c{len(docs.columns)}").toDF(*docs.columns)
