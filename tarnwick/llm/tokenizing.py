"""Word-cached encoding with a public tokenizer file.

The tokenizers library spends most of its time normalising and pre-splitting. Where a tokenizer
drops white space before it splits, each white-space word's ids depend on that word alone. So words
are hashed and numbered, ids are kept by word in one flat array, and a batch's ids are gathered from
there with NumPy. The bytes of each word are compared with those that its hash was learned with, so words whose hashes meet
still get their own ids. New words are split by the tokenizer's own rule and their letter runs encoded in
one call of a bare copy of the model; words with other than Latin letters go to the library itself.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from tarnwick.llm.words import Table, Words

#: Latin letters that lower-casing and NFC leave alone, after lower-casing: ranges of U+00C0 to U+024F.
_LATIN = "ß-öø-ɏ"
#: The tokenizer's split rule over lower-cased words of ASCII and those letters; "\n" keeps words apart.
_PIECE = re.compile(rf"\n|'(?:s|t|re|ve|m|ll|d)|[a-z{_LATIN}]+|[0-9]|[^\x09-\x0d\x20a-z0-9{_LATIN}]+")
_OTHER = re.compile(rf"[^\x00-\x7f{_LATIN}]")
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Lists:
    """Number -> list of numbers, kept flat."""

    def __init__(self, kind=np.uint32):
        self.n, self.used = 0, 0
        self.start, self.size, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, kind)

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n + sizes.size, self.used + ids.size
        if n > self.start.size:
            self.start, self.size = (np.concatenate([x, np.zeros(max(n, x.size), np.int32)]) for x in (self.start, self.size))
        if used > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros(max(used, self.flat.size), self.flat.dtype)])
        self.start[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : n] = sizes
        self.flat[self.used : used] = ids
        self.n, self.used = n, used

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[codes]
        return self.flat[_spread(self.start[codes], sizes)], sizes


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs, one run after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    at = np.repeat(starts - (ends - sizes), sizes)
    return at + np.arange(at.size)


#: By the number of bytes that count, from 0 to 8: which bits of a little-endian number those are.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _lanes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each word and the next eight, as numbers; bytes after its end are zero."""
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    every = np.lib.stride_tricks.as_strided(wide[:8].view("<u8"), shape=(wide.size - 7,), strides=(1,))
    return every[starts] & _BYTES[np.minimum(sizes, 8)], every[starts + 8] & _BYTES[np.clip(sizes - 8, 0, 8)]


class _Known:
    """Words with their ids, found by hash and checked by bytes: sixteen of them as two numbers, the rest of long words one by one."""

    def __init__(self, learn):
        self.table, self.ids, self.learn, self.met = Table(), _Lists(), learn, {}
        self.first, self.next, self.sizes, self.rest = _Lists(np.uint64), _Lists(np.uint64), _Lists(np.int64), _Lists(np.uint8)

    def _add(self, words: Words, at: np.ndarray) -> None:
        starts, sizes = words.starts[at], words.ends[at] - words.starts[at]
        one, two = _lanes(words.data, starts, sizes)
        self.first.extend(one, np.ones(at.size, np.int64))
        self.next.extend(two, np.ones(at.size, np.int64))
        self.sizes.extend(sizes, np.ones(at.size, np.int64))
        beyond = np.maximum(sizes - 16, 0)
        self.rest.extend(words.data[_spread(starts + 16, beyond)], beyond)
        self.ids.extend(*self.learn(words.strings(at)))

    def codes(self, words: Words) -> np.ndarray:
        codes = self.table.lookup(words.hashes)
        missing = np.flatnonzero(codes < 0)
        if missing.size:
            new, first = np.unique(words.hashes[missing], return_index=True)
            self.table.insert(new)
            self._add(words, missing[first])
            codes[missing] = self.table.lookup(words.hashes[missing])
        sizes = words.ends - words.starts
        one, two = _lanes(words.data, words.starts, sizes)
        same = (self.sizes.flat[codes] == sizes) & (self.first.flat[codes] == one) & (self.next.flat[codes] == two)
        long = np.flatnonzero(same & (sizes > 16))
        if long.size:
            beyond = sizes[long] - 16
            differs = self.rest.gather(codes[long])[0] != words.data[_spread(words.starts[long] + 16, beyond)]
            if differs.any():
                same[long[np.add.reduceat(differs, np.cumsum(beyond) - beyond) > 0]] = False
        for k in np.flatnonzero(~same).tolist():
            word = words.data[words.starts[k] : words.ends[k]].tobytes()
            if word not in self.met:  # its hash is another word's: it has a number outside the table
                self.met[word] = self.ids.n
                self.table.n += 1
                self._add(words, np.array([k]))
            codes[k] = self.met[word]
        return codes


class Encoder:
    """encode_flat(texts) gives the library's own ids of many texts; `limit` and `part_limit` bound the words and letter runs held."""

    def __init__(self, path: str | None = None, limit: int = 800_000, part_limit: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        path = path or default_path()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.limit, self.part_limit = Tokenizer.from_file(path), limit, part_limit
        self.by_word = self._drops_white_space(spec)
        if self.by_word:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = spec["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._clear_words()
        self._clear_parts()

    def _clear_words(self) -> None:
        self.words = _Known(self._learn)

    def _clear_parts(self) -> None:
        self.parts = _Known(self._pieces_of)

    @staticmethod
    def _drops_white_space(spec: dict) -> bool:
        """True if the file's rules are those that the word cache is proven for."""
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
            and splits[0].get("behavior") == "Removed"
            and bool(splits[0].get("invert"))
            and splits[0]["pattern"].get("Regex") == _RULE
            and spec["model"].get("end_of_word_suffix") == "</w>"
        )

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _pieces(self, lowered: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of n words, which "\n" joins."""
        found = _PIECE.findall(lowered)
        ends = np.fromiter(map("\n".__eq__, found), bool, len(found))
        pieces = Words(pa.array(["\n".join(found)], pa.string()))  # pieces hold no white space, so they are its words
        ids, sizes = self.parts.ids.gather(self.parts.codes(pieces))
        return ids, np.bincount(np.cumsum(ends)[~ends], weights=sizes, minlength=n).astype(np.int64)

    def _pieces_of(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of letter runs, from the bare model."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if cuts.size != len(new):
            raise ValueError("the model's end-of-word tokens don't mark every piece")
        return ids, np.diff(np.concatenate([[0], cuts]))

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(words)
        lowered = joined.lower()
        if not _OTHER.search(lowered) and "oftext|>" not in lowered:
            return self._pieces(lowered, len(words))
        odd = np.array([bool(_OTHER.search(w.lower())) or "oftext|>" in w.lower() for w in words])
        plain = [w for w, o in zip(words, odd, strict=True) if not o]
        sizes = np.zeros(len(words), np.int64)
        some, sizes[odd] = self._library([w for w, o in zip(words, odd, strict=True) if o])
        rest, sizes[~odd] = self._pieces("\n".join(plain).lower(), len(plain)) if plain else (np.empty(0, np.uint32), np.zeros(0, np.int64))
        ids, is_odd = np.empty(int(sizes.sum()), np.uint32), np.repeat(odd, sizes)
        ids[is_odd], ids[~is_odd] = some, rest
        return ids, sizes

    def encode_flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each); `end_id` is appended to each text. A null text is empty."""
        if self.by_word:
            if self.words.ids.n > self.limit:
                self._clear_words()
            if self.parts.ids.n > self.part_limit:
                self._clear_parts()
            words = Words(texts)
            ids, sizes = self.words.ids.gather(self.words.codes(words))
            cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(words.counts)])]
            sizes = np.diff(cuts)
        else:
            ids, sizes = self._library([t or "" for t in texts.to_pylist()])
        if end_id is not None:
            ids, sizes = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1
        return ids, sizes


_ENCODERS: dict = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder a Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
