"""Words of Arrow text columns as NumPy arrays, without a Python object per word.

A slice of texts is one byte buffer. White space bytes cut it into words, and polynomial hashes of every word come
from two prefix sums' difference: one modulo 2^64 with an odd base, one modulo the prime 2^31 - 1, mixed into 64 bits.
The first alone is fooled by regular long words (Thue-Morse words agree for every odd base); words of L bytes that do so
agree in the second with odds of L / 2^31 over its base. Other words collide with odds of about 2^-64 a pair: 10 million
distinct words hold a collision with odds of 1 in 400 000.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PRIME, _PRIME_BASE = (1 << 31) - 1, 0x3C6EF372
_M31, _31 = np.uint64(_PRIME), np.uint64(31)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 4


def _fold(x: np.ndarray) -> np.ndarray:
    """The number's remainder by 2^31 - 1 or a little more: at most 2^31 + 1."""
    x = (x & _M31) + (x >> _31)
    return (x & _M31) + (x >> _31)


def _modulo(x: np.ndarray) -> np.ndarray:
    """Remainder by 2^31 - 1."""
    x = _fold(x)
    return np.where(x >= _M31, x - _M31, x)


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the two bases and of their inverses."""
    if _POWERS[0].size < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
        for k, base in enumerate((_PRIME_BASE, pow(_PRIME_BASE, -1, _PRIME)), 2):
            p = np.ones(1, np.uint64)
            while p.size < 2 * n:
                p = np.concatenate([p, _modulo(p * np.uint64(pow(base, p.size, _PRIME)))])
            _POWERS[k] = p[: 2 * n].astype(np.uint32)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(32))


#: Bytes of text that are hashed at a time.
_BLOCK = 600_000


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down, up_p, down_p = _powers(data.size)
    total, values = np.empty(data.size + 1, np.uint64), data.astype(np.uint64) + np.uint64(1)
    total[0] = 0
    np.cumsum(values * up[: data.size], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    values *= up_p[: data.size]
    np.cumsum(values if data.size < 1 << 24 else _fold(values), out=total[1:])
    residue = _modulo(_fold(total[ends] - total[starts]) * down_p[starts])
    return mix(h ^ residue * np.uint64(_MIX)) | np.uint64(1)


def _cut(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, a line feed after each; starts and ends of words; number of words of each text)."""
    joined = pc.binary_join_element_wise(pc.coalesce(texts.cast(pa.large_string()), pa.scalar("", pa.large_string())), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    bounds = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(joined) else np.empty(0, np.uint8)
    bounds = bounds - (bounds[0] if len(joined) else 0)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if data.size and inside[0]:
        turn = np.concatenate([[0], turn])
    starts, ends = turn[0::2], turn[1::2]  # a text ends with a line feed, so every start has an end
    return data, starts, ends, np.diff(np.searchsorted(starts, bounds)) if len(texts) else np.zeros(0, np.int64)


class Words:
    """Words of a slice: starts and ends in `data`, hashes (never 0), and `counts` of each text."""

    __slots__ = ("data", "starts", "ends", "hashes", "counts")

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, self.starts, self.ends, self.counts = _cut(texts, lower)
        self.data = data
        self.hashes = np.empty(self.starts.size, np.uint64)
        k = 0
        while k < self.starts.size:  # blocks of whole words, so that a very long text takes no more room than many short ones
            base = self.starts[k]
            e = max(k + 1, int(np.searchsorted(self.ends, base + _BLOCK, side="right")))
            self.hashes[k:e] = _hashes(data[base : self.ends[e - 1]], self.starts[k:e] - base, self.ends[k:e] - base)
            k = e

    def __len__(self) -> int:
        return self.starts.size

    def strings(self, at) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:e].decode("utf-8", "replace") for a, e in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def slices(batch_column: pa.Array, size: int = 500_000, rows: int = 4096):
    """(start, length) of runs of rows of about `size` bytes of text and `rows` rows at most; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch_column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, k, n = np.cumsum(lengths), 0, len(batch_column)
    while k < n:
        e = min(k + rows, max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, side="right"))))
        yield k, e - k
        k = e
    trim()


_LIBC = None


def trim() -> None:
    """Give freed memory back to the system, so that workers that stay don't hold their peak."""
    global _LIBC
    pa.default_memory_pool().release_unused()
    if _LIBC is None:
        try:
            _LIBC = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):  # another C library
            _LIBC = lambda _: 0
    _LIBC(0)


class Table:
    """Open-addressing hash table from nonzero uint64 to numbers 0, 1, 2 ... in order of insertion."""

    def __init__(self, room: int = 1 << 16):
        self.n, self.keys, self.codes = 0, np.zeros(room, np.uint64), np.zeros(room, np.int32)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Numbers, -1 where missing."""
        mask = np.uint64(self.keys.size - 1)
        slot = (h >> np.uint64(7)) & mask
        key = self.keys[slot]
        out = np.where(key == h, self.codes[slot], np.int32(-1))
        todo = np.flatnonzero((key != h) & (key != 0))
        while todo.size:
            slot[todo] = (slot[todo] + np.uint64(1)) & mask
            key = self.keys[slot[todo]]
            same = key == h[todo]
            out[todo[same]] = self.codes[slot[todo[same]]]
            todo = todo[~same & (key != 0)]
        return out

    def insert(self, h: np.ndarray) -> None:
        """Distinct hashes that the table does not hold get the next numbers."""
        if 2 * (self.n + h.size) > self.keys.size:
            old = np.flatnonzero(self.keys)
            keys, codes, size = self.keys[old], self.codes[old], self.keys.size
            while 2 * (self.n + h.size) > size:
                size *= 2
            self.keys, self.codes = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(keys, codes)
        self._place(h, np.arange(self.n, self.n + h.size, dtype=np.int32))
        self.n += h.size

    def _place(self, h: np.ndarray, codes: np.ndarray) -> None:
        mask = np.uint64(self.keys.size - 1)
        slot, todo = (h >> np.uint64(7)) & mask, np.arange(h.size)
        while todo.size:
            s = slot[todo]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[todo[free]]  # of those that meet in a slot, one stays
            won = self.keys[s] == h[todo]
            self.codes[s[won]] = codes[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + np.uint64(1)) & mask
