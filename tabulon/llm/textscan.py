"""Vectorised word scanning of Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 are always whole
characters. Every function works on one Arrow batch, in units of about ``UNIT`` bytes, so that
per-byte arrays stay small; a longer text is cut at white space into pieces and only its word
hashes are put together again. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

UNIT = 1 << 18
M1, M2, ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * ODD)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), ODD, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte data and the offsets of each text in it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def units(off: np.ndarray, size: int = UNIT) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes together."""
    first, n = 0, len(off) - 1
    while first < n:
        last = int(np.searchsorted(off, off[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and hash of each word; no word goes over an offset in ``marks``."""
    inside = ~SPACE[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    marks = marks[marks < len(data)]
    begins[marks] = inside[marks]
    starts = np.flatnonzero(begins)
    word = np.cumsum(begins[at]) - 1
    place = at - starts[word]
    values = BYTE[data[at]] * powers(int(place.max()) + 1)[place]
    return starts, mix(np.add.reduceat(values, np.flatnonzero(begins[at])))


def pieces(data: np.ndarray, size: int = UNIT) -> Iterator[tuple[int, int]]:
    """Cuts a long text after white space."""
    lo = 0
    while lo < len(data):
        hi = lo + size
        if hi < len(data):
            back = np.flatnonzero(SPACE[data[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:
                while hi < len(data) and not SPACE[data[hi]]:
                    ahead = np.flatnonzero(SPACE[data[hi : hi + size]])
                    hi = min(hi + (int(ahead[0]) if len(ahead) else size), len(data))
        yield lo, min(hi, len(data))
        lo = hi


@dataclass
class Words:
    """The words of texts ``first`` to ``last``: the text of each word (0 is ``first``), in order."""

    first: int
    last: int
    text: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        return np.searchsorted(self.text, np.arange(self.last - self.first + 1))


def words(column: pa.Array, lower: bool) -> Iterator[Words]:
    data, off = string_buffers(column)
    for first, last in units(off):
        lo, hi = int(off[first]), int(off[last])
        raw = LOWER[data[lo:hi]] if lower else data[lo:hi]
        if last - first == 1 and hi - lo > 2 * UNIT:
            hashes = np.concatenate([word_hashes(raw[a:b], np.zeros(0, np.int64))[1] for a, b in pieces(raw)])
            yield Words(first, last, np.zeros(len(hashes), np.int64), hashes)
        else:
            starts, hashes = word_hashes(raw, off[first:last] - lo)
            yield Words(first, last, np.searchsorted(off[first + 1 : last + 1] - lo, starts, "right"), hashes)


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, by its first word; ordered, and unlike for other k."""
    out = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for i in range(k):
        out *= ODD
        out += hashes[i : i + len(out)]
    return mix(out + np.uint64(k))


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, text, shingle): the distinct k-word shingles of each text, sorted by text and
    hash; a text with fewer than k words has its whole sequence as one."""
    for w in words(column, lower=True):
        h = combine(w.hash, k)
        same = w.text[: len(h)] == w.text[k - 1 :] if len(h) else np.zeros(0, bool)
        h, t = h[same], w.text[: len(h)][same]
        bounds = w.bounds()
        short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < k))
        if len(short):
            whole = np.array([combine(w.hash[bounds[i] : bounds[i + 1]], int(bounds[i + 1] - bounds[i]))[0] for i in short], np.uint64)
            h, t = np.concatenate([h, whole]), np.concatenate([t, short])
        order = np.lexsort((h, t))
        h, t = h[order], t[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        yield w.first, w.last, t[new], h[new]


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags (or numbers) between offsets."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]
