"""Measurements of whole texts, taken in one scan of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tabulon.llm.textscan import SPACE, combine, per_text, string_buffers, units, words

ASCII_SPACE = " \t\n\x0b\x0c\r"


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LEAD = (np.arange(256) & 0xC0) != 0x80
CLASSES = {
    "n_chars": _LEAD,
    "word_chars": _LEAD & ~SPACE,
    "n_symbols": _class(b"#*$%&|<>"),
    "n_upper": _class(bytes(range(65, 91))),
    "n_lower": _class(bytes(range(97, 123))),
    "n_digits": _class(bytes(range(48, 58))),
    "n_bangs": _class(b"!?"),
    "n_stops": _class(b".,;:"),
}
NAMES = ["n_words", *CLASSES, "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(text: np.ndarray, hashes: np.ndarray, k: int = 3) -> np.ndarray:
    """For each word, whether it lies in a k-word window that its text has twice or more."""
    covered = np.zeros(len(hashes), bool)
    if len(hashes) < k:
        return covered
    h = combine(hashes, k)
    at = np.flatnonzero(text[: len(h)] == text[k - 1 :])
    h, t = h[at], text[at]
    order = np.lexsort((h, t))
    equal = (h[order][1:] == h[order][:-1]) & (t[order][1:] == t[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    for i in range(k):
        covered[at[twice] + i] = True
    return covered


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts per text, by the names in ``NAMES``; all are 0 for null and empty texts."""
    n = len(column)
    out = {name: np.zeros(n, np.int64) for name in NAMES}
    data, off = string_buffers(column)
    for first, last in units(off):
        raw = data[off[first] : off[last]]
        for name, table in CLASSES.items():
            flags = table[raw]
            out[name][first:last] = per_text(flags, off[first : last + 1] - off[first]) if last - first > 1 else np.count_nonzero(flags)
    for w in words(column, lower=False):
        out["n_words"][w.first : w.last] = np.diff(w.bounds())
        out["n_repeat_words"][w.first : w.last] = np.bincount(w.text[repeated_words(w.text, w.hash)], minlength=w.last - w.first)
    for i, text in enumerate(column):
        text = text.as_py()
        if text:
            lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out
