"""Token-sort similarity of short texts, a batch of pairs at a time, and what it can be joined by.

The similarity of two texts is 200 times the length of their longest common subsequence over the sum of
their lengths, each with its words sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.text import words

#: Pairs that are compared together; characters of the shorter text (bits of a word) and of the longer one.
BATCH, SHORT, LONG = 4096, 64, 256


def token_sort(x: str) -> str:
    return " ".join(sorted(x.split()))


def _one(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a number as long as the text for its row of bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _batch(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The same for many pairs at once: bits in 64-bit words. Texts are rows of code points."""
    full = np.where(la == SHORT, ~np.uint64(0), (np.uint64(1) << (la.astype(np.uint64) % np.uint64(SHORT))) - np.uint64(1))
    row = full.copy()
    for j in range(int(lb.max(initial=0))):
        mask = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        hit = row & mask
        row = np.where(j < lb, ((row + hit) | (row - hit)) & full, row)
    return la - np.bitwise_count(row).astype(np.int64)


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """The similarity of each pair."""
    done = {x: token_sort(x) for x in {*left, *right}}
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in ((done[a], done[b]) for a, b in zip(left, right))]
    la, lb = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    common = np.zeros(len(pairs), np.int64)
    fits = np.flatnonzero((la <= SHORT) & (lb <= LONG))
    fits = fits[np.argsort(lb[fits], kind="stable")]
    for at in np.array_split(fits, -(-len(fits) // BATCH)) if len(fits) else []:
        codes = [np.array([pairs[k][i] for k in at], f"U{width}").view(np.uint32).reshape(len(at), width) for i, width in ((0, SHORT), (1, LONG))]
        common[at] = _batch(*codes, la[at], lb[at])
    for k in np.flatnonzero((la > SHORT) | (lb > LONG)):
        common[k] = _one(*pairs[k])
    total = la + lb
    return np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))


def token_sort_ratio(a: str, b: str) -> float:
    return float(ratios([a], [b])[0])


def similarity_udf():
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(ratios(a.fillna("").tolist(), b.fillna("").tolist()))

    return score


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.array_sort(words(x)), " ")


def other_lengths(n: Column, threshold: float) -> tuple[Column, Column]:
    """The least and the greatest length of a text that can be as similar as that to one of length ``n``."""
    return F.ceil(n * (threshold / (200 - threshold)) - 1e-9).cast("int"), F.floor(n * ((200 - threshold) / threshold) + 1e-9).cast("int")


def prefix_keys(text: Column, n: Column, threshold: float) -> Column:
    """Keys (an array of numbers) of which two texts of sorted tokens share one, if they are as similar as
    the threshold; ``n``: the text's length.

    Such texts have L = threshold / 200 of both lengths in common, so at most n - L characters of one are
    deleted and m - L of the other inserted. Each deletion destroys at most q of the n + q - 1 grams of the
    padded text, each insertion q - 1; so many grams are shared at least, and the hashes that come first in
    order, all but one less than that, have one of them. Texts too short to share any (under low
    thresholds only) have the key 0 in common.
    """
    q = 3 if threshold >= 80 else 2
    low, high = other_lengths(n, threshold)

    def shared(m: Column) -> Column:
        both = F.ceil((n + m) * (threshold / 200) - 1e-9)
        return n + (q - 1) - q * (n - both) - (q - 1) * (m - both)

    least = F.array_min(F.transform(F.sequence(low, F.greatest(low, high)), shared))
    padded = F.concat(F.lit("\x02" * (q - 1)), text, F.lit("\x03" * (q - 1)))
    grams = F.array_sort(F.transform(F.sequence(F.lit(1), n + (q - 1)), lambda i: F.xxhash64(F.substr(padded, i, F.lit(q)))))
    first = F.array_distinct(F.slice(grams, F.lit(1), (n + q - F.greatest(least, F.lit(1))).cast("int")))
    return F.when(least < 1, F.concat(first, F.array(F.lit(0).cast("bigint")))).otherwise(first)


def sketch(text: Column, n: Column) -> Column:
    """The pairs of neighbouring characters of a text of length ``n``, padded, as 64 bits."""
    padded = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(F.substr(padded, i, F.lit(2))), F.lit(64)))
    return F.aggregate(F.sequence(F.lit(1), n + 1), F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(bit(i)))


def sketches_fit(a: Column, n: Column, b: Column, m: Column, threshold: float) -> Column:
    """Whether texts with these sketches and lengths can be as similar as the threshold: a deletion removes at
    most two pairs, an insertion one."""
    both = F.ceil((n + m) * (threshold / 200) - 1e-9)
    only = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    return (only(a, b) <= 2 * (n - both) + (m - both)) & (only(b, a) <= 2 * (m - both) + (n - both))
