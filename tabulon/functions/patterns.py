"""Many literal patterns at once, in a plan whose size doesn't grow with their number.

Up to ``FEW`` patterns are a chain of compiled tests on the JVM. More become one trie, built once in each
worker: a text is read once, and from each place only as far as some pattern goes on. Both ways give the
same; which one is taken depends on the configuration's list, never on the data. Texts and patterns are compared
as they come, so callers lower both.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FEW = 128


@lru_cache(maxsize=16)
def trie(patterns: tuple[str, ...]) -> dict:
    """Nested dicts by character; under None, the place in the list of the first pattern that ends there."""
    root: dict = {}
    for place, pattern in enumerate(patterns):
        node = root
        for c in pattern:
            node = node.setdefault(c, {})
        node.setdefault(None, place)
    return root


def find(text: str, patterns: tuple[str, ...], any_of: bool = False) -> int:
    """The least place in the list of a pattern in the text, -1 without one; with ``any_of`` of the first one
    met."""
    root, best = trie(patterns), len(patterns)
    best = min(best, root.get(None, best))
    for i in range(len(text)):
        node = root.get(text[i])
        at = i + 1
        while node is not None:
            if (place := node.get(None, best)) < best:
                best = place
                if any_of:
                    return best
            if at == len(text):
                break
            node = node.get(text[at])
            at += 1
    return best if best < len(patterns) else -1


def _found(patterns: tuple[str, ...], any_of: bool):
    @F.pandas_udf("int")
    def place(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: find(t, patterns, any_of)).astype("int32")

    return place


def any_contains(x: Column, parts: list[str]) -> Column:
    """Whether the text has one of the parts."""
    if len(parts) <= FEW:
        return reduce(or_, (F.contains(x, F.lit(p)) for p in parts), F.lit(False))
    return _found(tuple(parts), True)(x) >= 0


def _listed(texts: list[str]) -> Column:
    """A constant array, made in one step (the optimiser folds it)."""
    return F.split(F.lit("\x1f".join(texts)), "\x1f") if all(texts) and not any("\x1f" in t for t in texts) else F.array(*map(F.lit, texts))


def longest(x: Column, parts: list[str], shown: list[str]) -> Column:
    """Of the parts in the text the longest, the first of equally long ones, as what stands for it in
    ``shown``; null if there is none."""
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    names = [shown[i] for i in order]
    if not parts:
        return F.lit(None).cast("string")
    if len(parts) <= FEW:
        keys = _listed([parts[i] for i in order])
        found = F.get(F.filter(keys, lambda p: F.contains(x, p)), 0)
        return F.get(_listed(names), (F.array_position(keys, found) - 1).cast("int"))
    keys = tuple(parts[i] for i in order)

    @F.pandas_udf("string")
    def name(texts: pd.Series) -> pd.Series:
        places = (find(t, keys) for t in texts.fillna(""))
        return pd.Series([names[p] if p >= 0 else None for p in places], dtype=object)

    return name(x)
