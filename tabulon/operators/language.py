"""Languages by character trigrams: profiles learnt from texts with a known language, and scored by them.

A text is lower-cased, what is no letter becomes a space, and each three characters in a row of it are a
gram. A profile holds, for each of the most frequent grams of each language, how often it was seen; the
language of a text is the one under which its grams are likeliest together (naive Bayes, half a count for
grams that a language doesn't have). Texts are made plain on the JVM; tasks look the grams of each up in the
profile, an array of numbers, so that no gram is a row and nothing is shuffled. To learn, tasks count the grams of
their texts, and only these counts move. A profile has at most ``size`` grams a language, whatever it was learnt
from, and so is a table of known size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 3000
#: Characters whose grams are in memory at once, and bytes of texts that go to Python at once.
PIECE, BATCH = 1 << 20, 2 << 20
#: Bits of a character in a gram's number; numbers are in the order of the grams' texts.
BITS = 21


@dataclass
class Profile:
    """``grams``: gram and gains (what it adds to each language's score), ``gains``: the same by gram;
    ``floors``: what any gram adds."""

    languages: list[str]
    floors: list[float]
    grams: DataFrame
    gains: dict[str, list[float]] = field(default_factory=dict)


def letters_only(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))


def numbers(plain: str) -> Iterator[np.ndarray]:
    """The grams of a plain text as numbers, a piece at a time; a text has one at least."""
    plain = plain.ljust(3, "\0")
    for i in range(0, len(plain) - 2, PIECE):
        c = np.frombuffer(plain[i : i + PIECE + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype("int64")
        yield c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:]


def number(gram: str) -> int:
    return int(next(numbers(gram))[0])


def gram(number: int) -> str:
    return "".join(chr(number >> i * BITS & (1 << BITS) - 1) for i in (2, 1, 0)).rstrip("\0")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, gram's number and n of lang and plain; a gram comes once for some million characters of a language."""
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def counted(lang: str) -> pd.DataFrame:
        sizes.pop(lang)
        found, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        return pd.DataFrame({"lang": lang, "number": found, "n": n})

    for batch in batches:
        for lang, plain in zip(batch["lang"], batch["plain"]):
            for piece in numbers(plain):
                held.setdefault(lang, []).append(piece)
                sizes[lang] = sizes.get(lang, 0) + len(piece)
                if sizes[lang] >= PIECE:
                    yield counted(lang)
        if sum(sizes.values()) >= 4 * PIECE:
            yield from map(counted, list(held))
    yield from map(counted, list(held))


def _small_batches(rows: DataFrame) -> None:
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def learn(texts: DataFrame, size: int = SIZE) -> Profile:
    """``texts``: text and lang; rows where one is null are left out."""
    _small_batches(texts)
    plain = texts.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", letters_only(F.col("text")).alias("plain"))
    counted = plain.mapInPandas(_counts, "lang string, number long, n long").groupBy("lang", "number").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "number"))
    ranked = counted.withColumns({"rank": rank, "total": F.sum("n").over(Window.partitionBy("lang"))}).filter(F.col("rank") <= size)
    found = ranked.select("lang", "number", "n", "total").collect()
    languages = sorted({r["lang"] for r in found})
    gains: dict[str, list[float]] = {}
    for r in found:
        gains.setdefault(gram(r["number"]), [0.0] * len(languages))[languages.index(r["lang"])] = math.log(2.0 * r["n"])
    totals = {r["lang"]: r["total"] for r in found}
    table = texts.sparkSession.createDataFrame(sorted(gains.items()), "gram string, gains array<double>")
    return Profile(languages, [-math.log(2.0 * totals[x]) for x in languages], table, gains)


def likeliest(plain: Column, profile: Profile) -> Column:
    """The language of a plain text."""
    listed = sorted((number(g), gains) for g, gains in profile.gains.items())
    known = np.array([n for n, _ in listed], "int64")
    gains = np.array([g for _, g in listed] + [[0.0] * len(profile.languages)])  # the last is that of other grams
    floors, languages = np.array(profile.floors), profile.languages

    @F.pandas_udf("string")
    def language(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            total, n = np.zeros(len(languages)), 0
            for piece in numbers(text):
                at = np.searchsorted(known, piece)
                at[known[np.minimum(at, len(known) - 1)] != piece] = len(known)
                seen, times = np.unique(at, return_counts=True) if len(at) < 4096 else (slice(None), np.bincount(at, minlength=len(gains)))
                total, n = total + times @ gains[seen], n + len(piece)
            # rounded, since sums of doubles depend on their order; of equally likely ones the first
            return languages[int(np.argmax(np.round(total / n + floors, 9)))]

        return pd.Series([one(t) for t in texts], dtype=object)

    return language(plain)


def with_language(rows: DataFrame, column: str, profile: Profile, name: str = "language") -> DataFrame:
    """The rows with the language of a column's text: null where it is null or the profile has none; of equally
    likely ones the first by name. No row moves."""
    if not profile.languages:
        return rows.withColumn(name, F.lit(None).cast("string"))
    _small_batches(rows)
    return rows.withColumn(name, likeliest(letters_only(F.col(column)), profile))


def detect(texts: DataFrame, profile: Profile) -> DataFrame:
    """text and language of each distinct text."""
    return with_language(texts.select("text").distinct(), "text", profile)
