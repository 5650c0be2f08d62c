"""Document fingerprints by winnowing.

The rolling hashes of all ``K``-grams of code points are computed by doubling; in each window of
``WINDOW`` consecutive grams the smallest hash is chosen, the rightmost of equal ones, and kept with
its position. Any two texts that share ``K + WINDOW - 1`` code points in a row share a chosen gram,
and the positions say where. A text of fewer than ``SHARE * WINDOW`` grams has windows of a ``SHARE``-th
of its grams, so that it keeps several marks too. That loses nothing of the guarantee: what is
smallest in a window is so in the shorter windows within it. A text with fewer grams than a window
has one window; a text shorter than ``K`` is one gram, so any edit of it leaves a likeness of 0, as
does an edit after which no ``K`` code points in a row are left. Hashes have 32 bits and are fixed,
so equal texts have equal fingerprints.

A fingerprint is written ``hash:position`` (hex, decimal), joined by spaces; the likeness of two is
the Jaccard similarity of their sets of hashes (1 for two empty ones).

For neighbours in ascending doc_id, rows are dealt by ranges of doc_id, a task for each: the bounds
are quantiles, as many as there are partitions, and a row finds its range by halving. The first
document of each range also goes to the range before it, so each task streams its documents in order
and needs two at a time. The texts move once.

Defined cases: a null text counts as empty, with an empty fingerprint; a text of any length is
fingerprinted whole, in pieces of ``PIECE`` grams; rows with one doc_id (a null
doc_id goes first) count as different documents, in the order of their texts; equal rows are
documents each; other columns are not read; an empty table gives an empty result; a document alone
is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.session import arrow, partitions, table
from tabulon.llm.textscan import ODD, mix

K, WINDOW, SHARE = 16, 64, 8
PIECE = 1 << 18


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit polynomial hashes of all runs of k codes (k a power of two), by doubling."""
    h, base, n = mix(codes.astype(np.uint64) + np.uint64(1)), int(ODD), 1
    while n < k:
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base % 2**64, 2 * n
    return h


def select(text: str, k: int = K, window: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of the chosen grams, by position. Without ``window``, it is
    ``WINDOW`` or, of a short text, less."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(codes) < k:
        whole = mix(np.array([sum((int(c) + 1) * pow(int(ODD), i + 1, 2**64) for i, c in enumerate(codes)) % 2**64], np.uint64))
        return (whole >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)
    n = len(codes) - k + 1
    window = min(window, n) if window else max(1, min(WINDOW, n // SHARE))
    hashes, places = [], []
    for lo in range(0, n - window + 1, PIECE):
        some = codes[lo : min(lo + PIECE + window - 1, n) + k - 1]
        # the hash above, below it what is smaller the further right: the minimum is the rightmost
        key = (mix(_grams(some, k)) >> np.uint64(32) << np.uint64(32)) | (np.uint64(2**32 - 1) - np.arange(len(some) - k + 1, dtype=np.uint64))
        span = 1
        while 2 * span <= window:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < window:
            key = np.minimum(key[: len(key) - (window - span)], key[window - span :])
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        hashes.append((key >> np.uint64(32)).astype(np.uint32))
        places.append(lo + (2**32 - 1) - (key & np.uint64(2**32 - 1)).astype(np.int64))
    h, p = np.concatenate(hashes), np.concatenate(places)
    new = np.concatenate([[True], p[1:] != p[:-1]])
    return h[new], p[new]


def write(h: np.ndarray, p: np.ndarray) -> str:
    return " ".join(f"{a:08x}:{b}" for a, b in zip(h.tolist(), p.tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - common
    return common / total if total else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int | None = None) -> DataFrame:
    """doc_id and fingerprint of every row: one scan, no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [write(*select(t.as_py() or "", k, window)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.string())], names=["doc_id", "fingerprint"])

    return arrow(docs.select("doc_id", "text"), scan, "doc_id bigint, fingerprint string")


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the key, by halving."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*map(F.lit, bounds))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        above = F.get(listed, middle) > key
        low = F.when((acc["low"] >= acc["high"]) | above, acc["low"]).otherwise(middle + 1)
        high = F.when((acc["low"] < acc["high"]) & above, middle).otherwise(acc["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve)["low"]


def ranges(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text and ``range``: rows of equal doc_id go to one of at most ``n`` ranges, and those
    with the first doc_id of a range (of the first range: for the last) to the range before as well,
    with ``ahead`` true."""
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = sorted({int(x) for x in rows.stat.approxQuantile("key", [i / n for i in range(1, n)], 0.1 / n) or []}) if n > 1 else []
    # quantiles come as doubles, which round large ids; any bounds do, as long as all rows see the same
    rows = rows.withColumn("range", range_of(F.col("key"), bounds))
    firsts = sorted((r["range"], r["first"]) for r in rows.groupBy("range").agg(F.min("key").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    pairs = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead")))
    if before:
        lookup = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        pairs = F.when(F.col("key").isin(*before), F.concat(pairs, F.array(F.struct(F.element_at(lookup, F.col("key")).alias("range"), F.lit(True).alias("ahead"))))).otherwise(pairs)
    return rows.select("key", "doc_id", "text", F.explode(pairs).alias("r")).select("key", "doc_id", "text", "r.range", "r.ahead")


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame, n: int, k: int = K, window: int | None = None) -> DataFrame:
    """For every document: its fingerprint, that of its edited text (its last quarter replaced by
    the beginning of the next document), and its likeness to the edited text and to the next."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for doc_id, text, number, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "ahead"))):
                same = held is not None and held[2] == number
                if ahead and held is not None and not same:
                    continue
                chosen = select(text, k, window)
                if same and not held[4]:
                    mine = held[1]
                    q = len(mine) // 4
                    edited = mine[: len(mine) - q] + text[:q]
                    other = select(edited, k, window)
                    out.append((held[0], len(mine), hashlib.sha256(edited.encode()).hexdigest(), write(*held[3]), write(*other), likeness(held[3][0], other[0]), likeness(held[3][0], chosen[0])))
                held = (doc_id, text, number, chosen, ahead)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return arrow(ranges(docs, n).repartitionById(n, "range").sortWithinPartitions("range", "ahead", "key", "text"), scan, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"), partitions(spark))
