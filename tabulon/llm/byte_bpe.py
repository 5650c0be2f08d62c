"""Byte-level BPE: encoding by ranked merges, and decoding.

A text is cut by a pattern into words; each distinct word, as an array of bytes, is merged pair by
pair, the lowest rank first and the leftmost of equal ones, until no pair of neighbours has a rank.
A word that has a rank itself is one token.

There are two forms. ``encode_words`` is the named one: higher-order functions fold the merges over
byte arrays of distinct words, with the ranks as a literal (an array of small maps, dealt by CRC-32,
since a map literal is searched from end to end); ``decode_words`` concatenates binary pieces.
``encode`` is what whole corpora use: the same fold in Python over the distinct words that a task
meets, since bringing the tokens of distinct words back to some 31 million occurrences per 0.1 GB takes
a join whose shuffle exceeds the limits (README). It needs no shuffle at all.

Ranks are read on the driver and have the size of the vocabulary file, a parameter.

Defined cases: null and empty texts have no tokens; texts of any length and words of any length are
encoded whole (long words with a heap, in n log n); other columns are passed on where asked for;
repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.session import arrow, table, unused

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words that a worker remembers before it starts anew.
REMEMBER = 400_000
SHORT = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks) + 2**31
    found = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while found:
        best = min(found)
        if best == none:
            break
        i = found.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i:
            found[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(found):
            found[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of (rank, place) over a linked list of parts."""
    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j < 0 or len(part[i]) + len(part[j]) != size:
            continue
        part[i], part[j] = part[i] + part[j], None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else -1
            if b >= 0 and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
    return [ranks[p] for p in part if p is not None]


class Encoder:
    """Encodes texts, and remembers the tokens of the words it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.known = ranks, regex.compile(pattern), {}

    def word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        one = self.ranks.get(data)
        ids = (one,) if one is not None else tuple((_merge_short if len(data) <= SHORT else _merge_long)(data, self.ranks))
        if len(data) <= SHORT:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        words = self.pattern.findall(text) if len(text) < 1 << 20 else (m[0] for m in self.pattern.finditer(text))
        for w in words:
            ids = known.get(w)
            out += self.word(w) if ids is None else ids
        return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], digests: bool = False) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array<int>) of each row's text; with ``digests`` instead of
    the ids their number, and the digests of the ids and of what they decode to."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    share = docs.sparkSession.sparkContext.broadcast(ranks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(share.value, pattern)
        pieces = {i: p for p, i in encoder.ranks.items()}
        for batch in batches:
            columns, names = [batch.column(i) for i in range(len(keep))], list(keep)
            texts = (x.as_py() or "" for x in batch.column(len(keep)))
            if digests:
                rows = []
                for text in texts:
                    ids = encoder.encode(text)
                    rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"".join(map(pieces.__getitem__, ids))).hexdigest()))
                columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                names += ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns.append(pa.array([encoder.encode(t) for t in texts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return arrow(docs.select(*keep, F.col("text").alias(unused("text", keep))), scan, ", ".join(filter(None, [kept, more])))


# The named form, over a table of distinct words.


def rank_lookup(ranks: dict[bytes, int], parts: int = 4096) -> tuple[Column, int]:
    """A literal array of maps from piece to rank, dealt by CRC-32."""
    dealt: list[dict[bytes, int]] = [{} for _ in range(parts)]
    for piece, rank in ranks.items():
        dealt[zlib.crc32(piece) % parts][piece] = rank
    maps = ", ".join("map(" + ", ".join(f"X'{p.hex()}', {r}" for p, r in d.items()) + ")" if d else "cast(map() as map<binary, int>)" for d in dealt)
    return F.expr(f"array({maps})"), parts


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``word`` (distinct strings) with ``ids``, by higher-order functions alone."""
    lookup, parts = rank_lookup(ranks)
    none = F.lit(2**31 - 1)
    rank = lambda x: F.element_at(F.element_at("__ranks", (F.crc32(x) % parts + 1).cast("int")), x)

    def merge(acc: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(acc) - 1), lambda i: F.struct(F.coalesce(rank(F.concat(F.element_at(acc, i), F.element_at(acc, i + 1))), none).alias("r"), i.alias("i")))
        best = F.array_min(pairs)
        i = best["i"]
        merged = F.concat(F.slice(acc, F.lit(1), i - 1), F.array(F.concat(F.element_at(acc, i), F.element_at(acc, i + 1))), F.slice(acc, i + 2, F.size(acc)))
        return F.when(F.size(acc) < 2, acc).when(best["r"] == none, acc).otherwise(merged)

    data = F.col("word").cast("binary")
    single = F.transform(F.sequence(F.lit(1), F.octet_length("word")), lambda i: F.substring(data, i, F.lit(1)))
    folded = F.aggregate(F.sequence(F.lit(1), F.octet_length("word")), single, merge)
    rows = words.filter("word <> ''").withColumn("__ranks", lookup)
    return rows.select("word", F.when(rank(data).isNotNull(), F.array(rank(data))).otherwise(F.transform(folded, rank)).alias("ids"))


def decode_words(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``word`` as binary ``decoded``, from its ``ids``."""
    pieces = sorted((i, p) for p, i in ranks.items())
    known = F.expr("array(" + ", ".join(f"X'{p.hex()}'" for _, p in pieces) + ")")
    return rows.withColumn("__pieces", known).select("word", F.aggregate("ids", F.lit(b""), lambda acc, i: F.concat(acc, F.element_at("__pieces", i + 1))).alias("decoded"))


def settings() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), *settings(), keep=["doc_id"], digests=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, *settings(), keep=[c for c in docs.columns if c not in ("text", "ids")])
