"""Files of any size that tasks write together.

The rows of a table are numbered in its order, cut into pieces of ``PIECE`` rows, and a task turns each
piece into bytes beside the target. From the pieces' sizes follow their places in the file; other tasks
put them there. The driver sees a few numbers a piece, and writes what lies between pieces. A task that
runs again writes the same bytes to the same place, so lost executors and second attempts do no harm.

All paths are in a folder that driver and executors share.
"""

from __future__ import annotations

import os
import pathlib
import shutil
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 15
#: What a zip's fields of 32 bits can't hold.
WIDE = 2**32 - 1


@dataclass
class Piece:
    """Bytes here, or in a file of the folder; the checksum and size are those before packing."""

    crc: int
    raw: int
    packed: int
    body: bytes | None = None
    path: str | None = None


@contextmanager
def work_folder(path: str) -> Iterator[str]:
    """A hidden folder beside the path, which goes in the end."""
    folder = os.path.join(os.path.dirname(os.path.abspath(path)), f".parts-{uuid.uuid4().hex}")
    os.makedirs(folder)
    try:
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def packed(chunks: Iterable[bytes], pack: bool = True, last: bool = False) -> Piece:
    """One piece of a deflated stream, or with ``pack`` false the bytes as they are. Pieces end at a byte
    and refer to nothing before them, so they can be put one behind the other."""
    deflate, out, crc, raw = zlib.compressobj(6, zlib.DEFLATED, -15), [], 0, 0
    for chunk in chunks:
        crc, raw = zlib.crc32(chunk, crc), raw + len(chunk)
        out.append(deflate.compress(chunk) if pack else chunk)
    if pack:
        out.append(deflate.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH))
    body = b"".join(out)
    return Piece(crc, raw, len(body), body)


@cache
def _zeros(power: int) -> list[int]:
    """What 2**power zero bytes make of each bit of a checksum."""
    if not power:
        return [zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0") for i in range(32)]
    half = _zeros(power - 1)
    return [_moved(half, x) for x in half]


def _moved(images: list[int], crc: int) -> int:
    out = 0
    for i in range(32):
        if crc >> i & 1:
            out ^= images[i]
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two texts in a row, from theirs and the size of the second: it is linear in the first."""
    for power in range(size.bit_length()):
        if size >> power & 1:
            first = _moved(_zeros(power), first)
    return first ^ second


def numbered(df: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """The rows, kept in the folder under columns by number, with ``at``: their place in the order of the
    table's partitions and rows. And how many there are. The driver has one number a partition."""
    spark, path = df.sparkSession, pathlib.Path(folder, uuid.uuid4().hex).absolute().as_uri()
    plain = {"void": "string", "timestamp": "timestamp_ntz"}
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    named = named.select(*[F.col(c).cast(plain[t]).alias(c) if t in plain else F.col(c) for c, t in named.dtypes])
    # the lower 33 bits of the id count a partition's rows
    kept = named.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("at"))
    kept.write.parquet(path)
    rows = spark.read.schema(kept.schema).parquet(path)
    counts = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())
    begins = [(p, total - n) for (p, n), total in zip(counts, accumulate(n for _, n in counts))]
    before = F.broadcast(spark.createDataFrame(begins, "part int, begin long"))  # a row a partition
    return rows.join(before, "part").withColumn("at", F.col("at") + F.col("begin")).drop("part", "begin"), sum(n for _, n in counts)


def pieces(rows: DataFrame, folder: str, full: int | None, render: Callable[[tuple, int], bytes], pack: bool = True) -> dict[int, list[Piece]]:
    """The pieces of numbered rows, in order, by the part (of ``full`` rows, if not all in one) that they are
    in. ``render`` makes bytes of a row and its number in its part, from 0."""
    part = F.floor(F.col("at") / full) if full else F.lit(0).cast("long")
    names = [c for c in rows.columns if c != "at"]
    placed = rows.withColumn("part", part).withColumn("at", F.col("at") - F.col("part") * F.lit(full or 0))

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        at = group.column("at").to_pylist()
        values = zip(*(group.column(c).to_pylist() for c in names)) if names else ((),) * len(at)
        made = packed((render(v, i) for v, i in zip(values, at)), pack)
        path = os.path.join(folder, uuid.uuid4().hex)
        with open(path, "wb") as f:
            f.write(made.body)
        return pa.table({"part": [group.column("part")[0].as_py()], "at": [at[0]], "path": [path], "crc": [made.crc], "raw": [made.raw], "packed": [made.packed]})

    cut = placed.withColumn("piece", F.floor(F.col("at") / PIECE)).groupBy("part", "piece")
    out: dict[int, list[Piece]] = {}
    for r in sorted(cut.applyInArrow(write, "part long, at long, path string, crc long, raw long, packed long").collect(), key=lambda r: (r["part"], r["at"])):
        out.setdefault(r["part"], []).append(Piece(r["crc"], r["raw"], r["packed"], path=r["path"]))
    return out


def place(spark: SparkSession, path: str, begin: int, parts: list[Piece]) -> int:
    """Puts pieces one behind the other into the file, from ``begin`` on; those of tasks are put by tasks.
    Returns where the last one ends."""
    ends = list(accumulate((p.packed for p in parts), initial=begin))
    with open(path, "r+b") as f:
        for at, p in zip(ends, parts):
            if p.body is not None:
                f.seek(at)
                f.write(p.body)
    listed = [(path, p.path, at) for at, p in zip(ends, parts) if p.path]
    if listed:
        tasks = min(len(listed), spark.sparkContext.defaultParallelism)
        spark.createDataFrame(listed, "target string, path string, at long").repartition(tasks).foreach(_put)
    return ends[-1]


def _put(row) -> None:
    with open(row["path"], "rb") as piece, open(row["target"], "r+b") as f:
        f.seek(row["at"])
        shutil.copyfileobj(piece, f, 1 << 20)


@dataclass
class Archive:
    """A zip whose entries are pieces; fields of 64 bits stand only where 32 don't do."""

    spark: SparkSession
    path: str
    end: int = 0
    listed: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        open(self.path, "wb").close()

    def add(self, name: str, parts: list[Piece]) -> None:
        crc, raw, size, begin = 0, sum(p.raw for p in parts), sum(p.packed for p in parts), self.end
        for p in parts:
            crc = joined_crc(crc, p.crc, p.raw)
        wide = max(raw, size) >= WIDE
        extra = struct.pack("<HHQQ", 1, 16, raw, size) if wide else b""
        sizes = (WIDE, WIDE) if wide else (size, raw)
        head = struct.pack("<4s5H3I2H", b"PK\3\4", 45 if wide else 20, 0, 8, 0, 33, crc, *sizes, len(name), len(extra)) + name.encode() + extra
        self.end = place(self.spark, self.path, begin, [Piece(0, 0, len(head), head), *parts])
        self.listed.append((name.encode(), crc, raw, size, begin))

    def close(self) -> None:
        """The directory: one line an entry."""
        out, begin = [], self.end
        for name, crc, raw, size, at in self.listed:
            beyond = [x for x in (raw, size, at) if x >= WIDE]
            extra = struct.pack(f"<HH{len(beyond)}Q", 1, 8 * len(beyond), *beyond) if beyond else b""
            need = 45 if beyond else 20
            out.append(struct.pack("<4s6H3I5H2I", b"PK\1\2", need, need, 0, 8, 0, 33, crc, min(size, WIDE), min(raw, WIDE), len(name), len(extra), 0, 0, 0, 0, min(at, WIDE)) + name + extra)
        body, n = b"".join(out), len(self.listed)
        if max(begin, len(body)) >= WIDE or n >= 2**16 - 1:
            there = begin + len(body)
            body_end = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(body), begin) + struct.pack("<4sIQI", b"PK\6\7", 0, there, 1)
        else:
            body_end = b""
        few = min(n, 2**16 - 1)
        body_end += struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, few, few, min(len(body), WIDE), min(begin, WIDE), 0)
        with open(self.path, "r+b") as f:
            f.seek(begin)
            f.write(body + body_end)
