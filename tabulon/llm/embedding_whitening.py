"""Embedding whitening by TSQR.

Every entry c becomes the integer x = floor(1024 c) + 100000, so that sums over all rows are exact
whatever their order. Rows are centred with those sums: n x - S is an integer, and only its quotient by n
is rounded. Each partition folds its centred rows into one triangular factor R (a QR of R above the next
block); the factors, d x d numbers each, are merged ``FAN`` at a time over a tree of groups, and the
driver takes the SVD of the last one. Its right vectors are the eigenvectors of the covariance V, its
singular values s give the eigenvalues s^2 / n; V itself is never formed. A further scan whitens all rows
and sums their products, which gives ``identity_error``; nothing else is gathered than d sums, one R, and
the products of the components.

Defined cases: a row is dropped if its vector is null or empty or has an entry that is null, not finite, or
2^50 or more in size (no integer of 64 bits for it); vectors whose length isn't the most frequent one (of
equally frequent ones, the longest) are dropped too; repeated rows count each, ids may be null or equal.
A component without variance (a singular value not above the first one's rounding) has null in
``whitened`` and isn't part of ``identity_error``, which is null if all are so. A deviation above the range
of 64 bits is null. Other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.session import arrow, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: R factors that one task merges; rows that are folded at a time, at least.
FAN, BLOCK = 8, 1024
LIMIT = 2.0**50


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a whole vector, of the most frequent length."""
    whole = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False))))
    most = whole.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return whole.filter(F.size(vector) == (most[0]["d"] if most else 0))


def integers(column: pa.Array) -> np.ndarray:
    """The x of vectors of one length, a row each."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return (np.floor(flat * SCALE).astype(np.int64) + SHIFT).reshape(len(column), -1)


@dataclass
class Centre:
    """n and S, and what is exact of them in 64 bits."""

    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64-bit integers where they hold it, else Python's."""
        if self.n * int(np.abs(x).max(initial=0)) < 2**61 and max(map(abs, self.sums)) < 2**61:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """The sum of squared deviations of each row, None above the range."""
        gap = self.deviations(x)
        if gap.dtype == object or int(np.abs(gap).max(initial=0)) ** 2 * gap.shape[1] >= 2**63:
            total = [int(v) for v in (gap.astype(object) ** 2).sum(axis=1)]
            return [v if v < 2**63 else None for v in total]
        return (gap * gap).sum(axis=1).tolist()


def centre(rows: DataFrame) -> Centre:
    """n and the exact sums of every dimension: per partition in Python, then by dimension in Spark."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        n = 0
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column("v"))
                if int(np.abs(x).max()) * len(x) >= 2**62:
                    x = x.astype(object)
                part = [int(v) for v in x.sum(axis=0)]
                total = [a + b for a, b in zip(total, part)] if total else part
                n += len(x)
        kinds = [pa.int32(), pa.decimal128(38, 0), pa.int64()]
        columns = [range(len(total)), [Decimal(t) for t in total], [n] * len(total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["pos", "total", "n"])

    found = arrow(rows, scan, "pos int, total decimal(38,0), n bigint").groupBy("pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("pos").collect()
    return Centre(int(found[0]["n"]), [int(r["total"]) for r in found]) if found else Centre(0, [])


def fold(factor: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if factor is None else np.vstack([factor, rows]), mode="r")


def tsqr(rows: DataFrame, at: Centre) -> np.ndarray:
    """The triangular factor of all centred rows."""
    d = len(at.sums)
    schema = "node bigint, factor binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, held, n, node = None, [], 0, 0
        for batch in batches:
            if batch.num_rows:
                node = batch.column("part")[0].as_py()
                held.append(at.centred(integers(batch.column("v"))))
                n += batch.num_rows
                if n >= max(BLOCK, 4 * d):
                    factor, held, n = fold(factor, np.vstack(held)), [], 0
        if held:
            factor = fold(factor, np.vstack(held))
        if factor is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([np.ascontiguousarray(factor).tobytes()], pa.binary())], names=["node", "factor"])

    def merge(group: pa.Table) -> pa.Table:
        order = np.argsort(group["node"].to_numpy())
        got = group["factor"].to_pylist()
        factor = np.linalg.qr(np.vstack([np.frombuffer(got[i]).reshape(-1, d) for i in order]), mode="r")
        return pa.table({"node": pa.array([group["node"][0].as_py() // FAN], pa.int64()), "factor": pa.array([np.ascontiguousarray(factor).tobytes()], pa.binary())})

    factors = arrow(rows.withColumn("part", F.spark_partition_id().cast("long")), scan, schema)
    width = rows.rdd.getNumPartitions()
    while width > 1:
        factors = factors.groupBy(F.floor(F.col("node") / FAN).alias("up")).applyInArrow(merge, schema)
        width = -(-width // FAN)
    return np.frombuffer(factors.collect()[0]["factor"]).reshape(-1, d)


@dataclass
class Model:
    """What whitens: directions (a column each, scaled), shares of the variance, and the centre."""

    at: Centre
    directions: np.ndarray
    explained: np.ndarray

    @property
    def live(self) -> np.ndarray:
        return ~np.isnan(self.directions).any(axis=0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.at.centred(x) @ self.directions


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """``rows``: one column v of usable vectors. None if there are none."""
    at = centre(rows)
    if not at.n:
        return None
    _, s, right = np.linalg.svd(tsqr(rows, at), full_matrices=True)
    d = len(at.sums)
    s = np.concatenate([s, np.zeros(d - len(s))])
    k = min(components, d)
    live = s[:k] > s[0] * d * np.finfo(float).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        directions = np.where(live, right[:k].T * (np.sqrt(at.n) / s[:k]), np.nan)
    total = (s**2).sum()
    return Model(at, directions, s[:k] ** 2 / total if total else np.zeros(k))


def identity_error(rows: DataFrame, model: Model) -> float | None:
    """The largest entry, in size, of the covariance of all whitened rows less the identity."""
    live = np.flatnonzero(model.live)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(live), len(live)))
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(integers(batch.column("v")))[:, live]
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["pos", "total"])

    if not len(live):
        return None
    found = arrow(rows, scan, "pos int, total double").groupBy("pos").agg(F.sum("total").alias("total")).orderBy("pos").collect()
    return float(np.abs(np.array([r["total"] for r in found]).reshape(len(live), -1) / model.at.n - np.eye(len(live))).max())


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: its id, component (from 1), n, deviation, whitened,
    explained and identity_error."""
    kept = usable(rows.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v")), "v")
    model = fit(kept.select("v"), components)
    schema = f"`{id}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(kept.select("v"), model), model.directions.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = integers(batch.column("v")), batch.num_rows
            w = model.whiten(x).ravel()
            each = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.at.n)),
                    pa.array(model.at.squares(x), pa.int64()).take(each),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(model.explained, n)),
                    pa.array([error] * (n * k), pa.float64()),
                ],
                names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return arrow(kept, scan, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
