"""Quality classifier: a factorisation machine.

A text is described by hashed words (term frequencies of unit length), by structure statistics and
by metadata (its declared length), the last two as one bucket per field. The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),

so that all pairwise interactions cost time linear in the features of a text (sum-of-squares
identity). It is fitted with Adagrad on the driver on at most ``sample`` labelled rows, those whose
hashed ids are smallest, one row of each id; that bound is a parameter and the only one. Every text is scored whole, in
one scan without a shuffle; the model that travels to the executors has a fixed size (``BUCKETS`` and
``FACTORS``), whatever the corpus.

Defined cases: null and empty texts are scored by their statistics alone; a text of any length is
scored whole; a row with a null doc_id is scored, and is neither held out nor learnt from (held_out is
null); a null declared length counts as the text's own; conflicting labels of a document count as the larger; labels that are null
or without a document are not learnt from; without any label the score is 0.5; repeated rows are
scored each; ids with equal hashes go by id; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.measures import measure
from tabulon.llm.session import arrow, table
from tabulon.llm.textscan import words

BUCKETS, FACTORS, STEPS = 1 << 16, 8, 16
#: Fields of structure statistics: numerator, denominator, scale to steps.
FIELDS = [
    ("n_symbols", "n_words", 20.0),
    ("n_bangs", "n_words", 20.0),
    ("n_stops", "n_words", 20.0),
    ("n_upper", "n_chars", 15.0),
    ("n_digits", "n_chars", 40.0),
    ("word_chars", "n_words", 1.0),
    ("n_repeat_words", "n_words", 15.0),
    ("n_dup_lines", "n_lines", 15.0),
]
SIZE = BUCKETS + STEPS * (len(FIELDS) + 3)
SAMPLE, THRESHOLD = 4000, 0.3


@dataclass
class Features:
    """Sparse rows: text ``row`` has ``value`` at ``index``."""

    row: np.ndarray
    index: np.ndarray
    value: np.ndarray


def features(text: pa.Array, declared: pa.Array) -> Features:
    found = measure(text)
    rows, indexes, values = [], [], []
    for w in words(text, lower=False):
        key, count = np.unique(w.text * BUCKETS + (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
        row = key // BUCKETS
        norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, minlength=w.last - w.first))
        rows.append(row + w.first)
        indexes.append(key % BUCKETS)
        values.append(count / norm[row])
    own = found["n_chars"]
    said = np.asarray(pa.array(declared).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
    said = np.where(np.isnan(said), own, said)
    bucket = [np.clip(found[a] / np.maximum(found[b], 1) * scale, 0, STEPS - 1).astype(np.int64) for a, b, scale in FIELDS]
    bucket += [np.clip(np.log2(np.maximum(x, 0) + 1), 0, STEPS - 1).astype(np.int64) for x in (found["n_words"], said, found["n_lines"])]
    for i, b in enumerate(bucket):
        rows.append(np.arange(len(own)))
        indexes.append(BUCKETS + i * STEPS + b)
        values.append(np.ones(len(own)))
    return Features(np.concatenate(rows), np.concatenate(indexes), np.concatenate(values))


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, x: Features, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The value before the sigmoid, and the factors' sums."""
        out = self.w0 + np.bincount(x.row, self.w[x.index] * x.value, minlength=n)
        sums = np.zeros((n, self.v.shape[1]))
        for f in range(self.v.shape[1]):
            part = self.v[x.index, f] * x.value
            sums[:, f] = np.bincount(x.row, part, minlength=n)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(x.row, part**2, minlength=n))
        return out, sums

    def score(self, x: Features, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x, n)[0], -35, 35)))


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.1, l2: float = 1e-6, seed: int = 7) -> Model:
    """Adagrad over the logistic loss; each class has half of the weight."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS)))
    if not len(labels):
        return Model(0.0, model.w, np.zeros((SIZE, FACTORS)))
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    g0, gw, gv = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, FACTORS), 1e-8)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            x = Features(np.repeat(np.arange(len(at)), [len(examples[i][0]) for i in at]), np.concatenate([examples[i][0] for i in at]), np.concatenate([examples[i][1] for i in at]))
            out, sums = model.raw(x, len(at))
            error = (1 / (1 + np.exp(-np.clip(out, -35, 35))) - labels[at]) * weight[at] / len(at)
            touched, where = np.unique(x.index, return_inverse=True)
            slope = error[x.row] * x.value
            grad = np.bincount(where, slope) + l2 * model.w[touched]
            gw[touched] += grad**2
            model.w[touched] -= rate * grad / np.sqrt(gw[touched])
            for f in range(FACTORS):
                v = model.v[touched, f]
                grad = np.bincount(where, slope * (sums[x.row, f] - v[where] * x.value)) + l2 * v
                gv[touched, f] += grad**2
                model.v[touched, f] = v - rate * grad / np.sqrt(gv[touched, f])
            g0 += error.sum() ** 2
            model.w0 -= rate * error.sum() / np.sqrt(g0)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``labels``: doc_id, label. The sampled label rows (at most ``sample``) are broadcast to the
    scan of the texts, and of each id only one row's features come to the driver: of rows that share an id,
    the least in bytes."""
    chosen = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"), batch.column("n_chars"))
            order = np.argsort(x.row, kind="stable")
            cuts = np.searchsorted(x.row[order], np.arange(1, batch.num_rows))
            index, value = (np.split(a[order].astype(kind), cuts) if batch.num_rows else [] for a, kind in ((x.index, np.int32), (x.value, np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), *(pa.array([a.tobytes() for a in col], pa.binary()) for col in (index, value))], names=["doc_id", "label", "index", "value"])

    rows = arrow(docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id"), scan, "doc_id bigint, label int, index binary, value binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("index", "value", "label")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32).astype(float)) for r in rows], np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    compact = Model(model.w0, model.w.astype(np.float32), model.v.astype(np.float32))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = compact.score(features(batch.column("text"), batch.column("n_chars")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return arrow(docs.select("doc_id", "text", "n_chars"), scan, "doc_id bigint, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
