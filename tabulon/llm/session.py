"""Session helpers: reading tables, checkpoints in the shared folder, spreading rows."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a
    session on one machine (tests) gets a temporary folder; on a cluster, whose executors can't read
    such a folder, this raises."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(set_dir)
        return set_dir
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tabulon-checkpoint-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when it has ended.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run meanwhile leave no shuffle files. Else these stay until the driver
    happens to collect its garbage, so that a long job holds those of all its steps on disk."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there: the lineage ends, and rows
    that a lost executor had computed need not be computed again. (Unlike ``checkpoint()``, this
    computes each row once.) The shuffle files that led to it go at once."""
    path = shared_path(df.sparkSession, "table")
    with freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for tables in _noted:
        tables.append(out)
    return out


_noted: list[list[DataFrame]] = []


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """The tables that are cut meanwhile, so that they can be dropped when what they led to is written."""
    tables: list[DataFrame] = []
    _noted.append(tables)
    try:
        yield tables
    finally:
        _noted[:] = [x for x in _noted if x is not tables]


def drop(df: DataFrame) -> None:
    """Deletes a table that ``cut`` returned, once nothing that is still to run reads it."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """A name like this one that none of the columns has."""
    while name in columns:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a batch of rows between Spark and Python.
BATCH = "2m"


def release() -> None:
    """Gives memory that is free back to the system: an idle worker would keep it beside later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow(df: DataFrame, scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of at most ``BATCH`` (or one row), which the session keeps to from
    now on: long texts and sets would make large buffers on both sides."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        release()

    return df.mapInArrow(whole, schema)
