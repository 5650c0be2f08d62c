"""Folders as streams: each micro-batch is processed like a batch of documents.

``watch`` takes files of cells. ``watch_files`` takes documents, and keeps a ledger of what it has processed, so
that a file that comes again, under its name or another, gives no second rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.plans.documents import Result, process_cells, process_files
from tabulon.sources import documents as source
from tabulon.sources.config import Config

CELLS = "doc_id string, page_no int, row_no int, col_pos int, raw_header string, value string"


def watch(spark: SparkSession, folder: str, config: Config, sink: Callable[[Result, int], None], checkpoint: str) -> StreamingQuery:
    """Starts the stream; ``sink`` gets each batch's result and number, and may be called again with a
    number after a failure."""

    def one(batch: DataFrame, number: int) -> None:
        sink(process_cells(batch, config), number)

    files = spark.readStream.schema(CELLS).parquet(folder)
    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FILES = "path string, modificationTime timestamp, length bigint, content binary"
LEDGER = "digest string, path string, run string, batch bigint"


def unseen(files: DataFrame, ledger: DataFrame, run: str, batch: int) -> DataFrame:
    """Of path, content and digest, the files whose content no earlier batch has had; of equal ones in this
    batch the first path. What the ledger has of this batch or a later one of the same run is left aside: the
    batch is then one that runs again after a failure."""
    earlier = ledger.filter(~((F.col("run") == run) & (F.col("batch") >= batch))).select("digest").distinct()
    first = files.groupBy("digest").agg(F.min("path").alias("path"))  # without contents
    new = first.join(earlier, "digest", "left_anti")
    return files.join(new, ["digest", "path"], "left_semi")


def watch_files(spark: SparkSession, folder: str, config: Config, decode: Callable[[bytes], object], sink: Callable[[Result, int], None], checkpoint: str, ledger: str, work: str) -> StreamingQuery:
    """Starts the stream over a folder (nested ones too) of PDF files; ``sink`` gets the result of each batch's
    new files and the batch's number, and may be called again with a number after a failure. ``ledger`` is a table by
    path of what was processed, written after the sink, a partition for each run (as its checkpoint tells
    them apart) and batch; a stream with a new checkpoint goes on from it. (Spark's stream takes each path once:
    other content under a known name waits for such a stream.) ``work`` is a folder that driver and
    executors share, for what a batch keeps."""
    spark.createDataFrame([], LEDGER).write.mode("append").partitionBy("run", "batch").parquet(ledger)

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        run = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        known = session.read.schema(LEDGER).parquet(ledger)
        files = batch.select("path", "content", F.sha2("content", 256).alias("digest"))
        new = unseen(files, known, run, number)
        place = f"{ledger.rstrip('/')}/run={run}/batch={number}"
        todo = f"{work.rstrip('/')}/{run}-{number}"
        new.select("digest", "path").write.mode("overwrite").parquet(f"{todo}/new")
        chosen = session.read.schema("digest string, path string").parquet(f"{todo}/new")
        if chosen.isEmpty():
            return
        bytes_ = batch.join(chosen, "path", "left_semi").select("path", "content")
        none = session.createDataFrame([], "path string, error string")
        sink(process_files(session, source.Stored(bytes_, none, decode), config, todo), number)
        chosen.write.mode("overwrite").parquet(place)

    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(folder)
    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
