"""Files of batches appear whole and once, whatever fails; review columns in the order they are seen."""

import csv
import os
import re
import subprocess
import sys
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tabulon.operators import transform
from tabulon.plans import batch
from tabulon.plans.documents import process_cells
from tabulon.sources import sinks
from tabulon.sources.config import Config
from tabulon.streaming.watch import CELLS

CONFIG = Config()


def cells(spark, docs):
    rows = [(d, 1, r, c, h, v) for d in docs for r in (1, 2) for c, (h, v) in enumerate([("Item No.", str(r)), ("Item Designation", f"BOLT {r}"), ("Zeta", "z"), ("Alpha", "a")])]
    rows += [(d, 2, 1, c, h, v) for d in docs for c, (h, v) in enumerate([("Mid", "m"), ("Alpha", "b"), ("Item No.", "3"), ("Item Designation", "NUT"), ("Beta", " ")])]
    return spark.createDataFrame(rows, CELLS)


def visible(folder):
    return sorted(os.listdir(folder))


def sheet(path, n):
    body = zipfile.ZipFile(path).read(f"xl/worksheets/sheet{n}.xml").decode()
    return [re.findall(r'r="([A-Z]+)\d+"[^>]*><is><t[^>]*>([^<]*)', row) for row in re.findall("<row.*?</row>", body)]


def test_review_sheet_in_the_order_of_the_document(spark, tmp_path):
    result = process_cells(cells(spark, ["d.pdf"]), CONFIG)
    (o,) = batch.write_batch(result, CONFIG, ["d.pdf"], str(tmp_path / "out"), str(tmp_path / "t"))
    names = ["Zeta", "Alpha", "Mid", "Beta"]
    shown = [f"[UNMAPPED] {n}" for n in names]
    assert sheet(o.workbook, 2) == [list(zip("ABCD", shown)), [("A", "z"), ("B", "a")], [("A", "z"), ("B", "a")], [("B", "b"), ("C", "m")]]
    with open(o.report, encoding="utf-8-sig", newline="") as f:
        assert next(csv.reader(f))[-4:] == shown
    assert o.notes == ["4 columns could not be mapped: their cells are in the review sheet"]
    wide = transform.review_rows(result.unmapped, result.columns)
    assert wide.columns == [*transform.KEYS, *shown] and wide.count() == 3
    assert sorted(tuple(r)[1:] for r in wide.collect()) == [(1, 1, "z", "a", "", ""), (1, 2, "z", "a", "", ""), (2, 1, "", "b", "m", "")]
    blank = process_cells(spark.createDataFrame([("d", 1, 1, 0, "Item No.", "1"), ("d", 1, 1, 1, "Odd", " nan ")], CELLS), CONFIG)
    assert blank.columns.count() == 0


def test_equal_names_and_locked_files(spark, tmp_path, monkeypatch):
    out = tmp_path / "out"
    result = process_cells(cells(spark, ["a/d.pdf", "b/d.pdf", "e.pdf"]), CONFIG)
    write = lambda **more: batch.write_batch(result, CONFIG, ["a/d.pdf", "b/d.pdf", "e.pdf"], str(out), str(tmp_path / "t"), **more)
    got = write()
    assert [os.path.basename(o.workbook) for o in got] == ["d_PROCESSED.xlsx", "d_PROCESSED_1.xlsx", "e_PROCESSED.xlsx"]
    assert got[1].notes[-2:] == ["d_PROCESSED.xlsx was kept as d_PROCESSED_1.xlsx: another document of the batch has that name", "d_QC_Report.csv was kept as d_QC_Report_1.csv: another document of the batch has that name"]
    names = ["WIP_Tracker.txt", "d_PROCESSED.xlsx", "d_PROCESSED_1.xlsx", "d_QC_Report.csv", "d_QC_Report_1.csv", "e_PROCESSED.xlsx", "e_QC_Report.csv"]
    assert visible(out) == names
    monkeypatch.setattr(sinks, "_writable", lambda path: not path.endswith("e_PROCESSED.xlsx"))
    (out / "e_PROCESSED_1.xlsx").write_text("kept")
    last = write()[2]
    assert os.path.basename(last.workbook) == "e_PROCESSED_2.xlsx" and last.notes[-1] == "e_PROCESSED.xlsx was kept as e_PROCESSED_2.xlsx: it is locked"
    assert (out / "e_PROCESSED_1.xlsx").read_text() == "kept"
    refused = write(as_copy=False)
    assert [o.error and o.error.split(":")[0] for o in refused] == [None, None, "LockedError"] and refused[2].workbook is None


def test_foreign_rows_are_noted(spark, tmp_path):
    config = Config(language_detection=True)
    result = process_cells(cells(spark, ["d.pdf"]).withColumn("value", F.when(F.col("value") == "NUT", "Eine lange Schraube").otherwise(F.col("value"))), config)
    (o,) = batch.write_batch(result, config, ["d.pdf"], str(tmp_path / "out"), str(tmp_path / "t"), lambda text: "de")
    assert o.notes[0] == "1 rows are flagged as not English"


def test_a_file_that_fails_leaves_what_was_there(tmp_path, spark):
    path = tmp_path / "o.xlsx"
    path.write_text("before")

    def rows():
        yield 0, ["x"]
        raise OSError("disk full")

    with pytest.raises(OSError):
        sinks.write_qc_rows(str(path), ["c"], rows())
    assert path.read_text() == "before" and visible(tmp_path) == ["o.xlsx"]
    with pytest.raises(Exception):
        sinks.write_workbook(str(path), {"s": spark.range(3).selectExpr("raise_error('late')")})
    assert path.read_text() == "before" and visible(tmp_path) == ["o.xlsx"]


SCRIPT = """
import os, sys
sys.path[:0] = {paths!r}
from pyspark.sql import SparkSession
from tabulon.plans import batch
from test_commit import CONFIG, cells, process_cells
spark = SparkSession.builder.master("local[1,{tries}]").config("spark.sql.shuffle.partitions", 1).config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
real, flag = batch.sinks.write_workbook, {flag!r}
def dies(path, sheets):
    if not os.path.exists(flag):
        open(flag, "w").close()
        open(path, "wb").write(b"half a file")
        os._exit(1)  # the worker is gone
    return real(path, sheets)
batch.sinks.write_workbook = dies
try:
    got = batch.write_batch(process_cells(cells(spark, ["d.pdf", "e.pdf"]), CONFIG), CONFIG, ["d.pdf", "e.pdf"], {out!r}, {tables!r})
    print("WROTE", [os.path.basename(o.workbook) for o in got])
except Exception as e:
    print("FAILED", type(e).__name__)
"""


@pytest.mark.parametrize("tries", [1, 2])
def test_a_task_that_dies_half_way(tmp_path, tries):
    """Its next attempt writes the files, once; without one, none appears."""
    here = os.path.dirname(os.path.abspath(__file__))
    out = tmp_path / "out"
    script = SCRIPT.format(paths=[os.path.dirname(here), here], tries=tries, flag=str(tmp_path / "flag"), out=str(out), tables=str(tmp_path / "t"))
    said = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300).stdout
    assert (tmp_path / "flag").exists()
    log = (out / batch.LOG).read_text()
    if tries == 1:
        assert "FAILED" in said and visible(out) == [batch.LOG] and "FINISHED" not in log and log.count("STARTED") == 2
    else:
        assert "WROTE ['d_PROCESSED.xlsx', 'e_PROCESSED.xlsx']" in said and log.count("FINISHED") == 2
        assert visible(out) == [batch.LOG, "d_PROCESSED.xlsx", "d_QC_Report.csv", "e_PROCESSED.xlsx", "e_QC_Report.csv"]
        assert zipfile.ZipFile(out / "d_PROCESSED.xlsx").testzip() is None


def test_a_cancelled_batch_keeps_what_is_finished(spark, tmp_path):
    """Turns that ended stay; of the others nothing appears, and the log has STARTED alone."""
    ids, out, told = [f"{c}.pdf" for c in "abcde"], tmp_path / "out", []
    result = process_cells(cells(spark, ids), CONFIG)

    def progress(done, total):
        told.append((done, total))
        if done == 4:
            control.cancel()

    control = batch.Control(spark, 2, progress)
    got = batch.write_batch(result, CONFIG, ids, str(out), str(tmp_path / "t"), control=control)
    assert [o.doc_id for o in got] == ids[:4] and told == [(2, 5), (4, 5)] and control.share() is None
    log = (out / batch.LOG).read_text()
    assert log.count("STARTED") == 5 and log.count("FINISHED") == 4 and "FINISHED] | [e.pdf]" not in log
    assert [x for x in visible(out) if x.endswith("xlsx")] == [f"{c}_PROCESSED.xlsx" for c in "abcd"] and not any(x.startswith(".") for x in visible(out))


def test_jobs_of_a_turn_are_stopped(spark, tmp_path, monkeypatch):
    ids, out, seen = ["a.pdf", "b.pdf"], tmp_path / "out", []
    real, started = batch.sinks.write_workbook, str(tmp_path / "started")

    def slow(path, sheets):
        if "b_" in path:
            open(started, "w").close()
            time.sleep(120)
        return real(path, sheets)

    monkeypatch.setattr(batch.sinks, "write_workbook", slow)
    control = batch.Control(spark, 1)

    def stop():
        while not os.path.exists(started):
            time.sleep(0.2)
        seen.append(control.share())
        control.cancel(now=True)

    thread = threading.Thread(target=stop)
    thread.start()
    began = time.time()
    got = batch.write_batch(process_cells(cells(spark, ids), CONFIG), CONFIG, ids, str(out), str(tmp_path / "t"), control=control)
    thread.join()
    assert [o.doc_id for o in got] == ["a.pdf"] and time.time() - began < 110 and seen[0] is not None and 0 <= seen[0] < 1
    assert visible(out) == [batch.LOG, "a_PROCESSED.xlsx", "a_QC_Report.csv"] and (out / batch.LOG).read_text().count("FINISHED") == 1
