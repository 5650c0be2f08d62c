"""Batches of documents to files."""

import csv
import zipfile

from pyspark.sql import functions as F

from tabulon.operators.ocr_tables import ocr_cells
from tabulon.plans import batch
from tabulon.plans.documents import process_cells
from tabulon.sources.config import Config
from tabulon.streaming.watch import CELLS

CONFIG = Config()


def cells(spark):
    rows = []
    for doc, odd in (("in/x.pdf", ""), ("y.pdf", "zz")):
        for r in (1, 2, 3):
            named = [("Item No.", str(r)), ("Item Designation", f"BOLT NUMBER {r}"), ("Part No.", "" if r == 2 else f"00{r}"), ("Mystery", odd)]
            rows += [(doc, 1, r, c, h, v) for c, (h, v) in enumerate(named)]
    return spark.createDataFrame(rows, CELLS)


def test_files_of_a_batch(spark, tmp_path):
    result = process_cells(cells(spark), CONFIG)
    got = batch.write_batch(result, CONFIG, ["in/x.pdf", "y.pdf", "none.pdf"], str(tmp_path / "out"), str(tmp_path / "tables"))
    assert [(o.doc_id, o.rows, o.failed, o.error) for o in got] == [("in/x.pdf", 3, 1, None), ("y.pdf", 3, 1, None), ("none.pdf", 0, 0, None)]
    assert got[2].workbook is None and got[2].report is None
    sheets = [[n for n in zipfile.ZipFile(o.workbook).namelist() if "worksheets" in n] for o in got[:2]]
    assert [len(s) for s in sheets] == [1, 2]  # nothing to review in the first one
    with open(got[1].report, encoding="utf-8-sig", newline="") as f:
        head, row = csv.reader(f)
    assert head[:2] == ["", "Part Name"] and head[-1] == "[UNMAPPED] Mystery" and "Spare Part No" in head
    assert row[:2] == ["1", "Bolt Number 2"] and row[-1] == "zz"
    log = (tmp_path / "out" / batch.LOG).read_text().splitlines()
    assert len(log) == 6 and log[0].endswith("| [Status: STARTED] | [x.pdf] | [Rows Processed: 0]")
    assert log[3].endswith("| [Status: FINISHED] | [x.pdf] | [Rows Processed: 3]")


def test_a_failing_document_stops_no_other(spark, tmp_path, monkeypatch):
    real = batch.sinks.write_workbook

    def fail(path, sheets):
        if "x_" in path:
            raise OSError("disk full")
        return real(path, sheets)

    monkeypatch.setattr(batch.sinks, "write_workbook", fail)
    got = batch.write_batch(process_cells(cells(spark), CONFIG), CONFIG, ["in/x.pdf", "y.pdf"], str(tmp_path / "out"), str(tmp_path / "tables"))
    assert [o.error for o in got] == ["OSError: disk full", None]
    assert sum("FINISHED" in x for x in (tmp_path / "out" / batch.LOG).read_text().splitlines()) == 1


def test_mapping_report_shows_unmapped_first(spark):
    got = batch.mapping_report(process_cells(cells(spark), CONFIG).mapping).collect()
    assert [r.raw_header for r in got][0] == "Mystery" and got[0].target is None and len(got) == 4


def test_ocr_pages_are_streamed_apart(spark):
    """Pages of a task are told apart, whatever the number of batches; no boxes give no cells."""
    page = [("No.", 60.0, 0.0), ("NAME", 180.0, 0.0), ("1", 60.0, 30.0), ("bolt", 180.0, 30.0), ("2", 60.0, 60.0), ("nut", 180.0, 60.0)]
    rows = [("d", p, i, 800.0, [(x, y), (x + 20, y), (x + 20, y + 10), (x, y + 10)], t, 0.9) for p in range(40) for i, (t, x, y) in enumerate(page)]
    schema = "doc_id string, page_no int, box_no int, page_w double, box array<struct<x:double,y:double>>, text string, score double"
    boxes = spark.createDataFrame(rows, schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = ocr_cells(boxes).groupBy("page_no").agg(F.sort_array(F.collect_list(F.struct("row_no", "col_pos", "value"))).alias("c")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 40 and all([x.value for x in r.c] == ["1", "bolt", "2", "nut"] for r in got)
    assert ocr_cells(boxes.limit(0)).count() == 0
