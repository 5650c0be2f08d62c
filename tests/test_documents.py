"""Files to parts, by a decoder made for the test: pages of all kinds, and failures of each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import qc
from tabulon.plans import batch
from tabulon.plans.documents import process_files
from tabulon.sources import documents as source
from tabulon.sources import page_source, pages
from tabulon.sources.config import Config


def decoder():
    """Of path to document. Nested, so that it travels to tasks by value."""

    class Document:
        def __init__(self, path):
            if "broken" in path:
                raise RuntimeError("Cannot open PDF: not a PDF")
            self.name = path.split("/")[-1]
            self.pages = {"manual.pdf": 6, "scan.pdf": 2, "plain.pdf": 1, "long.pdf": 70}[self.name]

        def text(self, n):
            if (self.name, n) == ("manual.pdf", 5):
                raise ValueError("bad font")
            if self.name == "scan.pdf" or (self.name, n) == ("manual.pdf", 2):
                return " "
            return "see the Service Interval table of this book" if (self.name, n) == ("manual.pdf", 3) else f"page {n} of a manual with text enough"

        def size(self, n):
            return 600, 800

        def words(self, n):
            if (self.name, n) == ("manual.pdf", 1):
                rows = [("015", "pump", "body"), ("016", "valve", "disc"), ("017", "", "")]
                return [(x, 200 + 30 * i, x + 40, 210 + 30 * i, w) for i, r in enumerate(rows) for x, w in zip((60, 180, 240), r) if w]
            if self.name == "long.pdf":
                return [(60, y, 90, y + 10, str(n)) for y in (100, 130)] + [(180, y, 220, y + 10, f"part{n}") for y in (100, 130)]
            return [(60, 100, 90, 110, "Only"), (100, 100, 130, 110, "prose"), (140, 100, 170, 110, "here"), (60, 130, 90, 140, "today")]

        def lines(self, n):
            return [(20, "ACME Co., Ltd"), (300, "Plate"), (310, "Pump Room"), (780, "1072-1400-0002")] if n == 1 else []

        def tables(self, n):
            if (self.name, n) == ("manual.pdf", 6):
                raise ValueError("no finder")
            small = [["x", "y"], ["1", ""]]
            return [small, [["Item No.", "Description", "Part No."], ["7", "bolt", "P-7"], ["8", None, "P-8"]]] if (self.name, n) == ("manual.pdf", 4) else []

        def image(self, n, dpi):
            return np.full((4, 9 if self.name == "scan.pdf" else 6), n, np.uint8)

    return Document


def engine(ways):
    """OCR that sees a table in images of these shapes."""

    def make():
        def box(x, y, text):
            return ([(x, y), (x + 40, y), (x + 40, y + 14), (x, y + 14)], text, 0.9)

        def read(image):
            if image.shape not in ways:
                return None
            return [box(50, 10, "No."), box(200, 10, "NAME"), box(50, 40, "1"), box(200, 40, "seal ring"), box(50, 70, "2"), box(200, 70, "gland")]

        return read

    return make


def fails():
    def make():
        raise ImportError("no model")

    return make


PATHS = ["in/manual.pdf", "in/notes.txt", "in/broken.pdf", "in/scan.pdf", "in/plain.pdf", "in/manual.pdf"]


@pytest.fixture(scope="module")
def turned(spark, tmp_path_factory):
    """The upright image of the manual's scanned page has no table, the turned one has."""
    return process_files(spark, PATHS, Config(), str(tmp_path_factory.mktemp("kept")), decoder(), engine([(6, 4, 3)]))


def test_parts_of_all_kinds_of_pages(turned):
    got = [(r.page_no, r.drawing_pos_no, r.part_name, r.spare_part_no, r.manufacturer, r.spare_group, r.drawing_no, r.ref_page) for r in turned.main.orderBy("row_index").collect()]
    assert got == [
        (1, "015", "Pump Body", "", "ACME Co., Ltd", "Pump Room", "1072-1400-0002", "1"),
        (1, "016", "Valve Disc", "", "ACME Co., Ltd", "Pump Room", "1072-1400-0002", "1"),
        (2, "1", "Seal Ring", "", "", "", "", "2"),
        (2, "2", "Gland", "", "", "", "", "2"),
        (4, "7", "Bolt", "P-7", "", "", "", "4"),
        (4, "8", "", "P-8", "", "", "", "4"),
    ]
    assert {r.doc_id for r in turned.main.select("doc_id").distinct().collect()} == {"in/manual.pdf"}


def test_failures_and_statuses(turned):
    assert [(r.doc_id, r.error) for r in turned.errors.collect()] == [("in/broken.pdf", "Cannot open PDF: not a PDF")]
    got = sorted((r.doc_id, r.page_no, r.status, r.reason) for r in turned.status.collect())
    assert got == [
        ("in/manual.pdf", 3, "skipped", "page 3: skipped (non-parts page)"),
        ("in/manual.pdf", 5, "error", "page 5: bad font"),
        ("in/manual.pdf", 6, "empty", "page 6: no table detected"),
        ("in/plain.pdf", 1, "empty", "page 1: no table detected"),
        ("in/scan.pdf", 1, "unread", "page 1: scanned, OCR found no text"),
        ("in/scan.pdf", 2, "unread", "page 2: scanned, OCR found no text"),
    ]
    kinds = {r.kind: r.n for r in qc.error_groups(turned.status.select(F.col("reason").alias("message")).union(turned.errors.select("error"))).collect()}
    assert kinds == {"page": 6, "critical": 1}


def test_warnings(turned):
    got = {r.doc_id: r.warnings for r in turned.warnings.collect()}
    assert sorted(got) == ["in/manual.pdf", "in/plain.pdf", "in/scan.pdf"]
    assert got["in/manual.pdf"] == ["1 scanned pages were read by OCR: verify these rows", "1 pages may have lost rows: p1 (saw 3, got 2)"]
    assert got["in/scan.pdf"] == ["scanned document: 2 of 2 pages have no text layer, and OCR found no parts table"]
    assert len(got["in/plain.pdf"]) == 1 and got["in/plain.pdf"][0].startswith("no table was found")


def test_batch_of_files(turned, tmp_path):
    got = batch.write_batch(turned, Config(), ["in/manual.pdf", "in/broken.pdf", "in/plain.pdf"], str(tmp_path / "out"), str(tmp_path / "tables"))
    assert [(o.doc_id, o.rows, o.failed, o.error) for o in got] == [("in/manual.pdf", 6, 4, None), ("in/broken.pdf", 0, 0, "Cannot open PDF: not a PDF"), ("in/plain.pdf", 0, 0, None)]
    assert (tmp_path / "out" / "manual_PROCESSED.xlsx").exists() and got[2].workbook is None


@pytest.mark.parametrize("case", ["off", "none", "upright", "lines", "not ready"])
def test_ocr_cases(spark, tmp_path, case):
    ocr = {"off": engine([(4, 9, 3)]), "none": None, "upright": engine([(4, 9, 3)]), "lines": fails(), "not ready": fails()}[case]

    def lines():
        return lambda image: ["", "first part", " second part "] if image[0, 0, 0] == 1 else ["alone"]

    config = Config(enable_ocr=case != "off")
    got = process_files(spark, ["in/scan.pdf"], config, str(tmp_path), decoder(), ocr, lines if case == "lines" else None)
    rows = [(r.page_no, r.part_name) for r in got.main.orderBy("row_index").collect()]
    status = sorted((r.page_no, r.status) for r in got.status.collect())
    (warning,) = got.warnings.first().warnings
    if case == "upright":
        assert rows == [(1, "Seal Ring"), (1, "Gland"), (2, "Seal Ring"), (2, "Gland")] and status == [] and "verify" in warning
    elif case == "lines":  # one column; a page of a single line has none
        assert rows == [(1, "First Part"), (1, "Second Part")] and status == [(2, "unread")] and "verify" in warning
    else:
        end = {"off": "OCR is turned off", "none": "no OCR engine is installed", "not ready": "no OCR engine is installed"}[case]
        assert rows == [] and warning.endswith(end) and {s for _, s in status} == {"unread" if case == "not ready" else "scanned"}


def test_selected_pages(spark, tmp_path):
    """The spec goes before the range; what selects nothing of a document gives the whole of it."""
    count = lambda spec=None, between=None: {r.doc_id: r["count"] for r in page_source.read(spark, ["long.pdf", "plain.pdf"], decoder(), ["doc_id"], spec, between).groupBy("doc_id").count().collect()}
    assert count() == {"long.pdf": 70, "plain.pdf": 1}
    assert count("3, 60-") == {"long.pdf": 12, "plain.pdf": 1} and count(None, (2, 5)) == {"long.pdf": 4, "plain.pdf": 1} and count("1-2", (2, 5)) == {"long.pdf": 2, "plain.pdf": 1}
    got = process_files(spark, ["long.pdf"], Config(), str(tmp_path), decoder(), pages="33-34, 70")
    assert sorted({(r.page_no, r.part_name) for r in got.main.collect()}) == [(33, "part33"), (34, "part34"), (70, "part70")]


def test_no_files_and_no_decoder(spark, tmp_path):
    got = process_files(spark, [], Config(), str(tmp_path / "a"), decoder())
    assert got.main.count() == got.status.count() == got.errors.count() == got.warnings.count() == 0
    try:
        import fitz  # noqa: F401
    except ImportError:
        got = process_files(spark, ["x.pdf"], Config(), str(tmp_path / "b"))
        assert [r.error for r in got.errors.collect()] == ["Cannot open PDF: no decoder is installed"] and got.main.count() == 0


def test_images_get_three_channels():
    assert source.rgb(np.zeros((2, 3))).shape == source.rgb(np.zeros((2, 3, 4))).shape == source.rgb(np.zeros((2, 3, 1))).shape == (2, 3, 3)


def test_ocr_status():
    assert [pages.ocr_status(a, b) for a, b in ((False, True), (True, False), (True, True))] == ["disabled", "unavailable", "ran"]
