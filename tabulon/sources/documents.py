"""Files as pages, read on executors, every file and page failing alone.

Files come by path, as a data source (``page_source``) whose tasks open what all machines see under that
path; or as bytes, from any file system that Spark reads (``stored``).

A decoder is a function from a path (or from bytes) to an open document. It runs in tasks, and raises
what people are to read if a file can't be opened. The document has ``pages`` (their number) and functions of a page
number, from 1: ``text`` , ``size`` (width, height), ``words`` (x0, y0, x1, y1, text each), ``lines``
(y, text each, from top to bottom), ``tables`` (each rows of cells) and ``image`` (with a resolution:
an array of height, width and channels).
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabulon.operators import headers
from tabulon.operators.ocr_tables import ocr_cells
from tabulon.sources.pages import chosen_pages, parse_pages

Decoder = Callable[[str], object]
PAGE = ["doc_id", "page_no"]
#: Pages of a task, rows of a batch, resolution of page images.
STEP, ROWS, DPI = 32, 64, 200
#: Bytes of a file that is read whole.
LARGEST = 1 << 30


class FitzDocument:
    """A document by the optional PDF library."""

    def __init__(self, source: str | bytes):
        import fitz

        try:
            self.file = fitz.open(source) if isinstance(source, str) else fitz.open(stream=source, filetype="pdf")
        except Exception as e:
            raise RuntimeError(f"Cannot open PDF: {e}") from e
        if self.file.needs_pass:
            raise RuntimeError("The PDF has a password; remove it and try again.")
        self.pages = self.file.page_count

    def _page(self, n: int):
        return self.file.load_page(n - 1)

    def text(self, n: int) -> str:
        return self._page(n).get_text("text") or ""

    def size(self, n: int) -> tuple[float, float]:
        box = self._page(n).rect
        return float(box.width), float(box.height)

    def words(self, n: int) -> list[tuple]:
        return [tuple(w[:5]) for w in self._page(n).get_text("words")]

    def lines(self, n: int) -> list[tuple[float, str]]:
        found = [line for block in self._page(n).get_text("dict")["blocks"] for line in block.get("lines", [])]
        return [((x["bbox"][1] + x["bbox"][3]) / 2, "".join(s["text"] for s in x["spans"]).strip()) for x in found]

    def tables(self, n: int) -> list[list[list[str | None]]]:
        return [t.extract() for t in self._page(n).find_tables().tables]

    def image(self, n: int, dpi: int) -> np.ndarray:
        pix = self._page(n).get_pixmap(dpi=dpi)
        return np.frombuffer(pix.samples, np.uint8).reshape(pix.height, pix.width, pix.n)


def decoder() -> Decoder:
    """Documents by the PDF library, where it is installed; else every file fails with that message."""
    try:
        import fitz  # noqa: F401
    except ImportError:

        def missing(path: str):
            raise RuntimeError("Cannot open PDF: no decoder is installed")

        return missing
    return FitzDocument


def _rows(df: DataFrame, read: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``read`` over the rows of each partition, as a stream."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in read(r for b in batches for r in b.to_pylist()):
            out.append(row)
            if len(out) == ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return df.mapInArrow(scan, schema)


#: Columns of pages, in order.
COLUMNS = {
    "doc_id": "string",
    "page_no": "int",
    "total": "int",
    "page_w": "double",
    "page_h": "double",
    "text": "string",
    "words": "array<struct<word_no:int,x0:double,y0:double,x1:double,y1:double,text:string>>",
    "lines": "array<struct<line_no:int,y:double,text:string>>",
    "error": "string",
}
SCHEMA = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())


def page_row(doc, n: int, columns: Collection[str]) -> dict:
    """What the columns ask of a page; nothing else of it is decoded."""
    out = {}
    if "page_w" in columns or "page_h" in columns:
        w, h = doc.size(n)
        out |= {"page_w": float(w), "page_h": float(h)}
    if "text" in columns:
        out["text"] = doc.text(n)
    if "words" in columns:
        out["words"] = [dict(zip(("word_no", "x0", "y0", "x1", "y1", "text"), (i, *map(float, x[:4]), x[4]))) for i, x in enumerate(doc.words(n))]
    if "lines" in columns:
        out["lines"] = [{"line_no": i, "y": float(y), "text": t} for i, (y, t) in enumerate(doc.lines(n)) if t.strip()]
    return out


def file_rows(doc_id: str, open_: Callable[[], object], wanted: Callable[[int], Iterable[int]], columns: Collection[str] = tuple(COLUMNS)) -> Iterator[dict]:
    """A row for each page that ``wanted`` makes of the number of pages; ``error`` is null for a page that
    could be read. A file that can't be opened, or has no pages, is one row without a page_no."""
    none = {"words": [], "lines": []}
    try:
        doc = open_()
        total = int(doc.pages)
    except Exception as e:  # a file's failure is its own
        yield none | {"doc_id": doc_id, "error": str(e)}
        return
    if total < 1:
        yield none | {"doc_id": doc_id, "total": 0}
    for n in wanted(total):
        keys = {"doc_id": doc_id, "page_no": n, "total": total}
        try:
            yield keys | page_row(doc, n, columns)
        except Exception as e:  # and a page's
            yield none | keys | {"error": f"page {n}: {e}"}


@dataclass
class Stored:
    """Files of a file system that Spark reads: ``files`` has path and content, ``refused`` path and error,
    and ``decode`` makes a document of bytes."""

    files: DataFrame
    refused: DataFrame
    decode: Callable[[bytes], object]


def stored(spark: SparkSession, roots: str | list[str], decode: Callable[[bytes], object], largest: int = LARGEST) -> Stored:
    """PDF files under folders, of globs, or alone, by Spark's own listing and reading: nested ones too,
    names in either case, each file once. One of more than ``largest`` bytes is refused unread."""
    asked = list(dict.fromkeys([roots] if isinstance(roots, str) else roots))
    within = lambda x, root: x != root and (x.startswith(root.rstrip("/") + "/") or fnmatch(x, root) or fnmatch(x, root.rstrip("/") + "/*"))
    kept = [x for x in asked if not any(within(x, root) and not (within(root, x) and asked.index(x) < asked.index(root)) for root in asked)]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")  # else thousands of files would be one batch
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(kept)
    if sum(any(c in x for c in "*?[{") for x in kept) > 1:  # what several globs share comes once for each
        found = found.dropDuplicates(["path"])
    small = F.col("length") <= largest
    refused = found.filter(~small).select("path", F.format_string(f"Cannot open PDF: %d bytes are more than {largest}", "length").alias("error"))
    return Stored(found.filter(small).select("path", "content"), refused, decode)


def read_stored(files: Stored, spec: str | None = None, page_range: tuple[int, int] | None = None) -> DataFrame:
    """Pages (see ``COLUMNS``) of stored files: a file is read in the task that Spark reads its bytes in."""
    parse_pages(spec)  # a wrong spec fails here
    decode = files.decode

    def read(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            yield from file_rows(r["path"], lambda: decode(r["content"]), lambda total: chosen_pages(total, spec, page_range))

    refused = files.refused.select(F.col("path").alias("doc_id"), "error")
    return _rows(files.files, read, SCHEMA).unionByName(refused, allowMissingColumns=True)


def _each_page(numbers: DataFrame, files: Decoder | Stored, read: Callable[[object, int], Iterator[dict]], failed: Callable[[int, Exception], list[dict]], schema: str) -> DataFrame:
    """What ``read`` makes of each page, or ``failed`` of its exception. A task has one file open. Files by
    path are spread by ranges of pages; bytes move to their pages once."""
    whole = isinstance(files, Stored)

    def pages(rows: Iterator[dict]) -> Iterator[dict]:
        path, doc = None, None
        for r in rows:
            for n in r["pages"] if whole else [r["page_no"]]:
                try:
                    if path != r["doc_id"]:
                        path, doc = None, None
                        doc = files.decode(r["content"]) if whole else files(r["doc_id"])
                        path = r["doc_id"]
                    found = list(read(doc, n))
                except Exception as e:  # a page's failure is its own
                    found = failed(n, e)
                for x in found:
                    yield {"doc_id": r["doc_id"], "page_no": n} | x

    if whole:
        bytes_, decode = files.files, files.decode
        listed = numbers.groupBy("doc_id").agg(F.sort_array(F.collect_list("page_no")).alias("pages"))
        dealt = listed.join(bytes_.withColumnRenamed("path", "doc_id"), "doc_id")
        files = Stored(None, None, decode)  # what travels to tasks
    else:
        dealt = numbers.select(*PAGE).repartition("doc_id", F.floor((F.col("page_no") - 1) / STEP)).sortWithinPartitions(*PAGE)
    return _rows(dealt, pages, f"doc_id string, page_no int, {schema}")


def read_tables(numbers: DataFrame, open_: Decoder | Stored) -> DataFrame:
    """Cells of the best table that the decoder's own finder sees on each page; a page where it fails
    has none."""

    def read(doc, n: int) -> Iterator[dict]:
        for t, rows in enumerate(doc.tables(n)):
            for r, cells in enumerate(rows):
                yield {"table_no": t, "row_no": r, "cells": [c if c is None else str(c) for c in cells]}

    rows = _each_page(numbers, open_, read, lambda n, e: [], "table_no int, row_no int, cells array<string>")
    cells = headers.rows_to_cells(rows, [*PAGE, "table_no"])
    best = headers.best_table(cells, PAGE).drop("filled")
    return cells.join(best, [*PAGE, "table_no"], "left_semi").drop("table_no")


def rgb(image: np.ndarray) -> np.ndarray:
    """Three channels: a fourth goes, a single one is repeated."""
    image = image[:, :, None] if image.ndim == 2 else image
    return np.ascontiguousarray(np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[:, :, :3])


BOXES = "array<struct<box_no: int, box: array<struct<x: double, y: double>>, text: string, score: double>>"


def read_images(numbers: DataFrame, open_: Decoder | Stored, engine: Callable[[], Callable] | None, fallback: Callable[[], Callable] | None = None, turned: bool = False) -> DataFrame:
    """What OCR sees on page images, upright or ``turned`` by 90 degrees clockwise: page_w with boxes, or
    lines of text, or an error. See ``read_scans``."""
    made: dict[str, object] = {}

    def make() -> None:
        for name, factory in (("boxes", engine), ("lines", fallback)):
            if factory is None or "boxes" in made:
                continue
            try:
                made[name] = factory()
            except Exception as e:
                made["error"] = f"OCR engine could not start: {e}"
        made["done"] = True

    none = dict.fromkeys(("page_w", "boxes", "lines", "error")) | {"not_ready": False}

    def number(x) -> float | None:
        return None if x is None else float(x)

    def read(doc, n: int) -> Iterator[dict]:
        if "done" not in made:
            make()
        if "boxes" not in made and "lines" not in made:
            yield none | {"error": made.get("error", "no OCR engine"), "not_ready": True}
            return
        image = doc.image(n, DPI)
        image = rgb(np.rot90(image, k=-1) if turned else image)
        if "boxes" in made:
            found = [{"box_no": i, "box": [{"x": float(p[0]), "y": float(p[1])} for p in points], "text": text, "score": number(score)} for i, (points, text, score) in enumerate(made["boxes"](image) or [])]
            yield none | {"page_w": float(image.shape[1]), "boxes": found}
        else:
            yield none | {"lines": [x.strip() for x in made["lines"](image) if x.strip()]}

    return _each_page(numbers, open_, read, lambda n, e: [none | {"error": str(e)}], f"page_w double, boxes {BOXES}, lines array<string>, error string, not_ready boolean")


def read_scans(numbers: DataFrame, open_: Decoder | Stored, engine: Callable[[], Callable] | None, fallback: Callable[[], Callable] | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """Cells of page images, with the way they were read, and rows with an error alone for pages that
    gave none. ``engine`` makes, once a task, a function from an image to (points, text, score) each;
    only where it can't be made, ``fallback`` makes one from an image to lines of text, which become
    one column. ``not_ready`` says that there was neither. Pages without a table upright are read once
    more, turned. ``keep`` writes what is used several times, so that no image is read again for it."""

    def table(seen: DataFrame, way: str) -> DataFrame:
        return ocr_cells(seen.select(*PAGE, "page_w", F.inline("boxes"))).withColumn("method", F.lit(way))

    seen = keep("seen", read_images(numbers, open_, engine, fallback))
    upright = keep("upright", table(seen, "ocr"))
    left = seen.filter("boxes IS NOT NULL").select(*PAGE).join(upright.select(*PAGE), PAGE, "left_anti")
    again = keep("seen_turned", read_images(left, open_, engine, turned=True))
    lines = seen.filter("size(lines) > 1").select(*PAGE, F.posexplode("lines").alias("row_no", "value"), F.lit(0).alias("col_pos"), F.lit("Description").alias("raw_header"), F.lit("ocr lines").alias("method"))
    found = upright.unionByName(keep("turned", table(again, "ocr turned"))).unionByName(lines)
    tried = seen.join(left, PAGE, "left_anti").unionByName(again).select(*PAGE, "error", "not_ready")
    empty = tried.join(found.select(*PAGE), PAGE, "left_anti").withColumn("error", F.coalesce("error", F.lit("no table")))
    return found.withColumn("not_ready", F.lit(False)).unionByName(empty, allowMissingColumns=True)
