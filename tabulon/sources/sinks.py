"""Sinks: workbook, QC report, run log. Nothing is written before one of these is called."""

from __future__ import annotations

import csv
import os
import re
import uuid
import zipfile
from collections.abc import Collection, Iterable, Iterator
from contextlib import contextmanager
from functools import cache
from io import StringIO
from itertools import count
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.qc import log_line, qc_failed
from tabulon.sources import fixed_values as fixed
from tabulon.sources import spread_files

#: Rows of a worksheet, with the names.
SHEET_ROWS = 1 << 20


class LockedError(RuntimeError):
    """The target cannot be written."""


def display(parts: DataFrame, names: dict[str, str]) -> DataFrame:
    return parts.select(*[F.col(s).alias(c) for c, s in names.items()])


@cache
def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _text(cell) -> str:
    return "" if cell is None or cell != cell else re.sub(fixed.CONTROL_PATTERN, "", str(cell))


def _parts(name: str, rows: int) -> Iterator[str]:
    """Names of the worksheets that so many rows fill."""
    for part in range(max(1, -(-rows // (SHEET_ROWS - 1)))):
        yield name[: 31 - 4 * bool(part)] + (f" ({part + 1})" if part else "")


def _sheets(sheets: dict[str, pd.DataFrame]) -> Iterator[tuple[str, list[str], Iterator[tuple]]]:
    """Name, columns and rows of each worksheet; one that is full goes on in another."""
    for name, df in sheets.items():
        rows = iter(df.itertuples(index=False, name=None))
        for part in _parts(name, len(df)):
            yield part, list(df.columns), (r for _, r in zip(range(SHEET_ROWS - 1), rows))


@contextmanager
def whole(path: str) -> Iterator[str]:
    """A name beside the path, for a file that takes its place when it is whole; one that fails is removed
    and leaves what was there."""
    folder, name = os.path.split(path)
    beside = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    try:
        yield beside
        os.replace(beside, path)
    except BaseException:
        if os.path.exists(beside):
            os.remove(beside)
        raise


def write_workbook(path: str, sheets: dict[str, DataFrame | pd.DataFrame]) -> str:
    """An OOXML workbook of strings, from rows here or from tables, whose rows stay in their order. Sheets
    of tables are made and put together by tasks; the path is then in a folder that they share."""
    with whole(path) as beside:
        tables = [df for df in sheets.values() if not isinstance(df, pd.DataFrame)]
        if tables:
            _spread_workbook(tables[0].sparkSession, beside, sheets)
        else:
            _workbook(beside, sheets)
    return path


TOP = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
SHEET_END = b"</sheetData></worksheet>"


def _sheet_begin(columns: list[str]) -> bytes:
    head = f'{TOP}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    return head.encode() + _row(1, tuple(map(_text, columns)))


def _frame(names: list[str]) -> dict[str, str]:
    """The parts of a workbook with these worksheets, but for the worksheets."""
    numbers = list(enumerate(names, 1))
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i, _ in numbers)
    listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in numbers)
    links = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbers)
    return {
        "[Content_Types].xml": f'{TOP}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'{TOP}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{TOP}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{TOP}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
    }


def _workbook(path: str, sheets: dict[str, pd.DataFrame]) -> None:
    listed = list(_sheets(sheets))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in _frame([n for n, _, _ in listed]).items():
            z.writestr(name, body)
        for i, (_, columns, rows) in enumerate(listed, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(_sheet_begin(columns))
                for r, row in enumerate(rows, 2):
                    out.write(_row(r, tuple(map(_text, row))))
                out.write(SHEET_END)


def _spread_workbook(spark: SparkSession, path: str, sheets: dict[str, DataFrame | pd.DataFrame]) -> None:
    listed = []
    with spread_files.work_folder(path) as folder:
        for name, df in sheets.items():
            if isinstance(df, pd.DataFrame):
                for part, columns, rows in _sheets({name: df}):
                    listed.append((part, columns, [spread_files.packed(_row(r, tuple(map(_text, row))) for r, row in enumerate(rows, 2))]))
                continue
            rows, n = spread_files.numbered(df, folder)
            made = spread_files.pieces(rows, folder, SHEET_ROWS - 1, lambda row, i: _row(i + 2, tuple(map(_text, row))))
            listed += [(part, df.columns, made.get(i, [])) for i, part in enumerate(_parts(name, n))]
        archive = spread_files.Archive(spark, path)
        for name, body in _frame([n for n, _, _ in listed]).items():
            archive.add(name, [spread_files.packed([body.encode()], last=True)])
        for i, (_, columns, parts) in enumerate(listed, 1):
            archive.add(f"xl/worksheets/sheet{i}.xml", [spread_files.packed([_sheet_begin(columns)]), *parts, spread_files.packed([SHEET_END], last=True)])
        archive.close()


def _row(r: int, cells: tuple) -> bytes:
    body = "".join(f'<c r="{_letters(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for i, c in enumerate(cells) if c)
    return f'<row r="{r}">{body}</row>'.encode()


def free_path(path: str, as_copy: bool = True, taken: Collection[str] = ()) -> str:
    """The path, or if it is locked, or another file of the batch has it, the first copy name that is free."""
    if path not in taken and _writable(path):
        return path
    base, ext = os.path.splitext(path)
    if as_copy:
        return next(x for x in (f"{base}_{i}{ext}" for i in count(1)) if x not in taken and not os.path.exists(x))
    raise LockedError(f"{path} is locked; close it and try again")


def _writable(path: str) -> bool:
    if not os.path.exists(path):
        return True
    try:
        with open(path, "ab"):
            return True
    except OSError:
        return False


def grid(df: DataFrame, order: list[str], rows: int = 200) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """Names, and the first rows as text under labels from 1, for people to look at. Nothing is written."""
    shown = df.orderBy(*order).limit(rows).collect()
    return list(df.columns), [(i, [_text(x) for x in r]) for i, r in enumerate(shown, 1)]


def write_qc_report(parts: DataFrame, path: str, order: list[str], names: dict[str, str] | None = None) -> None:
    """Failing rows with their index as CSV; the index column has no name, the file begins with a BOM.
    ``names``: the columns by the name shown (all by their own if None). Tasks write it together, so the
    path is in a folder that they share."""
    names = {c: c for c in parts.columns if c != "row_index"} if names is None else names
    shown = qc_failed(parts).orderBy(*order).select("row_index", *names.values())
    with whole(path) as beside, spread_files.work_folder(beside) as folder:
        rows, _ = spread_files.numbered(shown, folder)
        made = spread_files.pieces(rows, folder, None, lambda row, _: _csv_line(row), pack=False).get(0, [])
        open(beside, "wb").close()
        spread_files.place(parts.sparkSession, beside, 0, [spread_files.packed(["\ufeff".encode() + _csv_line(["", *names])], pack=False), *made])


def _csv_line(cells: Iterable) -> bytes:
    out = StringIO(newline="")
    csv.writer(out).writerow(["" if x is None or x != x else x for x in cells])
    return out.getvalue().encode()


def write_qc_rows(path: str, columns: list[str], rows: Iterable[tuple[int, Iterable]]) -> str:
    with whole(path) as beside, open(beside, "wb") as f:
        f.write("\ufeff".encode() + _csv_line(["", *columns]))
        f.writelines(_csv_line([index, *cells]) for index, cells in rows)
    return path


def append_log(log: DataFrame, path: str) -> None:
    """run_log(ts, status, file, rows) as lines of text, appended to the table at ``path``."""
    log.select(log_line(F.col("ts"), F.col("status"), F.col("file"), F.col("rows")).alias("value")).write.mode("append").text(path)
