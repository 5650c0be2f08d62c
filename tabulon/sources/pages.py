"""Page specs, selection of pages, file intake and output names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = 2**31 - 1


def parse_pages(spec: str | None, total: int | None = None) -> list[tuple[int, int]]:
    """Ranges of a page spec: ``1-5, 12``, ``100-``, ``-5``; reversed ones are turned, ``-`` alone is all
    pages, junk raises ``ValueError``, nothing gives no range. Never a set of pages: an open range is
    as small as any."""
    out = []
    for part in re.split(r"[,\s]+", (spec or "").strip()):
        if not part:
            continue
        lo, dash, hi = part.partition("-")
        a = int(lo) if lo.strip() else 1
        b = a if not dash else int(hi) if hi.strip() else (total or LAST)
        a, b = max(min(a, b), 1), max(a, b)
        if total is not None:
            b = min(b, total)
        if a <= b:
            out.append((a, b))
    return out


def in_ranges(page: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | page.between(a, b)
    return out


def chosen_pages(total: int, spec: str | None = None, page_range: tuple[int, int] | None = None) -> list[int]:
    """Pages of a document of ``total`` pages, ascending: the spec goes before the range, and what selects
    nothing gives the whole."""
    ranges = parse_pages(spec, total) or ([page_range] if page_range else [])
    some = {n for a, b in ranges for n in range(max(a, 1), min(b, total) + 1)}
    return sorted(some) if some else list(range(1, total + 1))


def select_pages(pages: DataFrame, spec: str | None = None, page_range: tuple[int, int] | None = None, page: str = "page_no") -> DataFrame:
    """The spec goes before the range; either that selects nothing of a document gives the whole of it.
    The test of emptiness is per document and aggregates only page numbers."""
    ranges = parse_pages(spec) or ([page_range] if page_range else [])
    if not ranges:
        return pages
    hit = in_ranges(F.col(page), ranges)
    some = pages.filter(hit).select(F.col("doc_id").alias("__d")).distinct()
    return pages.join(some, F.col("doc_id") == F.col("__d"), "left").filter(F.col("__d").isNull() | hit).drop("__d")


def intake(paths: list[str]) -> list[str]:
    """PDF paths in their order, each once."""
    return list(dict.fromkeys(p for p in paths if p.lower().endswith(".pdf")))


def output_name(path: Column, suffix: str = "_PROCESSED.xlsx") -> Column:
    return F.concat(F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1), F.lit(suffix))


def ocr_status(enabled: bool, available: bool) -> str:
    return "disabled" if not enabled else "unavailable" if not available else "ran"
