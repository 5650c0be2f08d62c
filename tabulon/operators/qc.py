"""Quality control: failed rows, reconciliation, language flag, messages, run log."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import letters, strip
from tabulon.operators import language
from tabulon.operators.language import Profile
from tabulon.sources import fixed_values as fixed


def fails(parts: DataFrame, required: tuple[str, ...] = ("spare_part_no", "drawing_pos_no")) -> Column:
    """Whether a required cell is blank; columns that are missing are not required."""
    out = F.lit(False)
    for c in required:
        if c in parts.columns:
            out = out | (strip(F.col(c)) == "")
    return out


def qc_failed(parts: DataFrame) -> DataFrame:
    return parts.filter(fails(parts))


def qc_summary(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(fails(parts)).alias("n_failed"))


def reconcile(seen: DataFrame, extracted: DataFrame, by: list[str]) -> DataFrame:
    """Pages where more item numbers were seen than rows extracted. Both: keys and n."""
    joined = seen.select(*by, F.col("n").alias("seen")).join(extracted.select(*by, F.col("n").alias("got")), by, "left")
    return joined.withColumn("got", F.coalesce("got", F.lit(0))).filter("seen > got")


def reconcile_message(lost: DataFrame, order: list[str], page: str = "page_no") -> DataFrame:
    """One row: how many pages, the first five, and how many more."""
    some = lost.orderBy(*order).limit(5)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "seen", "got"))), lambda x: F.format_string("p%d (saw %d, got %d)", x[page], x["seen"], x["got"])), ", ")
    head = some.agg(text.alias("examples"))
    return head.withColumn("pages", lost.agg(F.count("*")).scalar()).withColumn("more", F.greatest(F.col("pages") - 5, F.lit(0)))


def document_message(docs: DataFrame) -> DataFrame:
    """Warning by scanned, total, is_scanned, ocr_used and ocr_status; null where there is none."""
    reason = F.when(F.col("ocr_status") == "disabled", "OCR is turned off").when(F.col("ocr_status") == "unavailable", "no OCR engine is installed").otherwise("OCR found no parts table")
    text = (
        F.when(F.col("scanned") == 0, None)
        .when(F.col("is_scanned") & ~F.col("ocr_used"), F.format_string("scanned document: %d of %d pages have no text layer, and %s", "scanned", "total", reason))
        .when(F.col("ocr_used"), F.format_string("%d scanned pages were read by OCR: verify these rows", "scanned"))
        .otherwise(F.format_string("%d pages were image-only and skipped", "scanned"))
    )
    return docs.withColumn("warning", text)


def lost_messages(lost: DataFrame, shown: int = 5) -> DataFrame:
    """doc_id and message: how many pages may have lost rows, the first ones, and how many more."""
    pages = F.sort_array(F.collect_list(F.struct("page_no", "seen", "got")))
    each = lost.groupBy("doc_id").agg(pages.alias("p"))
    examples = F.array_join(F.transform(F.slice("p", 1, shown), lambda x: F.format_string("p%d (saw %d, got %d)", x["page_no"], x["seen"], x["got"])), ", ")
    more = F.when(F.size("p") > shown, F.format_string(" +%d more", F.size("p") - shown)).otherwise("")
    return each.select("doc_id", F.concat(F.format_string("%d pages may have lost rows: ", F.size("p")), examples, more).alias("message"))


def unmapped_messages(columns: DataFrame) -> DataFrame:
    """doc_id and unmapped: how many columns had no target. ``columns``: doc_id and raw_header."""
    n = columns.groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.select("doc_id", F.format_string("%d columns could not be mapped: their cells are in the review sheet", "n").alias("unmapped"))


def document_warnings(docs: DataFrame, state: DataFrame, lost: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id and ``warnings``, in order: about scans, about lost rows, if there is neither and no row that
    no table was found, and about unmapped columns. ``state``: what ``document_message`` needs; ``rows``:
    doc_id and n; ``columns``: what ``unmapped_messages`` needs."""
    sides = [document_message(state).select("doc_id", "warning"), lost_messages(lost), rows, unmapped_messages(columns)]
    joined = reduce(lambda a, b: a.join(b, "doc_id", "left"), sides, docs)
    some = F.array_compact(F.array("warning", "message"))
    none = F.array(F.lit("no table was found on any page: the document may be scanned or laid out in an unknown way"))
    first = F.when((F.size(some) == 0) & F.col("n").isNull(), none).otherwise(some)
    return joined.select("doc_id", F.concat(first, F.array_compact(F.array("unmapped"))).alias("warnings"))


def error_groups(errors: DataFrame) -> DataFrame:
    """Errors of pages and of whole files, counted."""
    kind = F.when(F.startswith("message", F.lit("page ")), "page").otherwise("critical")
    return errors.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def flag_language(parts: DataFrame, detect: Callable[[str], str] | Profile | None, mark: str | None = None) -> DataFrame:
    """Tags internal_remark where a long, mostly alphabetic part_name is not English. ``detect`` is a
    learnt profile, or a plug-in from text to language code; without one nothing is tagged. ``mark`` names
    a column that says whether the row was tagged."""
    if detect is None:
        return parts.withColumn(mark, F.lit(False)) if mark else parts
    name, remark = strip(F.col("part_name")), strip(F.col("internal_remark"))
    long = (F.length(name) >= fixed.FOREIGN_MIN_LENGTH) & (letters(name) >= F.length(name) * 0.5)
    asked = parts.withColumn("__asked", F.when(long, name))
    if isinstance(detect, Profile):
        told = language.with_language(asked, "__asked", detect, "__language")
    else:
        told = asked.withColumn("__language", _by_plug_in(detect)(F.coalesce("__asked", F.lit(""))))
    foreign = F.coalesce(F.col("__language") != "en", F.lit(False)) & F.col("__asked").isNotNull() & ~F.contains("internal_remark", F.lit(fixed.FOREIGN_TAG))
    tagged = F.when(remark == "", fixed.FOREIGN_TAG).otherwise(F.concat_ws(" ", remark, F.lit(fixed.FOREIGN_TAG)))
    marked = told.withColumn(mark or "__foreign", foreign)
    marked = marked.withColumn("internal_remark", F.when(F.col(mark or "__foreign"), tagged).otherwise(F.col("internal_remark")))
    return marked.select(*parts.columns, *([mark] if mark else []))


def _by_plug_in(detect: Callable[[str], str]):
    @F.pandas_udf("string")
    def by_plug_in(names: pd.Series) -> pd.Series:
        def one(x: str) -> str | None:
            try:
                return detect(x)
            except Exception:  # a detector may refuse a text
                return None

        return names.map(one)

    return by_plug_in


def log_line(ts: Column, status: Column, file: Column, rows: Column) -> Column:
    name = F.regexp_extract(file, r"([^/\\]*)$", 1)
    return F.format_string("[%s] | [Status: %s] | [%s] | [Rows Processed: %d]", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), status, name, rows)
