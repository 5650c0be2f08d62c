"""Page context from lines(doc_id, page_no, line_no, band, text): scans, skips, makers, titles, plates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.patterns import any_contains
from tabulon.functions.text import strip
from tabulon.sources import fixed_values as fixed
from tabulon.sources.config import Config

PAGE = ["doc_id", "page_no"]


def is_scanned_page(text: Column, min_chars: int = fixed.MIN_TEXT_CHARS) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < min_chars


def is_skipped_page(text: Column, markers: list[str] = fixed.SKIP_MARKERS) -> Column:
    return any_contains(F.lower(F.coalesce(text, F.lit(""))), [m.lower() for m in markers])


def scanned_documents(pages: DataFrame, config: Config) -> DataFrame:
    """doc_id, scanned pages, all pages, and whether most of the document is scanned."""
    n = F.count_if(is_scanned_page(F.col("text"), config.min_text_chars))
    return pages.groupBy("doc_id").agg(n.alias("scanned"), F.count("*").alias("total")).withColumn("is_scanned", F.col("scanned") >= F.greatest(F.lit(1.0), F.col("total") * 0.6))


def mark_bands(lines: DataFrame) -> DataFrame:
    """Lines (y, page_h) with the band of their page that they are in: top, bottom or null."""
    y, h = F.col("y"), F.col("page_h")
    return lines.withColumn("band", F.when(y < fixed.BAND * h, "top").when(y > (1 - fixed.BAND) * h, "bottom"))


def bands(lines: DataFrame) -> DataFrame:
    """Lines in the top and bottom bands of their page."""
    return mark_bands(lines).filter("band IS NOT NULL")


def has_maker_hint(line: Column) -> Column:
    return any_contains(F.lower(line), fixed.MAKER_HINTS)


def first_maker(lines: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """The first line with a hint of a maker, of each page that has one."""
    return lines.filter(has_maker_hint(F.col("text"))).groupBy(*by).agg(strip(F.min_by("text", "line_no")).alias("manufacturer"))


def is_title(line: Column) -> Column:
    low = F.lower(line)
    some_letters = line.rlike(r"\p{L}[^\p{L}]*\p{L}[^\p{L}]*\p{L}")
    bad = line.rlike(fixed.CODE_LINE_PATTERN) | line.rlike("(?i)" + fixed.DATE_LINE_PATTERN) | any_contains(low, fixed.TITLE_STOPWORDS) | any_contains(low, fixed.MAKER_HINTS)
    return (F.length(strip(line)) >= 3) & some_letters & ~bad


def is_locator(line: Column) -> Column:
    low = F.lower(strip(line))
    exact = [w + end for w in fixed.TITLE_LOCATORS for end in ("", ":")]
    return low.isin(exact) | reduce(or_, (F.startswith(low, F.lit(w + " ")) for w in fixed.TITLE_LOCATORS))


def plate_captions(lines: DataFrame, config: Config, by: list[str] = PAGE) -> DataFrame:
    """Plate and title of each page with a plate number: of the lines with one, the first that has,
    within three lines above, a locator and below it a title; else the first plate without a title."""
    w = Window.partitionBy(*by).orderBy("line_no")
    plate = F.regexp_extract("text", config.plate_pattern, 0)
    looked = lines.withColumns({"plate": plate, "title_here": F.when(is_title(F.col("text")), strip(F.col("text"))), "locates": is_locator(F.col("text"))})
    above = F.array(*[F.struct(F.lag("title_here", k).over(w).alias("t"), F.coalesce(F.lag("locates", k).over(w), F.lit(False)).alias("l")) for k in (1, 2, 3)])
    looked = looked.withColumn("above", above).filter("plate <> ''")
    anchor = F.array_position(F.transform("above", lambda x: x["l"]), True)
    below = F.filter(F.transform(F.slice("above", F.lit(1), F.greatest(anchor - 1, F.lit(0)).cast("int")), lambda x: x["t"]), lambda t: t.isNotNull())
    looked = looked.withColumn("title", F.when(anchor > 0, F.get(below, 0)))
    rank = F.struct(F.col("title").isNull().alias("late"), "line_no")
    return looked.groupBy(*by).agg(F.min_by(F.struct("plate", F.coalesce("title", F.lit("")).alias("title")), rank).alias("b")).select(*by, F.col("b.plate").alias("drawing_no"), F.col("b.title").alias("spare_group"))


def propagate_titles(context: DataFrame) -> DataFrame:
    """Pages take the title that their plate had first, in page order within the document."""
    learnt = context.filter("spare_group <> '' AND drawing_no <> ''").groupBy("doc_id", "drawing_no").agg(F.min_by("spare_group", "page_no").alias("learnt"))
    return context.join(learnt, ["doc_id", "drawing_no"], "left").withColumn("spare_group", F.coalesce("learnt", "spare_group")).drop("learnt")


def page_status(pages: DataFrame, config: Config, tables: DataFrame | None = None, ocr: bool = False) -> DataFrame:
    """doc_id, page_no, status and reason of pages that give no table. With ``ocr``, the tables hold
    what it read from scanned pages too."""
    text = F.col("text")
    scanned = is_scanned_page(text, config.min_text_chars)
    has = F.lit(False)
    if tables is not None:
        pages = pages.join(tables.select(*PAGE).distinct().withColumn("has", F.lit(True)), PAGE, "left")
        has = F.coalesce("has", F.lit(False))
    status = F.when(scanned & F.lit(ocr), F.when(~has, "unread")).when(scanned, "scanned").when(is_skipped_page(text, config.skip_markers), "skipped")
    if tables is not None:
        status = status.when(~has, "empty")
    reason = F.create_map(*[F.lit(x) for p in fixed.PAGE_STATUS.items() for x in p])
    return pages.select(*PAGE, status.alias("status")).filter("status IS NOT NULL").withColumn("reason", F.format_string("page %d: %s", F.col("page_no"), F.element_at(reason, F.col("status"))))


def page_context(lines: DataFrame, config: Config) -> DataFrame:
    """page_ctx: doc_id, page_no, manufacturer, spare_group, drawing_no, with titles propagated."""
    pages = lines.select(*PAGE).distinct()
    edge = lines.filter("band IN ('top', 'bottom')").withColumn("line_no", F.struct((F.col("band") == "bottom").alias("b"), "line_no"))
    joined = pages.join(first_maker(edge), PAGE, "left").join(plate_captions(lines, config), PAGE, "left")
    return propagate_titles(joined.na.fill("", ["manufacturer", "spare_group", "drawing_no"]))
