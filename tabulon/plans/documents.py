"""From files, words or cells to parts, with what has to be reviewed; all lazy until a sink is called
(but that ``process_files`` writes down what it has read, so that a file is read once)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import context, headers, layout, qc, transform
from tabulon.sources import documents as source
from tabulon.sources import page_source
from tabulon.sources.config import Config
from tabulon.sources.pages import ocr_status

PAGE = ["doc_id", "page_no"]


@dataclass
class Result:
    main: DataFrame
    unmapped: DataFrame
    failed: DataFrame
    mapping: DataFrame
    lost: DataFrame | None = None
    status: DataFrame | None = None
    #: doc_id and error of files that could not be opened; doc_id and warnings (texts) of the others.
    errors: DataFrame | None = None
    warnings: DataFrame | None = None
    #: doc_id, raw_header and place of the columns of the review sheets.
    columns: DataFrame | None = None


def process_cells(cells: DataFrame, config: Config, page_ctx: DataFrame | None = None) -> Result:
    """Distinct headers are mapped once; cells are then pivoted, transformed and checked."""
    mapping = headers.header_map(cells.select("raw_header").distinct(), config)
    parts = transform.transform(cells, mapping, config, page_ctx)
    return Result(parts, transform.unmapped_cells(cells, mapping), qc.qc_failed(parts), mapping, columns=transform.review_columns(cells, mapping))


def process_words(words: DataFrame, lines: DataFrame, pages: DataFrame, config: Config, other: DataFrame | Callable[[DataFrame], DataFrame] | None = None, scans: DataFrame | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Result:
    """Pages with text that are no prose become cells by the text-block pass, get their context, and are
    processed; lost rows are reconciled. ``other``: cells of a second pass for pages where the first one
    is not confident, or a function that makes them for such pages (doc_id, page_no). ``scans``: cells
    of pages without text. ``keep`` may write down what is used several times, and return what it wrote."""
    usable = pages.filter(~context.is_scanned_page(F.col("text"), config.min_text_chars) & ~context.is_skipped_page(F.col("text"), config.skip_markers)).select(*PAGE)
    words, lines = (x.join(usable, PAGE, "left_semi") for x in (words, lines))
    cells = keep("cells", layout.textblock_cells(words))
    if other is not None:
        known = headers.known_headers(cells.sparkSession, config)
        if callable(other):
            sure = headers.score_tables(cells, PAGE, known).filter(F.col("score") >= config.score_confident)
            other = keep("other", other(usable.join(sure, PAGE, "left_anti")))
        cells = keep("chosen", headers.escalate(cells, other, PAGE, known, config.score_confident))
    found = cells if scans is None else cells.unionByName(scans)
    result = process_cells(found, config, keep("context", context.page_context(lines, config)))
    got = cells.groupBy(*PAGE).agg(F.countDistinct("row_no").alias("n"))
    # pages without any row are told of as pages without a table
    result.lost = qc.reconcile(layout.item_anchors(words), got, PAGE).filter("got > 0")
    result.status = context.page_status(pages, config, found, scans is not None)
    return result


def process_files(spark: SparkSession, paths: list[str] | source.Stored, config: Config, folder: str, decoder: source.Decoder | None = None, ocr: Callable[[], Callable] | None = None, ocr_lines: Callable[[], Callable] | None = None, pages: str | None = None, page_range: tuple[int, int] | None = None) -> Result:
    """PDF files, by path or stored, to parts. ``folder`` is one that driver and executors share; files, pages, what OCR read
    and each step's rows are kept there, so that nothing is read or worked out twice. ``ocr`` and ``ocr_lines`` make OCR functions (see ``read_scans``). A file or
    page that can't be read stops no other: see errors, status and warnings of the result."""
    decoder = paths if isinstance(paths, source.Stored) else decoder or source.decoder()

    def keep(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    found = source.read_stored(paths, pages, page_range) if isinstance(paths, source.Stored) else page_source.read(spark, paths, decoder, pages=pages, page_range=page_range)
    read = keep("pages", found)
    files = read.groupBy("doc_id").agg(F.max(F.when(F.col("page_no").isNull(), F.col("error"))).alias("error"))
    read = read.filter("page_no IS NOT NULL")
    good = read.filter("error IS NULL")
    words = good.select(*PAGE, F.inline("words"))
    lines = context.mark_bands(good.select(*PAGE, "page_h", F.inline("lines")))
    ready = ocr is not None or ocr_lines is not None
    scanned = good.filter(context.is_scanned_page(F.col("text"), config.min_text_chars)).select(*PAGE)
    seen = keep("scans", source.read_scans(scanned, decoder, ocr, ocr_lines, keep)) if config.enable_ocr and ready else None
    scans = None if seen is None else seen.filter("error IS NULL").select(*PAGE, "row_no", "col_pos", "raw_header", "value")
    result = process_words(words, lines, good.select(*PAGE, "text"), config, lambda weak: source.read_tables(weak, decoder), scans, keep)
    result.main = keep("parts", result.main)
    result.failed = qc.qc_failed(result.main)
    broken = read.filter("error IS NOT NULL").select(*PAGE, F.lit("error").alias("status"), F.col("error").alias("reason"))
    result.status = result.status.unionByName(broken)
    result.errors = files.filter("error IS NOT NULL").select("doc_id", "error")
    state = context.scanned_documents(good.select(*PAGE, "text"), config).withColumn("ocr_status", F.lit(ocr_status(config.enable_ocr, ready)))
    if seen is None:
        state = state.withColumn("ocr_used", F.lit(False))
    else:
        used = seen.groupBy("doc_id").agg(F.max(F.col("error").isNull()).alias("ocr_used"), F.max(F.coalesce("not_ready", F.lit(False))).alias("not_ready"))
        state = state.join(used, "doc_id", "left").withColumn("ocr_used", F.coalesce("ocr_used", F.lit(False)))
        state = state.withColumn("ocr_status", F.when(F.coalesce("not_ready", F.lit(False)) & ~F.col("ocr_used"), "unavailable").otherwise(F.col("ocr_status")))
    opened = files.filter("error IS NULL").select("doc_id")
    rows = result.main.groupBy("doc_id").agg(F.count("*").alias("n"))
    result.warnings = qc.document_warnings(opened, state, result.lost, rows, result.columns)
    return result
