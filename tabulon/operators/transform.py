"""From cells to clean parts. Column names are snake case inside and restored at the sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import bundle, clean, dimension, join_nonblank, material, strip, strip_controls, title_case
from tabulon.sources import fixed_values as fixed
from tabulon.sources.config import Config

KEYS = ["doc_id", "page_no", "row_no"]


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()).strip("_")


def columns(config: Config) -> dict[str, str]:
    """Snake-case names by display name, in schema order."""
    return {c: snake(c) for c in config.target_schema}


def pivot_cells(cells: DataFrame, mapping: DataFrame, config: Config) -> DataFrame:
    """One row per raw row with every schema column: mapped cells are cleaned and bundled in column
    order, missing ones are empty. One shuffle and one list a row; the mapping is configuration-sized."""
    named = cells.join(mapping.filter("target IS NOT NULL").select("raw_header", "target"), "raw_header", "left")
    cell = F.when(F.col("target").isNotNull(), F.struct("col_pos", "target", clean(F.col("value")).alias("value")))
    rows = named.groupBy(*KEYS).agg(F.sort_array(F.collect_list(cell)).alias("__cells"))
    of = lambda c: F.transform(F.filter("__cells", lambda x: x["target"] == c), lambda x: x["value"])
    names = columns(config)
    held = rows.select(*KEYS, *[of(c).alias(s) for c, s in names.items()])
    return held.select(*KEYS, *[bundle(F.col(s)).alias(s) for s in names.values()])


def unmapped_cells(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells of headers without a target, of rows where one of them is not blank."""
    rest = cells.join(mapping.filter("target IS NOT NULL"), "raw_header", "left_anti").withColumn("value", clean(F.col("value")))
    some = rest.withColumn("some", F.max(strip(F.col("value")) != "").over(Window.partitionBy(*KEYS)))
    return some.filter("some").select(*KEYS, "raw_header", "value")


def first_seen(cells: DataFrame, by: list[str]) -> DataFrame:
    """The columns of the union of a document's tables: ``by``, raw_header, and place, from 0 in the order
    in which pages, and columns within a page, first have them."""
    seen = cells.groupBy(*by, "raw_header").agg(F.min(F.struct("page_no", "col_pos")).alias("__at"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("__at", "raw_header")) - 1).drop("__at")


def review_columns(cells: DataFrame, mapping: DataFrame, by: list[str] = KEYS[:1]) -> DataFrame:
    """The unmapped columns of each document that has a cell in one of them, as ``first_seen``."""
    rest = cells.join(mapping.filter("target IS NOT NULL"), "raw_header", "left_anti")
    seen = rest.groupBy(*by, "raw_header").agg(F.min(F.struct("page_no", "col_pos")).alias("__at"), F.max(strip(clean(F.col("value"))) != "").alias("__some"))
    w = Window.partitionBy(*by)
    ranked = seen.withColumns({"place": F.row_number().over(w.orderBy("__at", "raw_header")) - 1, "__any": F.max("__some").over(w)})
    return ranked.filter("__any").drop("__at", "__some", "__any")


def review_rows(unmapped: DataFrame, columns: DataFrame) -> DataFrame:
    """One document's review table: KEYS and its unmapped columns in their order. The columns (one document's)
    come to the driver, the cells don't; they are pivoted in one pass."""
    names = [r["raw_header"] for r in columns.orderBy("place").collect()]
    of = lambda h: F.coalesce(F.max(F.when(F.col("raw_header") == h, F.col("value"))), F.lit(""))
    return unmapped.groupBy(*KEYS).agg(*[of(h).alias(f"[UNMAPPED] {h}") for h in names])


def apply_context(parts: DataFrame, context: DataFrame) -> DataFrame:
    """Fills blank manufacturer, spare_group, drawing_no and ref_page from page_ctx."""
    names = ["manufacturer", "spare_group", "drawing_no"]
    side = context.select("doc_id", "page_no", *[F.col(n).alias(f"__{n}") for n in names])
    joined = parts.join(side, ["doc_id", "page_no"], "left")
    fill = lambda own, other: F.when(strip(own) != "", strip(own)).otherwise(F.coalesce(other, F.lit("")))
    out = {n: fill(F.col(n), F.col(f"__{n}")) for n in names} | {"ref_page": fill(F.col("ref_page"), F.col("page_no").cast("string"))}
    return joined.withColumns(out).drop(*[f"__{n}" for n in names])


def extract_dimensions(parts: DataFrame, config: Config) -> DataFrame:
    """Dimensions in text and then in part_name move to the end of text."""
    text, from_text = dimension(F.col("text"), config.dimension_pattern)
    name, from_name = dimension(F.col("part_name"), config.dimension_pattern)
    add = lambda cur, dim: F.when(dim.isNull() | (cur == dim), cur).otherwise(join_nonblank(cur, dim))
    once = parts.withColumns({"part_name": name, "text": strip(text), "__d1": from_text, "__d2": from_name})
    return once.withColumn("text", add(add(F.col("text"), F.col("__d1")), F.col("__d2"))).drop("__d1", "__d2")


def tag_materials(parts: DataFrame, config: Config) -> DataFrame:
    """A short material is appended to part_name as a tag, a long one to internal_remark."""
    found = parts.withColumn("__m", material(F.concat_ws(" ", "part_name", "text"), config.materials, config.whole_word_materials))
    tag = F.concat(F.lit("Matl. "), F.col("__m"))
    short = F.length("__m") <= config.max_material_length
    name = F.when(short & ~F.contains("part_name", tag), strip(F.concat_ws(" ", "part_name", tag))).otherwise(F.col("part_name"))
    remark = F.when(~short, F.when(strip(F.col("internal_remark")) == "", F.col("__m")).otherwise(strip(F.concat_ws(" ", "internal_remark", "__m")))).otherwise(F.col("internal_remark"))
    return found.withColumns({"part_name": name, "internal_remark": remark}).drop("__m")


def stitch(parts: DataFrame, order: list[str] = KEYS[1:], by: list[str] = KEYS[:1]) -> DataFrame:
    """Rows with a name but no key are appended to the row before, if that (past others of their kind)
    has a key: gaps and islands, within a document."""
    key, name = strip(F.col("drawing_pos_no")), strip(F.col("part_name"))
    kind = F.when(key != "", "K").when(name != "", "N").otherwise("E")
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = parts.withColumn("__kind", kind)
    marked = marked.withColumn("__joins", (F.col("__kind") == "N") & F.coalesce(F.last(F.when(F.col("__kind") != "N", F.col("__kind")), ignorenulls=True).over(before) == "K", F.lit(False)))
    marked = marked.withColumn("__island", F.sum((~F.col("__joins")).cast("int")).over(w))
    island = Window.partitionBy(*by, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = F.collect_list(F.struct("__joins", F.col("part_name").alias("n"))).over(island)
    whole = F.when(F.size(names) == 1, F.col("part_name")).otherwise(strip(F.array_join(F.transform(names, lambda x: strip(x["n"])), " ")))
    return marked.withColumn("part_name", whole).filter("NOT __joins").drop("__kind", "__joins", "__island")


def is_noise(config: Config) -> Column:
    names = list(columns(config).values())
    name, number, text = (strip(F.col(c)) for c in ("part_name", "spare_part_no", "text"))
    blank = F.concat(*[strip(F.col(c)) for c in names]) == ""
    page_mark = (number == "") & name.rlike(fixed.NOISE_PATTERN)
    return blank | F.when((name == "") & (number == ""), F.length(text) <= 3).otherwise(page_mark)


def pad_and_order(parts: DataFrame, config: Config, keys: list[str] = KEYS) -> DataFrame:
    """Every schema column, in order, as text without control characters; missing ones empty."""
    cell = lambda s: strip_controls(F.coalesce(F.col(s).cast("string"), F.lit(""))) if s in parts.columns else F.lit("")
    return parts.select(*keys, *[cell(s).alias(s) for s in columns(config).values()])


def reindex(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("row_index", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def transform(cells: DataFrame, mapping: DataFrame, config: Config, context: DataFrame | None = None) -> DataFrame:
    """All steps in their order; row_index numbers what is left of each document."""
    parts = pivot_cells(cells, mapping, config)
    if context is not None:
        parts = apply_context(parts, context)
    parts = parts.withColumn("part_name", title_case(F.col("part_name"), config.title_case_lower))
    parts = stitch(tag_materials(extract_dimensions(parts, config), config))
    return reindex(pad_and_order(parts, config).filter(~is_noise(config)), ["doc_id"], ["page_no", "row_no"])
