"""Headers and raw tables, in long form: cells(doc_id, page_no, row_no, col_pos, raw_header, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions.similarity import other_lengths, prefix_keys, similarity_udf, sketch, sketches_fit, sorted_tokens
from tabulon.functions.text import norm_header, strip
from tabulon.sources import fixed_values as fixed
from tabulon.sources.config import Config, literal_rows, norm, phrase_table

CONTEXT_COLUMNS = ["__manufacturer__", "__spare_group__", "__drawing_no__", "__ref_page__"]


def alias_index(phrases: DataFrame) -> DataFrame:
    """norm, target: of equal norms the last phrase wins."""
    return phrases.groupBy("norm").agg(F.max_by("target", "ordinal").alias("target"))


def named(headers: DataFrame, phrases: DataFrame) -> DataFrame:
    """Distinct headers with the target that they have by normalised equality, null without one."""
    distinct = headers.filter(~F.col("raw_header").isin(CONTEXT_COLUMNS)).select("raw_header").distinct()
    index = alias_index(phrases).withColumnRenamed("norm", "key")
    return distinct.withColumn("key", norm_header(F.col("raw_header"))).join(index, "key", "left").select("raw_header", F.col("target").alias("named"))


def similar(headers: DataFrame, phrases: DataFrame, threshold: float) -> DataFrame:
    """raw_header, named, and ``best`` for those without a name: score and target of the most similar phrase,
    the first of equal ones; a score below the threshold is not the best one there is.

    Headers and phrases meet by an index of grams (``prefix_keys``) and by length, at the first key that they
    share, so a pair comes once; of these pairs, the ones whose sketches are near are scored. A header's own
    row, without a key, keeps those that meet no phrase."""
    side = phrases.select("ordinal", "target", "phrase", sorted_tokens(F.col("phrase")).alias("s")).withColumn("m", F.length("s"))
    side = side.withColumns({"theirs": prefix_keys(F.col("s"), F.col("m"), threshold), "drawn": sketch(F.col("s"), F.col("m"))})
    side = side.select("ordinal", "target", "phrase", "m", "theirs", "drawn", F.explode("theirs").alias("k"))
    longest = phrases.agg(F.max(F.length("phrase"))).scalar()
    text = headers.withColumn("s", sorted_tokens(F.col("raw_header"))).withColumns({"n": F.length("s"), "longest": longest})
    low, high = other_lengths(F.col("n"), threshold)
    fits = F.col("named").isNull() & (low <= F.col("longest"))
    own = F.when(fits, prefix_keys(F.col("s"), F.col("n"), threshold)).otherwise(F.expr("cast(array() as array<bigint>)"))
    keyed = text.select("raw_header", "named", "n", low.alias("low"), high.alias("high"), F.when(fits, sketch(F.col("s"), F.col("n"))).alias("bits"), own.alias("own"))
    keyed = keyed.withColumn("k", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "own")))
    near = F.col("m").between(F.col("low"), F.col("high")) & sketches_fit(F.col("bits"), F.col("n"), F.col("drawn"), F.col("m"), threshold)
    met = keyed.join(side, (keyed["k"] == side["k"]) & near & (keyed["k"] == F.array_min(F.array_intersect("own", "theirs"))), "left")
    score = F.when(F.col("phrase").isNotNull(), similarity_udf()(F.col("raw_header"), F.col("phrase")))
    scored = met.select("raw_header", "named", "ordinal", "target", score.alias("score"))
    best = F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("ordinal")).alias("first"), "target"))).alias("best")
    return scored.groupBy("raw_header").agg(F.max("named").alias("named"), best)


def _mapping(found: DataFrame, threshold: float) -> DataFrame:
    """raw_header, target (null: unmapped), method and score."""
    exact, near = F.col("named").isNotNull(), F.col("best.score") >= threshold
    target = F.when(exact, F.col("named")).when(near, F.col("best.target"))
    return found.select("raw_header", target.alias("target"), F.when(exact, "exact").when(near, "fuzzy").alias("method"), F.when(exact, 100.0).when(near, F.col("best.score")).alias("score"))


def map_exact(headers: DataFrame, phrases: DataFrame) -> DataFrame:
    """raw_header, target, method and score by normalised equality."""
    return _mapping(named(headers, phrases).withColumn("best", F.lit(None).cast("struct<score:double,target:string>")), 100.0)


def map_fuzzy(headers: DataFrame, phrases: DataFrame, threshold: float) -> DataFrame:
    """The same by similarity, for headers without an exact name."""
    return _mapping(similar(headers.select("raw_header", F.lit(None).cast("string").alias("named")), phrases, threshold), threshold)


def header_map(headers: DataFrame, config: Config) -> DataFrame:
    """By name, and by similarity for what has none, in one pass over the headers."""
    phrases = phrase_table(headers.sparkSession, config)
    return _mapping(similar(named(headers, phrases), phrases, config.fuzzy_threshold), config.fuzzy_threshold)


def known_headers(spark: SparkSession, config: Config) -> DataFrame:
    names = {norm(p) for _, _, p in config.phrases()} | {norm(t) for t in config.header_aliases}
    return literal_rows(spark, [(x,) for x in sorted(names - {""})], "norm string")


def unique_headers(header: DataFrame, table: list[str]) -> DataFrame:
    """Blank names become ``col_i``, the n-th repeat ``name_n``. ``header``: table keys, col_pos, name."""
    name = F.when(strip(F.col("name")) == "", F.format_string("col_%d", "col_pos")).otherwise(F.col("name"))
    filled = header.withColumn("name", name)
    nth = F.row_number().over(Window.partitionBy(*table, "name").orderBy("col_pos")) - 1
    return filled.withColumn("nth", nth).withColumn("raw_header", F.when(F.col("nth") > 0, F.concat_ws("_", "name", F.col("nth").cast("string"))).otherwise(F.col("name"))).drop("nth", "name")


def rows_to_cells(rows: DataFrame, table: list[str]) -> DataFrame:
    """Rows (table keys, row_no, cells array<string>) to cells: blank rows go, the first row names the
    columns, ragged rows are padded or cut; a table of one row has none."""
    trimmed = rows.withColumn("cells", F.transform("cells", lambda c: strip(F.coalesce(c, F.lit(""))))).filter(F.exists("cells", lambda c: c != ""))
    first = trimmed.groupBy(*table).agg(F.min_by("cells", "row_no").alias("header"), F.min("row_no").alias("top"))
    names = unique_headers(first.select(*table, F.posexplode("header").alias("col_pos", "name")), table)
    body = trimmed.join(first.select(*table, "top", F.size("header").alias("width")), table).filter("row_no > top")
    cells = body.select(*table, "row_no", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col_pos"), "cells")
    cells = cells.select(*table, "row_no", "col_pos", F.coalesce(F.get("cells", F.col("col_pos")), F.lit("")).alias("value"))
    return cells.join(names, [*table, "col_pos"]).select(*table, "row_no", "col_pos", "raw_header", "value")


def header_points(header: Column, known: Column) -> Column:
    """What one header adds to its table's score; ``known``: array of known normalised headers."""
    n, low = norm_header(header), F.lower(strip(header))
    near = F.exists(known, lambda k: (F.length(k) > 2) & (F.contains(k, n) | F.contains(n, k)))
    return F.when(n == "", -2.0).when(low.rlike(fixed.GARBAGE_HEADER_PATTERN), -8.0).when(F.array_contains(known, n), 12.0).when(F.length(n) <= 1, -3.0).when(near, 4.0).otherwise(0.5)


def score_tables(cells: DataFrame, table: list[str], known: DataFrame) -> DataFrame:
    """Table keys and score: points of the headers, 3 times the share of filled cells, less 5 for a
    single column with one row."""
    listed = known.agg(F.sort_array(F.collect_set("norm"))).scalar()
    columns = cells.groupBy(*table, "col_pos", "raw_header").agg(F.count("*").alias("n"), F.count_if(strip(F.col("value")) != "").alias("filled"))
    scored = columns.withColumn("known", listed).withColumn("points", header_points(F.col("raw_header"), F.col("known")))
    total = scored.groupBy(*table).agg(F.sum("points").alias("points"), F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.count("*").alias("width"), F.max("n").alias("rows"))
    return total.select(*table, (F.col("points") + 3.0 * F.col("filled") / F.col("n") - F.when((F.col("width") == 1) & (F.col("rows") < 2), 5.0).otherwise(0.0)).alias("score"))


def best_table(cells: DataFrame, page: list[str]) -> DataFrame:
    """Of a page's tables (table_no), the one with the most filled cells, the first of equal ones."""
    filled = cells.groupBy(*page, "table_no").agg(F.count_if(strip(F.col("value")) != "").alias("filled"))
    return filled.filter("filled > 0").groupBy(*page).agg(F.max(F.struct("filled", (-F.col("table_no")).alias("t"))).alias("b")).select(*page, (-F.col("b.t")).alias("table_no"), F.col("b.filled").alias("filled"))


def escalate(first: DataFrame, second: DataFrame, page: list[str], known: DataFrame, confident: float) -> DataFrame:
    """Cells of the cheap pass where its score is confident; elsewhere of the better of both passes, the
    cheap one if equal. Both are scored in one pass."""
    cells = first.withColumn("__late", F.lit(False)).unionByName(second.withColumn("__late", F.lit(True)))
    of = lambda late: F.max(F.when(F.col("__late") == late, F.col("score")))
    scores = score_tables(cells, [*page, "__late"], known).groupBy(*page).agg(of(False).alias("s1"), of(True).alias("s2"))
    late = F.coalesce(F.col("s1") < confident, F.lit(True)) & F.col("s2").isNotNull() & (F.col("s1").isNull() | (F.col("s2") > F.col("s1")))
    # one row a page, so an inner join: a semi-join would be pushed into both sides of the union, with its scores
    return cells.join(scores.select(*page, late.alias("__late")), [*page, "__late"]).select(*first.columns)


def describe_rescue(cells: DataFrame, table: list[str]) -> DataFrame:
    """Names the most textual of the ``colN`` columns Description, unless a column has a like name."""
    value = strip(F.col("value"))
    filled = cells.filter(value != "").groupBy(*table, "raw_header").agg(F.avg(value.rlike("[A-Za-z]").cast("double")).alias("texty"), F.avg(F.length(value)).alias("size"), F.min("col_pos").alias("pos"))
    named = cells.filter(F.exists(F.array(*map(F.lit, fixed.NAME_LIKE)), lambda k: F.contains(F.lower("raw_header"), k))).select(*table).distinct()
    fit = filled.filter(F.col("raw_header").rlike(r"^col\d+$") & (F.col("texty") >= 0.6) & (F.col("size") >= 4)).join(named, table, "left_anti")
    best = fit.groupBy(*table).agg(F.max(F.struct((F.col("texty") * F.col("size")).alias("m"), (-F.col("pos")).alias("p"), "raw_header")).alias("b")).select(*table, F.col("b.raw_header").alias("chosen"))
    joined = cells.join(best, table, "left")
    return joined.withColumn("raw_header", F.when(F.col("raw_header") == F.col("chosen"), "Description").otherwise(F.col("raw_header"))).drop("chosen")
