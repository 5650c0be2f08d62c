"""The queries over the test tables, one per operator, and the same in DuckDB's SQL.

The tables hold no manuals, so each query derives its input from them; the deriving expressions are
strings that both engines read alike. Names of columns and orders match between both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import text as t
from tabulon.functions.similarity import similarity_udf
from tabulon.operators import context, headers, language, layout, ocr_tables, qc, transform
from tabulon.plans import documents as plan
from tabulon.sources import fixed_values as fixed
from tabulon.sources.config import Config, phrase_table
from tabulon.sources.pages import in_ranges, output_name, parse_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CONFIG = Config()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_list(xs: list[str]) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


# Expressions that both engines read, over part.
NAME = """CASE p_partkey % 8 WHEN 0 THEN concat(p_name, ' EPDM') WHEN 1 THEN concat(upper(p_name), ' of the steel') WHEN 2 THEN concat('dia ', p_name, ' 30mm*')
 WHEN 3 THEN concat(p_name, ' length 250 mm & more') WHEN 4 THEN concat('the ', p_name, ' for pump') WHEN 5 THEN concat(p_name, ' M', cast(p_size AS varchar(9)), ' with seal') WHEN 6 THEN concat(p_name, ' 3 inch x 50 mm') ELSE p_name END"""
CELL = "CASE p_partkey % 7 WHEN 0 THEN 'nan' WHEN 1 THEN ' None ' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'NaT' ELSE p_name END"
KEY = "CASE WHEN p_partkey % 4 = 1 OR p_partkey % 11 = 0 THEN '' ELSE cast(p_partkey % 1000 AS varchar(9)) END"
NUMBER = "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('P-', cast(p_partkey AS varchar(19))) END"
MATERIAL = "CASE p_partkey % 6 WHEN 0 THEN 'Stainless Steel' WHEN 1 THEN 'copper' WHEN 2 THEN '' WHEN 3 THEN 'Circuit' WHEN 4 THEN 'SUS316L plate' ELSE 'none' END"
SIZE = "CASE p_partkey % 3 WHEN 0 THEN concat(cast(p_size AS varchar(9)), ' mm') WHEN 1 THEN '' ELSE concat('dia ', cast(p_size AS varchar(9)), 'cm') END"

# The cell functions in DuckDB's SQL.
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
CLEAN = lambda x: f"CASE WHEN lower({STRIP(f'coalesce({x}, {q(str())})')}) IN ('nan', 'none', 'nat', '') THEN '' ELSE {x} END"
TITLE = lambda x: f"array_to_string(list_transform(list_filter(string_split_regex({STRIP('trim(' + STRIP(x) + ', ' + q('*') + ')')}, '\\s+'), lambda w: w <> ''), lambda w, i: CASE WHEN regexp_matches(w, '[0-9]') THEN w WHEN list_contains({sql_list(fixed.TITLE_CASE_LOWER)}, lower(w)) AND i > 1 THEN lower(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ')"
DIM = r"""(\d+(?:[.,]\d+)?)\s*(mm|cm|meter|metre|inch|in|")([^A-Za-z0-9]|$)"""
DIM_HAS = lambda x: f"regexp_matches({x}, {q(DIM)}, 'i')"
DIM_TEXT = lambda x: f"CASE WHEN {DIM_HAS(x)} THEN CASE WHEN contains(lower({x}), 'dia') THEN 'Dia. ' ELSE 'L= ' END || regexp_extract({x}, {q(DIM)}, 1, 'i') || regexp_extract({x}, {q(DIM)}, 2, 'i') END"
DIM_LEFT = lambda x: f"CASE WHEN {DIM_HAS(x)} THEN {STRIP('regexp_replace(regexp_replace(regexp_replace(' + x + ', ' + q(DIM) + ', ' + q(chr(92) + '3') + ', ' + q('gi') + '), ' + q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's./-]') + ', ' + q(' ') + ', ' + q('g') + '), ' + q(chr(92) + 's+') + ', ' + q(' ') + ', ' + q('g') + ')')} ELSE {x} END"
FOUND = lambda x: f"list_filter({sql_list(sorted(fixed.MATERIALS, key=len, reverse=True))}, lambda m: contains(lower({x}), lower(m)))[1]"
PHRASES = "(VALUES " + ", ".join(f"({i}, {q(c)}, {q(p)})" for i, c, p in CONFIG.phrases()) + ") AS phrases(ordinal, target, phrase)"
NORM = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
KNOWN = f"(SELECT DISTINCT {NORM('phrase')} AS norm FROM {PHRASES} UNION SELECT DISTINCT {NORM('target')} FROM {PHRASES})"
HEADERS = ["Item No.", "Item Designation", "Title", "TYPE", "Ref. No.", "Mystery Col", "P/N", "q'ty", "part  name", "描述", "__ref_page__", "col_3", "1234-5678", "s"]
HEADER_CASE = "CASE p_partkey % 20 " + " ".join(f"WHEN {i} THEN {q(h)}" for i, h in enumerate(HEADERS)) + " WHEN 17 THEN p_brand WHEN 18 THEN p_name ELSE p_type END"
HEADER_ROWS = f"(SELECT DISTINCT {HEADER_CASE} AS raw_header FROM part) AS h"
TYPOS = ["Descripton", "Drawing   No.", "Types", "Manufacturor", "Zxqv Nonsense 999", "No. Part", "Quantitty", "Referense No."]
TYPO_CASE = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN {q(h)}" for i, h in enumerate(TYPOS)) + " WHEN 9 THEN p_brand WHEN 10 THEN p_name ELSE p_type END"


@query(f"SELECT p_partkey, {NORM('p_type')} AS norm_type, {NORM('p_brand')} AS norm_brand FROM part")
def norm_header(spark, d):
    return read(spark, d, "part").select("p_partkey", t.norm_header(F.col("p_type")).alias("norm_type"), t.norm_header(F.col("p_brand")).alias("norm_brand"))


@query(f"""WITH i AS (SELECT {NORM('phrase')} AS norm, arg_max(target, ordinal) AS target FROM {PHRASES} GROUP BY 1)
SELECT raw_header, target, CASE WHEN target IS NOT NULL THEN 'exact' END AS method, CASE WHEN target IS NOT NULL THEN 100.0::DOUBLE END AS score
FROM {HEADER_ROWS} LEFT JOIN i ON norm = {NORM('raw_header')} WHERE raw_header NOT LIKE '\\_\\_%' ESCAPE '\\'""")
def map_exact(spark, d):
    return headers.map_exact(read(spark, d, "part").select(F.expr(HEADER_CASE.replace("''", "\\'")).alias("raw_header")), phrase_table(spark, CONFIG))


@query()
def map_fuzzy(spark, d):
    """Headers with typing errors, and names and types of parts; a threshold and ties by the first phrase."""
    return headers.map_fuzzy(read(spark, d, "part").select(F.expr(TYPO_CASE).alias("raw_header")).distinct(), phrase_table(spark, CONFIG), CONFIG.fuzzy_threshold)


@query()
def header_map(spark, d):
    """Both tiers over headers made of part types."""
    made = read(spark, d, "part").selectExpr("CASE p_partkey % 5 WHEN 0 THEN 'Item No.' WHEN 1 THEN 'Descripton' WHEN 2 THEN p_type WHEN 3 THEN 'Part No' ELSE p_brand END AS raw_header")
    return headers.header_map(made.distinct(), CONFIG)


@query()
def token_sort_similarity(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", F.round(similarity_udf()(F.col("p_name"), F.col("p_type")), 6).alias("score"))


@query(f"SELECT raw_header, {NORM('raw_header')} IN (SELECT norm FROM {KNOWN} WHERE norm <> '') AS known FROM {HEADER_ROWS}")
def known_headers(spark, d):
    """Whether a header of the table is a known one."""
    made = read(spark, d, "part").select(F.expr(HEADER_CASE.replace("''", "\\'")).alias("raw_header")).distinct()
    known = headers.known_headers(spark, CONFIG).withColumn("known", F.lit(True))
    return made.withColumn("norm", t.norm_header(F.col("raw_header"))).join(known, "norm", "left").select("raw_header", F.coalesce("known", F.lit(False)).alias("known"))


TABLES = "SELECT cast(p_size % 10 AS bigint) AS table_no, cast(p_partkey AS bigint) AS row_no, {} AS col_pos, {} AS raw_header, {} AS value FROM part"
TABLE_CELLS = " UNION ALL ".join(TABLES.format(i, h, v) for i, (h, v) in enumerate([("CASE WHEN p_size % 10 < 5 THEN 'Item No.' ELSE 'col_0' END", KEY), ("CASE WHEN p_size % 10 < 7 THEN 'Part Names' ELSE '12-345' END", "p_name"), ("CASE WHEN p_size % 10 < 3 THEN 's' ELSE 'zz' END", NUMBER)]))
POINTS = f"""CASE WHEN n = '' THEN -2.0 WHEN regexp_matches(lower(trim(raw_header)), {q(fixed.GARBAGE_HEADER_PATTERN)}) THEN -8.0 WHEN list_contains(known, n) THEN 12.0 WHEN length(n) <= 1 THEN -3.0
 WHEN len(list_filter(known, lambda k: length(k) > 2 AND (contains(k, n) OR contains(n, k)))) > 0 THEN 4.0 ELSE 0.5 END"""


@query(f"""WITH cells AS ({TABLE_CELLS}), k AS (SELECT list(norm) AS known FROM {KNOWN} WHERE norm <> ''),
c AS (SELECT table_no, col_pos, raw_header, {NORM('raw_header')} AS n, count(*) AS rows, count(*) FILTER (WHERE trim(value) <> '') AS filled FROM cells GROUP BY ALL),
p AS (SELECT *, {POINTS} AS points FROM c, k)
SELECT table_no, round((sum(points) + 3.0 * sum(filled) / sum(rows) - CASE WHEN count(*) = 1 AND max(rows) < 2 THEN 5 ELSE 0 END)::DOUBLE, 6) AS score FROM p GROUP BY table_no""")
def header_score(spark, d):
    cells = _sql(spark, d, TABLE_CELLS, "part")
    return headers.score_tables(cells, ["table_no"], headers.known_headers(spark, CONFIG)).select("table_no", F.round("score", 6).alias("score"))


def _sql(spark: SparkSession, d: str, sql: str, *names: str) -> DataFrame:
    """Shared SQL over tables, by name, without leaving views behind."""
    return spark.sql(_named(sql, names), **{n: read(spark, d, n) for n in names})


def _named(sql: str, names: tuple[str, ...]) -> str:
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return sql


@query(f"SELECT p_partkey, {CLEAN('c')} AS value FROM (SELECT p_partkey, {CELL} AS c FROM part)".replace("ELSE c END", "ELSE coalesce(c, '') END"))
def clean_nulls(spark, d):
    return read(spark, d, "part").select("p_partkey", t.clean(F.expr(CELL)).alias("value"))


BUNDLES = "[{a}, {b}, {c}]".format(a="' ' || p_brand || ' '", b="CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_type END", c="CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' ELSE 'x' END")


@query(f"""WITH b AS (SELECT p_partkey, list_transform({BUNDLES}, lambda v: trim(v)) AS v FROM part)
SELECT p_partkey, list_reduce(v, lambda acc, x: CASE WHEN x = '' OR lower(acc) = lower(x) THEN acc WHEN acc = '' THEN x ELSE acc || '; ' || x END) AS text FROM b""")
def bundle_text(spark, d):
    values = F.array(F.expr("' ' || p_brand || ' '"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_type END"), F.expr("CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' ELSE 'x' END"))
    return read(spark, d, "part").select("p_partkey", t.bundle(values).alias("text"))


@query(f"SELECT p_partkey, {TITLE('name')} AS part_name FROM (SELECT p_partkey, {NAME} AS name FROM part)")
def title_case(spark, d):
    return read(spark, d, "part").select("p_partkey", t.title_case(F.expr(NAME)).alias("part_name"))


@query(f"SELECT p_partkey, {DIM_LEFT('name')} AS left_text, {DIM_TEXT('name')} AS dimension FROM (SELECT p_partkey, {NAME} AS name FROM part)")
def extract_dimensions(spark, d):
    left, dim = t.dimension(F.col("name"))
    return read(spark, d, "part").selectExpr("p_partkey", f"{NAME} AS name").select("p_partkey", left.alias("left_text"), dim.alias("dimension"))


TAG = """CASE WHEN m IS NULL OR length(m) > {n} OR contains(part_name, 'Matl. ' || m) THEN part_name ELSE trim(part_name || ' Matl. ' || m) END AS part_name,
 CASE WHEN length(m) > {n} THEN m ELSE '' END AS internal_remark"""


@query(f"SELECT p_partkey, {TAG.format(n=8)} FROM (SELECT *, {FOUND('part_name || chr(32) || text')} AS m FROM (SELECT p_partkey, {NAME} AS part_name, {MATERIAL} AS text FROM part))")
def material_tag(spark, d):
    parts = read(spark, d, "part").selectExpr("p_partkey", f"{NAME} AS part_name", f"{MATERIAL} AS text", "'' AS internal_remark")
    return transform.tag_materials(parts, Config(max_material_length=8)).select("p_partkey", "part_name", "internal_remark")


STITCH = """k AS (SELECT *, CASE WHEN trim(drawing_pos_no) <> '' THEN 'K' WHEN trim(part_name) <> '' THEN 'N' ELSE 'E' END AS kind FROM rows),
j AS (SELECT *, kind = 'N' AND coalesce(last_value(CASE WHEN kind <> 'N' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'K', false) AS joins FROM k),
i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_no, row_no) AS island FROM j),
n AS (SELECT doc_id, island, CASE WHEN count(*) = 1 THEN any_value(part_name) ELSE trim(string_agg(trim(part_name), ' ' ORDER BY page_no, row_no)) END AS whole FROM i GROUP BY ALL)"""
STITCH_ROWS = f"SELECT p_brand AS doc_id, cast(1 + p_partkey % 3 AS int) AS page_no, p_partkey AS row_no, {KEY} AS drawing_pos_no, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END AS part_name FROM part"


@query(f"WITH rows AS ({STITCH_ROWS}), {STITCH} SELECT doc_id, page_no, row_no, drawing_pos_no, whole AS part_name FROM i JOIN n USING (doc_id, island) WHERE NOT joins")
def stitch_rows(spark, d):
    return transform.stitch(_sql(spark, d, STITCH_ROWS, "part"))


NOISE_NAME = "CASE p_partkey % 6 WHEN 0 THEN '(2)' WHEN 1 THEN ' 12 ' WHEN 2 THEN '' WHEN 3 THEN '- 7 -' ELSE p_name END"
NOISE_TEXT = "CASE p_partkey % 4 WHEN 0 THEN 'abc' WHEN 1 THEN 'steel' ELSE '' END"
NOISE_NUMBER = "CASE WHEN p_partkey % 3 = 0 THEN 'X-9' ELSE '' END"
NOISE = f"""trim(part_name || spare_part_no || text) = '' OR CASE WHEN trim(part_name) = '' AND trim(spare_part_no) = '' THEN length(trim(text)) <= 3
 ELSE trim(spare_part_no) = '' AND regexp_matches(trim(part_name), {q(fixed.NOISE_PATTERN)}) END"""


@query(f"SELECT * FROM (SELECT p_partkey, {NOISE_NAME} AS part_name, {NOISE_NUMBER} AS spare_part_no, {NOISE_TEXT} AS text FROM part) WHERE NOT ({NOISE})")
def noise_drop(spark, d):
    rows = read(spark, d, "part").selectExpr("p_partkey", f"{NOISE_NAME} AS part_name", f"{NOISE_NUMBER} AS spare_part_no", f"{NOISE_TEXT} AS text")
    return rows.filter(~transform.is_noise(Config(target_schema=["Part Name", "Spare Part No", "Text"])))


SNAKE = list(transform.columns(CONFIG).values())


@query("SELECT p_partkey, " + ", ".join({"part_name": "p_name AS part_name", "type": "p_type AS type", "quantity": "p_size::VARCHAR AS quantity"}.get(c, f"'' AS {c}") for c in SNAKE) + " FROM part")
def pad_schema(spark, d):
    rows = read(spark, d, "part").selectExpr("p_partkey", "concat(p_name, char(7)) AS part_name", "p_type AS type", "p_size AS quantity")
    return transform.pad_and_order(rows, CONFIG, ["p_partkey"])


QC_ROWS = f"SELECT p_brand AS doc_id, p_partkey AS row_no, {NUMBER} AS spare_part_no, {KEY} AS drawing_pos_no FROM part"


@query(f"SELECT * FROM ({QC_ROWS}) WHERE trim(spare_part_no) = '' OR trim(drawing_pos_no) = ''")
def qc_failed(spark, d):
    return qc.qc_failed(_sql(spark, d, QC_ROWS, "part"))


@query(f"SELECT doc_id, count(*) AS n_rows, count(*) FILTER (WHERE trim(spare_part_no) = '' OR trim(drawing_pos_no) = '') AS n_failed FROM ({QC_ROWS}) GROUP BY doc_id")
def qc_summary(spark, d):
    return qc.qc_summary(_sql(spark, d, QC_ROWS, "part"), ["doc_id"])


PAGES = "SELECT source AS doc_id, cast(doc_id AS int) AS page_no, text FROM documents"


@query(f"SELECT doc_id, page_no FROM ({PAGES}) WHERE length({STRIP('text')}) < 20")
def scanned_pages(spark, d):
    return _sql(spark, d, PAGES, "documents").filter(context.is_scanned_page(F.col("text"))).select("doc_id", "page_no")


@query(f"SELECT doc_id, count(*) FILTER (WHERE s) AS scanned, count(*) AS total, count(*) FILTER (WHERE s) >= greatest(1.0, count(*) * 0.6) AS is_scanned FROM (SELECT doc_id, length({STRIP('text')}) < 20 AS s FROM ({PAGES})) GROUP BY doc_id")
def is_scanned(spark, d):
    return context.scanned_documents(_sql(spark, d, PAGES, "documents"), CONFIG)


MARKED = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(text, ' Service Interval ', lang) WHEN 1 THEN concat('Table of Contents', text) ELSE text END AS text FROM documents"


@query(f"SELECT doc_id, len(list_filter({sql_list(fixed.SKIP_MARKERS)}, lambda m: contains(lower(text), m))) > 0 AS skipped FROM ({MARKED})")
def skip_pages(spark, d):
    return _sql(spark, d, MARKED, "documents").select("doc_id", context.is_skipped_page(F.col("text")).alias("skipped"))


LINES = "SELECT doc_id, 1 AS page_no, cast(n AS int) AS line_no, CASE WHEN (doc_id + n) % 7 = 3 THEN concat(line, ' Co., Ltd') ELSE line END AS text"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    split = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return split.selectExpr(*LINES.removeprefix("SELECT ").split(", ", 3)[:3], LINES.split(", ", 3)[3])


SQL_LINES = f"{LINES} FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
HAS = lambda x, words: f"len(list_filter({sql_list(words)}, lambda k: contains({x}, k))) > 0"
IS_TITLE = f"length(lower({STRIP('text')})) >= 3 AND NOT regexp_matches(text, '^[\\d\\s\\-./()]+$') AND NOT regexp_matches(text, {q(fixed.DATE_LINE_PATTERN)}, 'i') AND NOT {HAS('lower(text)', fixed.TITLE_STOPWORDS)} AND NOT {HAS('lower(text)', fixed.MAKER_HINTS)} AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 3".replace("{{", "{").replace("}}", "}")


@query(f"SELECT doc_id, page_no, arg_min({STRIP('text')}, line_no) AS manufacturer FROM ({SQL_LINES}) WHERE {HAS('lower(text)', fixed.MAKER_HINTS)} GROUP BY ALL")
def first_maker(spark, d):
    return context.first_maker(_lines(spark, d))


@query(f"SELECT doc_id, line_no, {IS_TITLE} AS title FROM ({SQL_LINES})")
def title_candidates(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", context.is_title(F.col("text")).alias("title"))


CAPTIONS = "SELECT cast(o_custkey AS string) AS doc_id, 1 AS page_no, cast(o_orderkey AS int) AS line_no, CASE o_orderkey % 5 WHEN 0 THEN 'Plate' WHEN 1 THEN concat('Cover ', o_orderpriority) WHEN 2 THEN '0570-0100-0002' WHEN 3 THEN concat('1072-', cast(1000 + o_orderkey % 999 AS string), '-0002') ELSE '12' END AS text FROM orders"


@query(f"""WITH l AS ({CAPTIONS.replace('AS string', 'AS varchar')}),
m AS (SELECT *, regexp_extract(text, '\\b\\d{{3,4}}-\\d{{3,4}}-\\d{{2,4}}\\b', 0) AS plate, CASE WHEN {IS_TITLE} THEN trim(text) END AS tt, lower(trim(text)) IN ('plate', 'drawing', 'title', 'group') AS loc FROM l),
a AS (SELECT *, lag(tt, 1) OVER w AS t1, lag(tt, 2) OVER w AS t2, coalesce(lag(loc, 1) OVER w, false) AS l1, coalesce(lag(loc, 2) OVER w, false) AS l2, coalesce(lag(loc, 3) OVER w, false) AS l3 FROM m WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
c AS (SELECT *, CASE WHEN l1 THEN NULL WHEN l2 THEN t1 WHEN l3 THEN coalesce(t1, t2) END AS title FROM a WHERE plate <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY title IS NULL, line_no) AS k FROM c)
SELECT doc_id, page_no, plate AS drawing_no, coalesce(title, '') AS spare_group FROM r WHERE k = 1""")
def plate_captions(spark, d):
    return context.plate_captions(_sql(spark, d, CAPTIONS, "orders"), CONFIG)


PLATES = "SELECT o_orderstatus AS doc_id, o_orderkey AS page_no, concat('P', o_custkey) AS drawing_no, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS spare_group FROM orders"


@query(f"""WITH p AS ({PLATES}), l AS (SELECT doc_id, drawing_no, arg_min(spare_group, page_no) AS learnt FROM p WHERE spare_group <> '' GROUP BY ALL)
SELECT doc_id, page_no, drawing_no, coalesce(learnt, spare_group) AS spare_group FROM p LEFT JOIN l USING (doc_id, drawing_no)""")
def plate_propagation(spark, d):
    return context.propagate_titles(_sql(spark, d, PLATES, "orders"))


POINTS_SQL = "SELECT l_orderkey, l_suppkey, l_partkey * 10 + l_linenumber AS pt, l_quantity AS y FROM lineitem"


@query(f"""WITH p AS (SELECT l_orderkey, pt, y, row_number() OVER (PARTITION BY l_orderkey ORDER BY y, pt) AS i FROM ({POINTS_SQL})),
j AS (SELECT *, CASE WHEN y - lag(y) OVER w > 6 THEN 1 ELSE 0 END AS jump FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY y, pt))
SELECT l_orderkey, pt, (sum(jump) OVER (PARTITION BY l_orderkey ORDER BY y, pt))::BIGINT AS cluster FROM j""")
def row_cluster_gap(spark, d):
    points = _sql(spark, d, POINTS_SQL, "lineitem").select("l_orderkey", "pt", "y")
    return layout.gap_clusters(points, ["l_orderkey"], "y", "pt", 6.0).select("l_orderkey", "pt", "cluster")


@query(f"""WITH j AS (SELECT *, CASE WHEN y - lag(y) OVER w > 8 THEN 1 ELSE 0 END AS jump FROM ({POINTS_SQL}) WINDOW w AS (PARTITION BY l_orderkey ORDER BY y, pt)),
c AS (SELECT *, (sum(jump) OVER (PARTITION BY l_orderkey ORDER BY y, pt))::BIGINT AS cluster FROM j)
SELECT l_orderkey, cluster, round(avg(y), 6) AS centre, count(*) AS n FROM c GROUP BY ALL""")
def column_cluster(spark, d):
    clustered = layout.gap_clusters(_sql(spark, d, POINTS_SQL, "lineitem"), ["l_orderkey"], "y", "pt", 8.0)
    return layout.cluster_centres(clustered, ["l_orderkey"], "y").withColumn("centre", F.round("centre", 6))


@query(f"""WITH RECURSIVE p AS (SELECT l_orderkey, pt, y, row_number() OVER (PARTITION BY l_orderkey ORDER BY y, pt) AS i FROM ({POINTS_SQL})),
r AS (SELECT l_orderkey, pt, y, i, 0 AS cluster, y AS s, 1 AS n FROM p WHERE i = 1
 UNION ALL SELECT p.l_orderkey, p.pt, p.y, p.i, CASE WHEN abs(p.y - s / n) <= 5 THEN cluster ELSE cluster + 1 END, CASE WHEN abs(p.y - s / n) <= 5 THEN s + p.y ELSE p.y END, CASE WHEN abs(p.y - s / n) <= 5 THEN n + 1 ELSE 1 END
 FROM r JOIN p ON p.l_orderkey = r.l_orderkey AND p.i = r.i + 1)
SELECT l_orderkey, pt, cluster FROM r""")
def row_cluster_mean(spark, d):
    points = _sql(spark, d, POINTS_SQL, "lineitem").select("l_orderkey", "pt", "y")
    return layout.cluster_rows(points, ["l_orderkey"], "y", "pt", F.lit(5.0)).select("l_orderkey", "pt", "cluster")


PRICES_SQL = "SELECT l_linenumber % 2 AS page, concat(cast(l_orderkey AS varchar(19)), '-', cast(l_linenumber AS varchar(9)), '-', cast(l_partkey AS varchar(19))) AS pt, cast(l_extendedprice AS double) AS y FROM lineitem"


@query(f"""WITH RECURSIVE p AS (SELECT page, pt, y, row_number() OVER w AS i, CASE WHEN y - lag(y) OVER w <= 0.5 THEN 0 ELSE 1 END AS jump FROM ({PRICES_SQL}) WINDOW w AS (PARTITION BY page ORDER BY y, pt)),
s AS (SELECT *, sum(jump) OVER (PARTITION BY page ORDER BY i) AS seg FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY page, seg ORDER BY i) AS k FROM s),
r AS (SELECT page, pt, y, i, seg, k, y AS sums, 1 AS n, 1 AS begins FROM t WHERE k = 1
 UNION ALL SELECT t.page, t.pt, t.y, t.i, t.seg, t.k, CASE WHEN abs(t.y - sums / n) <= 0.5 THEN sums + t.y ELSE t.y END, CASE WHEN abs(t.y - sums / n) <= 0.5 THEN n + 1 ELSE 1 END, CASE WHEN abs(t.y - sums / n) <= 0.5 THEN 0 ELSE 1 END
 FROM r JOIN t ON t.page = r.page AND t.seg = r.seg AND t.k = r.k + 1)
SELECT page, pt, (sum(begins) OVER (PARTITION BY page ORDER BY i) - 1)::BIGINT AS cluster FROM r""")
def row_cluster_spread(spark, d):
    """Rows by running means where two groups hold all points."""
    points = _sql(spark, d, PRICES_SQL, "lineitem")
    return layout.cluster_rows_spread(points, ["page"], "y", "pt", 0.5).select("page", "pt", F.col("cluster").cast("long").alias("cluster"))


@query(f"SELECT l_orderkey, pt, (list_position(ds, list_min(ds)) - 1)::INTEGER AS nearest FROM (SELECT l_orderkey, pt, list_transform([5.0, 15.0, 25.0, 40.0], lambda c: abs(c - y)) AS ds FROM ({POINTS_SQL}))")
def nearest_column(spark, d):
    points = _sql(spark, d, POINTS_SQL, "lineitem")
    return layout.nearest(points, ["l_orderkey"], "y", F.array(*map(F.lit, [5.0, 15.0, 25.0, 40.0]))).select("l_orderkey", "pt", "nearest")


@query("""WITH e AS (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER w > 20 THEN 1 ELSE 0 END AS jump FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
s AS (SELECT *, sum(jump) OVER (PARTITION BY user_id ORDER BY value, event_id) AS a FROM e) SELECT user_id, event_id FROM s WHERE a = 0""")
def gap_stop(spark, d):
    return layout.before_gap(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 20.0).select("user_id", "event_id")


TABLES_SQL = "SELECT user_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS table_no, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END AS value FROM events"


@query(f"SELECT user_id, table_no, filled FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY filled DESC, table_no) AS k FROM (SELECT user_id, table_no, count(*) FILTER (WHERE trim(value) <> '') AS filled FROM ({TABLES_SQL}) GROUP BY ALL)) WHERE k = 1 AND filled > 0")
def best_table(spark, d):
    return headers.best_table(_sql(spark, d, TABLES_SQL, "events"), ["user_id"])


@query("""WITH n AS (SELECT conv_id, turn::INTEGER AS col_pos, CASE WHEN turn % 3 = 2 THEN 'col_' || turn ELSE role END AS name FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, name ORDER BY col_pos) - 1 AS nth FROM n)
SELECT conv_id, col_pos, CASE WHEN nth > 0 THEN name || '_' || nth ELSE name END AS raw_header FROM k""")
def dedupe_headers(spark, d):
    rows = read(spark, d, "conversations").selectExpr("conv_id", "cast(turn AS int) AS col_pos", "CASE WHEN turn % 3 = 2 THEN ' ' ELSE role END AS name")
    return headers.unique_headers(rows, ["conv_id"])


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_nationkey AS nation, s_acctbal AS balance FROM supplier")
def union_by_name(spark, d):
    a = read(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment", "c_nationkey AS nation")
    b = read(spark, d, "supplier").selectExpr("cast(s_suppkey AS bigint) AS id", "s_nationkey AS nation", "s_acctbal AS balance")
    return a.unionByName(b, allowMissingColumns=True)


@query("""WITH s AS (SELECT o_orderkey, 1 + o_orderkey % 7 AS n FROM orders), g AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, s.n AS seen, coalesce(g.n, 0) AS got FROM s LEFT JOIN g USING (o_orderkey) WHERE s.n > coalesce(g.n, 0)""")
def reconcile(spark, d):
    seen = read(spark, d, "orders").selectExpr("o_orderkey", "1 + o_orderkey % 7 AS n")
    got = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return qc.reconcile(seen, got, ["o_orderkey"])


@query("""WITH s AS (SELECT o_orderkey, 1 + o_orderkey % 7 AS n FROM orders), g AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
l AS (SELECT o_orderkey, s.n AS seen, coalesce(g.n, 0) AS got FROM s LEFT JOIN g USING (o_orderkey) WHERE s.n > coalesce(g.n, 0)),
f AS (SELECT * FROM l ORDER BY o_orderkey LIMIT 5)
SELECT (SELECT string_agg('p' || o_orderkey || ' (saw ' || seen || ', got ' || got || ')', ', ' ORDER BY o_orderkey) FROM f) AS examples, (SELECT count(*) FROM l) AS pages, greatest((SELECT count(*) FROM l) - 5, 0) AS more""")
def reconcile_message(spark, d):
    return qc.reconcile_message(reconcile(spark, d), ["o_orderkey"], "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 1 AND 50 OR o_orderkey = 120 OR o_orderkey >= 1000")
def page_select(spark, d):
    return read(spark, d, "orders").filter(in_ranges(F.col("o_orderkey"), parse_pages("50-1, 120 1000-"))).select("o_orderkey")


CELLS = " UNION ALL ".join(
    f"SELECT p_brand AS doc_id, cast(1 + p_partkey % 3 AS int) AS page_no, cast(p_partkey AS int) AS row_no, {i} AS col_pos, {q(h)} AS raw_header, {v} AS value FROM part"
    for i, (h, v) in enumerate([("Item No.", KEY), ("Item Designation", NAME), ("Material", MATERIAL), ("Size", SIZE), ("Part No.", NUMBER), ("Maker", "CASE WHEN p_partkey % 2 = 0 THEN 'nan' ELSE p_brand END"), ("Mystery", "CASE WHEN p_partkey % 10 = 0 THEN p_type ELSE ' ' END")])
)


@query(f"SELECT doc_id, page_no, row_no, raw_header, value FROM ({CELLS}) WHERE raw_header = 'Mystery' AND trim(value) <> ''")
def unmapped_rows(spark, d):
    cells = _sql(spark, d, CELLS, "part")
    return transform.unmapped_cells(cells, headers.map_exact(cells, phrase_table(spark, CONFIG)))


SEEN = "SELECT p_brand AS doc_id, cast(1 + p_partkey % 9 AS int) AS page_no, cast(p_partkey AS int) AS row_no, cast({} AS int) AS col_pos, {} AS raw_header, {} AS value FROM part"
SEEN_CELLS = " UNION ALL ".join(SEEN.format(c, h, v) for c, h, v in [("p_size % 3", "CASE WHEN p_partkey % 9 > 2 THEN 'Weight' ELSE 'No.' END", "p_name"), ("3 + p_size % 2", "concat('Z', cast(p_size % 7 AS varchar(9)))", CELL), ("4", "CASE WHEN length(p_name) % 2 = 0 THEN 'Part No.' ELSE 'Alpha' END", "p_type"), ("9", "'Blank'", "' '")])


@query(f"""WITH c AS ({SEEN_CELLS}), f AS (SELECT doc_id, raw_header, min((page_no, col_pos)) AS seen FROM c GROUP BY ALL)
SELECT doc_id, raw_header, (row_number() OVER (PARTITION BY doc_id ORDER BY seen, raw_header) - 1)::INTEGER AS place FROM f""")
def first_seen_columns(spark, d):
    """The columns of the union of each document's pages."""
    return transform.first_seen(_sql(spark, d, SEEN_CELLS, "part"), ["doc_id"])


@query(f"""WITH i AS (SELECT DISTINCT {NORM('phrase')} AS norm FROM {PHRASES}), c AS ({SEEN_CELLS}),
r AS (SELECT *, {CLEAN('value')} AS v FROM c WHERE {NORM('raw_header')} NOT IN (SELECT norm FROM i)),
f AS (SELECT doc_id, raw_header, min((page_no, col_pos)) AS seen, bool_or({STRIP('v')} <> '') AS filled FROM r GROUP BY ALL),
g AS (SELECT *, bool_or(filled) OVER (PARTITION BY doc_id) AS shown FROM f)
SELECT doc_id, raw_header, (row_number() OVER (PARTITION BY doc_id ORDER BY seen, raw_header) - 1)::INTEGER AS place FROM g WHERE shown""")
def review_columns(spark, d):
    """The columns of each document's review sheet: those without a target, in the order they are first seen."""
    cells = _sql(spark, d, SEEN_CELLS, "part")
    return transform.review_columns(cells, headers.map_exact(cells, phrase_table(spark, CONFIG)))


RESCUE = " UNION ALL ".join(f"SELECT p_brand AS doc_id, p_partkey AS row_no, {i} AS col_pos, {h} AS raw_header, {v} AS value FROM part" for i, (h, v) in enumerate([("'No.'", KEY), ("'col1'", "p_type"), ("CASE WHEN length(p_brand) % 2 = 0 THEN 'Title Name' ELSE 'col2' END", "p_name")]))


@query(f"""WITH c AS ({RESCUE}), f AS (SELECT doc_id, raw_header, avg(CASE WHEN regexp_matches(value, '[A-Za-z]') THEN 1.0 ELSE 0.0 END) AS texty, avg(length(trim(value))) AS size, min(col_pos) AS pos FROM c WHERE trim(value) <> '' GROUP BY ALL),
g AS (SELECT * FROM f WHERE regexp_full_match(raw_header, 'col\\d+') AND texty >= 0.6 AND size >= 4 AND doc_id NOT IN (SELECT doc_id FROM c WHERE contains(lower(raw_header), 'name'))),
b AS (SELECT doc_id, raw_header AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY texty * size DESC, pos) AS k FROM g) WHERE k = 1)
SELECT doc_id, row_no, col_pos, CASE WHEN raw_header = chosen THEN 'Description' ELSE raw_header END AS raw_header, value FROM c LEFT JOIN b USING (doc_id)""")
def describe_rescue(spark, d):
    return headers.describe_rescue(_sql(spark, d, RESCUE, "part"), ["doc_id"])


@query("SELECT l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_orderkey")
def upper_median(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(layout.upper_median(F.collect_list("l_quantity")).alias("upper_median"))


@query("SELECT event_id, format('[{}] | [Status: {}] | [{}] | [Rows Processed: {}]', strftime(ts, '%Y-%m-%d %H:%M:%S'), upper(event_type), 'book ' || user_id || '.pdf', event_id % 100) AS line FROM events")
def run_log(spark, d):
    line = qc.log_line(F.col("ts"), F.upper("event_type"), F.concat(F.lit("/in/a\\b/book "), F.col("user_id"), F.lit(".pdf")), F.col("event_id") % 100)
    return read(spark, d, "events").select("event_id", line.alias("line"))


@query("SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'a.b' ELSE 'c' END || '_PROCESSED.xlsx' AS name, count(*) AS n FROM events GROUP BY ALL")
def output_names(spark, d):
    path = F.expr("CASE WHEN event_id % 2 = 0 THEN '/x.y/a.b.pdf' ELSE 'dir/c' END")
    return read(spark, d, "events").groupBy("user_id", output_name(path).alias("name")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 'critical' ELSE 'page' END AS kind, count(*) AS n FROM events GROUP BY 1")
def error_groups(spark, d):
    return qc.error_groups(read(spark, d, "events").selectExpr("CASE WHEN event_id % 4 = 0 THEN 'Cannot open' ELSE concat('page ', event_id, ': x') END AS message"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %02dm', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS took FROM (SELECT event_id, event_id * 37 % 9000 AS s FROM events)")
def duration_text(spark, d):
    return read(spark, d, "events").select("event_id", t.duration(F.expr("event_id * 37 % 9000")).alias("took"))


@query("""WITH b AS (SELECT l_orderkey AS doc_id, l_partkey * 10 + l_linenumber AS pt, l_quantity * 2 AS y, 100.0 AS h FROM lineitem)
SELECT doc_id, pt, CASE WHEN y < 0.18 * h THEN 'top' ELSE 'bottom' END AS band FROM b WHERE y < 0.18 * h OR y > 0.82 * h""")
def page_bands(spark, d):
    lines = read(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_partkey * 10 + l_linenumber AS pt", "l_quantity * 2 AS y", "100.0D AS page_h")
    return context.bands(lines).select("doc_id", "pt", "band")


WORDS = """SELECT cast(l_orderkey AS string) AS doc_id, 1 AS page_no, k.x0 + (l_suppkey % 2) * k.j AS x0, k.x0 + 20.0D AS x1, l_linenumber * 20.0D AS y0, l_linenumber * 20.0D + 10 AS y1,
 CASE k.i WHEN 0 THEN CASE WHEN l_partkey % 4 = 0 THEN 'and' ELSE cast(l_linenumber AS string) END WHEN 1 THEN concat('valve', cast(l_suppkey % 9 AS string)) WHEN 2 THEN l_returnflag ELSE 'Bolts' END AS text, cast(l_linenumber * 10 + k.i AS int) AS word_no
 FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber)
 LATERAL VIEW inline(array(named_struct('i', 0, 'x0', 60.0D, 'j', 1), named_struct('i', 1, 'x0', 180.0D, 'j', 0), named_struct('i', 2, 'x0', 220.0D, 'j', 0), named_struct('i', 3, 'x0', 18.0D, 'j', 0))) k AS i, x0, j"""


def words(spark: SparkSession, d: str) -> DataFrame:
    """A page of words for each order: numbers, descriptions, some lines without a number, margins."""
    sql = WORDS.replace("k.x0", "x0").replace("k.i", "i").replace("k.j", "j")
    return _sql(spark, d, sql, "lineitem")


#: The same words in DuckDB's SQL, without blank ones.
SQL_WORDS = """SELECT * FROM (SELECT l_orderkey::VARCHAR AS doc_id, 1 AS page_no, x + (l_suppkey % 2) * j AS x0, l_linenumber * 20.0::DOUBLE AS y0, l_linenumber * 20.0::DOUBLE + 10 AS y1, (l_linenumber * 10 + i)::INTEGER AS word_no,
 trim(CASE i WHEN 0 THEN CASE WHEN l_partkey % 4 = 0 THEN 'and' ELSE l_linenumber::VARCHAR END WHEN 1 THEN 'valve' || l_suppkey % 9 WHEN 2 THEN l_returnflag ELSE 'Bolts' END) AS text
 FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL), (VALUES (0, 60.0::DOUBLE, 1), (1, 180.0, 0), (2, 220.0, 0), (3, 18.0, 0)) AS k(i, x, j)) WHERE text <> ''"""
#: Pages with four words at least, their words' centres and height, and the number column of two numbers at least.
SQL_PAGES = f"""w AS ({SQL_WORDS}), f AS (SELECT *, (y0 + y1) / 2 AS cy, regexp_matches(text, {q(fixed.ITEM_NO_PATTERN)}) AS num FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, page_no) >= 4),
g AS (SELECT doc_id, page_no, coalesce(list_sort(list(y1 - y0) FILTER (y1 > y0))[count(*) FILTER (y1 > y0) // 2 + 1], 10.0) AS h, list_sort(list(x0) FILTER (num))[count(*) FILTER (num) // 2 + 1] AS numcol FROM f GROUP BY ALL HAVING count(*) FILTER (num) >= 2)"""


@query(f"""WITH RECURSIVE {SQL_PAGES},
p AS (SELECT f.*, numcol, greatest(4.0, h * 0.6) AS tol, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY cy, word_no) AS i FROM f JOIN g USING (doc_id, page_no)),
r AS (SELECT doc_id, page_no, word_no, i, 0 AS cluster, cy AS s, 1 AS n FROM p WHERE i = 1
 UNION ALL SELECT p.doc_id, p.page_no, p.word_no, p.i, CASE WHEN abs(p.cy - s / n) <= p.tol THEN cluster ELSE cluster + 1 END, CASE WHEN abs(p.cy - s / n) <= p.tol THEN s + p.cy ELSE p.cy END, CASE WHEN abs(p.cy - s / n) <= p.tol THEN n + 1 ELSE 1 END
 FROM r JOIN p ON p.doc_id = r.doc_id AND p.page_no = r.page_no AND p.i = r.i + 1),
c AS (SELECT p.*, cluster FROM p JOIN r USING (doc_id, page_no, word_no)),
m AS (SELECT doc_id, page_no, cluster, arg_min(text, (x0, word_no)) AS number, arg_min(x0, (x0, word_no)) AS mark FROM c WHERE num AND abs(x0 - numcol) <= 30 GROUP BY ALL),
b AS (SELECT doc_id, page_no, cluster, any_value(number) AS number, string_agg(text, ' ' ORDER BY x0, word_no) FILTER (CASE WHEN mark IS NOT NULL THEN x0 > mark + 2 ELSE x0 > numcol + 2 AND NOT num END) AS words FROM c LEFT JOIN m USING (doc_id, page_no, cluster) GROUP BY ALL),
t AS (SELECT *, sum((number IS NOT NULL)::INTEGER) OVER (PARTITION BY doc_id, page_no ORDER BY cluster) AS item FROM b),
d AS (SELECT doc_id, page_no, item, any_value(number) AS number, {STRIP("string_agg(words, ' ' ORDER BY cluster) FILTER (words <> '')")} AS description FROM t WHERE item > 0 GROUP BY ALL HAVING description <> ''),
e AS (SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY doc_id, page_no) >= 2)
SELECT doc_id, page_no, item::INTEGER AS row_no, 0 AS col_pos, 'No.' AS raw_header, number AS value FROM e UNION ALL SELECT doc_id, page_no, item::INTEGER, 1, 'Description', description FROM e""")
def textblock_table(spark, d):
    return layout.textblock_cells(words(spark, d))


@query(f"""WITH {SQL_PAGES}, n AS (SELECT doc_id, page_no, cy FROM f JOIN g USING (doc_id, page_no) WHERE num AND abs(x0 - numcol) <= 30)
SELECT doc_id, page_no, sum(jump)::BIGINT AS n FROM (SELECT doc_id, page_no, coalesce((cy - lag(cy) OVER (PARTITION BY doc_id, page_no ORDER BY cy) > 6)::INTEGER, 1) AS jump FROM n) GROUP BY ALL""")
def item_anchors(spark, d):
    return layout.item_anchors(words(spark, d))


#: The header's cells stand at 38, 80 and 200, and the first one, a stop word, joins the second; a row of words is
#: a row of the table, up to a gap of five heights.
@query(f"""WITH w AS ({SQL_WORDS}),
b AS (SELECT doc_id, page_no, word_no, text, y0, x0 + 20 AS x, CASE WHEN abs(x - 38) <= abs(x - 80) THEN 0 WHEN abs(x - 80) <= abs(x - 200) THEN 1 ELSE 2 END AS k FROM w WHERE word_no % 13 <> 0),
r AS (SELECT doc_id, page_no, y0, coalesce(string_agg(text, ' ' ORDER BY k, x, word_no) FILTER (k < 2), '') AS c0, coalesce(string_agg(text, ' ' ORDER BY x, word_no) FILTER (k = 2), '') AS c1 FROM b GROUP BY ALL),
g AS (SELECT *, y0 - lag(y0, 1, 0.0) OVER (PARTITION BY doc_id, page_no ORDER BY y0) > 50 AS gap FROM r),
t AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0) - 1)::INTEGER AS row_no FROM g QUALIFY coalesce(sum(gap::INTEGER) OVER (PARTITION BY doc_id, page_no ORDER BY y0), 0) = 0)
SELECT doc_id, page_no, row_no, 0 AS col_pos, 'of No.' AS raw_header, c0 AS value FROM t UNION ALL SELECT doc_id, page_no, row_no, 1, 'NAME', c1 FROM t""")
def ocr_table(spark, d):
    """Boxes of a header and rows for each order, with noise."""
    box = "array(struct(x0 as x, y0 as y), struct(x0 + 40 as x, y0 as y), struct(x0 + 40 as x, y0 + 10 as y), struct(x0 as x, y0 + 10 as y)) AS box"
    body = words(spark, d).selectExpr("doc_id", "page_no", "word_no AS box_no", "800.0D AS page_w", box, "text", "IF(word_no % 13 = 0, 0.1D, 0.9D) AS score")
    pages = _sql(spark, d, "SELECT DISTINCT cast(l_orderkey AS string) AS doc_id, 1 AS page_no FROM lineitem", "lineitem")
    head = pages.selectExpr("doc_id", "page_no", "inline(array(named_struct('x0', 60.0D, 'text', 'No.'), named_struct('x0', 180.0D, 'text', 'NAME'), named_struct('x0', 18.0D, 'text', 'of')))")
    head = head.selectExpr("doc_id", "page_no", "cast(-x0 as int) AS box_no", "800.0D AS page_w", box.replace("y0 + 10", "10.0D").replace("y0 as y", "0.0D as y"), "text", "0.9D AS score")
    return ocr_tables.ocr_cells(head.unionByName(body))


ROWS_TABLE = "SELECT user_id AS doc_id, event_id AS row_no, array(CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END, CASE WHEN event_id % 7 = 0 THEN NULL ELSE cast(event_id AS string) END, event_type) AS cells FROM events"


@query("""WITH r AS (SELECT user_id AS doc_id, event_id AS row_no, [CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_id::VARCHAR END, event_type] AS c FROM events),
h AS (SELECT doc_id, arg_min(c, row_no) AS hc, min(row_no) AS top FROM r GROUP BY doc_id),
n AS (SELECT doc_id, i - 1 AS col_pos, CASE WHEN hc[i] = '' THEN 'col_' || (i - 1) ELSE hc[i] END AS name FROM h, range(1, 4) t(i)),
u AS (SELECT doc_id, col_pos, name, row_number() OVER (PARTITION BY doc_id, name ORDER BY col_pos) - 1 AS nth FROM n)
SELECT r.doc_id, r.row_no, u.col_pos::INTEGER AS col_pos, CASE WHEN nth > 0 THEN name || '_' || nth ELSE name END AS raw_header, c[col_pos + 1] AS value FROM r JOIN h USING (doc_id) JOIN u ON u.doc_id = r.doc_id WHERE r.row_no > top""")
def rows_to_cells(spark, d):
    return headers.rows_to_cells(_sql(spark, d, ROWS_TABLE, "events"), ["doc_id"])


SQL_SCORES = lambda name, cells: f"""{name}_c AS (SELECT table_no, col_pos, raw_header, {NORM('raw_header')} AS n, count(*) AS rows, count(*) FILTER (WHERE trim(value) <> '') AS filled FROM {cells} GROUP BY ALL),
{name} AS (SELECT table_no, sum(points) + 3.0 * sum(filled) / sum(rows) - CASE WHEN count(*) = 1 AND max(rows) < 2 THEN 5 ELSE 0 END AS score FROM (SELECT *, {POINTS} AS points FROM {name}_c, k) GROUP BY table_no)"""  # noqa: E731


@query(f"""WITH cells AS ({TABLE_CELLS}), other AS (SELECT * REPLACE (CASE WHEN col_pos = 2 THEN 'Part No.' ELSE raw_header END AS raw_header) FROM cells), k AS (SELECT list(norm) AS known FROM {KNOWN} WHERE norm <> ''),
{SQL_SCORES('s1', 'cells')}, weak AS (SELECT * FROM other WHERE table_no NOT IN (SELECT table_no FROM s1 WHERE score >= {CONFIG.score_confident})), {SQL_SCORES('s2', 'weak')},
late AS (SELECT table_no FROM s1 JOIN s2 USING (table_no) WHERE s2.score > s1.score)
SELECT * FROM cells WHERE table_no NOT IN (FROM late) UNION ALL SELECT * FROM weak WHERE table_no IN (FROM late)""")
def score_escalation(spark, d):
    """The cheap pass where it is confident, else the better one of both."""
    cells = _sql(spark, d, TABLE_CELLS, "part")
    other = cells.withColumn("raw_header", F.when(F.col("col_pos") == 2, "Part No.").otherwise(F.col("raw_header")))
    return headers.escalate(cells, other, ["table_no"], headers.known_headers(spark, CONFIG), CONFIG.score_confident)


CTX = "SELECT DISTINCT p_brand AS doc_id, cast(1 + p_partkey % 3 AS int) AS page_no, CASE WHEN p_partkey % 3 = 0 THEN 'ACME Co., Ltd' ELSE '' END AS manufacturer, concat('Group ', p_brand) AS spare_group, concat('10-', cast(p_partkey % 3 AS varchar(9))) AS drawing_no FROM part"
BUNDLE_TEXT = "CASE WHEN m = '' THEN s WHEN s = '' OR lower(m) = lower(s) THEN m ELSE m || '; ' || s END"
ADD = lambda cur, dim: f"CASE WHEN {dim} IS NULL OR {cur} = {dim} THEN {cur} WHEN {cur} = '' THEN {dim} ELSE {cur} || ' ' || {dim} END"
END_TO_END = f"""WITH base AS (SELECT p_brand AS doc_id, (1 + p_partkey % 3)::INTEGER AS page_no, p_partkey::INTEGER AS row_no, {KEY} AS drawing_pos_no, {NAME} AS raw, {MATERIAL} AS mat, {SIZE} AS s, {NUMBER} AS spare_part_no, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS maker FROM part),
a AS (SELECT * EXCLUDE (mat), CASE WHEN mat = 'none' THEN '' ELSE mat END AS m, {TITLE('raw')} AS name FROM base),
b AS (SELECT *, {BUNDLE_TEXT} AS txt FROM a),
c AS (SELECT *, {DIM_LEFT('name')} AS name2, {DIM_TEXT('name')} AS d2, trim({DIM_LEFT('txt')}) AS txt2, {DIM_TEXT('txt')} AS d1 FROM b),
e AS (SELECT *, {ADD('txt2', 'd1')} AS txt3 FROM c), f AS (SELECT *, {ADD('txt3', 'd2')} AS text FROM e),
g AS (SELECT *, {FOUND("name2 || ' ' || text")} AS found FROM f),
rows AS (SELECT * EXCLUDE (name), CASE WHEN found IS NULL OR contains(name2, 'Matl. ' || found) THEN name2 ELSE trim(name2 || ' Matl. ' || found) END AS part_name FROM g),
{STITCH},
z AS (SELECT i.* EXCLUDE (part_name), whole AS part_name FROM i JOIN n USING (doc_id, island) WHERE NOT joins),
ctx AS (SELECT DISTINCT p_brand AS doc_id, (1 + p_partkey % 3)::INTEGER AS page_no, CASE WHEN p_partkey % 3 = 0 THEN 'ACME Co., Ltd' ELSE '' END AS cm FROM part),
k AS (SELECT z.doc_id, z.page_no, row_no, part_name, '' AS measuring_unit, '' AS quantity, 'Group ' || doc_id AS spare_group, '10-' || (page_no - 1) AS drawing_no, drawing_pos_no, spare_part_no, '' AS classification, '' AS classification_no, '' AS type, text, '' AS ref_no,
 CASE WHEN maker <> '' THEN maker ELSE cm END AS manufacturer, '' AS internal_remark, page_no::VARCHAR AS ref_page FROM z JOIN ctx USING (doc_id, page_no))
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, row_no) - 1 AS row_index, trim(spare_part_no) = '' OR trim(drawing_pos_no) = '' AS qc_failed
FROM k WHERE NOT (CASE WHEN trim(part_name) = '' AND trim(spare_part_no) = '' THEN length(trim(text)) <= 3 ELSE trim(spare_part_no) = '' AND regexp_matches(trim(part_name), {q(fixed.NOISE_PATTERN)}) END)"""


@query(END_TO_END.replace("k AS (SELECT *, CASE WHEN trim", "kk AS (SELECT *, CASE WHEN trim").replace("FROM k),\ni AS", "FROM kk),\ni AS").replace("FROM k),\nj AS", "FROM kk),\nj AS").replace("AS joins FROM k)", "AS joins FROM kk)"))
def pipeline_end_to_end(spark, d):
    """Cells to parts, with context, and the check of required cells."""
    result = plan.process_cells(_sql(spark, d, CELLS, "part"), CONFIG, _sql(spark, d, CTX, "part"))
    return result.main.withColumn("row_index", F.col("row_index").cast("long")).withColumn("qc_failed", qc.fails(result.main))


PLAIN = lambda of, keep: f"(SELECT {keep}, ' ' || regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g') || ' ' AS p FROM {of})"
GRAMS = lambda of, keep: f"(SELECT {keep}, z[1] || z[2] || z[3] AS gram FROM (SELECT {keep}, unnest(list_zip(c, c[2:], c[3:])) AS z FROM (SELECT {keep}, string_split(p, '') AS c FROM {PLAIN(of, keep)})) WHERE z[3] IS NOT NULL UNION ALL SELECT {keep}, p FROM {PLAIN(of, keep)} WHERE length(p) < 3)"


@query(f"""WITH c AS (SELECT lang, gram, count(*) AS n FROM {GRAMS("(SELECT text, lang FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL AND lang IS NOT NULL)", "lang")} GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank, sum(n) OVER (PARTITION BY lang) AS total FROM c),
l AS (SELECT lang, max(total) AS total FROM k GROUP BY lang), g AS (SELECT text, gram, count(*) AS m FROM {GRAMS("(SELECT DISTINCT text FROM documents)", "text")} GROUP BY ALL),
s AS (SELECT text, l.lang, sum(m * coalesce(ln(2.0 * n), 0)) / sum(m) - ln(2.0 * any_value(l.total)) AS score FROM g CROSS JOIN l LEFT JOIN k ON k.gram = g.gram AND k.lang = l.lang AND rank <= {language.SIZE} GROUP BY ALL),
b AS (SELECT text, arg_min(lang, (-round(score, 9), lang)) AS language FROM s GROUP BY text)
SELECT doc_id, lang, doc_id % 5 = 0 AS held_out, language FROM documents LEFT JOIN b USING (text)""")
def detect_language(spark, d):
    """The language of every text, by profiles learnt from four fifths of the documents."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "text")
    told = language.with_language(docs, "text", language.learn(docs.filter("doc_id % 5 <> 0")))
    return told.select("doc_id", "lang", (F.col("doc_id") % 5 == 0).alias("held_out"), "language")
