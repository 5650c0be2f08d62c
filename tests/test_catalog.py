from functools import cache

import pytest
from compare import assert_same, duck

import __spark_entry__
from tabulon import catalog
from tabulon.sources import fixed_values as fixed
from tabulon.sources.config import norm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# Queries without SQL, against plain versions.


@cache
def common(a, b):
    """Length of the longest common subsequence, by the textbook's table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[-1]))
    return row[-1]


def ratio(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def mapped(header, tiers=2):
    """Target, method and score of one header: the last exact phrase, else the first most similar one."""
    phrases = catalog.CONFIG.phrases()
    exact = [t for _, t, p in phrases if norm(p) == norm(header)]
    if exact and tiers > 1:
        return exact[-1], "exact", 100.0
    score, _, target = max((ratio(header, p), -i, t) for i, t, p in phrases)
    return (target, "fuzzy", round(score, 6)) if score >= catalog.CONFIG.fuzzy_threshold else (None, None, None)


@pytest.mark.parametrize("name", ["header_map", "map_fuzzy"])
def test_headers_by_a_plain_version(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    got = {r.raw_header: (r.target, r.method, r.score and round(r.score, 6)) for r in rows}
    assert len(got) == len(rows) and got == {h: mapped(h, 1 + (name == "header_map")) for h in got}
    assert {m for _, m, _ in got.values()} >= {"fuzzy", None}
    if name == "header_map":
        made = duck(SF).sql("SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'Item No.' WHEN 1 THEN 'Descripton' WHEN 2 THEN p_type WHEN 3 THEN 'Part No' ELSE p_brand END AS h FROM part").fetchall()
        assert set(got) == {h for (h,) in made} and {m for _, m, _ in got.values()} == {"exact", "fuzzy", None}


def test_similarity_by_a_plain_version(spark):
    got = {r.p_partkey: r.score for r in catalog.QUERIES["token_sort_similarity"](spark, SF).collect()}
    assert got == {k: round(ratio(a, b), 6) for k, a, b in duck(SF).sql("SELECT p_partkey, p_name, p_type FROM part").fetchall()}


def plain_ocr(boxes):
    """Cells of a page (x, y, text of each box that counts), for a header of single words whose first
    one may be a stop word: rows by running means, cells by the nearest word of the header."""
    rows = []
    for x, y, text in sorted(boxes, key=lambda b: b[1]):
        if rows and abs(y - sum(b[1] for b in rows[-1]) / len(rows[-1])) <= 8:
            rows[-1].append((x, y, text))
        else:
            rows.append([(x, y, text)])
    known = lambda r: sum(norm(t) in fixed.OCR_HEADER_TOKENS for _, _, t in r)
    assert known(rows[0]) >= 2 and all(known(r) < 2 for r in rows[1:])
    head = sorted(rows[0])
    names = [t for _, _, t in head]
    merged = names[0].lower() in fixed.OCR_STOPWORDS
    out, at = [], rows[0][0][1]
    for row in rows[1:]:
        y = sum(b[1] for b in row) / len(row)
        if y - at > 50:
            break
        at = y
        cells = [[] for _ in head]
        for x, _, text in sorted(row, key=lambda b: b[0]):
            cells[min(range(len(head)), key=lambda i: abs(head[i][0] - x))].append(text)
        texts = [" ".join(c) for c in cells]
        out.append([" ".join(t for t in texts[:2] if t), *texts[2:]] if merged else texts)
    return ([" ".join(names[:2]), *names[2:]] if merged else names), out


def test_ocr_by_a_plain_version(spark):
    got = {}
    for r in catalog.QUERIES["ocr_table"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.row_no, r.col_pos] = (r.raw_header, r.value)
    pages = {}
    for w in catalog.words(spark, SF).collect():
        boxes = pages.setdefault(w.doc_id, [(x + 20.0, 5.0, t) for x, t in ((60.0, "No."), (180.0, "NAME"), (18.0, "of"))])
        if w.word_no % 13:
            boxes.append((w.x0 + 20, w.y0 + 5, w.text))
    want = {}
    for doc, boxes in pages.items():
        names, rows = plain_ocr(boxes)
        cells = {(i, j): (n, v) for i, row in enumerate(rows) for j, (n, v) in enumerate(zip(names, row))}
        if cells:
            want[doc] = cells
    assert got == want and len(got) > 100


def test_short_pages_are_scans(spark):
    from pyspark.sql import functions as F

    from tabulon.operators import context

    texts = [None, "", " \n", "x" * 19, " " + "x" * 19 + "\u3000", "x" * 20, "漢" * 19, "漢" * 20]
    df = spark.createDataFrame([("d" if i % 2 else "e", i, t) for i, t in enumerate(texts)], "doc_id string, page_no int, text string")
    assert sorted(r.page_no for r in df.filter(context.is_scanned_page(F.col("text"))).collect()) == [0, 1, 2, 3, 4, 6]
    assert {(r.doc_id, r.scanned, r.total, r.is_scanned) for r in context.scanned_documents(df, catalog.CONFIG).collect()} == {("e", 4, 4, True), ("d", 2, 4, False)}
