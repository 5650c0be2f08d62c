"""Pages as a data source, and files by Spark's own reader, by decoders that note what they are asked."""

import json

import pytest
from pyspark.sql import functions as F
from test_documents import decoder as by_path

from tabulon.plans.documents import process_files
from tabulon.sources import documents as source
from tabulon.sources import page_source
from tabulon.sources.config import Config


def noting(log):
    def make(path):
        def note(what, *n):
            with open(log, "a") as f:
                f.write(json.dumps([path, what, *n]) + "\n")

        note("open")
        if "broken" in path:
            raise RuntimeError("Cannot open PDF: not a PDF")

        class Document:
            pages = 0 if "none" in path else 70

            def text(self, n):
                note("text", n)
                return f"text {n}"

            def size(self, n):
                note("size", n)
                return 600, 800

            def words(self, n):
                note("words", n)
                if n == 3:
                    raise ValueError("bad font")
                return [(1, 2, 3, 4, f"w{n}")]

            def lines(self, n):
                note("lines", n)
                return [(5, "line"), (6, " ")]

        return Document()

    return make


def asked(log):
    got = [json.loads(x) for x in log.read_text().splitlines()] if log.exists() else []
    if log.exists():
        log.unlink()
    return got


def test_conditions_and_columns_reach_the_decoder(spark, tmp_path):
    log = tmp_path / "log"
    page_source.register(spark, noting(str(log)))
    load = lambda schema=None: (lambda r: r.schema(schema) if schema else r)(spark.read.format(page_source.FORMAT).option("paths", json.dumps(["a.pdf", "b.PDF", "a.pdf", "c.txt"])).option("push", True)).load()
    some = load().filter("page_no IN (1, 5)")
    assert sorted((r.doc_id, r.page_no, r.text, r.words[0].text, len(r.lines)) for r in some.collect()) == [(d, n, f"text {n}", f"w{n}", 1) for d in ("a.pdf", "b.PDF") for n in (1, 5)]
    assert {tuple(x[2:]) for x in asked(log) if x[1] != "open"} == {(1,), (5,)}
    text = lambda: load("doc_id string, page_no int, text string")
    assert text().filter("doc_id = 'a.pdf' AND page_no > 68").collect() == [("a.pdf", 69, "text 69"), ("a.pdf", 70, "text 70")]
    assert sorted(asked(log)) == [["a.pdf", "open"], ["a.pdf", "text", 69], ["a.pdf", "text", 70]]
    # what is not pushed is right too
    assert text().filter("page_no = 2 OR page_no BETWEEN 60 AND 61").groupBy("page_no").count().orderBy("page_no").collect() == [(2, 2), (60, 2), (61, 2)]
    assert text().filter("page_no NOT IN (1, 2) AND page_no <= 4 AND doc_id LIKE 'b%' AND text <> 'text 4'").collect() == [("b.PDF", 3, "text 3")]


def test_a_table_can_be_used_several_times(spark, tmp_path):
    one = page_source.read(spark, ["a.pdf", "b.pdf"], noting(str(tmp_path / "log")), ["doc_id", "page_no"])
    two, last = one.filter("page_no = 2"), one.filter("page_no > 60")
    assert (two.count(), one.count(), two.union(last).count(), two.join(last, "doc_id").count()) == (2, 140, 22, 20)


def test_failures_of_files_and_pages(spark, tmp_path):
    read = lambda *names, **more: page_source.read(spark, list(names), noting(str(tmp_path / "log")), **more)
    got = read("broken.pdf", "none.pdf", "a.pdf", pages="2-3").orderBy("doc_id", "page_no").collect()
    assert [(r.doc_id, r.page_no, r.total, r.error) for r in got] == [("a.pdf", 2, 70, None), ("a.pdf", 3, 70, "page 3: bad font"), ("broken.pdf", None, None, "Cannot open PDF: not a PDF"), ("none.pdf", None, 0, None)]
    assert got[1].words == [] and got[1].text is None
    assert read("broken.pdf", "a.pdf").filter("page_no IS NULL").count() == 1 and read("broken.pdf").filter("page_no >= 1").count() == 0
    assert read().count() == 0 and read().schema == read("a.pdf").schema
    with pytest.raises(Exception, match="invalid literal"):
        read("a.pdf", pages="x-y").count()
    with pytest.raises(Exception, match="no columns"):
        spark.read.format(page_source.FORMAT).schema("page_no int, colour string").load("a.pdf").count()


def test_large_files_are_shared_out(spark, tmp_path):
    path = tmp_path / "big.pdf"
    path.write_bytes(b"x" * 1000)
    page_source.register(spark, noting(str(tmp_path / "log")))
    whole = spark.read.format(page_source.FORMAT).option("split", 300).load(str(path))
    assert whole.rdd.getNumPartitions() == 4
    parts = whole.filter("error IS NULL").groupBy(F.spark_partition_id().alias("p")).agg(F.sort_array(F.collect_set(F.floor((F.col("page_no") - 1) / source.STEP))).alias("blocks"), F.count("*").alias("n")).collect()
    assert sorted(b for r in parts for b in r.blocks) == [0, 1, 2] and sum(r.n for r in parts) == 69
    path.rename(tmp_path / "broken.pdf")
    assert spark.read.format(page_source.FORMAT).option("split", 300).load(str(tmp_path / "broken.pdf")).count() == 1


def by_bytes():
    """The same documents as in the test of paths, from files that hold their name."""
    make = by_path()

    def decode(content):
        return make(content.decode())

    return decode


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "in"
    for name, holds in (("manual.pdf", "in/manual.pdf"), ("x/scan.PDF", "scan.pdf"), ("x/y/plain.pdf", "plain.pdf"), ("x/y/manual.pdf", "long.pdf"), ("z/bad.pdf", "broken.pdf"), ("z/notes.txt", "plain.pdf"), ("z/huge.pdf", "z" * 500)):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(holds)
    return str(top)


def test_stored_files_of_nested_folders(spark, folder):
    read = lambda roots, **more: source.read_stored(source.stored(spark, roots, by_bytes(), largest=400), **more)
    name = F.regexp_extract("doc_id", "/in/(.*)", 1)
    got = {tuple(r) for r in read(folder).groupBy(name).agg(F.count("page_no"), F.max("error")).collect()}
    want = {("manual.pdf", 6, "page 5: bad font"), ("x/scan.PDF", 2, None), ("x/y/plain.pdf", 1, None), ("x/y/manual.pdf", 70, None), ("z/bad.pdf", 0, "Cannot open PDF: not a PDF"), ("z/huge.pdf", 0, "Cannot open PDF: 500 bytes are more than 400")}
    assert got == want
    # what lies under two roots is read once
    for roots in ([folder, folder + "/x"], [folder + "/x", folder], [folder + "/*", folder + "/x/y/plain.pdf"], [folder + "/*", folder + "/x*", folder]):
        assert read(roots).filter("page_no IS NOT NULL").count() == 79, roots
    assert read(folder + "/x/*/*.pdf", spec="1, 70").count() == 3 and read([folder + "/[xz]", folder + "/[xy]"]).filter("page_no IS NOT NULL").count() == 73
    assert source.read_stored(source.stored(spark, folder, by_bytes()), page_range=(2, 3)).filter("doc_id LIKE '%y/manual.pdf'").count() == 2


def test_stored_files_give_the_parts_of_files_by_path(spark, folder, tmp_path):
    want = process_files(spark, ["in/manual.pdf", "scan.pdf", "plain.pdf", "broken.pdf"], Config(), str(tmp_path / "a"), by_path())
    got = process_files(spark, source.stored(spark, [folder + "/manual.pdf", folder + "/x/scan.PDF", folder + "/x/y/plain.pdf", folder + "/z/bad.pdf"], by_bytes()), Config(), str(tmp_path / "b"))
    names = {"manual.pdf": "in/manual.pdf", "scan.PDF": "scan.pdf", "plain.pdf": "plain.pdf", "bad.pdf": "broken.pdf"}
    rows = lambda df, rename: sorted(str(({**r.asDict(), "doc_id": names[r.doc_id.split("/")[-1]] if rename else r.doc_id})) for r in df.collect())
    for part in ("main", "status", "errors", "warnings"):
        assert rows(getattr(got, part), True) == rows(getattr(want, part), False), part
    assert got.main.filter("page_no = 4").count() == 2  # a second pass over the bytes
