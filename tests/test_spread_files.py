"""Files that tasks write together: the same as those of one writer, of any size, whole or not there."""

import csv
import os
import re
import resource
import subprocess
import sys
import zipfile
import zlib

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.sources import sinks, spread_files


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=3000))
def test_joined_checksums(a, b):
    assert spread_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=50), max_size=4), min_size=1, max_size=5))
def test_joined_pieces(groups):
    made = [spread_files.packed(g, last=g is groups[-1]) for g in groups[:-1]] + [spread_files.packed(groups[-1], last=True)]
    assert zlib.decompress(b"".join(p.body for p in made), -15) == b"".join(x for g in groups for x in g)


def test_entries_and_places_of_more_than_32_bits(spark, tmp_path):
    path = str(tmp_path / "o.zip")
    archive = spread_files.Archive(spark, path)
    zeros = spread_files.packed([bytes(1 << 26)])
    archive.add("long", [zeros] * 66 + [spread_files.packed([b"end"], last=True)])
    archive.end += 2**32  # a gap that takes no disk
    archive.add("far", [spread_files.packed([b"there"], last=True)])
    archive.close()
    with zipfile.ZipFile(path) as z:
        assert [(i.filename, i.file_size) for i in z.infolist()] == [("long", 66 * 2**26 + 3), ("far", 5)]
        assert z.testzip() is None and z.read("far") == b"there"


def bodies(path):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        return {n: z.read(n) for n in z.namelist()}


def test_same_as_one_writer(spark, tmp_path, monkeypatch):
    """Full sheets, pieces, control characters, missing cells, empty tables, columns of one name."""
    monkeypatch.setattr(sinks, "SHEET_ROWS", 12)
    monkeypatch.setattr(spread_files, "PIECE", 4)
    rows = [(i, None if i % 3 else f"<{i}>\x01&", float(i) if i % 2 else None, i % 2 == 0) for i in range(40)]
    here = pd.DataFrame(rows, columns=["n", "t", "x", "yes"]).astype({"n": object})
    there = spark.createDataFrame(rows, "n int, t string, x double, yes boolean").repartition(3).orderBy("n")
    one = sinks.write_workbook(str(tmp_path / "one.xlsx"), {"s": here, "e": here[:0]})
    many = sinks.write_workbook(str(tmp_path / "many.xlsx"), {"s": there, "e": there.limit(0)})
    mixed = sinks.write_workbook(str(tmp_path / "mixed.xlsx"), {"s": there, "e": here[:0]})
    assert bodies(one) == bodies(many) == bodies(mixed) and len(bodies(one)) == 4 + 5
    twice = there.select("n", F.col("t").alias("n"), F.lit(None).alias("at"), F.array("n").alias("part"))
    assert b"[39]" in bodies(sinks.write_workbook(str(tmp_path / "twice.xlsx"), {"s": twice}))["xl/worksheets/sheet4.xml"]
    assert sorted(os.listdir(tmp_path)) == ["many.xlsx", "mixed.xlsx", "one.xlsx", "twice.xlsx"]


def test_report_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spread_files, "PIECE", 3)
    rows = [(i, "BOLT", f'say "{i}",\nor not' if i % 5 else None) for i in range(30)]
    parts = spark.createDataFrame(rows, "row_index long, item string, note string")
    monkeypatch.setattr(sinks, "qc_failed", lambda df: df.filter("row_index % 2 = 1"))
    sinks.write_qc_report(parts, str(tmp_path / "q.csv"), ["row_index"], {"Item": "item", "Note": "note"})
    sinks.write_qc_rows(str(tmp_path / "r.csv"), ["Item", "Note"], [(i, (a, b)) for i, a, b in rows if i % 2])
    assert (tmp_path / "q.csv").read_bytes() == (tmp_path / "r.csv").read_bytes()
    with open(tmp_path / "q.csv", encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f))[1] == ["1", "BOLT", 'say "1",\nor not'] and sorted(os.listdir(tmp_path)) == ["q.csv", "r.csv"]


def test_three_million_rows(spark, tmp_path):
    """The driver's process grows by less than 100 MB, and a common reader finds every row at its place."""
    n = 3_000_000
    df = spark.range(n, numPartitions=8).select(F.concat(F.lit("part "), "id").alias("name"), (F.col("id") % 97).alias("quantity"))
    sinks.write_workbook(str(tmp_path / "small.xlsx"), {"s": df.limit(10)})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    path = sinks.write_workbook(str(tmp_path / "o.xlsx"), {"Spare Parts": df})
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = re.findall('<sheet name="([^"]*)', z.read("xl/workbook.xml").decode())
        assert names == ["Spare Parts", "Spare Parts (2)", "Spare Parts (3)"]
        full = sinks.SHEET_ROWS - 1
        for i, rows in enumerate([full, full, n - 2 * full]):
            body = z.read(f"xl/worksheets/sheet{i + 1}.xml")
            assert body.count(b"<row ") == rows + 1
            for k in (0, 1, rows // 2, rows - 1):
                assert f'<c r="A{k + 2}" t="inlineStr"><is><t xml:space="preserve">part {i * full + k}</t>'.encode() in body


SCRIPT = """
import os, sys
sys.path[:0] = {paths!r}
from pyspark.sql import SparkSession
from tabulon.sources import sinks, spread_files
spark = SparkSession.builder.master("local[1,2]").config("spark.sql.shuffle.partitions", 1).config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
real, flag = spread_files._put, {flag!r}
def dies(row):
    if not os.path.exists(flag):
        open(flag, "w").close()
        with open(row["target"], "r+b") as f:
            f.seek(row["at"])
            f.write(b"half")
            f.flush()
            os._exit(1)  # the worker is gone
    real(row)
spread_files._put = dies
spread_files.PIECE = 7
print("WROTE", sinks.write_workbook({out!r}, {{"s": spark.range(50)}}))
"""


def test_a_task_that_dies_while_it_puts_a_piece(spark, tmp_path):
    root, flag, out = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "flag", str(tmp_path / "o.xlsx")
    said = subprocess.run([sys.executable, "-c", SCRIPT.format(paths=[root], flag=str(flag), out=out)], capture_output=True, text=True, timeout=300)
    assert "WROTE" in said.stdout, said.stderr[-2000:]
    plain = sinks.write_workbook(str(tmp_path / "p.xlsx"), {"s": pd.DataFrame({"id": range(50)})})
    assert flag.exists() and bodies(out) == bodies(plain)


def test_nothing_is_left_of_a_table_that_fails(spark, tmp_path):
    with pytest.raises(Exception):
        sinks.write_workbook(str(tmp_path / "o.xlsx"), {"a": spark.range(3), "s": spark.range(3).selectExpr("raise_error('late')")})
    assert os.listdir(tmp_path) == []
