"""A watched folder of documents: each content is processed once, whatever comes again."""

import os
import shutil
import time

import pytest
from test_page_source import by_bytes

from tabulon.sources.config import Config
from tabulon.streaming.watch import watch_files


@pytest.fixture
def box(spark, tmp_path):
    """Runs the stream over what is there; gives what the sink got: batch, files, rows."""
    top = tmp_path / "in"
    top.mkdir()
    fails = []

    def run(checkpoint="a"):
        got = []

        def sink(result, number):
            names = sorted(r.doc_id.split("/in/")[1] for r in result.warnings.select("doc_id").union(result.errors.select("doc_id")).collect())
            got.append((number, names, result.main.count()))
            if fails:
                raise OSError(fails.pop())

        work = str(tmp_path / "work")
        query = watch_files(spark, str(top), Config(), by_bytes(), sink, str(tmp_path / checkpoint), str(tmp_path / "ledger"), work)
        try:
            query.awaitTermination()
        except Exception as e:
            got.append(str(e))
        return got

    def put(name, holds):
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(holds)
        later = time.time() + 5
        os.utime(path, (later, later))  # a newer file to the stream

    run.put, run.fails, run.top = put, fails, top
    return run


def test_each_content_once(spark, box, tmp_path):
    box.put("manual.pdf", "in/manual.pdf")
    box.put("x/copy.PDF", "in/manual.pdf")
    box.put("x/bad.pdf", "broken.pdf")
    box.put("notes.txt", "plain.pdf")
    assert box() == [(0, ["manual.pdf", "x/bad.pdf"], 4)]
    # a restart, the same file again, and its content under a new name
    assert box() == []
    box.put("manual.pdf", "in/manual.pdf")
    box.put("again.pdf", "in/manual.pdf")
    assert box() == []
    # a new file is processed, and after a failure again, under the same number
    box.put("long.pdf", "long.pdf")
    box.fails.append("the sink is full")
    first = box()
    assert first[0][1:] == (["long.pdf"], 140) and "the sink is full" in first[1]
    assert box() == [first[0]] and box() == []
    # a stream takes each path once; one without that checkpoint sees all files anew, and the ledger knows
    # all but the other content under a known name
    box.put("manual.pdf", "plain.pdf")
    assert box() == []
    assert [x[1:] for x in box("b")] == [(["manual.pdf"], 0)]
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    assert ledger.count() == ledger.select("digest").distinct().count() == 4
    shutil.rmtree(tmp_path / "work")
    box.put("scan.pdf", "scan.pdf")
    assert [x[1:] for x in box("b")] == [(["scan.pdf"], 0)]
