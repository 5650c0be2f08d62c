"""Languages by profiles: held-out accuracy, odd texts, and the flag on rows that uses them."""

import math

import pytest
from compare import duck
from pyspark.sql import functions as F

from tabulon.operators import language, qc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def profile(spark, docs):
    return language.learn(docs.filter("doc_id % 5 <> 0"))


def test_held_out_accuracy(docs, profile):
    held = docs.filter("doc_id % 5 = 0 AND text IS NOT NULL")
    got = held.join(language.detect(held, profile), "text").select("lang", "language", F.length("text").alias("n")).collect()
    long = [r for r in got if r.n >= 200]
    print(sum(r.lang == r.language for r in got) / len(got), sum(r.lang == r.language for r in long) / len(long), len(got))
    assert sum(r.lang == r.language for r in got) >= 0.9 * len(got) and sum(r.lang == r.language for r in long) >= 0.95 * len(long)
    assert len(profile.languages) == duck(SF).sql("SELECT count(DISTINCT lang) FROM documents").fetchall()[0][0]


def test_odd_texts(spark, profile):
    rows = [("",), (" \n",), ("1234 !?",), ("ä",), ("the the the",), ("the the the",), ("x" * 20_000,)]
    got = {r.text: r.language for r in language.detect(spark.createDataFrame(rows, "text string"), profile).collect()}
    assert len(got) == 6 and set(got.values()) <= set(profile.languages)
    nothing = language.learn(spark.createDataFrame([(None, "en"), ("x", None)], "text string, lang string"))
    assert nothing.languages == [] and language.detect(spark.createDataFrame(rows, "text string"), nothing).filter("language IS NOT NULL").count() == 0


def test_a_small_profile_by_hand(spark):
    texts = [("aaab", "p"), ("bbba", "q"), ("bbb", "q")]
    profile = language.learn(spark.createDataFrame(texts, "text string, lang string"), 2)
    kept = {r.gram for r in profile.grams.collect()}
    assert profile.languages == ["p", "q"] and kept == {" aa", "aaa", " bb", "bbb"}
    got = {r.text: r.language for r in language.detect(spark.createDataFrame([("aaa",), ("bbbb",), ("AAA!",)], "text string"), profile).collect()}
    assert got == {"aaa": "p", "bbbb": "q", "AAA!": "p"}


def test_no_row_moves_and_pieces_change_nothing(spark, docs, profile, monkeypatch):
    """Scoring has no exchange and no join; texts beyond the basic plane and of many pieces are counted whole."""
    told = language.with_language(docs, "text", profile)
    plan = told._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
    texts = [("\U00010400\U00010428ab" * 50, "p"), ("zz", "q"), ("", "q"), ("ab cd " * 40, "p")]
    want: dict = {}
    for text, lang in texts:
        plain = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        for g in [plain[i : i + 3] for i in range(len(plain) - 2)] or [plain]:
            want.setdefault(g, {}).setdefault(lang, 0)
            want[g][lang] += 1
    got = language.learn(spark.createDataFrame(texts, "text string, lang string"))
    assert set(got.gains) == set(want) and all(round(math.exp(got.gains[g][i]) / 2) == want[g].get(x, 0) for g in want for i, x in enumerate("pq") if want[g].get(x))
    whole = [n for x in language.numbers("\U00010400 abc de" * 9) for n in x]
    monkeypatch.setattr(language, "PIECE", 7)
    assert whole == [n for x in language.numbers("\U00010400 abc de" * 9) for n in x] and language.gram(whole[0]) == "\U00010400 a"


def test_rows_are_flagged_by_a_profile(spark, docs, profile):
    names = {r.lang: r.text for r in docs.filter("length(text) BETWEEN 200 AND 2000 AND doc_id % 5 = 0").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    rows = [(i, n, "old" if i == 1 else "") for i, n in enumerate([names["en"], *(v for k, v in sorted(names.items()) if k != "en"), "short", "1234567890123", "1234567890123"])]
    parts = spark.createDataFrame(rows, "i int, part_name string, internal_remark string")
    got = {r.i: (r.internal_remark, r.tagged) for r in qc.flag_language(parts, profile, "tagged").collect()}
    tag = qc.fixed.FOREIGN_TAG
    assert len(got) == len(rows) and got[0] == ("", False) and got[1] == (f"old {tag}", True) and got[2] == (tag, True)
    assert all(got[i] == ("", False) for i in range(len(names), len(rows)))
    once = qc.flag_language(qc.flag_language(parts, profile), profile)
    assert once.columns == parts.columns and {r.i: r.internal_remark for r in once.collect()} == {i: x[0] for i, x in got.items()}
