"""Long lists of phrases and patterns: the same as one test after the other."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tabulon.functions import patterns, similarity
from tabulon.functions.text import material
from tabulon.operators import context, headers
from tabulon.sources import fixed_values as fixed

LETTERS = "etaoinshrdlucmfé名 "


def common(a, b):
    """Length of the longest common subsequence, by the textbook's table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[-1]))
    return row[-1]


def plain(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def made(seed):
    """Phrases, and headers that are phrases with typing errors, other words, blank or long."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randrange(2, 9)))
    words = [word() for _ in range(60)]
    phrases = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(90)] + ["", "a", "x" * 70, "y" * 300]
    out = {"", " ", "a", "b", "x" * 69, "y" * 290 + "z", "z" * 3000}
    while len(out) < 160:
        x = list(rng.choice(phrases[:90]) if rng.random() < 0.7 else " ".join(rng.choice(words) for _ in range(2)))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(2)] = rng.choice(["", "q", " "])
        out.add("".join(x))
    return phrases, sorted(out)


def test_similarities_of_batches():
    phrases, names = made(1)
    pairs = [(a, b) for a in names[::5] for b in phrases[::4]] + [("", ""), ("", "x"), ("b a", "a b"), ("x" * 64, "x" * 64), ("ab" * 32, "ba" * 60)]
    assert list(similarity.ratios(*map(list, zip(*pairs)))) == [plain(a, b) for a, b in pairs]
    assert similarity.token_sort_ratio("Part No", "No Part") == 100 and len(similarity.ratios([], [])) == 0


@pytest.mark.parametrize("threshold", [100.0, 88.0, 80.0, 72.0, 50.0])
def test_the_index_finds_what_a_comparison_with_all_finds(spark, threshold):
    phrases, names = made(int(threshold))
    listed = spark.createDataFrame([(i, f"t{i % 9}", p, headers.norm(p)) for i, p in enumerate(phrases)], "ordinal int, target string, phrase string, norm string")
    rows = headers.map_fuzzy(spark.createDataFrame([(h,) for h in names], "raw_header string"), listed, threshold).collect()
    want = {}
    for h in names:
        row = [float(x) for x in similarity.ratios([h] * len(phrases), phrases)]
        best = max(row)
        want[h] = (f"t{row.index(best) % 9}", "fuzzy", best) if best >= threshold else (None, None, None)
    assert {r.raw_header: (r.target, r.method, r.score) for r in rows} == want and len(rows) == len(names)
    assert 3 < sum(x[0] is not None for x in want.values()) < len(names)


def test_longest_pattern_either_way(spark, monkeypatch):
    rng = random.Random(3)
    parts = list(dict.fromkeys("".join(rng.choice("abÄ ") for _ in range(rng.randrange(1, 6))) for _ in range(60)))
    texts = ["".join(rng.choice("abcÄ -x") for _ in range(rng.randrange(25))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    columns = {"some": patterns.any_contains, "least": lambda x, p: patterns.any_contains(x, []), "name": lambda x, p: material(x, p), "word": lambda x, p: material(x, p, True)}
    got = []
    for few in (1000, 0):
        monkeypatch.setattr(patterns, "FEW", few)
        got.append([(r.some or False, r.least or False, r.name, r.word) for r in df.select("i", *[f(F.col("t"), parts).alias(k) for k, f in columns.items()]).orderBy("i").collect()])
    assert got[0] == got[1]
    longest = sorted(parts, key=len, reverse=True)
    assert [g[2] for g in got[1]] == [next((p for p in longest if p.lower() in (t or "").lower()), None) for t in texts]
    assert [g[0] for g in got[1]] == [any(p in (t or "") for p in parts) for t in texts]


def test_ten_thousand_materials(spark):
    """They take no longer than twice the time of the list that comes with the library; nothing is compiled for each."""
    rng = random.Random(4)
    many = [*fixed.MATERIALS, *{"".join(rng.choice("QXZJKVWY") for _ in range(rng.randrange(6, 15))) for _ in range(10_400)}][:10_000]
    df = spark.range(0, 400_000, 1, 4).selectExpr("id", "CASE id % 3 WHEN 0 THEN concat('valve body of SUS316L ', id) WHEN 1 THEN concat('hexagon bolt with copper ring ', id) ELSE concat('cover plate ', id) END AS t")
    seconds, counts = {}, {}
    for name, listed in (("few", list(fixed.MATERIALS)), ("many", many)):
        found = df.select(material(F.col("t"), listed).alias("m")).groupBy("m").count()
        found.collect()
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            counts[name] = sorted(map(str, found.collect()))
            runs.append(time.perf_counter() - began)
        seconds[name] = min(runs)
    assert counts["few"] == counts["many"] and seconds["many"] <= 2 * seconds["few"], seconds


def test_long_lists_of_markers(spark):
    markers = [f"marker {i} of the list" for i in range(500)]
    df = spark.createDataFrame([("See MARKER 77 of the List",), ("no marker here",), (None,)], "t string")
    assert [r[0] for r in df.select(context.is_skipped_page(F.col("t"), markers)).collect()] == [True, False, False]
