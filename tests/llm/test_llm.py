import base64
import glob
import gzip
import hashlib
import io
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from compare import assert_same, duck
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import byte_bpe, chat_windows, components, line_dedup, measures, mixing, ngram_join, quality_fm, quality_rules, registry, session, signature_tree, textscan, url_filters, warc, winnowing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = ["w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents():
    """Nulls, empty, long and odd texts, ties, repeated rows, exact and near copies, shared lines."""
    rng = random.Random(5)
    base, line = prose(rng, 90), prose(rng, 40)
    texts = [None, "", " \n\t ", "one", "a b c d", "A B C D", base, base, base.replace("wa", "x"), prose(rng, 60) + "\n" + line + "\nshort end", "begin\n" + line + "\nshort end\n" + prose(rng, 50), line, "\n".join([prose(rng, 12)] * 9), "é ü 漢字 🙂 " * 30, prose(rng, 30_000), "x" * 300_000, "no words\x00here\x0b!"]
    words = base.split()
    texts += [" ".join(words[:i] + ["z%d" % i] + words[i + 1 :]) for i in range(0, 12, 3)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None or i % 4 == 0 else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, "nameless " + base, "en", "s1", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names clash with working columns
    return spark.createDataFrame(documents(), DOCS).withColumns({c: F.lit(1) for c in ("id", "n", "row", "runs", "epoch", "lines", "failed", "block")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# textscan


def test_word_hashes_follow_the_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\t\n　") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "q" * 700_000, prose(rng, 120_000)]
    by_hash, by_word = {}, {}
    got = {}
    for w in textscan.words(pa.array(texts), lower=False):
        for i in range(w.first, w.last):
            got[i] = w.hash[w.bounds()[i - w.first] : w.bounds()[i - w.first + 1]].tolist()
    for i, t in enumerate(texts):
        assert len(got[i]) == len(split(t))
        for h, w in zip(got[i], split(t)):
            assert by_hash.setdefault(h, w) == w and by_word.setdefault(w, h) == h


# op1


def test_fm_identity_and_heldout(spark):
    rng = np.random.default_rng(0)
    m = quality_fm.Model(0.3, rng.normal(size=quality_fm.SIZE), rng.normal(size=(quality_fm.SIZE, 4)))
    x = quality_fm.Features(np.zeros(5, int), np.array([1, 5, 9, 70, 200]), rng.normal(size=5))
    pairs = sum(m.v[x.index[i]] @ m.v[x.index[j]] * x.value[i] * x.value[j] for i in range(5) for j in range(i))
    assert np.isclose(m.raw(x, 1)[0][0], 0.3 + m.w[x.index] @ x.value + pairs)
    got = quality_fm.query(spark, "/root/testdata/sf0.01").toPandas()
    labels = duck("/root/testdata/sf0.01").sql("SELECT doc_id, quality FROM labels").df()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert len(both) > 30 and (both.predicted == both.quality).mean() >= 0.95 and len(got) == 1000


def plain_score(model, text, declared):
    """The score by its definition: words, statistics and pairs of features one by one."""
    words = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    tri = list(zip(words, words[1:], words[2:]))
    covered = {i + j for i, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}
    count = lambda chars: sum(c in chars for c in text or "")
    m = {"n_words": len(words), "n_chars": len(text or ""), "word_chars": sum(map(len, words)), "n_symbols": count("#*$%&|<>"), "n_upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_digits": count("0123456789"), "n_bangs": count("!?"), "n_stops": count(".,;:"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    x = {}
    for w in words:
        i = int(next(textscan.words(pa.array([w]), lower=False)).hash[0]) % quality_fm.BUCKETS
        x[i] = x.get(i, 0) + 1
    norm = sum(v * v for v in x.values()) ** 0.5
    x = {i: v / norm for i, v in x.items()}
    steps = [int(min(max(m[a] / max(m[b], 1) * scale, 0), quality_fm.STEPS - 1)) for a, b, scale in quality_fm.FIELDS]
    steps += [int(min(np.log2(max(v, 0) + 1), quality_fm.STEPS - 1)) for v in (m["n_words"], m["n_chars"] if declared is None else declared, m["n_lines"])]
    x |= {quality_fm.BUCKETS + k * quality_fm.STEPS + s: 1.0 for k, s in enumerate(steps)}
    ids = list(x)
    out = model.w0 + sum(model.w[i] * x[i] for i in ids)
    out += sum(model.v[i] @ model.v[j] * x[i] * x[j] for a, i in enumerate(ids) for j in ids[:a])
    return 1 / (1 + np.exp(-out))


def test_fm_scores_by_a_plain_version(spark, docs):
    """The query's scores, and those of odd texts, pair by pair."""
    con = duck(SF)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter(~quality_fm.held_out())
    model = quality_fm.train(table, labels)
    got = {r.doc_id: r for r in quality_fm.query(spark, SF).collect()}
    rows = con.sql("SELECT doc_id, text, n_chars FROM documents").fetchall()
    assert len(got) == len(rows)
    short = [r for r in rows if len(split(r[1])) <= 120]
    assert len(short) > 30
    for d, text, declared in short:
        assert abs(got[d].score - plain_score(model, text, declared)) < 1e-5
        assert got[d].predicted == (got[d].score >= 0.3) and got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
    odd = {r.doc_id: r.score for r in quality_fm.score(docs, model).collect()}
    for d, text, *_, declared in documents()[:12]:
        assert abs(odd[d] - plain_score(model, text, declared)) < 1e-5


def test_fm_labels(spark, docs):
    """Labels of held-out rows, null labels and those without a document or a doc_id teach nothing; of
    two labels the larger counts."""
    base = [(6, 1), (10, 0), (13, 1)]
    more = base + [(6, 0), (None, 0), (777, 0), (12, None)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, label int")
    a, b = (quality_fm.train(docs, frame(x)) for x in (base, more))
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()
    held = docs.filter("doc_id IS NULL").select("doc_id", quality_fm.held_out().alias("h")).collect()
    assert [r.h for r in held] == [None]  # a row without an id is in neither part


def test_fm_cases(spark, docs, empty):
    labels = spark.createDataFrame([(6, 1), (6, 0), (10, 0), (99, 1), (3, None)], "doc_id bigint, label int")
    model = quality_fm.train(docs, labels)
    got = quality_fm.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_fm.score(docs, quality_fm.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality_fm.score(empty, model).count() == 0


# op2


def test_urls(spark):
    urls = ["http://Example.NET/en/x?q", "https://a.example.net/de/", "ftp://example.com/de/", "https://x.org/fr", "http://org/fr/a", None, "nothing", "http://notnet/", "http://net", "http://a.b.net#/x", "x://y://z.net/", "http://example.com/den/", "://net/", "http://" + "a." * 2000 + "net/"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls + urls[:1])], "page_id bigint, url string, rule string")
    got = {r.page_id: (r.host[-12:], r.path, r.rule, r.verdict) for r in url_filters.judge(df, url_filters.rule_table(spark, url_filters.RULES)).collect()}
    assert got[0] == got[14] == ("example.net"[-12:], "/en/x", "example.net/en/", "allow")
    assert [got[i][2:] for i in range(1, 14)] == [("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/", "block"), ("net/", "block")]
    assert got[5][:2] == got[6][:2] == ("", "")
    ties = url_filters.rule_table(spark, [("b.c", "/", "allow"), ("b.c", "/", "block"), ("c", "/xx", "allow")])
    assert url_filters.judge(df.limit(1).withColumn("url", F.lit("http://b.c/xx")), ties).first().rule == "b.c/"
    assert url_filters.judge(df.limit(0), ties).count() == 0


def test_urls_beside_any_columns(spark):
    """Columns of any type and name come through; a third of the rows without a URL is spread by the others."""
    df = spark.range(900).selectExpr("id", "IF(id % 3 = 0, NULL, concat('http://a', id % 7, '.net/')) AS url", "map('k', id) AS m", "array(map(1, id)) AS am", "id AS hit_url", "id AS hit_key", "id AS row", "id AS key", "id AS `a.b`", "'x' AS rule")
    got = url_filters.judge(df, url_filters.rule_table(spark, url_filters.RULES))
    assert got.columns == [c for c in df.columns if c != "rule"] + ["host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == 900 and all(r.m == {"k": r.id} and r.am == [{1: r.id}] and r.hit_url == r.hit_key == r.row == r.key == r["a.b"] == r.id for r in rows)
    assert all((r.verdict, r.rule) == (("allow", None) if r.id % 3 == 0 else ("block", "net/")) for r in rows)
    only = spark.range(3).selectExpr("CAST(NULL AS string) AS url", "map(1, id) AS m")
    assert {r.verdict for r in url_filters.judge(only, url_filters.rule_table(spark, url_filters.RULES)).collect()} == {"allow"}


# op3


def test_chat(spark):
    rng = random.Random(3)
    rows = [(c, i, rng.choice(["user", "assistant", "system", "tool\n"]), rng.choice(["", "### x </turn>\n", "\\E\\\\H", "\n</turn>\n", prose(rng, rng.randint(1, 300)), None])) for c in range(30) for i in range(rng.randint(1, 40))]
    rows += [(77, 0, "system", "alone"), (78, 0, None, None), (79, None, "user", "x"), (79, 0, "assistant", "y"), (79, 0, "assistant", "y"), (None, 1, "user", "z"), (80, 0, "system", prose(rng, 2000)), (80, 1, "user", "q"), (80, 2, "assistant", prose(rng, 900))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, window int")
    got = {r.conv_id: r for r in chat_windows.digests(chat_windows.windows(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))]
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_windows.windows(df.limit(0)).count() == 0


def test_chat_in_blocks(spark, monkeypatch):
    """Spread windows are those of conversations in one task, whatever the blocks; so are their digests."""
    rng = random.Random(14)
    rows = [(c, i if c % 3 else i // 2, rng.choice(["user", "assistant"]) if i or c % 2 else "system", prose(rng, rng.randint(0, 90))) for c in range(12) for i in range(rng.choice([3, 50, 150, 400]))]
    rows += [(None, i, "assistant", f"t{i}") for i in range(100)] + [(90, 0, "system", "alone"), (91, None, "system", "s"), (91, None, "system", "s"), (92, 0, "system", "a"), (92, 0, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").cache()

    def found(spread):
        made = chat_windows.windows(df, spread=spread)
        return sorted((str(w.conv_id), w.window, w.n_repeated, w.text, str(w.loss)) for w in made.collect()), sorted(map(str, chat_windows.digests(made, dealt=not spread).collect()))

    some = found(False)
    assert len(some[1]) == 16 and len(some[0]) > 100
    for block in (7, 64, 10**6):
        monkeypatch.setattr(chat_windows, "BLOCK", block)
        assert found(True) == some


def test_chat_moves_texts_once(spark):
    """Conversations of any length: one exchange, and it is by conversation."""
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat_windows.digests(chat_windows.windows(df), dealt=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(c" in plan and "Join" not in plan


def cost(text):
    return (len(text.encode()) + 3) // 4 + 8


def test_chat_budget(spark):
    """Windows exceed the budget only by what a turn has beyond the stride, and the system turn beyond half."""
    rng = random.Random(4)
    rows = []
    for c, size in enumerate([0, 100, 450, 500, 700, 980, 1500, 2000, 4000]):  # bytes of the system turn
        rows += [(c, 0, "system", "s" * size)] * bool(size)
        rows += [(c, i, rng.choice(["user", "assistant"]), "t" * rng.randint(0, 950)) for i in range(1, 60)]
    rows += [(20, i, "user", "u" * rng.randint(0, 6000)) for i in range(30)]  # turns that may not fit
    rows += [(21, 0, "system", "s" * 2000)] + [(21, i, "assistant", "short answer") for i in range(1, 41)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    half, spans = chat_windows.BUDGET // 2, {}
    for w in chat_windows.windows(df).collect():
        turns = chat_windows.parse(w.text)
        system = cost(turns[0][1]) if turns[0][0] == "system" else 0
        spans.setdefault(w.conv_id, []).append((w.window, [t for _, t in turns[w.n_repeated :]]))
        longest = max([cost(t) for r, t in turns if r != "system"], default=0)
        stride = max(chat_windows.BUDGET - system - chat_windows.HISTORY, half)
        assert sum(cost(t) for _, t in turns) <= chat_windows.BUDGET + max(0, system - half) + max(0, longest - stride)
        if w.conv_id <= 5:
            assert system <= half and sum(cost(t) for _, t in turns) <= chat_windows.BUDGET
    for c, found in spans.items():  # every turn is new once, in order
        assert [t for _, some in sorted(found) for t in some] == [t for x, _, _, t in rows if x == c]
    # 40 short turns beside a long system turn: a few windows, not one a turn
    assert len(spans[21]) <= -(-sum(cost(t) for c, i, _, t in rows if c == 21 and i) // half) * 2


# op4


def brute_winnow(text, k, w):
    if not text:
        return []
    h, _ = zip(*[(winnowing.select(text[i : i + k], k, 1)[0][0], i) for i in range(max(len(text) - k + 1, 1))])
    w = min(w, len(h))
    return sorted({max(range(i, i + w), key=lambda j: (-int(h[j]), j)) for i in range(len(h) - w + 1)})


def test_winnowing():
    rng = random.Random(4)
    for n in (0, 1, 3, 4, 5, 9, 40, 200):
        text = "".join(rng.choice("aab") for _ in range(n))
        assert winnowing.select(text, 4, 5)[1].tolist() == brute_winnow(text, 4, 5)
    long = "".join(rng.choice("abcdefgh") for _ in range(2 * winnowing.PIECE + 77))
    shared = long[1000:1079]
    h, p = winnowing.select(long)
    other = winnowing.select("zz" + shared + "yy")[0]
    assert set(h[(p >= 1000) & (p < 1064)].tolist()) & set(other.tolist())
    assert winnowing.likeness(h, h) == 1 and winnowing.likeness(h[:0], h[:0]) == 1 and winnowing.likeness(h, h[:0]) == 0


def test_ranges_by_halving(spark):
    rng = random.Random(2)
    keys = [rng.randint(-50, 50) for _ in range(200)]
    for n in (0, 1, 2, 3, 7, 16, 33):
        bounds = sorted(rng.sample(range(-50, 50), n))
        got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", winnowing.range_of(F.col("k"), bounds).alias("r")).collect()
        assert all(r.r == sum(b <= r.k for b in bounds) for r in got)
    dealt = winnowing.ranges(spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 8).repartitionById(8, "range")
    tasks = dealt.select("range", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(tasks) == 8 and all(r.range == r.p for r in tasks)


def test_short_texts_keep_several_marks():
    rng = random.Random(6)
    for n in (22, 30, 40, 79, 149, 300, 600):
        text, other = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for _ in range(2))
        edited = text[: n - n // 4] + other[: n // 4]
        assert winnowing.likeness(winnowing.select(text)[0], winnowing.select(edited)[0]) > 0
        assert len(winnowing.select(text)[0]) >= min(7, n - winnowing.K + 1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    for size in (79, 150, 400):  # a shared run of 79 code points, whatever windows the two texts have
        for at in range(0, 4500, 90):
            short = long[at : at + 79] + "".join(rng.choice("xyz") for _ in range(size - 79))
            assert set(winnowing.select(long)[0].tolist()) & set(winnowing.select(short)[0].tolist())
    assert winnowing.select(long)[1].tolist() == winnowing.select(long, winnowing.K, winnowing.WINDOW)[1].tolist()


MASK = 2**64 - 1


def plain_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & MASK
    return x ^ x >> 31


def plain_marks(text, k=winnowing.K):
    """Hash and position of the chosen grams, by the definition: a polynomial of the code points' hashes."""
    odd = 0x9E3779B97F4A7C15
    if not text:
        return []
    codes = [ord(c) for c in text]
    if len(codes) < k:
        return [(plain_mix(sum((c + 1) * pow(odd, i + 1, 2**64) for i, c in enumerate(codes)) & MASK) >> 32, 0)]
    each = [plain_mix(c + 1) for c in codes]
    powers = [pow(odd, k - 1 - j, 2**64) for j in range(k)]
    h = [plain_mix(sum(e * p for e, p in zip(each[i : i + k], powers)) & MASK) >> 32 for i in range(len(codes) - k + 1)]
    w = max(1, min(winnowing.WINDOW, len(h) // winnowing.SHARE))
    places = {max(range(i, i + w), key=lambda j: (-h[j], j)) for i in range(len(h) - w + 1)}
    return sorted((h[p], p) for p in places)


def test_neighbours_by_a_plain_version(spark):
    """All columns of the query over documents of up to 1,500 code points and their neighbours."""
    df = spark.createDataFrame([(d, t if t is None else t[:1500]) for d, t, *_ in documents()[:-2]] + [(50 + i, prose(random.Random(i), 8 * i)) for i in range(12)], "doc_id bigint, text string")
    rows = sorted((r.doc_id, r.text or "") for r in df.collect())
    got = {r.doc_id: r for r in winnowing.compare_neighbours(df, 3).collect()}
    assert len(got) == len(rows)
    show = lambda marks: " ".join(f"{h:08x}:{p}" for h, p in sorted(marks, key=lambda m: m[1]))

    def like(a, b):
        a, b = ({h for h, _ in x} for x in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        own, other = plain_marks(text), plain_marks(edited)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (show(own), show(other))
        assert abs(r.near_edited - like(own, other)) < 1e-12 and abs(r.near_next - like(own, plain_marks(after))) < 1e-12


def test_neighbours(spark, docs, empty):
    for n in (1, 3):
        got = winnowing.compare_neighbours(docs, n).collect()
        rows = sorted(((-(2**63) if r[0] is None else r[0], r[1] or "", r[0]) for r in documents()))
        want = sorted((str(d), len(a), hashlib.sha256((a[: len(a) - len(a) // 4] + rows[(i + 1) % len(rows)][1][: len(a) // 4]).encode()).hexdigest()) for i, (_, a, d) in enumerate(rows))
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[6].fingerprint == by[7].fingerprint and by[6].near_next == 1 and by[0].fingerprint == ""
    assert winnowing.compare_neighbours(empty, 3).count() == 0 and winnowing.fingerprints(docs).count() == len(rows)


# op5


def test_rules(spark, docs, empty):
    led = quality_rules.ledger(docs.drop("failed"), ["doc_id"]).collect()
    by = {r.doc_id: r for r in led}
    for d, text, *_ in documents():
        words, lines = split(text), [x for x in (text or "").split("\n") if split(x)]
        tri = list(zip(words, words[1:], words[2:]))
        covered = {i + j for i, x in enumerate(tri) if len(tri) < 2000 and tri.count(x) > 1 for j in range(3)}
        r = by[d]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert len(tri) >= 2000 or r.n_repeat_words == len(covered)
    assert len(led) == docs.count() and quality_rules.ledger(empty).count() == 0
    staged = quality_rules.stage(spark, docs, "")
    assert staged.columns == docs.columns and {6, 7} <= {r.doc_id for r in staged.collect()} and 0 not in {r.doc_id for r in staged.collect()}
    ab = {r.rule: r for r in quality_rules.ablation(spark.createDataFrame([(1,), (3,), (2,), (0,)], "failed bigint"), "base").collect()}
    assert (ab["few_words"].fails, ab["few_words"].fails_alone, ab["few_words"].kept_without) == (2, 1, 2)


# op6


def test_mixing(spark, docs, empty):
    counts = mixing.counted(docs)
    total = sum(len(split(t)) for _, t, *_ in documents())
    assert counts.agg(F.sum("n_tokens")).first()[0] == total and "text" not in counts.columns
    got = mixing.schedule(counts, counts, 2 * total, entropy=None, repeats=None)
    rows = got.collect()
    assert got.columns.count("epoch") == 1 and got.columns.count("block") == 1 and {r.source for r in rows} == {None, "s0", "s1", "s2"}
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.epoch), []).append(r)
    for (s, e), some in uses.items():
        if (s, e + 1) in uses:  # a whole epoch has every document with words once
            assert len(some) == sum(1 for d in documents() if d[3] == s)
    none = mixing.counted(empty)
    assert mixing.schedule(none, none, 10).count() == 0 and mixing.schedule(none, none).count() == 0 and mixing.schedule(none, none, -1).count() == 0
    assert mixing.n_blocks(0) == mixing.n_blocks(mixing.BLOCKS * mixing.BLOCK_TOKENS) == mixing.BLOCKS and mixing.n_blocks(3 * mixing.BLOCKS * mixing.BLOCK_TOKENS) == 4 * mixing.BLOCKS
    staged = mixing.stage(spark, docs, "")
    assert staged.columns == docs.columns and {r.doc_id for r in staged.filter("text LIKE '%w%'").collect()} == {d for d, t, *_ in documents() if t and "w" in t}
    totals = spark.createDataFrame([(float(np.log(0.7)), 70), (float(np.log(0.2)), 20), (float(np.log(0.1)), 10)], "ln_p double, tokens bigint")
    a = mixing.exponent(totals, 100, 0.9, None)
    w = np.array([0.7, 0.2, 0.1]) ** a
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 0.9 * np.log(3)) < 1e-9
    a = mixing.exponent(totals, 100, None, 2.0)
    w = np.array([0.7, 0.2, 0.1]) ** a
    assert abs((w / w.sum() * 100 / [70, 20, 10]).max() - 2) < 1e-9


def test_mixing_with_more_blocks(spark, docs, monkeypatch):
    """Whole epochs and quotas do not depend on the number of blocks."""
    counts = mixing.counted(docs).cache()
    uses = lambda: {(r.source, r.epoch): (r.n, r.t) for r in mixing.schedule(counts, counts, -1, entropy=0.99).groupBy("source", "epoch").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    some = uses()
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 1)
    many = uses()
    assert some.keys() == many.keys() and all(some[k] == many[k] for k in some if (k[0], k[1] + 1) in some)


def test_mixing_deals_rows_without_an_id(spark):
    """A source of 600 rows without an id lies in many blocks, and every row is used once before any twice."""
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("w"), F.repeat(F.lit(" w"), (F.col("id") % 97).cast("int"))).alias("text"))
    counts = mixing.counted(rows)
    spread = counts.filter("doc_id IS NULL").groupBy(mixing.block_of(F.col("doc_id"), F.col("n_tokens"), mixing.BLOCKS).alias("b")).count()
    assert spread.count() > 80 and spread.agg(F.max("count")).first()[0] < 30
    got = mixing.schedule(counts, counts, -1)
    assert got.count() == 900 and got.filter("epoch > 0").count() == 0
    assert got.groupBy("n_tokens").count().exceptAll(counts.groupBy("n_tokens").count()).count() == 0
    starts = sorted((r.start_token, r.n_tokens) for r in got.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_mixing_stage_keeps_clashing_columns(spark, docs):
    odd = docs.withColumns({"start_token": F.lit("x"), "n_tokens": F.lit(-5)})
    got = mixing.stage(spark, odd, "")
    assert got.columns == odd.columns and {(r.epoch, r.start_token, r.n_tokens) for r in got.collect()} == {(1, "x", -5)}


def test_mixing_bisects_without_budget(spark):
    shares = [0.7, 0.2, 0.1]
    totals = spark.createDataFrame([(float(np.log(p)), int(100 * p + 0.5)) for p in shares], "ln_p double, tokens bigint")
    # the largest source once, the smallest twice: (0.7 / 0.1)^(1 - a) = 2
    assert abs(mixing.exponent(totals, None, None, 2.0) - (1 - np.log(2) / np.log(7))) < 1e-9
    assert abs(mixing.exponent(totals, None, 0.9, 50.0) - mixing.exponent(totals, 100, 0.9, None)) < 1e-9


# op7


def brute_components(texts):
    sets = []
    for t in texts:
        w = split((t or "").translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("large", [False, True, "spread"])
def test_join(spark, docs, large, monkeypatch):
    if large:  # every family by leaders and blocks, every bucket by stars
        monkeypatch.setattr(ngram_join, "BLOCK", 150)
        monkeypatch.setattr(ngram_join, "PAIRED", 2)
        monkeypatch.setattr(ngram_join, "OFTEN", 2)
    if large == "spread":  # every frequent shingle to several buckets
        monkeypatch.setattr(ngram_join, "SPREAD", 2)
        monkeypatch.setattr(ngram_join, "STRETCH", 1)
    rng = random.Random(9)
    base = [prose(rng, 40) for _ in range(5)]
    texts = [t for _, t, *_ in documents()[:-2]]
    for b in base:
        for _ in range(10):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w[: rng.randint(30, 40)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    sizes, label = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == list(zip(sizes, label))


def test_spread_buckets_hang_together(spark):
    """Of shingles that all sets have, every bucket is a star around a node for the shingle."""
    rng = random.Random(12)
    base = prose(rng, 30)
    docs = spark.createDataFrame([(i, f"{base} own{i}") for i in range(300)], "doc_id bigint, text string")
    hot = next(textscan.shingle_sets(pa.array([base])))[3]
    few = ngram_join.prefixes(docs, hot, np.full(len(hot), 5)).collect()
    many = ngram_join.prefixes(docs, hot, np.full(len(hot), 40 * ngram_join.SPREAD))
    rows = many.collect()
    assert sorted((r.id, r.n_pos, r.key) for r in rows if r.n_pos) == sorted((r.id, r.n_pos, r.key) for r in few) and all(r.n_pos for r in few)
    middles = {r.id for r in rows if not r.n_pos}
    assert middles <= set(hot.view(np.int64).tolist()) and len({r.token for r in rows if not r.n_pos}) > 30 * len(middles)
    edges = ngram_join.candidates(many).select(F.col("x").alias("u"), F.col("y").alias("v"))
    assert {r.u for r in edges.collect()} == middles
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert len({roots[r.id] for r in few}) == 1


def test_stars_stream(spark):
    """A bucket over several batches gives one star, whatever the batches."""
    def rows(n):
        return [(5, 100 + i, 10 << 32, 7) for i in range(n)] + [(6, 1, 10 << 32, 7), (6, 2, 10 << 32, 7)] + [(7, 100 + i, 10 << 32, 7) for i in range(n)]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        for n in (30, 49, 90, 200):
            df = spark.createDataFrame(rows(n), "token bigint, id bigint, n_pos bigint, key int").coalesce(1)
            got = {(r.x, r.y) for r in ngram_join.candidates(df).collect()}
            star = {(100, 100 + i) for i in range(1, n)} if n > ngram_join.PAIRED else {(100 + i, 100 + j) for j in range(n) for i in range(j)}
            assert got - {(1, 2)} == star
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_join_with_many_null_ids(spark):
    rng = random.Random(13)
    rows = [(None, prose(rng, 30)) for _ in range(40)]
    rows += [(None, t + " z") for _, t in rows[:20]] + [(3, rows[0][1] + " y"), (None, None)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and sum(r.component_id == 3 for r in got) == 3 and sum(r.component_id is None for r in got) == len(rows) - 3


def test_join_cases(spark, docs, empty):
    assert ngram_join.join(docs).count() == docs.count() and ngram_join.join(empty).count() == 0
    staged = ngram_join.stage(spark, docs, "")
    assert staged.columns == docs.columns
    left = [r.doc_id for r in staged.collect()]
    assert len(left) == len(set(left)) and 6 in left and 7 not in left and 4 in left and 5 not in left and {0, 1, 2} <= set(left)


def test_join_stage_tells_rows_apart(spark):
    rng = random.Random(11)
    a, b, c, d, e, f, g = (prose(rng, 40) for _ in range(7))
    near = lambda x: " ".join(x.split()[:-1] + ["z"])
    rows = [(None, a), (None, b), (1, c), (1, d), (1, near(d)), (None, near(c)), (None, e), (None, near(e)), (None, e), (2, f), (2, f), (3, f), (None, None), (None, ""), (None, " "), (4, g), (None, g)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = [(r.doc_id, r.text) for r in ngram_join.stage(spark, docs, "").collect()]
    texts = [t for _, t in got]
    assert {(None, a), (None, b), (1, c), (2, f), (4, g)} <= set(got) and texts.count(None) == texts.count("") == texts.count(" ") == 1
    assert sum(t in (d, near(d)) for t in texts) == 1 and sum(t in (e, near(e)) for t in texts) == 1 and len(got) == 10


def test_sieve(spark):
    """No hash is lost, few others pass, and nothing passes an empty one."""
    all_ = spark.range(20_000).select(F.col("id"), F.xxhash64("id").alias("h"))
    some = all_.filter("id % 10 = 3").select("h")
    passed = [r.id for r in all_.filter(ngram_join.sieve(some, "h")(F.col("h"))).collect()]
    assert {i for i in passed if i % 10 == 3} == set(range(3, 20_000, 10)) and len(passed) < 2_100
    assert all_.filter(ngram_join.sieve(some.limit(0), "h")(F.col("h"))).isEmpty()


def test_join_stage_moves_only_rows_that_may_go(spark, monkeypatch):
    rng = random.Random(14)
    texts = [prose(rng, 40) for _ in range(300)]
    texts += [t + " z" for t in texts[:10]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    moved, whole = [], type(docs).dropDuplicates
    monkeypatch.setattr(type(docs), "dropDuplicates", lambda self, *names: moved.append(self.count()) or whole(self, *names))
    assert sorted(r.doc_id for r in ngram_join.stage(spark, docs, "").collect()) == list(range(300))
    assert len(moved) == 1 and moved[0] < 30


def test_cut_leaves_no_shuffle_files(spark):
    def files():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {p for d in dirs for p in glob.glob(f"{d}/*/shuffle_*")}

    before = files()
    spark.range(1000).repartition(7, F.xxhash64("id")).write.format("noop").mode("overwrite").save()
    others = files()
    assert others - before  # Spark's own way; they go when the driver collects its garbage
    table = session.cut(spark.range(1000).repartition(7, F.xxhash64("id")))
    for _ in range(50):
        if not files() - others:
            break
        time.sleep(0.1)
    assert not files() - others and table.count() == 1000
    assert spark.conf.get(session.FREED) == "false"


def test_first_shingles_in_parts(spark, docs, monkeypatch):
    """What is dealt out at a time is a part of the rows; the parts have all of them, and give the same pairs."""
    rng = random.Random(15)
    base = [prose(rng, 60) for _ in range(20)]
    texts = [" ".join(w for w in b.split() if rng.random() > 0.01) for b in base for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole, parts = ngram_join.prefixes(df, *none), [ngram_join.prefixes(df, *none, part, 3) for part in range(3)]
    every = lambda x: sorted(map(tuple, x.collect()))
    assert sorted(sum(map(every, parts), [])) == every(whole)
    assert every(ngram_join.candidates(*parts)) == every(ngram_join.candidates(whole)) != []
    dealt, meet = [], ngram_join.meetings
    monkeypatch.setattr(ngram_join, "meetings", lambda rows: dealt.append(rows.count()) or meet(rows))
    got = {r.doc_id: r.component_id for r in ngram_join.join(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)[1]
    assert sum(dealt) == whole.count() and max(dealt) < 0.7 * sum(dealt)


def test_join_leaves_only_tables_that_its_result_reads(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    joined = ngram_join.join(docs)
    assert len(list(tmp_path.iterdir())) == 2 and joined.count() == docs.count()  # sets of the documents, roots


def test_tree_loses_no_link():
    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool[o : o + 60], rng.integers(30, 60), replace=False)) for o in rng.integers(0, 200, 120)]
    sets.sort(key=len)
    for cut in (0, 50):
        a, b = (signature_tree.Tree(sets), None) if not cut else (signature_tree.Tree(sets[:cut]), signature_tree.Tree(sets[cut:]))
        labels = signature_tree.Labels(len(sets))
        signature_tree.links(a, b, labels)
        want = signature_tree.Labels(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if (not cut or (j < cut <= i)) and signature_tree.linked(sets[i], sets[j]):
                    want.join(i, j)
        same = lambda of: [[x == y for y in of] for x in of]
        assert same(labels.of.tolist()) == same(want.of.tolist())


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


# op8


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a/\r\nb c", big), (3, None, big), (9, "u", big), (4, "u", None), (6, "u", "tiny"), (7, "u", "tiny"), (3, None, big), (None, "u", big), (8, "u", "é" * 500_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int")
    manifest = warc.write_archives(df, f"file://{tmp_path}/w")
    got = warc.read_archives(manifest).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("5", "revisit", 3), ("3", "response", None), ("9", "revisit", 3), ("4", "response", None), ("6", "response", None), ("7", "response", None), ("3", "response", None), ("None", "revisit", 3), ("8", "response", None)])
    assert {r.page_id: r.payload_bytes for r in got}[8] == 1_000_000 and {r.page_id: r.payload.decode() for r in got}[8] == "é" * 500_000
    assert warc.read_archives(warc.write_archives(df.limit(0), f"file://{tmp_path}/e")).count() == 0
    path = manifest.filter("records > 0").first().path.removeprefix("file://")
    data = open(path, "rb").read()
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_records(io.BytesIO(data[:-3])))
    record = warc.record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), 5, None)
    assert next(warc.read_records(io.BytesIO(warc.member(record)), chunk=3)).payload == b"hello"
    for bad in (record.replace(b"hello", b"hallo"), record[:-2], record.replace(b"WARC/1.1", b"XXXX/1.1")):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(warc.member(bad))))


# op9


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return byte_bpe.settings(), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, empty, bpe):
    (ranks, pattern), library = bpe
    encoder = byte_bpe.Encoder(ranks, pattern)
    got = byte_bpe.encode(docs, ranks, pattern, ["doc_id"]).collect()
    texts = {d: t or "" for d, t, *_ in documents()}
    for r in got:
        if len(texts[r.doc_id]) < 250_000:
            assert r.ids == library.encode_ordinary(texts[r.doc_id])
        assert library.decode(r.ids) == texts[r.doc_id]
    assert len(got) == docs.count() and byte_bpe.encode(empty, ranks, pattern, ["doc_id"]).count() == 0
    # the form that the query takes, and the query itself
    for frame, rows in ((docs, texts), (spark.read.parquet(f"{SF}/documents.parquet"), dict(duck(SF).sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()))):
        coded = byte_bpe.encode(frame, ranks, pattern, ["doc_id"], digests=True)
        found = {r.doc_id: r for r in coded.collect()}
        assert found.keys() == rows.keys()
        for d, text in rows.items():
            ids = library.encode_ordinary(text) if len(text) < 250_000 else encoder.encode(text)
            assert (found[d].n_tokens, found[d].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert found[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.query(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, byte_bpe.query(spark, SF).collect())) == sorted(map(str, found.values()))
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("ab é'sll 12\n\t　!🙂") for _ in range(rng.randint(0, 120)))
        assert encoder.encode(text) == library.encode_ordinary(text)
        assert byte_bpe._merge_long(text.encode(), ranks) == byte_bpe._merge_short(text.encode(), ranks)


def test_bpe_higher_order_form(spark, bpe):
    (ranks, pattern), library = bpe
    words = sorted({w for _, t, *_ in documents()[:14] for w in byte_bpe.Encoder(ranks, pattern).pattern.findall(t or "")})[:150]
    coded = byte_bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()
    assert {r.word: r.ids for r in coded} == {w: library.encode_ordinary(w) for w in words}
    back = byte_bpe.decode_words(spark.createDataFrame([(r.word, r.ids) for r in coded[:20]], "word string, ids array<int>"), ranks).collect()
    assert all(bytes(r.decoded).decode() == r.word for r in back)


# op10


def brute_dedup(rows, least=line_dedup.MIN_WORDS):
    """Windows by text, in order of doc_id; lines of windows seen before go, and what agrees after."""
    places, first, gone = {}, {}, set()
    for d, text in rows:
        places[d] = [(n, x, len(split(x))) for n, x in enumerate(text.split("\n")) if split(x)]
    for d, _ in rows:
        lines = places[d]
        for i in range(len(lines)):
            total, j = 0, i
            while j < len(lines) and total < least:
                total += lines[j][2]
                j += 1
            if total < least:
                continue
            od, oi = first.setdefault(tuple(x[1] for x in lines[i:j]), (d, i))
            if (od, oi) != (d, i):
                k = 0
                while j + k < len(lines) and oi + (j - i) + k < len(places[od]) and lines[j + k][1] == places[od][oi + (j - i) + k][1]:
                    k += 1
                gone |= {(d, n) for n in range(lines[i][0], lines[j + k - 1][0] + 1)}
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in rows}


def test_line_dedup(spark, docs, empty):
    rng = random.Random(7)
    pool = [prose(rng, rng.randint(1, 30)) for _ in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else prose(rng, 9) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_dedup(rows)
    out = line_dedup.dedup(docs.drop("n")).collect()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert len(out) == docs.count() and by[0].text is None and by[1].text == "" and by[10].text.startswith("begin\nw") and by[10].n_removed == 2 and by[7].text == ""
    want = brute_dedup(sorted({(d, t) for d, t, *_ in documents()[:-1] if t is not None}))  # a repeated row is treated like its copy
    nameless = next(r for r in out if r.doc_id is None)
    assert {d: r.text for d, r in by.items() if r.text is not None} == want and nameless.text == documents()[-1][1]
    assert by[12].n_removed == 8  # nine equal lines: one is kept
    assert line_dedup.dedup(empty).count() == 0 and line_dedup.stage(spark, docs, "").columns == docs.columns


def brute_choice(lines, least=line_dedup.MIN_WORDS):
    """Chosen places (from 1) with their windows, of lines given as (hash, words)."""
    chosen = {}
    for i in range(len(lines)):
        total, j = 0, i
        while j < len(lines) and total < least:
            total += lines[j][1]
            j += 1
        if total >= least:
            at = min(range(i, j), key=lambda x: (lines[x][0], -x))
            chosen.setdefault(at + 1, []).append((i + 1, j))
    return chosen


def test_line_dedup_winnows(spark):
    """One row a chosen position; positions go on only if another place has their fingerprint."""
    rng = random.Random(8)
    line, common = prose(rng, 30), [prose(rng, 9) for _ in range(4)]
    texts = ["\n".join(prose(rng, 9) for _ in range(12)), "\n".join([line] * 3), "\n".join([prose(rng, 9), *common]), "\n".join([*common, prose(rng, 9)]), "\n".join([common[0]] * 8), "few words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = line_dedup.lines(df)
    lines = {r.doc.id: [(x.h, x.w) for x in r.lines] for r in found.collect()}
    want = {(d, at): (ls[at - 1][0], w) for d, ls in lines.items() for at, w in brute_choice(ls).items()}
    rows = line_dedup.fingerprints(found).collect()
    assert {(r.doc.id, r.at): (r.fingerprint, [(w["first"], w["last"]) for w in r.windows]) for r in rows} == want
    assert len(rows) == len(want) < sum(len(w) for _, w in want.values())
    places = {}
    for (d, at), (h, _) in want.items():
        places.setdefault(h, set()).add((d, at))
    got = sorted((r.doc.id, r.at) for r in line_dedup.shared(line_dedup.fingerprints(found)).collect())
    assert got == sorted(p for some in places.values() if len(some) > 1 for p in some) and {d for d, _ in got} == {1, 2, 3, 4}


def test_line_dedup_brings_two_texts_together_once(spark):
    """Texts that differ in every sixth line: many matches, one row."""
    rng = random.Random(9)
    a = [prose(rng, 9) for _ in range(600)]
    b = [prose(rng, 9) if i % 6 == 5 else x for i, x in enumerate(a)]
    rows = [(1, "\n".join(a)), (2, "\n".join(b))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = line_dedup.lines(df)
    matched = line_dedup.matches(line_dedup.shared(line_dedup.fingerprints(found)))
    assert matched.count() == 100 and matched.select("doc", "source").distinct().count() == 1
    assert {r.doc_id: r.text for r in line_dedup.dedup(df).collect()} == brute_dedup(rows) and brute_dedup(rows)[2].count("\n") == 99


# pipeline


def test_pipeline(spark, tmp_path, bpe):
    (ranks, pattern), library = bpe
    rng = random.Random(10)
    line = prose(rng, 60)
    base = prose(rng, 120)
    texts = [base, base, prose(rng, 80) + "\n" + line, prose(rng, 90) + "\n" + line, "spam! " * 80, "few words", None] + [prose(rng, 70) for _ in range(10)]
    rows = [(i, t, "en", "a" if i % 3 else "b", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(d, t) for d, t, *_ in rows if t and len(split(t)) >= 50 and "spam" not in t]
    kept = {d: t for d, t in brute_dedup(kept).items() if split(t)}
    assert {r.doc_id: r.ids for r in got} == {d: library.encode_ordinary(t) for d, t in kept.items()}
    assert max(sum(r.doc_id == d for r in got) for d in kept) <= 2


def test_pipeline_cases(spark, tmp_path, docs, bpe, monkeypatch):
    """Odd rows and columns named like working ones, then an empty table; no table is left but the result."""
    (ranks, pattern), library = bpe
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    odd = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("n_tokens", "hash", "token", "start_token", "n_lines", "n_removed", "n_words", "key", "doc", "component_id", "__row", "__block", "__text", "__id")})
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a")
    rows = got.collect()
    assert set(got.columns) == set(odd.columns) - {"text"} | {"ids"}
    assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in ("n_tokens", "hash", "n_lines", "__row", "__block", "__id", "key"))
    assert len(list((tmp_path / "shared").iterdir())) == 1
    kept = [(d, t) for d, t, *_ in documents()[:-1] if t and len(split(t)) >= 50 and d not in (12, 13)]
    kept = {d: t for d, t in brute_dedup(sorted(set(kept))).items() if split(t)}
    sizes, label = brute_components(list(kept.values()))
    first = {d for i, d in enumerate(kept) if label[i] == i}
    for r in rows:
        if r.doc_id is not None:
            assert r.doc_id in first and (len(kept[r.doc_id]) > 250_000 or r.ids == library.encode_ordinary(kept[r.doc_id]))
    assert {r.doc_id for r in rows} >= first
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    none = corpus_pipeline.run(spark, f"{tmp_path}/b")
    assert none.count() == 0 and none.columns == ["doc_id", "lang", "source", "n_chars", "ids"]


def test_shared_folder(spark):
    """Without spark.checkpoint.dir a cluster is refused, and one machine gets a temporary folder."""
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("spark://somewhere:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(Session(master))
    for master in ("local", "local[2]", "local[*]"):
        assert session.shared_dir(Session(master)).startswith("file:///")
    assert session.shared_dir(spark)


def test_labelled_rows_have_a_bound(spark, monkeypatch):
    """However many rows share an id, one of them is learnt from."""
    seen = []
    monkeypatch.setattr(quality_fm, "fit", lambda examples, labels: seen.append((len(examples), labels.tolist())))
    docs = spark.createDataFrame([(1, f"text {i} of words", 5) for i in range(500)] + [(2, "other", 1), (None, "x", 1)], "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id bigint, label int")
    quality_fm.train(docs.filter("doc_id = 1"), labels, 1)
    quality_fm.train(docs, labels)
    assert seen[0][0] <= 1 and seen[1] == (2, [1.0, 0.0])
