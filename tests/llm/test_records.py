"""Whitening, golden records and secret scans against plain versions."""

import base64
import hashlib
import json
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from compare import duck
from pyspark.sql import functions as F

from tabulon.llm import embedding_whitening as ew
from tabulon.llm import golden_record, secret_scan

SF = "/root/testdata/sf0.001"


# embedding whitening


def plain_whitening(vectors):
    """id, deviation, |whitened| of each component, by the covariance and its eigenvectors."""
    kept = [(i, np.array(v, float)) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    gap = n * x - s
    centred = (gap / n).astype(float)
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    k = min(8, len(e))
    e, vec = e[::-1][:k], vec[:, ::-1][:, :k]
    return {i: (n, int((g**2).sum()), np.abs(w), share) for (i, _), g, w, share in zip(kept, gap, centred @ vec / np.sqrt(e), [e / np.var(x.astype(float), axis=0).sum()] * n)}


def check_whitening(df, want):
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(want)
    for i, (n, deviation, w, share) in want.items():
        rows = got[i]
        assert sorted(rows) == list(range(1, len(w) + 1))
        assert all(r.n == n and r.deviation == deviation and 0 <= r.identity_error < 1e-9 for r in rows.values())
        assert np.allclose([abs(rows[k + 1].whitened) for k in range(len(w))], w, atol=1e-8)
        assert np.allclose([rows[k + 1].explained for k in range(len(w))], share, rtol=1e-8)


def test_whitening_query_by_a_plain_version(spark):
    rows = duck(SF).sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    check_whitening(ew.query(spark, SF), plain_whitening(rows))


VEC = "vec_id bigint, embedding array<float>, label int"


def test_whitening_of_odd_rows(spark, monkeypatch):
    """Null, empty, broken and short vectors go; repeated rows and clashing columns stay; many partitions
    and small blocks give the same."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, [3, 2, 1, 0.5])], 0) for i in range(60)]
    odd = [(100, None, 0), (101, [], 0), (102, [1.0, None, 2.0, 3.0], 0), (103, [1.0, float("nan"), 2.0, 3.0], 0), (104, [float("inf"), 0.0, 2.0, 3.0], 0)]
    short = [(105, [1.0, 2.0], 0)] * 3
    df = spark.createDataFrame(rows + odd + short, VEC).withColumns({c: F.lit("x") for c in ("id", "v", "part", "component", "n")})
    want = plain_whitening([(i, v) for i, v, _ in rows])
    check_whitening(ew.whiten(df.coalesce(1)), want)
    monkeypatch.setattr(ew, "BLOCK", 1)
    check_whitening(ew.whiten(df.repartition(37)), want)
    third = df.filter("vec_id < 60").unionByName(df.filter("vec_id = 7").withColumn("vec_id", F.explode(F.sequence(F.lit(200), F.lit(229)))).withColumn("vec_id", F.col("vec_id").cast("bigint")))
    check_whitening(ew.whiten(third), plain_whitening([(i, v) for i, v, _ in rows] + [(200 + j, rows[7][1]) for j in range(30)]))


def test_whitening_keeps_ids_as_they_are(spark):
    got = ew.whiten(spark.createDataFrame([(None, [1.0, 2.0], 0), (3, [2.0, 1.0], 0), (3, [2.0, 1.0], 0)], VEC)).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == [(-1, 1), (-1, 2), (3, 1), (3, 1), (3, 2), (3, 2)]
    assert all((r.whitened is None) == (r.component == 2) for r in got)  # all on one line
    assert {round(r.explained, 9) for r in got} == {0.0, 1.0}


def test_whitening_without_variance_and_without_rows(spark):
    same = ew.whiten(spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0) for i in range(4)], VEC)).collect()
    assert len(same) == 12 and all(r.whitened is None and r.identity_error is None and r.deviation == 0 and r.explained == 0 for r in same)
    none = ew.whiten(spark.createDataFrame([(1, None, 0)], VEC))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_are_exact_beyond_64_bits(spark):
    schema = "vec_id bigint, embedding array<double>"
    rows = [(0, [2.0**49, 0.0]), (1, [-(2.0**49), 1.0]), (2, [0.0, 2.0])]
    got = {r.vec_id: r for r in ew.whiten(spark.createDataFrame(rows, schema)).filter("component = 1").collect()}
    assert got[0].deviation is None and got[1].deviation is None and got[2].deviation == 3072**2
    assert abs(got[2].whitened) < 1e-9 and ew.whiten(spark.createDataFrame([(0, [2.0**50])], schema)).count() == 0
    x = np.array([[5, -7], [2**40, 3]])
    at = ew.Centre(2**30, [17, 2**61])
    assert [[int(v) for v in r] for r in at.deviations(x)] == [[5 * 2**30 - 17, -7 * 2**30 - 2**61], [2**70 - 17, 3 * 2**30 - 2**61]]


# golden records

CLIENTS = "client_id bigint, master_id bigint, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def plain_golden(rows):
    clusters = {}
    for r in rows:
        clusters.setdefault(r[1] if r[1] is not None else r[0], []).append(r)
    out = {}
    for cluster, members in clusters.items():
        text = lambda x: None if x is None or re.fullmatch(r"[\x20\x09-\x0D]*", x) else x
        members = [dict(id=r[0], trust={"store": 4, "crm": 3, "partner": 2, "web": 1}.get(r[2], 0), at=r[3], name=text(r[4]), email=text(r[5]), city=text(r[6]), nation=r[7], segment=text(r[8]), balance=r[9]) for r in members]
        latest = max((m["at"] for m in members if m["at"]), default=None)
        for m in members:
            m["stale"] = m["at"] is None or latest - m["at"] > timedelta(hours=240)
        recent = lambda m: (m["at"] is None, -(m["at"] - datetime(1970, 1, 1)).total_seconds() if m["at"] else 0, -m["trust"], m["id"] is None, m["id"] or 0)
        trusted = lambda m: (m["stale"], -m["trust"], recent(m))

        def best(field, key):
            return min((m for m in members if m[field] is not None), key=lambda m: (key(m), m[field]), default=None)

        segment = best("segment", recent)
        chosen = segment and segment["segment"]
        name, email = best("name", lambda m: (-len(m["name"]), trusted(m))), best("email", trusted)
        balance = best("balance", lambda m: (m["segment"] != chosen, recent(m)))
        address = min(members, key=lambda m: (-(m["city"] is not None) - (m["nation"] is not None), recent(m), m["city"] or "", m["nation"] or 0))
        of = lambda m, f: m and m[f]
        filled = address["city"] is not None or address["nation"] is not None
        cents = balance and int(np.floor(100 * balance["balance"] + 0.5))
        out[cluster] = (len(members), sum(m["stale"] for m in members), of(name, "name"), of(email, "email"), chosen, address["city"], address["nation"], cents, of(name, "id"), of(email, "id"), of(segment, "id"), of(balance, "id"), address["id"] if filled else None)
    return out


def made_clients(n, seed):
    """Few values, so that all criteria tie; a hot cluster, nulls, blanks, unknown sources."""
    rng = random.Random(seed)
    day = datetime(2024, 3, 1)
    some = lambda *x: rng.choice([None, "", " \t", *x])
    rows = []
    for i in range(n):
        at = None if rng.random() < 0.1 else day - timedelta(days=rng.choice([0, 1, 10, 11]), microseconds=rng.choice([0, 1]))
        master = rng.choice([None, 1, 1, rng.randrange(n // 3)])
        rows.append((i, master, rng.choice(["store", "crm", "partner", "web", "other", None]), at, some("Ann", "Ännë", "Anna B", "🙂🙂🙂🙂🙂🙂"), some("a@x", "b@x"), some("Ar", "Bel"), rng.choice([None, 3, 4]), some("retail", "public"), rng.choice([None, -0.005, 12.345, 99.995])))
    return rows


@pytest.mark.parametrize("salts", [1, 5])
def test_golden_records_by_a_plain_version(spark, salts):
    rows = made_clients(400, salts)
    df = spark.createDataFrame(rows, CLIENTS).withColumns({c: F.lit(1) for c in ("k", "none", "salt", "n", "fresh", "is_name", "salts", "chosen")})
    got = golden_record.golden(df.repartition(3), salts).collect()
    assert {r.cluster_id: tuple(r)[1:] for r in got} == plain_golden(rows) and len(got) == len(plain_golden(rows))


def test_golden_records_of_odd_tables(spark):
    assert golden_record.golden(spark.createDataFrame([], CLIENTS), 4).count() == 0
    at = datetime(2024, 1, 1)
    rows = [(None, None, "crm", at, "A", None, None, None, "s", 1.0), (None, None, "crm", at, "B", None, None, None, None, float("nan")), (5, 5, None, None, "n" * 300_000, "", "\n", None, None, None), *[(7, 7, "web", at, "same", "e", "c", 1, "s", 2.0)] * 40]
    got = {r.cluster_id: r for r in golden_record.golden(spark.createDataFrame(rows, CLIENTS), 4).collect()}
    assert set(got) == {None, 5, 7}
    assert (got[None].n_records, got[None].name, got[None].balance_cents, got[None].name_from) == (2, "A", 100, None)
    assert (len(got[5].name), got[5].n_stale, got[5].email, got[5].city, got[5].address_from) == (300_000, 1, None, None, None)
    assert (got[7].n_records, got[7].n_stale, got[7].balance_from, got[7].city) == (40, 0, 7, "c")


def test_zoned_timestamps_give_the_same(spark):
    rows = made_clients(120, 9)
    ntz = spark.createDataFrame(rows, CLIENTS)
    zoned = ntz.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    assert sorted(map(str, golden_record.golden(ntz, 3).collect())) == sorted(map(str, golden_record.golden(zoned, 3).collect()))


# secret scans


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def integer(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def ssh_string(x):
    return len(x).to_bytes(4, "big") + x


RNG = random.Random(8)
OID_RSA, OID_PBES2 = der(6, bytes.fromhex("2a864886f70d010101")), der(6, bytes.fromhex("2a864886f70d01050d"))
PKCS1 = der(0x30, integer(0), *[integer(RNG.getrandbits(n) | 1) for n in (512, 17, 512, 256, 256, 256, 256, 256)])
PKCS8 = der(0x30, integer(0), der(0x30, OID_RSA, der(5)), der(4, PKCS1))
SEC1 = der(0x30, integer(1), der(4, RNG.randbytes(32)), der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")), der(0xA1, der(3, b"\0" + RNG.randbytes(65))))
DSA = der(0x30, integer(0), *[integer(RNG.getrandbits(200) | 1) for _ in range(5)])
LOCKED = der(0x30, der(0x30, OID_PBES2, der(0x30)), der(4, RNG.randbytes(300)))
SSH = b"openssh-key-v1\0" + ssh_string(b"none") * 2 + ssh_string(b"") + (1).to_bytes(4, "big") + ssh_string(RNG.randbytes(51)) + ssh_string(RNG.randbytes(136))
KEYS = [PKCS1, PKCS8, SEC1, DSA, LOCKED, SSH]
PUBLIC = der(0x30, der(0x30, OID_RSA, der(5)), der(3, b"\0" + der(0x30, integer(RNG.getrandbits(512)), integer(65537))))


def b64(x):
    return base64.b64encode(x).decode()


def lines(x, by=64):
    return "\n".join(x[i : i + by] for i in range(0, len(x), by))


def pem(x):
    return f"-----BEGIN PRIVATE KEY-----\n{lines(b64(x))}\n-----END PRIVATE KEY-----\n"


def url64(x):
    return base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")


def token(alg="HS256", size=32):
    return ".".join([url64({"alg": alg, "typ": "JWT"}), url64({"sub": "1"}), url64(RNG.randbytes(size))])


def found(text):
    return [(text[a:b], kind) for a, b, kind in secret_scan.spans(text)]


@pytest.mark.parametrize("key", KEYS)
def test_keys_are_found_in_every_encoding(key):
    plain = b64(key)
    ways = [plain, lines(plain), lines(plain).replace("\n", "\r\n"), lines(plain).replace("\n", "\\n"), lines(plain, 76).replace("\n", "\n    "), url64(key)]
    for way in ways:
        text = f"é key: {way} end\nabc"
        assert found(text) == [(way, "key")], way
    assert (key.hex(), "key") in found(f"0x{key.hex()}.") and found(f"<{key.hex().upper()}>") == [(key.hex().upper(), "key")]
    twice = b64(pem(key).encode())
    assert found(f"data: {twice}\n") == [(twice, "key")]
    assert found(f"{pem(key)} and {plain}") == [(lines(plain), "key"), (plain, "key")]


def test_what_is_no_key():
    rng = random.Random(2)
    for key in KEYS:
        plain = b64(key)
        assert not found(plain[:-8]) and not found(plain[: len(plain) // 2]) and not found("A" + plain)
        assert not found(plain.rstrip("=") + "ABCD") and not found(b64(key[:-1]))
    broken = bytearray(PKCS8)
    broken[5] ^= 0x7F
    assert not found(b64(bytes(broken))) and not found(b64(PUBLIC)) and not found(pem(PUBLIC)) and not found(b64(pem(PUBLIC).encode()))
    assert not found(b64(der(0x30, der(0x30, der(6, b"\x55\x04\x03")), der(4, b"x" * 40)))) and not found(b64(SSH[:-20]))
    assert not any(k == "key" for _ in range(300) for _, k in found(b64(rng.randbytes(rng.randrange(20, 400)))))
    assert not found("\n".join(["MII" + "A" * 61] * 3000)) and not found("x" * 300_000) and not found("a." * 100_000)


def test_tokens_by_their_headers():
    one, two = token(), token("RS256", 256)
    assert found(f"see {one} and {two}.") == [(one, "token"), (two, "token")]
    assert found(f"prefix.{one}.{two}") == [(one, "token"), (two, "token")]
    other = token("X9", 16)
    assert found(other) == [(other, "token")]
    for bad in (token("none", 32), token("HS256", 31), token("X9", 15), ".".join(one.split(".")[:2]) + ".", one.replace("eyJ", "fyJ", 1), ".".join([url64({"typ": "JWT", "x": "HS256"}), *one.split(".")[1:]]), ".".join([url64(["alg", "HS256", 1]), *one.split(".")[1:]])):
        assert not found(bad), bad


def plain_base(text):
    """The three kinds by their form, straight from the rules."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x for *_, x in sorted(out)]


def odd_texts():
    rng = random.Random(4)
    parts = ["password", "PassWd", "token", "toKen", "ſecret", "api_key", "APIkey", "secret", ": ", "=", ' = "', "'", "abcdefgh", "abc", "AKIA", "Z9" * 6, "0123456789abcdef" * 2, "0" * 31, " ", "\n", "é🙂", "==", "token=secret=abcdefgh12"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    return [None, "", " ", *texts, "password: token: abcdefghij", "x" * 200_000 + " token = " + "9" * 40, token(), pem(PKCS8), "AKIAAKIA" + "A" * 8]


def test_base_kinds_by_a_plain_version(spark):
    texts = odd_texts()
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("spans", "kind", "lang")})
    got = secret_scan.find(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    mine = sorted([(r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in secret_scan.BASE)) for r in got], key=key)
    assert mine == sorted([(i, ",".join(plain_base(t or ""))) for i, t in rows], key=key)
    assert sum(s.kind == "token" for r in got for s in r.spans) == 1 and sum(s.kind == "key" for r in got for s in r.spans) == 1
    assert secret_scan.find(df.limit(0)).count() == 0


def test_scan_query_by_a_plain_version(spark):
    rows = duck(SF).sql("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: r for r in secret_scan.query(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base = plain_base(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        assert [x for x in got[i].spans.split(",") if x and x.split(":")[0] in secret_scan.BASE] == base
