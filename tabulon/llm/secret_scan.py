"""Secret scans with structural confirmation.

Three kinds of secrets are found by their form alone:

* ``assign``: a name such as password or token, a sign, and a value of 8 characters or more;
* ``access``: AKIA and upper-case letters or digits, 16 characters or more;
* ``hex``: 32 lower-case hexadecimal digits or more.

Two more are candidates until their content is read:

* ``key``: a run of base64 (over several lines, real or escaped) or of hexadecimal digits is decoded and
  has to be a private key: nested lengths that end where the structure ends (PKCS #1, PKCS #8 plain or
  encrypted, SEC 1, the six numbers of DSA), a private key file of the SSH tools, or PEM text that
  holds one of these.
* ``token``: of parts of base64url with dots between, three in a row are a signed token if the first is a
  JSON object that names its algorithm, the second decodes, and the third is as long as a signature of
  that algorithm (at least 16 bytes for algorithms not known here). Unsigned tokens are none.

Public keys, certificates and encoded data of other sorts are not reported.

One scan, no shuffle: a vectorised search passes by texts without any candidate; the others are read in
Python. A key is decoded from where a run begins (what is glued before it in the same alphabet hides
it), has at most 65,539 bytes, and is read no further than its lengths say, so that work is linear in a
text's length.

Defined cases: a null text counts as empty; empty texts have no spans; texts of any length are scanned
whole; positions are code points, the end exclusive; spans are sorted by start, then kind as listed;
spans of different kinds may overlap, those of one kind don't; repeated rows are scanned each, and ids may be null or equal; other
columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.session import arrow, table

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "key", "token"]

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs that may be encoded: long enough for the shortest key (a SEC 1 key has 25 bytes or more).
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}(?![0-9A-Fa-f])")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
#: What stands between two lines of one encoded block.
BREAK = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t]*")
MORE = re.compile(r"[A-Za-z0-9+/_-]+")
#: A text without a match of this has nothing to report. (Syntax of the vectorised search.)
MAYBE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|[A-Za-z0-9+/_-]{24}"""

#: Bytes of a signature, by algorithm; those not listed take 16 or more.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64, "EdDSA": 64}
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Encodings of the object identifiers under which keys are encrypted (PKCS #5, PKCS #12).
ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
SSH = b"openssh-key-v1\x00"
#: Bytes of a key, at most: what two bytes of length can say.
LARGEST = 65_539


def header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the element at ``at``, if its length has the shortest form."""
    if at + 2 > len(data):
        return None
    size, begin = data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or begin + n > len(data):
            return None
        size, begin = int.from_bytes(data[begin : begin + n], "big"), begin + n
        if size < 0x80 or size < 1 << 8 * (n - 1):
            return None
    return data[at], begin, begin + size


def elements(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill this range, None if they don't end where it ends."""
    found, at = [], begin
    while at < end:
        one = header(data, at)
        if one is None or one[2] > end or len(found) > 64:
            return None
        found.append(one)
        at = one[2]
    return found


def is_der_key(data: bytes) -> bool:
    """Whether these bytes are one private key, all of them."""
    top = header(data, 0)
    if top is None or top[0] != SEQUENCE or top[2] != len(data):
        return False
    parts = elements(data, top[1], top[2])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    number = lambda i: int.from_bytes(data[parts[i][1] : parts[i][2]], "big", signed=True)
    if all(t == INTEGER for t in tags[:9]) and len(tags) in (6, 9) or len(tags) == 10 and tags == [INTEGER] * 9 + [SEQUENCE]:
        return number(0) in (0, 1) and all(number(i) > 0 for i in range(1, 6))
    if tags[:2] == [INTEGER, OCTETS]:  # SEC 1
        return number(0) == 1 and 14 <= parts[1][2] - parts[1][1] <= 80 and set(tags[2:]) <= {0xA0, 0xA1}
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS #8
        inner = elements(data, parts[1][1], parts[1][2])
        return number(0) in (0, 1) and bool(inner) and inner[0][0] == OID and parts[2][2] - parts[2][1] >= 14 and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
    if tags == [SEQUENCE, OCTETS]:
        inner = elements(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == OID and data[inner[0][1] : inner[0][2]].startswith(ENCRYPTED)
    return False


def ssh_key(data: bytes) -> int:
    """Bytes of the SSH private key that begins here: fields with their lengths; 0 if there is none."""
    if not data.startswith(SSH):
        return 0

    def field(at: int) -> int:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data) + 1
        if end > len(data):
            raise ValueError
        return end

    try:
        at = field(field(field(len(SSH))))
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not 1 <= n <= 64:
            return 0
        for _ in range(n):
            at = field(at)
        end = field(at)
        return end if end - at > 16 else 0
    except ValueError:
        return 0


def decode64(text: str) -> bytes:
    """Base64 of either alphabet, without padding; what is left of a group of four is dropped."""
    text = text.replace("-", "+").replace("_", "/")
    text = text[: len(text) - (len(text) % 4 == 1)]
    return base64.b64decode(text + "=" * (-len(text) % 4))


def base64_key(text: str, begin: int, end: int) -> int:
    """The end of the key whose base64 begins with the run from ``begin`` to ``end``; 0 if it is none."""
    head = decode64(text[begin : begin + 24])
    top = header(head, 0)
    if head.startswith((SSH[:15], b"-----BEGIN")):
        need = None
    elif top and top[0] == SEQUENCE:
        need = -(-top[2] * 4 // 3)  # characters
        if top[2] > LARGEST:
            return 0
    else:
        return 0
    runs, have, at = [(begin, end)], end - begin, end
    while have < (need or LARGEST * 4 // 3):
        gap = BREAK.match(text, at)
        run = MORE.match(text, gap.end()) if gap else None
        if run is None:
            break
        runs.append(run.span())
        have, at = have + run.end() - run.start(), run.end()
    if need is None:
        data = decode64("".join(text[a:b] for a, b in runs))
        size = len(data) if data.startswith(b"-----BEGIN") else ssh_key(data)
        if data.startswith(b"-----BEGIN") and not pem_key(data):
            return 0
        need = -(-size * 4 // 3)
        if not size:
            return 0
    elif have < need:
        return 0
    for i, (a, b) in enumerate(runs):  # where the last character that is needed stands
        if need <= b - a:
            if need < b - a:  # the run goes on: not the end of a block
                return 0
            data = decode64("".join(text[x:y] for x, y in runs[: i + 1]))
            if not (is_der_key(data) or ssh_key(data) == len(data) or data.startswith(b"-----BEGIN")):
                return 0
            while b < len(text) and text[b] == "=" and (need + b - runs[i][1]) % 4:
                b += 1
            return b
        need -= b - a
    return 0


def pem_key(data: bytes) -> bool:
    """Whether encoded text holds a private key between PEM marks."""
    text = data.decode("latin-1")
    mark = re.match(r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*", text)
    run = MORE.match(text, mark.end()) if mark else None
    return bool(run) and not decode64(text[run.start() : run.start() + 24]).startswith(b"-----") and base64_key(text, *run.span()) > 0


def token_size(alg: str, signature: bytes) -> bool:
    if alg.lower() == "none":
        return False
    if alg[:2] in ("RS", "PS"):
        return len(signature) >= 128
    return len(signature) == SIGNATURE[alg] if alg in SIGNATURE else len(signature) >= 16


def is_token(parts: list[str]) -> bool:
    """Whether header, payload and signature of a signed token stand here."""
    if any(len(p) % 4 == 1 for p in parts) or len(parts[0]) < 15 or len(parts[2]) < 22:
        return False
    first = decode64(parts[0][:4])
    if first[:1] not in (b"{", b" ", b"\n", b"\r", b"\t"):
        return False
    try:
        said = json.loads(decode64(parts[0]))
    except (ValueError, RecursionError):
        return False
    alg = said.get("alg") if isinstance(said, dict) else None
    return isinstance(alg, str) and alg != "" and token_size(alg, decode64(parts[2]))


def confirmed(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and kind of what decodes to a key or a signed token."""
    found = []
    after = 0
    for m in BASE64.finditer(text):
        if m.start() >= after and (end := base64_key(text, *m.span())):
            found.append((m.start(), end, "key"))
            after = end
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and m[0][:2] in ("30", "6f", "6F"):
            data = binascii.unhexlify(m[0])
            if is_der_key(data) or ssh_key(data) == len(data):
                found.append((*m.span(), "key"))
    for m in DOTTED.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(parts):
            if is_token(parts[i : i + 3]):
                end = at + sum(map(len, parts[i : i + 3])) + 2
                found.append((at, end, "token"))
                at, i = end + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1
    return found


def spans(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and kind of every secret, sorted."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found + confirmed(text), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            maybe = pc.fill_null(pc.match_substring_regex(text, MAYBE), False).to_pylist()
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in spans(text[i].as_py())] if m else [] for i, m in enumerate(maybe)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), scan, f"doc_id bigint, spans {SPANS}")


def written(found: Column) -> Column:
    """Spans as kind:start:end, with commas between."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = written(F.filter("spans", lambda x: x["kind"].isin(BASE)))
    counts = [n(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
