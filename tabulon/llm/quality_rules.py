"""Quality rules: a rule bitmask ledger.

Every rule is evaluated once per document. The ledger keeps one bit per failed rule next to the
measurements, so that policies (sets of enforced rules, by version) are later applied as a bit
mask without reading a text again, and ablations are sums over a histogram of the bit masks.

Defined cases: a null or empty text has no words, so all measurements are 0 and ``few_words``
fails; a text of any length is measured whole, in pieces of some 256 KB; ties and repeated rows get a
ledger row each; other columns, ``doc_id`` included, are passed on
untouched (a column named like one of the ledger's is replaced); an empty table gives an empty
ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.measures import NAMES, measure
from tabulon.llm.session import arrow, table, unused

#: Bit number, name and failure condition (SQL over the measurements; integers only).
RULES = [
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "short_words", "word_chars < 2 * n_words"),
    (3, "long_words", "word_chars > 15 * n_words"),
    (4, "symbols", "100 * n_symbols > 20 * n_words"),
    (5, "repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    (6, "capitals", "n_upper > n_lower"),
    (7, "exclamations", "100 * n_bangs > 30 * n_words"),
    (8, "digits", "100 * n_digits > 30 * word_chars"),
]
BITS = {name: bit for bit, name, _ in RULES}
#: Policies by version: the names of the rules each enforces.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines", "capitals", "exclamations", "digits"],
}


def mask(policy: str | list[str]) -> int:
    return sum(1 << BITS[x] for x in (POLICIES[policy] if isinstance(policy, str) else policy))


def failure_bits(rules: list[tuple[int, str, str]] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for bit, _, condition in rules:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but ``text`` if None) with measurements and ``failed`` (the bits).
    One scan, no shuffle."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NAMES and (keep is not None or c != "text")]
    whole = unused("text", keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"{x} bigint" for x in NAMES)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(whole))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(found[x]) for x in NAMES)], names=[*keep, *NAMES])

    read = docs.select(*keep, F.col("text").alias(whole))
    return arrow(read, scan, schema).withColumn("failed", failure_bits())


def kept(policy: str | list[str]) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """For each enforced rule: documents that fail it, that fail no other enforced rule, and that the
    policy without it would keep. The documents are first reduced to a histogram of bit masks (at
    most 2 to the number of rules), each rule then sums over it."""
    enforced = mask(policy)
    histogram = led.groupBy(F.col("failed").bitwiseAND(F.lit(enforced).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, name, _ in RULES if enforced >> bit & 1])
    each = histogram.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("fails_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(-1).cast("long").bitwiseXOR(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~kept("base")).alias("base_failed"), kept("v1").alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps, as they came. The text is measured beside the row, so that no
    join is needed."""
    columns = docs.columns
    held = docs.select(F.struct(*columns).alias("row"), "text")
    return ledger(held, ["row"]).filter(kept("v1")).select("row.*")


#: The same rows in DuckDB. Word positions are windowed over each text; a word is covered when a
#: three-word window that starts at it or at most two words before it occurs twice or more.
SQL = r"""
WITH words AS (
  SELECT doc_id, w, i FROM (
    SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents))
), windows AS (
  SELECT doc_id, i, w, lead(w, 1) OVER t AS w2, lead(w, 2) OVER t AS w3 FROM words WINDOW t AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS again FROM windows
), covered AS (
  SELECT doc_id, again OR coalesce(lag(again, 1) OVER t, false) OR coalesce(lag(again, 2) OVER t, false) AS c
  FROM twice WINDOW t AS (PARTITION BY doc_id ORDER BY i)
), repeats AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE c) AS n_repeat_words FROM covered GROUP BY doc_id
), lengths AS (
  SELECT doc_id, sum(length(w)) AS word_chars FROM words GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), chars AS (
  SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g')) AS n_lower,
    length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(coalesce(text, ''), '[^!?]', '', 'g')) AS n_bangs
  FROM documents
), m AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    n_upper, n_lower, n_digits, n_bangs
  FROM chars LEFT JOIN repeats USING (doc_id) LEFT JOIN lengths USING (doc_id) LEFT JOIN lines USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 60 * n_lines
       OR n_upper > n_lower OR 100 * n_bangs > 30 * n_words OR 100 * n_digits > 30 * word_chars) AS kept
FROM b
"""
