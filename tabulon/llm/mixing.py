"""Mixing sources to target weights: temperature mixing.

With ``T_s`` tokens in source s and shares ``p_s = T_s / T``, the weights are ``p_s^a`` normalised,
with one exponent ``a`` in [0, 1]: 1 leaves the shares, 0 makes the sources equal. Bisection finds
the smallest exponent that meets both targets given:

* entropy: the weights' entropy is at most ``entropy`` times the logarithm of the number of sources;
* repetition: no source's quota is more than ``repeats`` times its tokens.

Both quantities fall as ``a`` grows, except that repetition may be impossible to meet even at 1, when
1 is taken. Then source s has a quota of ``floor(w_s * budget)`` tokens, realised by block
permutations: its documents are dealt into blocks by a digest of the doc_id (those without one by a
digest of their number of tokens, so that they aren't one block; ``BLOCKS`` or, of large corpora, twice as many and so on, until a block of a source that held everything would have no more
than ``BLOCK_TOKENS`` tokens); each epoch orders the blocks by a digest of epoch and block, and within
a block documents are ordered by their digest. A document is scheduled in an epoch if fewer tokens than the quota come before it, so whole
epochs repeat every document and the last one is cut within a block.

Prefix sums are made in two levels, over a source's blocks and within a block, so a source that holds
a third of the rows is spread over its blocks. Texts are scanned once to count their words; the counts
are written as a table without texts, from which all totals come. Rows move once, by source and block,
with their texts only if the schedule is to hold them. The exponent is found in a few jobs over the table of source totals, which is never collected: each job tests the 63
points of six halvings. All in DataFrame functions.

Defined cases: a null source is a source; null and empty texts have no tokens, and a source without
tokens has no quota and is not scheduled; rows with equal doc_id are ordered by their tokens, and
equal rows are scheduled each; a text of any length is one document, counted whole and never cut;
columns named epoch, start_token or n_tokens are replaced, others passed on (those named like working
columns too); an empty table gives an empty schedule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.session import cut, table

BLOCKS, BLOCK_TOKENS, HALVINGS, SEED = 1024, 1 << 24, 48, "mix"
ENTROPY, REPEATS = 0.97, 4.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def block_of(doc_id: Column, n_tokens: Column, blocks: int) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("tokens "), n_tokens.cast("string")))
    return F.conv(F.substring(_digest(key), 1, 8), 16, 10).cast("long") % blocks


def exponent(totals: DataFrame, budget: int | None, entropy: float | None, repeats: float | None) -> float:
    """The smallest exponent in [0, 1] that meets the targets, by bisection. ``totals``: ln_p and
    tokens of each source. Without a budget, it follows the weights: the smallest that gives every
    source all its tokens once; then repetition can always be met by an exponent of 1."""
    low, width, left = 0.0, 1.0, HALVINGS
    n = totals.count()
    while left > 0:
        steps = min(6, left)
        points = [low + width * i / 2**steps for i in range(1, 2**steps)]
        a = F.explode(F.array(*map(F.lit, points))).alias("a")
        weighed = totals.select("ln_p", "tokens", a).withColumn("q", F.exp(F.col("a") * F.col("ln_p")))
        sums = weighed.groupBy("a").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.col("a") * F.col("ln_p")).alias("e"), F.max(F.col("q") / F.col("tokens")).alias("r"), F.max(F.col("tokens") / F.col("q")).alias("c"))
        met = {}
        for row in sums.collect():  # 63 rows
            h = math.log(row["z"]) - row["e"] / row["z"]
            most = row["r"] * row["c"] if budget is None else row["r"] / row["z"] * budget
            met[row["a"]] = (entropy is None or h <= entropy * math.log(n)) and (repeats is None or most <= repeats)
        # the halvings that these points make possible
        for _ in range(steps):
            width /= 2
            if not met.get(low + width, True):
                low += width
        left -= steps
    return low + width / 2


def quotas(totals: DataFrame, budget: int | None, entropy: float | None, repeats: float | None) -> DataFrame:
    """source, tokens, weight and quota. Without a budget, the smallest that gives every source at
    least all its tokens once."""
    known = cut(totals.filter("tokens > 0"))
    whole = known.agg(F.sum("tokens").alias("t")).first()["t"]
    if whole is None:
        return known.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
    shares = known.withColumn("ln_p", F.log(F.col("tokens") / F.lit(float(whole))))
    a = exponent(shares, budget, entropy, repeats)
    powered = shares.withColumn("q", F.exp(F.lit(a) * F.col("ln_p")))
    z, r = powered.agg(F.sum("q"), F.max(F.col("tokens") / F.col("q"))).first()
    budget = math.ceil(r * z) if budget is None else budget
    weight = F.col("q") / F.lit(z)
    quota = F.floor(weight * F.lit(float(budget)) + 1e-6).cast("long")
    return powered.select("source", "tokens", weight.alias("weight"), quota.alias("quota"))


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_tokens, the words of its column text, which goes: of the texts nothing else is read."""
    columns = [F.col(c) for c in docs.columns if c not in ("n_tokens", "text")]
    return docs.select(*columns, n_words(F.col("text")).alias("n_tokens"))


def n_blocks(tokens: int) -> int:
    blocks = BLOCKS
    while tokens > blocks * BLOCK_TOKENS:
        blocks *= 2
    return blocks


def schedule(rows: DataFrame, counts: DataFrame, budget: int | None = None, entropy: float | None = ENTROPY, repeats: float | None = REPEATS) -> DataFrame:
    """Each scheduled use of a row of ``rows`` (doc_id, source, n_tokens and others), with epoch and
    start_token, the tokens of its source that come before it. ``counts`` holds doc_id, source and
    n_tokens of the same rows, to be read several times. ``budget`` is in tokens; -1: as many as there are."""
    columns = [c for c in rows.columns if c not in ("n_tokens", "epoch", "start_token")]
    whole = counts.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0
    budget, blocks = whole if budget == -1 else budget, n_blocks(whole)
    # working columns beside the row, so that no name clashes
    held = F.struct(*columns).alias("__row") if columns else F.lit(None).alias("__row")
    block = block_of(F.col("doc_id"), F.col("n_tokens"), blocks).alias("__block")
    totals = cut(counts.select("source", block, "n_tokens").groupBy("source", "__block").agg(F.sum("n_tokens").alias("tokens")))
    plan = quotas(totals.groupBy("source").agg(F.sum("tokens").alias("tokens")), budget, entropy, repeats)
    epochs = F.explode(F.sequence(F.lit(0), F.ceil(F.col("quota") / F.col("all_tokens")).cast("int") - 1)).alias("__epoch")
    named = plan.filter("quota > 0").select(F.col("source").alias("q_source"), F.col("tokens").alias("all_tokens"), "quota")
    turns = totals.join(named, F.col("source").eqNullSafe(F.col("q_source"))).select("source", "__block", "tokens", "all_tokens", "quota", epochs)
    order = Window.partitionBy("source", "__epoch").orderBy(_digest(F.col("__epoch"), F.col("__block")), "__block").rowsBetween(Window.unboundedPreceding, -1)
    begins = turns.withColumn("begin", F.col("__epoch") * F.col("all_tokens") + F.coalesce(F.sum("tokens").over(order), F.lit(0))).filter("begin < quota")
    begins = begins.groupBy("source", "__block").agg(F.collect_list(F.struct(F.col("__epoch").alias("epoch"), "begin")).alias("__begins"), F.first("quota").alias("__quota"))
    # keys without nulls, so that the join finds the rows where the window has put them
    key = [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"), F.col("source").isNull().alias("__none")]
    begins = begins.select(*key, "__block", "__begins", "__quota")
    placed = rows.select(held, *key, F.col("doc_id").alias("__id"), F.col("n_tokens").alias("__n"), block)
    inner = Window.partitionBy("__source", "__none", "__block").orderBy(_digest(F.col("__id")), "__id", "__n").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__before", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    joined = placed.join(begins, ["__source", "__none", "__block"])
    used = F.filter(F.transform("__begins", lambda e: F.struct(e["epoch"].alias("epoch"), (e["begin"] + F.col("__before")).alias("start_token"))), lambda e: e["start_token"] < F.col("__quota"))
    out = joined.select("__row", "__n", F.explode(used).alias("__use"))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in columns], F.col("__n").alias("n_tokens"), "__use.epoch", "__use.start_token")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule of as many tokens as there are: large sources lose some, small ones repeat."""
    counts = cut(counted(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return schedule(counts, counts, -1)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with the smallest budget that uses every document at least once, and none more than
    twice: small sources are repeated, nothing is left out."""
    counts = cut(counted(docs.select("doc_id", "source", "text")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("n_tokens"))
    return schedule(rows, counts, None, entropy=None, repeats=2.0).select("row.*")


#: The same rows in DuckDB: one bisection step a recursion.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS n_tokens, md5('mix|' || doc_id) AS h FROM documents
), x AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % 1024 AS block FROM d),
s AS (SELECT source, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
g AS (SELECT sum(tokens) AS whole, sum(tokens) AS budget, count(*) AS n FROM s),
p AS (SELECT source, tokens, ln(tokens / whole) AS lp FROM s, g),
v AS (SELECT list(struct_pack(lp := lp, t := tokens)) AS l FROM p),
bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS width
  UNION ALL
  SELECT step + 1, CASE WHEN ln(z) - e / z <= 0.97 * ln(n) AND r / z * budget <= 4.0 THEN low ELSE low + width / 2 END, width / 2
  FROM (SELECT step, low, width, list_sum(list_transform(l, lambda q: exp((low + width / 2) * q.lp))) AS z,
      list_sum(list_transform(l, lambda q: exp((low + width / 2) * q.lp) * (low + width / 2) * q.lp)) AS e,
      list_max(list_transform(l, lambda q: exp((low + width / 2) * q.lp) / q.t)) AS r, n, budget
    FROM bisect, v, g WHERE step < 48)
), a AS (SELECT low + width / 2 AS a FROM bisect WHERE step = 48),
w AS (SELECT source, tokens, exp(a * lp) / sum(exp(a * lp)) OVER () AS weight FROM p, a),
q AS (SELECT source, tokens::BIGINT AS all_tokens, floor(weight * budget + 1e-6)::BIGINT AS quota FROM w, g),
b AS (SELECT source, block, sum(n_tokens)::BIGINT AS tokens FROM x GROUP BY ALL),
t AS (SELECT source, block, tokens, all_tokens, quota, unnest(range(0, ceil(quota / all_tokens)::BIGINT)) AS epoch FROM b JOIN q USING (source) WHERE quota > 0),
o AS (SELECT source, block, epoch, quota, epoch * all_tokens + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY md5('mix|' || epoch || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM t),
i AS (SELECT doc_id, source, block, n_tokens, coalesce(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, (begin + before)::BIGINT AS start_token FROM i JOIN o USING (source, block) WHERE begin + before < quota
"""
