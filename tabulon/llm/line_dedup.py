"""Line dedup: winnowing over line hashes.

Lines are the parts of a text between line feeds; those without a word are passed over. From each
line on, a window is the shortest run of lines with at least ``MIN_WORDS`` words. Of each window the
line with the smallest hash is chosen, the rightmost of equal ones; as windows move on, so does their
choice, and neighbouring windows mostly choose the same line. The chosen lines are the text's
fingerprints: one row per chosen position, with the windows that chose it. A run of lines with that
many words that two places share holds the same windows in both, which choose the same lines of it;
so its fingerprint is at both places: that is the guarantee. Positions whose fingerprint has no
second place (a place being a text and a line in it) are dropped; only the others' windows are
looked at again.

Positions of equal fingerprints are joined through the windows that chose them: each with the first
place (by doc_id, then line) of the same window under the same fingerprint. The first place of a
fingerprint alone may have other lines around it, which would lose repeats, and all pairs of its
places would be too many. Each match is extended both ways as far as the lines agree, and the runs at
the later places, merged where they overlap, are deleted. The first place keeps its lines, but for a
run that overlaps its own first place (one line over and over): there each line deleted still stands
the distance before, so the period is kept once.

Each position meets the first one of its kind only, so a line or passage that a third of all
documents share gives a row per occurrence, never a pair of occurrences. What such rows are joined
with is a written table, one row a key, so the optimiser can split the task of a frequent key (beside an
aggregate it can't). The lines of two texts are brought together once for all their matches. Texts move once, for the documents that lose lines and
with them the others, in the last join. All in DataFrame functions.

Defined cases: null and empty texts have no lines and stay; a text of any length is cut whole, its
lines held as one array of numbers; rows with one doc_id and one text are one place, so copies of a
row are treated alike and none is later than the other; rows with one doc_id and different texts are
ordered by a hash of the text; a null doc_id comes first; a repeated run within a text is deleted
like any other; other columns are passed on (those named like working columns too); an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.session import cut, table

#: Words that a repeated run has at least.
MIN_WORDS = 25
SPACES = "[ \\t-\\r]+"


def _n_words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, SPACES), lambda w: w != ""))


def _place(doc: str = "doc") -> Column:
    """Documents by doc_id and a hash of the text."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))


def lines(docs: DataFrame) -> DataFrame:
    """doc, and of its lines with a word: number ``n``, hash ``h`` and words ``w``, as arrays."""
    split = F.split("text", "\n")
    marked = F.transform(split, lambda x, i: F.struct(i.alias("n"), F.xxhash64(x).alias("h"), _n_words(x).alias("w")))
    rows = docs.filter("text IS NOT NULL").select(_place().alias("doc"), F.filter(marked, lambda x: x["w"] > 0).alias("lines"))
    return rows.filter(F.size("lines") > 0).groupBy("doc").agg(F.first("lines").alias("lines"))


def fingerprints(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, and one row per chosen position ``at`` (a place in the array of lines) with its hash, the
    ``fingerprint``, and the ``windows`` that chose it: first and last line and hash of each. They are
    made within the array, so that no row of a position carries its text's lines."""
    ends = F.transform(
        F.sequence(F.lit(1), F.size("lines")),
        lambda i: F.aggregate(
            F.slice("lines", i, F.lit(min_words)),
            F.struct(i.alias("first"), F.lit(0).alias("words"), F.lit(0).alias("count")),
            lambda acc, x: F.when(acc["words"] < min_words, F.struct(acc["first"].alias("first"), (acc["words"] + x["w"]).alias("words"), (acc["count"] + 1).alias("count"))).otherwise(acc),
        ),
    )
    full = F.filter(ends, lambda e: e["words"] >= min_words)
    hashes = F.transform(full, lambda e: F.struct(e["first"].alias("first"), (e["first"] + e["count"] - 1).alias("last"), F.transform(F.slice("lines", e["first"], e["count"]), lambda x: x["h"]).alias("run")))
    rightmost = lambda r: (r["last"] + 1 - F.array_position(F.reverse(r["run"]), F.array_min(r["run"]))).cast("int")
    each = F.transform(hashes, lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), F.array_min(r["run"]).alias("fingerprint"), rightmost(r).alias("at"), F.xxhash64(r["run"]).alias("window")))
    made = found.select("doc", each.alias("each")).filter(F.size("each") > 0)
    # the choice never moves back: windows with one choice are neighbours, and a choice begins where it changes
    begins = F.filter(F.sequence(F.lit(1), F.size("each")), lambda i: (i == 1) | (F.element_at("each", i)["at"] != F.get("each", i - 2)["at"]))
    made = made.withColumn("begins", begins)
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("each") + 1))
    kept = lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last"), w["window"].alias("window"))
    chosen = F.zip_with("begins", ends, lambda b, e: F.struct(F.element_at("each", b)["fingerprint"].alias("fingerprint"), F.element_at("each", b)["at"].alias("at"), F.transform(F.slice("each", b, e - b), kept).alias("windows")))
    return made.select("doc", F.inline(chosen))


def shared(chosen: DataFrame) -> DataFrame:
    """The positions whose fingerprint has two places or more."""
    at = F.xxhash64("doc", "at")
    two = cut(chosen.groupBy("fingerprint").agg(F.min(at).alias("least"), F.max(at).alias("most")).filter("least <> most").select("fingerprint"))
    return chosen.join(two, "fingerprint", "left_semi")


def matches(positions: DataFrame) -> DataFrame:
    """doc, source, distance, first and last: runs of neighbouring windows that a place shares with an
    earlier one, as far as windows go."""
    windows = positions.select("doc", "fingerprint", F.inline("windows"))
    place = F.struct("doc", "first", "last")
    origin = cut(windows.groupBy("fingerprint", "window").agg(F.min(place).alias("origin"), F.count("*").alias("places")).filter("places > 1").select("fingerprint", "window", "origin"))
    later = windows.join(origin, ["fingerprint", "window"]).filter(place > F.col("origin"))
    # neighbouring windows with one origin at one distance are one match; it is extended once
    later = later.select("doc", F.col("origin.doc").alias("source"), (F.col("first") - F.col("origin.first")).alias("distance"), "first", "last")
    chain = Window.partitionBy("doc", "source", "distance").orderBy("first")
    later = later.withColumn("new", (F.col("first") > F.coalesce(F.lag("last").over(chain), F.lit(-1)) + 1).cast("int"))
    later = later.withColumn("match", F.sum("new").over(chain))
    return later.groupBy("doc", "source", "distance", "match").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("match")


def extended(found: DataFrame, matched: DataFrame) -> DataFrame:
    """doc, and the first and last line number of each match, extended both ways. A pair of texts is
    one row, whatever the number of its matches."""
    pairs = matched.groupBy("doc", "source").agg(F.collect_list(F.struct("first", "last", "distance")).alias("matches"))
    mine = found.select(F.col("doc").alias("d"), F.col("lines").alias("here"))
    theirs = found.select(F.col("doc").alias("s"), F.transform("lines", lambda x: x["h"]).alias("there"))
    both = pairs.join(mine, F.col("doc").eqNullSafe(F.col("d"))).join(theirs, F.col("source").eqNullSafe(F.col("s")))
    both = both.select("doc", "matches", "there", F.transform("here", lambda x: x["h"]).alias("here"), F.transform("here", lambda x: x["n"]).alias("numbers"))
    part = lambda a, begin, end: F.slice(a, begin, F.greatest(end - begin + 1, F.lit(0)))
    differs = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)  # noqa: E731  place of the first difference, 0 if none

    def reach(a: Column, b: Column) -> Column:
        at = differs(a, b)
        return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")

    def run(m: Column) -> Column:
        ahead = reach(part("here", m["last"] + 1, F.size("here")), part("there", m["last"] - m["distance"] + 1, F.size("there")))
        back = reach(F.reverse(part("here", F.lit(1), m["first"] - 1)), F.reverse(part("there", F.lit(1), m["first"] - m["distance"] - 1)))
        return F.struct(F.element_at("numbers", m["first"] - back).alias("a"), F.element_at("numbers", m["last"] + ahead).alias("b"))

    return both.select("doc", F.inline(F.transform("matches", run)))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc and ``runs``: the ranges of line numbers to delete, disjoint and ascending."""
    found = cut(lines(docs))
    # both tables are read twice, and choosing costs more than writing down what was chosen
    chosen = cut(fingerprints(found, min_words))
    runs = extended(found, matches(cut(shared(chosen))))
    ordered = Window.partitionBy("doc").orderBy("a", "b")
    runs = runs.withColumn("new", (F.col("a") > F.coalesce(F.max("b").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) + 1).cast("int"))
    merged = runs.withColumn("island", F.sum("new").over(ordered)).groupBy("doc", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from ``text``, and n_lines and n_removed."""
    found = repeats(docs.select("doc_id", "text"), min_words).select(F.col("doc").alias("__doc"), F.col("runs").alias("__runs"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text").select("__row", _place().alias("__place"))
    joined = rows.join(found, F.col("__place").eqNullSafe(F.col("__doc")), "left")
    whole = F.col("__row.text")
    split = F.split(whole, "\n")
    # what lies before each run, and what lies after the last
    begins = F.concat(F.array(F.lit(0)), F.transform("__runs", lambda r: r["b"] + 1))
    stops = F.concat(F.transform("__runs", lambda r: r["a"]), F.array(F.size("__lines")))
    left = F.flatten(F.zip_with(begins, stops, lambda b, e: F.slice("__lines", b + 1, e - b)))
    joined = joined.withColumn("__lines", split)
    text = F.when(F.col("__runs").isNull(), whole).otherwise(F.array_join(left, "\n"))
    removed = F.coalesce(F.aggregate("__runs", F.lit(0), lambda acc, r: acc + r["b"] - r["a"] + 1), F.lit(0)).cast("long")
    kept = [text.alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*kept, F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"), removed.alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs. A document that loses all its words holds nothing that an earlier
    place does not keep, and goes; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = dedup(docs.select("doc_id", "text", F.struct(*others).alias("others"))).filter("n_removed = 0 OR text RLIKE '[^ \\\\t-\\\\r]'")
    field = {c: F.col("others").getField(c) for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    field["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(field["n_chars"])
    return left.select(*[field[c].alias(c) for c in docs.columns])


#: The same rows in DuckDB, by the lines themselves: no hashes, and every window.
SQL = r"""
WITH l AS (
  SELECT doc_id, n, line, len(list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda w: w <> '')) AS w
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
), k AS (
  SELECT *, row_number() OVER d AS i, sum(w) OVER (d ROWS UNBOUNDED PRECEDING) AS c FROM l WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY n)
), ends AS (
  SELECT a.doc_id, a.i AS first, min(b.i) AS last FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 25 AND b.c - a.c + a.w >= 25 GROUP BY ALL
), win AS (
  SELECT e.doc_id, first, last, string_agg(line, chr(10) ORDER BY i) AS body FROM ends e JOIN k ON k.doc_id = e.doc_id AND k.i BETWEEN first AND last GROUP BY ALL
), org AS (
  SELECT *, first_value({d: doc_id, f: first}) OVER (PARTITION BY body ORDER BY doc_id, first) AS o FROM win
), later AS (SELECT DISTINCT doc_id, first, last, o.d AS od, first - o.f AS dist FROM org WHERE doc_id <> o.d OR first <> o.f),
ext AS (
  SELECT x.doc_id, x.first, x.last, x.od, x.dist, min(CASE WHEN m.line IS DISTINCT FROM t.line THEN m.i END) AS stop, max(m.i) AS top
  FROM later x LEFT JOIN k m ON m.doc_id = x.doc_id AND m.i > x.last LEFT JOIN k t ON t.doc_id = x.od AND t.i = m.i - x.dist
  GROUP BY ALL
), runs AS (SELECT doc_id, first, CASE WHEN stop IS NOT NULL THEN stop - 1 ELSE coalesce(top, last) END AS last FROM ext),
gone AS (
  SELECT DISTINCT l.doc_id, l.n FROM runs r JOIN k a ON a.doc_id = r.doc_id AND a.i = r.first JOIN k b ON b.doc_id = r.doc_id AND b.i = r.last
  JOIN l ON l.doc_id = r.doc_id AND l.n BETWEEN a.n AND b.n
), joined AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.n) FILTER (WHERE g.n IS NULL) AS text, count(*) AS n_lines, count(g.n) AS n_removed
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN joined j USING (doc_id)
"""
