"""Cell functions as column expressions: JVM-side, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.patterns import longest
from tabulon.sources import fixed_values as fixed

#: White space as Unicode-aware programs strip it; Java's \s and SQL's trim know less.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
NULL_WORDS = ["nan", "none", "nat", ""]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def clean(x: Column) -> Column:
    """Null words and blanks become the empty string; other cells stay as they are."""
    text = F.coalesce(x, F.lit(""))
    return F.when(F.lower(strip(text)).isin(NULL_WORDS), "").otherwise(text)


def norm_header(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, f"{SPACE}+"), lambda w: w != "")


def title_case(x: Column, lower_words: list[str] = fixed.TITLE_CASE_LOWER) -> Column:
    """Words with a digit stay; short words are lower-case but for the first; stars around go."""
    bare = strip(F.trim(strip(x), F.lit("*")))
    word = lambda w, i: F.when(w.rlike(r"\p{Nd}"), w).when(F.lower(w).isin(lower_words) & (i > 0), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))
    return F.array_join(F.transform(words(bare), word), " ")


def dimension(x: Column, pattern: str = fixed.DIMENSION_PATTERN) -> tuple[Column, Column]:
    """The cell without its dimensions, and the first of them as text (null if there is none)."""
    pattern = "(?i)" + pattern
    whole, number = F.regexp_extract(x, pattern, 0), F.regexp_extract(x, pattern, 1)
    low = F.lower(x)
    round_ = low.contains("dia") | low.contains("ø") | x.contains("⌀")
    text = F.concat(F.when(round_, "Dia. ").otherwise("L= "), number, strip(whole.substr(F.length(number) + 1, F.length(whole))))
    left = F.regexp_replace(F.regexp_replace(x, pattern, ""), r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85./-]", " ")
    left = strip(F.regexp_replace(left, f"{SPACE}+", " "))
    has = whole != ""
    return F.when(has, left).otherwise(x), F.when(has, text)


def join_nonblank(a: Column, b: Column) -> Column:
    """Two texts with a space between, where both are there."""
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit(" "), b))


def bundle(values: Column) -> Column:
    """Cells of one target, in order: one cell stays; of several, each not blank one is appended
    unless it equals all that is there so far."""

    def step(acc: Column, v: Column) -> Column:
        v = strip(v)
        return F.when((v == "") | (F.lower(acc) == F.lower(v)), acc).when(acc == "", v).otherwise(F.concat(acc, F.lit("; "), v))

    return F.when(F.size(values) == 0, "").when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.aggregate(values, F.lit(""), step))


def material(scan: Column, materials: list[str], whole_words: bool = False) -> Column:
    """The longest material named in the text, null if none is."""
    low, lowered = F.lower(scan), [m.lower() for m in materials]
    if whole_words:
        low = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}-]+", " "), F.lit(" "))
        lowered = [f" {m} " for m in lowered]
    return longest(low, lowered, materials)


def strip_controls(x: Column) -> Column:
    return F.regexp_replace(x, fixed.CONTROL_PATTERN, "")


def letters(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{L}]", ""))


def duration(seconds: Column) -> Column:
    """Seconds as h, m and s."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, s % 60)).otherwise(F.format_string("%ds", s))
