"""Tables from OCR boxes: a page is one array, and all steps are folds and filters over it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import norm_header, strip
from tabulon.operators.layout import PAGE, let, running_rows, slices, upper_median
from tabulon.sources import fixed_values as fixed

#: Boxes below which a page has no table.
FEWEST = 4


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda total, v: total + v), F.size(values))


def _some(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _filled(texts: Column) -> Column:
    return F.filter(texts, lambda t: t != "")


def _known(texts: Column) -> Column:
    return F.size(F.filter(texts, lambda t: norm_header(t).isin(fixed.OCR_HEADER_TOKENS)))


def _row(points: Column) -> Column:
    """Of a row's points by height: its height, header tokens, whether it has a number, cells from the left."""
    known = F.size(F.array_remove(points["known"], F.lit(False)))
    return F.struct(_mean(points["y"]).alias("y"), known.alias("known"), F.array_contains(points["numbered"], True).alias("numbered"), F.sort_array(points["cell"]).alias("cells"))


def _header_row(rows: Column) -> Column:
    """The place of the row with the most header tokens, at least two; where item numbers begin shortly
    below another such row, the nearest one above them. Null if there is none."""
    known = rows["known"]
    numbered = _some(F.transform(rows["numbered"], lambda has, i: F.when(has, i)))
    onset = let(numbered, lambda at: F.coalesce(F.get(F.filter(at, lambda a, i: F.get(at, i + 1) - a <= 3), F.lit(0)), F.lit(0)))
    nearest = let(onset, lambda o: F.array_max(F.transform(known, lambda k, i: F.when((k >= 2) & (i < o) & (i >= o - 5), i))))
    best = lambda most: (F.array_position(known, most) - 1).cast("int")
    several = F.size(F.filter(known, lambda k: k >= 2)) > 1  # else the nearest one is the best one
    return let(F.array_max(known), lambda most: F.when(most >= 2, F.coalesce(F.when(several, nearest), best(most))))


def _single_link(values: Column, gap: Column) -> Column:
    """Centres of sorted values: one farther than the gap from that before it begins a group."""

    def groups(xs: Column) -> Column:
        begins = _some(F.transform(xs, lambda x, i: F.when((i == 0) | (x - F.get(xs, i - 1) > gap), i + 1)))
        return let(begins, lambda at: _some(F.transform(slices(xs, at), _mean)))

    return let(values, groups)


def _with_stray(own: Column, under: Column, gap: Column) -> Column:
    """Columns come from the header's cells, and from at least two cells below that are farther than a
    gap from all of those."""
    xs = F.flatten(under["cells"])["x"]
    far = F.filter(F.array_distinct(xs), lambda x: ~F.exists(own, lambda c: F.abs(x - c) <= gap))
    twice = lambda s: F.filter(_single_link(s, gap), lambda x: F.size(F.filter(s, lambda v: F.abs(v - x) <= gap)) >= 2)
    more = lambda some: let(F.sort_array(F.filter(xs, lambda x: F.array_contains(some, x))), twice)
    return let(far, lambda some: F.when(F.size(some) == 0, own).otherwise(F.sort_array(F.concat(own, more(some)))))


def _borders(centres: Column, begins: Column) -> Column:
    """The columns left and right of each place where columns begin anew; left of the first there is none."""
    return F.transform(begins, lambda b: F.struct(F.get(centres, b - 2).alias("left"), F.get(centres, b - 1).alias("right")))


def _texts(cells: Column, borders: Column) -> Column:
    """A row's text right of each border, up to the next; cells go to the nearest column, the left one of
    equally near ones. As cells and columns stand in order, each border cuts the row once."""
    left = lambda b: F.filter(cells["x"], lambda x: x - b["left"] <= b["right"] - x)
    cuts = F.transform(borders, lambda b, i: F.when(i == 0, 1).otherwise(F.size(left(b)) + 1))
    return let(cuts, lambda at: F.transform(slices(cells["text"], at), lambda t: F.array_join(t, " ")))


def _unique(names: Column) -> Column:
    """Names without a text by their place; a name's later uses are numbered."""

    def numbered(all_: Column) -> Column:
        def one(n: Column, i: Column) -> Column:
            earlier = F.size(F.filter(F.slice(all_, F.lit(1), i), lambda m: m == n))
            return F.when(earlier > 0, F.concat(n, F.lit("_"), earlier.cast("string"))).otherwise(n)

        return F.when(F.size(F.array_distinct(all_)) == F.size(all_), all_).otherwise(F.transform(all_, one))

    return let(F.transform(names, lambda n, i: F.when(n == "", F.concat(F.lit("col"), i.cast("string"))).otherwise(n)), numbered)


def _groups(names: Column) -> Column:
    """Where columns put together begin (from 1): a header that is a stop word joins its neighbours: both, if
    both are words of their own, else the one to the left, else the one to the right. A fold that keeps the
    begins so far, the last group's name, and whether the next column belongs to it."""
    stop = lambda n: F.lower(n).isin(fixed.OCR_STOPWORDS)
    solid = lambda n: F.coalesce((F.length(n) > 3) & ~stop(n), F.lit(False))
    zero = F.struct(F.expr("cast(array() as array<int>)").alias("begins"), F.lit("").alias("last"), F.lit(False).alias("open"))

    def step(acc: Column, i: Column) -> Column:
        first, name, after = F.size(acc["begins"]) == 0, F.get(names, i), F.get(names, i + 1)
        joins = acc["open"] | (~first & stop(name))
        begins = F.when(joins, acc["begins"]).otherwise(F.concat(acc["begins"], F.array(i + 1)))
        last = F.when(joins, F.concat_ws(" ", acc["last"], name)).otherwise(name)
        opens = ~acc["open"] & stop(name) & F.when(first, after.isNotNull()).otherwise(solid(acc["last"]) & solid(after))
        return F.struct(begins.alias("begins"), last.alias("last"), opens.alias("open"))

    folded = F.aggregate(F.transform(names, lambda _, i: i), zero, step)["begins"]
    return F.when(F.exists(names, stop), folded).otherwise(F.transform(names, lambda _, i: i + 1))


def _is_record(cells: Column) -> Column:
    """Neither empty, nor another header, nor a note."""
    note = F.exists(cells, lambda t: F.lower(t).rlike(f"^(?:{'|'.join(map(re.escape, fixed.OCR_SKIP_PREFIXES))})"))
    return (F.array_join(cells, "") != "") & ((F.size(cells) < 3) | (_known(cells) < 3)) & ~note


def _records(rows: Column, s: Column) -> Column:
    """Records of rows that lead away from the header, up to the first large gap."""

    def near(ys: Column) -> Column:
        before = lambda i: F.when(i == 0, s["header"]["y"]).otherwise(F.get(ys, i - 1))
        far = F.array_min(F.transform(ys, lambda y, i: F.when(F.abs(y - before(i)) > s["height"] * 5, i)))
        return F.slice(rows, F.lit(1), F.coalesce(far, F.size(ys)))

    return F.filter(F.transform(let(rows["y"], near), lambda r: _texts(r["cells"], s["borders"])), _is_record)


def _share(records: Column, number: Column) -> Column:
    return F.try_divide(F.size(F.filter(records, lambda r: F.get(r, number).rlike(r"^\p{Nd}+$"))), F.size(records))


def _rescued(names: Column, records: Column) -> Column:
    """The most textual unnamed column becomes Description, unless one has a like name."""

    def textual(filled: Column, i: Column) -> Column:
        texty = F.try_divide(F.size(F.filter(filled, lambda v: v.rlike("[A-Za-z]"))), F.size(filled))
        length = F.try_divide(F.aggregate(filled, F.lit(0), lambda total, v: total + F.length(v)), F.size(filled))
        return let(F.struct(texty.alias("texty"), length.alias("length")), lambda s: F.when((s["texty"] >= 0.6) & (s["length"] >= 4), F.struct((s["texty"] * s["length"]).alias("score"), (-i).alias("minus"))))

    def score(n: Column, i: Column) -> Column:
        return F.when(n.rlike(r"^col\d+$"), let(_filled(F.transform(records, lambda r: F.get(r, i))), lambda filled: textual(filled, i)))

    named = F.exists(names, lambda n: F.lower(n).rlike("|".join(map(re.escape, fixed.NAME_LIKE))))
    best = F.when(~named, -F.array_max(F.transform(names, score))["minus"])
    return let(best, lambda b: F.when(b.isNull(), names).otherwise(F.transform(names, lambda n, i: F.when(i == b, "Description").otherwise(n))))


def _above(s: Column) -> Column:
    """Rows that stand on the header, the nearest first, without what lies beside its columns."""
    upward = F.reverse(F.slice(slices(s["points"], s["begins"]), F.lit(1), s["top"]))
    reach = F.struct((F.array_min(s["centres"]) - s["gap"] * 2).alias("lo"), (F.array_max(s["centres"]) + s["gap"] * 2).alias("hi"))
    kept = let(reach, lambda r: F.transform(upward, lambda p: F.filter(p, lambda c: c["cell"]["x"].between(r["lo"], r["hi"]))))
    return F.transform(F.filter(kept, lambda p: F.size(p) > 0), _row)


def _better(s: Column) -> Column:
    """The records below the header, or if few of them are numbered and more of those above it are, these."""
    few = let(_share(s["below"], s["number"]), lambda b: F.when(b < 0.3, b))
    chosen = lambda below: let(let(_above(s), lambda rows: _records(rows, s)), lambda a: F.when(_share(a, s["number"]) > below, a).otherwise(s["below"]))
    return F.when((s["top"] > 0) & s["number"].isNotNull(), let(few, lambda b: F.when(b.isNotNull(), chosen(b)).otherwise(s["below"]))).otherwise(s["below"])


def _number(names: Column) -> Column:
    return F.array_min(F.transform(names, lambda n, i: F.when(norm_header(n).isin(fixed.OCR_NUMBER_TOKENS), i)))


#: A page's columns, from ``points`` (by height, ``n`` of them) and ``page_w`` on: name, the columns it is made of, and how. A
#: page without a table has null from the column on that can't be made.
STEPS: list[tuple[str, str, Callable[[Column], Column]]] = [
    ("height", "n points", lambda s: F.when(s["n"] >= FEWEST, let(upper_median(s["points"]["h"]), lambda m: F.when(m == 0, 12.0).otherwise(m)))),
    ("begins", "points height", lambda s: F.when(s["height"].isNotNull(), running_rows(s["points"], "y", F.greatest(F.lit(8.0), s["height"] * 0.7)))),
    ("rows", "points begins", lambda s: F.transform(slices(s["points"], s["begins"]), _row)),
    ("top", "rows", lambda s: let(_header_row(s["rows"]), lambda best: F.when(best < F.size(s["rows"]) - 1, best))),
    ("gap", "page_w", lambda s: F.greatest(F.lit(40.0), s["page_w"] * 0.035)),
    ("header", "rows top", lambda s: F.get(s["rows"], s["top"])),
    ("under", "rows top", lambda s: F.slice(s["rows"], s["top"] + 2, F.size(s["rows"]))),
    ("centres", "header under gap", lambda s: let(_single_link(s["header"]["cells"]["x"], s["gap"]), lambda own: _with_stray(own, s["under"], s["gap"]))),
    ("titles", "header centres", lambda s: _unique(let(_borders(s["centres"], F.transform(s["centres"], lambda _, i: i + 1)), lambda b: _texts(s["header"]["cells"], b)))),
    ("groups", "titles", lambda s: _groups(s["titles"])),
    ("borders", "centres groups", lambda s: _borders(s["centres"], s["groups"])),
    ("unnamed", "titles groups", lambda s: _unique(F.transform(slices(s["titles"], s["groups"]), lambda t: F.array_join(t, " ")))),
    ("number", "unnamed", lambda s: _number(s["unnamed"])),
    ("below", "under header borders height", lambda s: _records(s["under"], s)),
    ("records", "below points begins top centres gap header borders height number", _better),
    ("names", "unnamed records", lambda s: _rescued(s["unnamed"], s["records"])),
]


def _span(name: str) -> tuple[Column, Column]:
    """Of a box's points: their mean, and how far they lie apart. Boxes of four points, as most are, do without folds."""
    values, four = F.col("box")[name].cast("array<double>"), [F.get("box", F.lit(i))[name].cast("double") for i in range(4)]
    is_four = F.size("box") == 4
    mean = F.when(is_four, (F.lit(0.0) + four[0] + four[1] + four[2] + four[3]) / 4).otherwise(_mean(values))
    return mean, F.when(is_four, F.greatest(*four) - F.least(*four)).otherwise(F.array_max(values) - F.array_min(values))


def ocr_cells(boxes: DataFrame) -> DataFrame:
    """Cells of the tables in ocr_boxes(doc_id, page_no, box_no, page_w, box array<struct<x,y>>, text,
    score). Boxes move once, by page. Those without a text or a place, or with a low score, don't count;
    one without a score does."""

    (x, _), (y, h), score = _span("x"), _span("y"), F.col("score").cast("double")
    sure = score.isNull() | F.isnan(score) | (score >= fixed.OCR_MIN_SCORE)
    read = boxes.select(*PAGE, "box_no", F.col("page_w").cast("double").alias("page_w"), x.alias("x"), y.alias("y"), h.alias("h"), strip(F.col("text")).alias("text"), sure.alias("sure"))
    # null, where a place is
    counts = F.col("sure") & (F.col("text") != "") & (F.col("x") < float("inf")) & (F.col("y") < float("inf"))
    known, numbered = norm_header(F.col("text")).isin(fixed.OCR_HEADER_TOKENS), F.col("text").rlike(fixed.ITEM_NO_PATTERN)
    point = F.struct("y", "box_no", F.struct("x", "y", "box_no", "text").alias("cell"), "h", known.alias("known"), numbered.alias("numbered"))
    # counted too, as the optimiser would put what is used once into the gathering, which works it out without compiled code
    points = read.select(*PAGE, F.when(counts, point).alias("p"), F.struct("box_no", "page_w").alias("w")).groupBy(*PAGE)
    pages = points.agg(F.count("p").alias("n"), F.sort_array(F.collect_list("p")).alias("points"), F.min("w")["page_w"].alias("page_w"))
    for name, used, made in STEPS:
        # bound once, as lambdas would work out again what the optimiser puts in place of a column's name
        pages = pages.withColumn(name, let(F.struct(*used.split()), made))
    # an outer explode, as a plain one would work the table out once more to see whether it is empty
    records = pages.select(*PAGE, "names", F.posexplode_outer("records").alias("row_no", "record")).filter("record IS NOT NULL")
    cells = records.select(*PAGE, "row_no", "names", F.posexplode("record").alias("col_pos", "value"))
    return cells.select(*PAGE, "row_no", "col_pos", F.get("names", F.col("col_pos")).alias("raw_header"), "value")
