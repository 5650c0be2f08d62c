"""Layout from coordinates: clustering rows and columns, text-block tables, item anchors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import strip
from tabulon.sources import fixed_values as fixed

PAGE = ["doc_id", "page_no"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value worked out once, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upper_median(values: Column) -> Column:
    """Of an array: the middle one, of two middle ones the larger."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


#: The part of a tolerance that a height has to be clear of it by, to tell rows without adding their heights up.
CLEAR = 1e-4


def running_rows(points: Column, y: str, tolerance: Column) -> Column:
    """Sorted points (an array) cut into rows: in order of y a point joins the row before it if it is
    within the tolerance of that row's running mean. A row's mean is never outside it: a gap wider than the
    tolerance always begins a row, and what is no taller than the tolerance is one. Where that, with room for
    rounding, tells all rows of the array, nothing is added up; else the state depends on the data, so it is
    a fold; it notes where rows begin, so it grows by row and not by point."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("begins"))

    def fold(s: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            near = (acc["n"] > 0) & (F.abs(v - acc["sum"] / F.greatest(acc["n"], F.lit(1))) <= s["tolerance"])
            begins = F.when(near, acc["begins"]).otherwise(F.concat(acc["begins"], F.array(acc["at"] + 1)))
            return F.struct((v + F.when(near, acc["sum"]).otherwise(0.0)).alias("sum"), (F.when(near, acc["n"]).otherwise(0) + 1).alias("n"), (acc["at"] + 1).alias("at"), begins.alias("begins"))

        return F.aggregate(s["ys"], zero, step)["begins"]

    def rows(s: Column) -> Column:
        ys, n = s["ys"], F.size(s["ys"])
        gaps = lambda wide: F.filter(F.transform(ys, lambda _, i: i + 1), lambda k: F.coalesce(F.get(ys, k - 1) - F.get(ys, k - 2) > wide, F.lit(True)))
        flat = lambda at, most: F.forall(F.transform(at, lambda b, i: F.get(ys, F.coalesce(F.get(at, i + 1) - 2, n - 1)) - F.get(ys, b - 1)), lambda h: F.coalesce(h <= most, F.lit(False)))
        exact = s["tolerance"] * CLEAR > n * 1e-15 * F.greatest(F.abs(F.get(ys, F.lit(0))), F.abs(F.get(ys, n - 1)))
        begins = let(let(s["tolerance"] * (1 + CLEAR), gaps), lambda at: F.when(flat(at, s["tolerance"] * (1 - CLEAR)), at))
        return let(F.when(exact, begins), lambda at: F.when(at.isNotNull(), at).otherwise(fold(s)))

    return let(F.struct(points[y].alias("ys"), tolerance.alias("tolerance")), rows)


def slices(points: Column, begins: Column) -> Column:
    """The parts of an array that begin at these places."""
    return F.transform(begins, lambda b, i: F.slice(points, b, F.coalesce(F.get(begins, i + 1), F.size(points) + 1) - b))


def cluster_rows(points: DataFrame, by: list[str], y: str, tie: str, tolerance: Column) -> DataFrame:
    """``cluster`` (from 0) of each point: the rows of a page by running means."""
    fields = [c for c in points.columns if c not in by]
    rows = points.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(y).alias("__y"), F.col(tie).alias("__tie"), F.struct(*fields).alias("row")))).alias("__points"), F.first(tolerance).alias("__tol"))
    rows = rows.withColumn("__begins", running_rows(F.col("__points"), "__y", F.col("__tol")))
    parts = rows.select(*by, F.posexplode(slices(F.col("__points"), F.col("__begins"))).alias("__cluster", "__part"))
    return parts.select(*by, "__cluster", F.explode("__part").alias("__p")).select(*by, "__p.row.*", F.col("__cluster").alias("cluster"))


#: Tolerances that a bin of ``cluster_rows_spread`` is wide, and the most that it may be.
SPAN, WIDEST = 64, 128
#: Tolerances that no row is wide: it takes e ** k points to move a row's mean by k tolerances.
REACH = 32


def next_begins(ys: np.ndarray, ns: np.ndarray, own: int, tolerance: float) -> list[int]:
    """For each of the first ``own`` places (sorted, told apart; ns: points at each): where, if a row begins there,
    the next one does; len(ys) if none does within these places. The later a row begins the higher its mean, so the
    next begin never moves back and one pass with two ends finds all. Where rounding could decide, points are added
    one after the other, as a fold does."""
    n = len(ys)
    base, places = float(ys[0]), ys.tolist()
    sums = np.concatenate([[0.0], np.cumsum((ys - base) * ns)]).tolist()
    counts = np.concatenate([[0], np.cumsum(ns)]).tolist()
    doubt = 1e-15 * (float(np.abs(ys).max()) + tolerance) * (counts[-1] + 8)

    def over(i: int, k: int) -> float:
        return places[k] - base - (sums[k] - sums[i]) / (counts[k] - counts[i]) - tolerance

    def begins(i: int, k: int) -> bool:
        total = np.cumsum(np.repeat(ys[i:k], ns[i:k]))[-1]
        return bool(abs(ys[k] - total / (counts[k] - counts[i])) > tolerance)

    out, low = [], 0
    for i in range(own):
        low = max(low, i + 1)
        while low < n and over(i, low) <= -doubt:
            low += 1
        k = low
        while k < n and not ((by := over(i, k)) > doubt or (by > -doubt and begins(i, k))):
            k += 1
        out.append(k)
    return out


def _ways(tolerance: float) -> Callable[[Column, Column, Column], Column]:
    """Of a bin's places: pairs, flat, of an entry (the first begin in the bin) and the first begin beyond the bin
    that it leads to, past all places within reach if none is one; an entry stands for those up to the next one
    listed."""

    @F.pandas_udf("array<double>")
    def ways(ys: pd.Series, ns: pd.Series, own: pd.Series) -> pd.Series:
        def one(ys: np.ndarray, ns: np.ndarray, own: int) -> list[float]:
            out, past = [0.0] * own, math.nextafter(float(ys[-1]), math.inf)
            for i, k in reversed(list(enumerate(next_begins(ys, ns, own, tolerance)))):
                out[i] = past if k == len(ys) else out[k] if k < own else float(ys[k])
            return [x for i in range(own) if i == 0 or out[i] != out[i - 1] for x in (float(ys[i]), out[i])]

        return pd.Series([one(*x) for x in zip(ys, ns, own)], dtype=object)

    return ways


def _begun(tolerance: float) -> Callable[[Column, Column, Column, Column], Column]:
    """Places where rows begin in a bin whose first one begins at ``entry`` (null: none does)."""

    @F.pandas_udf("array<double>")
    def begun(ys: pd.Series, ns: pd.Series, own: pd.Series, entry: pd.Series) -> pd.Series:
        def one(ys: np.ndarray, ns: np.ndarray, own: int, entry: float) -> list[float]:
            if math.isnan(entry):
                return []
            at, out = int(np.searchsorted(ys[:own], entry)), []
            following = next_begins(ys[at:], ns[at:], own - at, tolerance)
            i = 0
            while i < own - at:
                out.append(float(ys[at + i]))
                i = following[i]
            return out

        return pd.Series([one(*x) for x in zip(ys, ns, own, entry.astype("float64"))], dtype=object)

    return begun


def _entries(bins: pd.DataFrame) -> pd.DataFrame:
    """The first begin in each bin of a group: where the row before it leads to."""
    bins, entries, ahead = bins.sort_values("__bin"), [], -math.inf
    for ways, last in zip(bins["__ways"], bins["__last"]):
        entry = max(ways[0], ahead)
        if entry > last:  # a row of an earlier bin holds all of this one
            entries.append(None)
            continue
        entries.append(entry)
        ahead = ways[2 * int(np.searchsorted(ways[::2], entry, "right")) - 1]
    return bins.assign(__entry=pd.Series(entries, index=bins.index, dtype="float64")).drop(columns=["__ways", "__last"])


def cluster_rows_spread(points: DataFrame, by: list[str], y: str, tie: str, tolerance: float) -> DataFrame:
    """The same as ``cluster_rows`` for groups of any size and density: no task needs the points of a group, and
    points are neither sorted nor gathered.

    Where a row begins depends on all points before, but from any begin on only on those that follow. So places
    (told apart, with their number of points) are dealt by bins of ``SPAN`` tolerances, with what follows within
    ``REACH``; each bin tells for all of its places where a row that begins there leads to beyond the bin. These
    ways coalesce, and are short lists; one step a bin through them gives its first begin, and the bins then give
    their begins for themselves, at most about one a tolerance. A row begins at the first of equal places, so a
    point's row is told by its place alone. Points without a place or a group are left out.
    """
    yy, width = F.col(y).cast("double"), float(min(SPAN, WIDEST) * tolerance) or 1.0
    of = lambda at: F.floor(at / width)
    told = points.filter(yy.isNotNull())
    for c in by:
        told = told.filter(F.col(c).isNotNull())
    places = told.groupBy(*by, yy.alias("__y")).agg(F.count("*").alias("__n"))
    dealt = places.withColumn("__bin", F.explode(F.sequence(of(F.col("__y") - REACH * tolerance), of(F.col("__y"))))).withColumn("__own", (F.col("__bin") == of(F.col("__y"))).cast("int"))
    listed = F.sort_array(F.collect_list(F.struct("__y", "__n"))).alias("__at")
    bins = dealt.groupBy(*by, "__bin").agg(listed, F.sum("__own").cast("int").alias("__k")).filter("__k > 0")
    at = [F.col("__at.__y"), F.col("__at.__n"), F.col("__k")]
    ways = bins.select(*by, "__bin", _ways(tolerance)(*at).alias("__ways"), F.get("__at.__y", F.col("__k") - 1).alias("__last"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (points.schema[c] for c in by))
    entries = ways.groupBy(*by).applyInPandas(_entries, f"{kinds}, __bin long, __entry double")
    begun = bins.join(entries, [*by, "__bin"]).select(*by, "__bin", _begun(tolerance)(*at, F.col("__entry")).alias("__begins"))
    earlier = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.withColumn("__first", F.coalesce(F.sum(F.size("__begins")).over(earlier), F.lit(0)))
    rows = told.withColumn("__bin", of(yy)).join(begun, [*by, "__bin"])
    nth = F.size(F.filter("__begins", lambda b: b <= yy))
    return rows.withColumn("cluster", F.col("__first") + nth - 1).drop("__bin", "__begins", "__first")


def gap_clusters(points: DataFrame, by: list[str], x: str, tie: str, gap: Column | float) -> DataFrame:
    """``cluster`` of each point: a gap to the one before, larger than allowed, begins a new one."""
    w = Window.partitionBy(*by).orderBy(x, tie)
    jump = F.coalesce((F.col(x) - F.lag(x).over(w) > gap).cast("int"), F.lit(0))
    return points.withColumn("__jump", jump).withColumn("cluster", F.sum("__jump").over(w)).drop("__jump")


def cluster_centres(clustered: DataFrame, by: list[str], x: str) -> DataFrame:
    return clustered.groupBy(*by, "cluster").agg(F.avg(x).alias("centre"), F.count("*").alias("n"))


def count_anchors(points: DataFrame, by: list[str], y: str, gap: float = 6.0) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(y)
    jump = (F.col(y) - F.lag(y).over(w) > gap).cast("int")
    return points.withColumn("__jump", F.coalesce(jump, F.lit(1))).groupBy(*by).agg(F.sum("__jump").alias("n"))


def before_gap(points: DataFrame, by: list[str], y: str, tie: str, limit: Column | float) -> DataFrame:
    """Points up to the first gap larger than the limit."""
    w = Window.partitionBy(*by).orderBy(y, tie)
    jump = F.coalesce((F.col(y) - F.lag(y).over(w) > limit).cast("int"), F.lit(0))
    return points.withColumn("__jump", jump).withColumn("__after", F.sum("__jump").over(w)).filter("__after = 0").drop("__jump", "__after")


def nearest(points: DataFrame, by: list[str], x: str, centres: Column) -> DataFrame:
    """``nearest`` (from 0) of each point's centres (an array), the first of equally near ones."""
    distance = F.transform(centres, lambda c, i: F.struct(F.abs(c - F.col(x)).alias("d"), i.alias("i")))
    return points.withColumn("nearest", F.array_min(distance)["i"])


def item_numbers(words: DataFrame) -> DataFrame:
    """Words that look like item numbers near the page's number column (at least two of them)."""
    numbers = words.filter(F.col("text").rlike(fixed.ITEM_NO_PATTERN))
    column = numbers.groupBy(*PAGE).agg(upper_median(F.collect_list("x0")).alias("numcol"), F.count("*").alias("k")).filter("k >= 2").drop("k")
    return numbers.join(column, PAGE).filter(F.abs(F.col("x0") - F.col("numcol")) <= 30)


def item_anchors(words: DataFrame) -> DataFrame:
    """doc_id, page_no and n: rows with an item number, seen apart from any extraction."""
    full = words.withColumn("text", strip(F.col("text"))).filter("text <> ''")
    full = full.withColumn("__k", F.count("*").over(Window.partitionBy(*PAGE))).filter("__k >= 4")
    return count_anchors(item_numbers(full).withColumn("cy", (F.col("y0") + F.col("y1")) / 2), PAGE, "cy")


def textblock_cells(words: DataFrame) -> DataFrame:
    """Cells of two columns, No. and Description, from positioned words: rows are clusters by height,
    a row with a number in the number column begins an item, what is right of it is its description;
    rows without a number continue the item before. Items without description go, and pages with
    fewer than two items. Words move once, by page, and a page's rows and items stay one array."""
    text = strip(F.col("text"))
    point = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), "word_no", "x0", (F.col("y1") - F.col("y0")).alias("h"), text.alias("text"), text.rlike(fixed.ITEM_NO_PATTERN).alias("number"))
    pages = words.select(*PAGE, point.alias("p")).filter("p.text <> ''").groupBy(*PAGE).agg(F.sort_array(F.collect_list("p")).alias("points")).filter(F.size("points") >= 4)
    xs = F.transform(F.filter("points", lambda p: p["number"]), lambda p: p["x0"])
    heights = F.filter(F.transform("points", lambda p: p["h"]), lambda h: h > 0)
    pages = pages.withColumns({"xs": xs, "tol": F.greatest(F.lit(4.0), F.coalesce(upper_median(heights), F.lit(10.0)) * 0.6)}).filter(F.size("xs") >= 2)
    pages = pages.withColumns({"numcol": upper_median(F.col("xs")), "begins": running_rows(F.col("points"), "cy", F.col("tol"))})

    def right(w: Column, mark: Column) -> Column:
        return F.when(mark.isNotNull(), w["x0"] > mark["x0"] + 2).otherwise((w["x0"] > F.col("numcol") + 2) & ~w["number"])

    def band(row: Column) -> Column:
        across = F.sort_array(F.transform(row, lambda p: F.struct(p["x0"].alias("x0"), p["word_no"].alias("word_no"), p["text"].alias("text"), p["number"].alias("number"))))
        marked = lambda ws: F.struct(ws.alias("words"), F.get(F.filter(ws, lambda w: w["number"] & (F.abs(w["x0"] - F.col("numcol")) <= 30)), 0).alias("mark"))
        joined = lambda m: F.array_join(F.transform(F.filter(m["words"], lambda w: right(w, m["mark"])), lambda w: w["text"]), " ")
        return let(let(across, marked), lambda m: F.struct(m["mark"]["text"].alias("number"), joined(m).alias("words")))

    def item(part: Column, i: Column) -> Column:
        parts = F.filter(F.transform(part, lambda b: b["words"]), lambda x: x != "")
        return F.struct((i + 1).alias("item"), F.get(part, 0)["number"].alias("number"), strip(F.array_join(parts, " ")).alias("description"))

    def marks(bands: Column) -> Column:
        return F.filter(F.transform(bands, lambda b, i: F.when(b["number"].isNotNull(), i + 1)), lambda i: i.isNotNull())

    def cut(bands: Column) -> Column:
        described = lambda at: F.filter(F.transform(slices(bands, at), item), lambda x: x["description"] != "")
        return let(marks(bands), lambda at: F.when(F.size(at) >= 2, described(at)))

    # bound, and without a filter before the rows come apart, as the optimiser would work arrays out again for it
    bands = let(F.struct("points", "begins"), lambda s: F.transform(slices(s["points"], s["begins"]), band))
    items = let(let(bands, cut), lambda xs: F.when(F.size(xs) >= 2, xs))
    items = pages.select(*PAGE, F.explode_outer(items).alias("i")).filter("i IS NOT NULL").select(*PAGE, "i.*")
    pair = F.array(F.struct(F.lit(0).alias("col_pos"), F.lit("No.").alias("raw_header"), F.col("number").alias("value")), F.struct(F.lit(1).alias("col_pos"), F.lit("Description").alias("raw_header"), F.col("description").alias("value")))
    return items.select(*PAGE, F.col("item").cast("int").alias("row_no"), F.explode(pair).alias("c")).select(*PAGE, "row_no", "c.*")
