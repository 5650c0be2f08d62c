"""Pages as a data source.

    register(spark, decoder)
    spark.read.format("document_pages").option("paths", json.dumps(paths)).option("push", True).load().filter("page_no IN (1, 5)")

``paths`` (a JSON list) or ``load(path)`` name files that every machine sees under that path. With the
option ``push``, conditions on doc_id and page_no are pushed: files and pages that they rule out are not
opened and not decoded. It is for a table that is loaded for one filter: Spark 4.1 keeps the conditions
pushed last with the loaded table, so that another use of it, in the same plan or later, would see those
rows alone. Without the option Spark filters what was read, and a table can be used at will. (Pushing has to be
turned on for a session; ``register`` does so.) Columns that a given schema leaves out,
``.schema("doc_id string, page_no int, text string")``, are not decoded; Spark doesn't tell a source what a
query selects. Options ``pages`` (a page spec) and ``first``, ``last`` (a range) select pages per document;
what selects nothing of a document gives the whole of it, before pushed conditions.

A partition is a share of a file's blocks of ``STEP`` pages; a file has one partition for every ``split``
bytes (an option). Each opens the file and finds its pages itself, so the driver opens none. A file that can't
be opened is one row with an error and without page_no; conditions on page_no drop it, as in SQL.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabulon.sources.documents import COLUMNS, ROWS, SCHEMA, STEP, Decoder, file_rows
from tabulon.sources.pages import chosen_pages, intake, parse_pages

FORMAT = "document_pages"
SPLIT = 32 << 20


@dataclass
class Share(ds.InputPartition):
    """The blocks of a file whose number leaves ``part`` when divided by ``parts``."""

    path: str
    part: int
    parts: int


def _test(f: ds.Filter):
    """A condition on one column as a function of its value, None if it isn't one that is pushed."""
    if isinstance(f, ds.Not):
        inner = _test(f.child)
        return inner and (lambda v: v is not None and not inner(v))
    known = {
        ds.EqualTo: lambda v: v == f.value,
        ds.In: lambda v: v in f.value,
        ds.GreaterThan: lambda v: v > f.value,
        ds.GreaterThanOrEqual: lambda v: v >= f.value,
        ds.LessThan: lambda v: v < f.value,
        ds.LessThanOrEqual: lambda v: v <= f.value,
        ds.StringStartsWith: lambda v: v.startswith(f.value),
        ds.StringEndsWith: lambda v: v.endswith(f.value),
        ds.StringContains: lambda v: f.value in v,
        ds.IsNotNull: lambda v: True,
    }
    found = known.get(type(f))
    return found and (lambda v: v is not None and found(v))


def _column(f: ds.Filter) -> tuple:
    return _column(f.child) if isinstance(f, ds.Not) else getattr(f, "attribute", ())


class PageReader(ds.DataSourceReader):
    def __init__(self, decoder: Decoder, options: dict, schema: StructType):
        self.decoder, self.schema = decoder, schema
        unknown = [f.name for f in schema if f.name not in COLUMNS]
        if unknown:
            raise ValueError(f"{FORMAT} has no columns {unknown}; it has {list(COLUMNS)}")
        listed = json.loads(options["paths"]) if options.get("paths") else [options["path"]] if options.get("path") else []
        self.paths = intake(listed)
        self.spec, self.split = options.get("pages"), int(options.get("split") or SPLIT)
        self.range = (int(options.get("first") or 1), int(options["last"])) if options.get("last") else None
        parse_pages(self.spec)  # a wrong spec fails here
        self.filters: list[ds.Filter] = []

    def passes(self, column: str, value) -> bool:
        return all(_test(f)(value) for f in self.filters if _column(f) == (column,))

    def partitions(self) -> list[Share]:
        out = []
        for path in self.paths:
            if self.passes("doc_id", path):
                size = os.path.getsize(path) if os.path.isfile(path) else 0
                parts = max(1, -(-size // self.split))
                out += [Share(path, i, parts) for i in range(parts)]
        return out

    def rows(self, share: Share) -> Iterator[dict]:
        mine = lambda n: (n - 1) // STEP % share.parts == share.part and self.passes("page_no", n)
        wanted = lambda total: [n for n in chosen_pages(total, self.spec, self.range) if mine(n)]
        for row in file_rows(share.path, lambda: self.decoder(share.path), wanted, self.schema.names):
            if "page_no" in row or share.part == 0 and self.passes("page_no", None):
                yield row

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        kinds, out = to_arrow_schema(self.schema), []
        for row in self.rows(partition) if partition else ():  # without files Spark asks for one empty partition
            out.append(row)
            if len(out) == ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)


class PushedReader(PageReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if _column(f) in (("doc_id",), ("page_no",)) and _test(f):
                self.filters.append(f)
            else:
                yield f


def register(spark: SparkSession, decoder: Decoder, name: str = FORMAT) -> str:
    """Makes the format known to the session, with this decoder (the last one registered under a name
    counts), and lets conditions be pushed."""

    class Pages(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> PageReader:
            push = str(self.options.get("push") or "").lower() == "true"
            return (PushedReader if push else PageReader)(decoder, self.options, schema)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(Pages)
    return name


def read(spark: SparkSession, paths: list[str], decoder: Decoder, columns: list[str] | None = None, pages: str | None = None, page_range: tuple[int, int] | None = None) -> DataFrame:
    """Pages of these files, with these columns (all of them if None)."""
    names = list(COLUMNS) if columns is None else columns
    source = spark.read.format(register(spark, decoder)).schema(", ".join(f"{c} {COLUMNS[c]}" for c in names)).option("paths", json.dumps(list(paths)))
    if pages:
        source = source.option("pages", pages)
    if page_range:
        source = source.option("first", page_range[0]).option("last", page_range[1])
    return source.load()
