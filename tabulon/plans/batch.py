"""A batch of documents to files: a workbook, a QC report and log lines for each document.

The documents are processed as one plan, and their parts are kept as tables. Each document's rows then
meet in a task that writes its files, so the number of documents is spread over executors; the driver
has one outcome per document and the log. A document that fails is reported, the others go on.

Files are committed: a task writes them under names of its own attempt in a hidden folder, and when all
tasks of a turn (without a ``Control``, of the batch) have ended, the driver gives those of the attempts that
counted their final names, and removes the folder with what other attempts left. If a turn fails or is
cancelled, no file of it appears, and the log has STARTED without FINISHED for its documents.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import headers, qc, transform
from tabulon.operators.language import Profile
from tabulon.plans.documents import Result
from tabulon.sources import sinks
from tabulon.sources.config import Config

# --- fixed values: names of sheets and files ---
MAIN, REVIEW = "Spare Parts", "Unmapped (review)"
WORKBOOK, REPORT, LOG = "_PROCESSED.xlsx", "_QC_Report.csv", "WIP_Tracker.txt"


@dataclass
class Outcome:
    doc_id: str
    workbook: str | None = None
    report: str | None = None
    rows: int = 0
    failed: int = 0
    error: str | None = None
    #: What people should know of the rows and files.
    notes: list[str] = field(default_factory=list)


def log_entry(status: str, doc_id: str, rows: int, now: datetime | None = None) -> str:
    """A line of the run log; the same as ``qc.log_line``, for the driver's own events."""
    name = doc_id.replace("\\", "/").rsplit("/", 1)[-1]
    return f"[{now or datetime.now():%Y-%m-%d %H:%M:%S}] | [Status: {status}] | [{name}] | [Rows Processed: {rows}]"


def _log(folder: str, lines: list[str]) -> None:
    try:
        with open(os.path.join(folder, LOG), "a", encoding="utf-8") as f:
            f.writelines(x + "\n" for x in lines)
    except OSError:  # a log that can't be written stops nothing
        pass


def base_name(doc_id: str) -> str:
    return os.path.splitext(doc_id.replace("\\", "/").rsplit("/", 1)[-1])[0]


def review_table(rest: pd.DataFrame) -> pd.DataFrame:
    """One document's raw rows (their keys) with unmapped cells, a column for each header, in the order in
    which the document first has them. A column without cells here has a row without keys."""
    if rest.empty:
        return pd.DataFrame(columns=transform.KEYS)
    order = rest.groupby("raw_header")["place"].min().sort_values(kind="stable").index
    cells = rest[rest["row_no"].notna()].astype({"page_no": int, "row_no": int})
    wide = cells.pivot_table(index=transform.KEYS, columns="raw_header", values="value", aggfunc="max").reindex(columns=order).fillna("")
    return wide.add_prefix("[UNMAPPED] ").rename_axis(columns=None).reset_index()


def write_batch(result: Result, config: Config, doc_ids: list[str], out_dir: str, tables: str, detect: Callable[[str], str] | Profile | None = None, as_copy: bool = True, control: Control | None = None) -> list[Outcome]:
    """Files of ``doc_ids`` in ``out_dir``. Both it and ``tables``, where parts and unmapped cells are
    kept, are folders that driver and executors share. A workbook that is locked is kept under another name,
    or with ``as_copy`` false is an error of its document. With ``control`` the documents go in turns, and
    the batch can be watched and ended; the outcomes are then those of the documents that were finished."""
    spark = result.main.sparkSession
    os.makedirs(out_dir, exist_ok=True)
    _log(out_dir, [log_entry("STARTED", d, 0) for d in doc_ids])
    parts = qc.flag_language(result.main, detect if config.language_detection else None, "__foreign")
    columns = result.columns if result.columns is not None else result.unmapped.select("doc_id", "raw_header").distinct().withColumn("place", F.lit(0))
    placed = result.unmapped.join(columns, ["doc_id", "raw_header"]).unionByName(columns, allowMissingColumns=True)
    kept = {}
    for name, df in (("main", parts.withColumn("__failed", qc.fails(parts))), ("unmapped", placed)):
        path = f"{tables.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        kept[name] = spark.read.schema(df.schema).parquet(path)
    asked = dict.fromkeys(doc_ids)
    unread = {r["doc_id"]: Outcome(r["doc_id"], error=r["error"]) for r in result.errors.collect()} if result.errors is not None else {}
    out, taken = [], set()
    for turn in turns(list(asked), control.turn if control else None):
        if control and control.cancelled:
            break
        rows = {k: df.join(spark.createDataFrame([(d,) for d in turn], "doc_id string"), "doc_id", "left_semi") for k, df in kept.items()}
        try:
            done = _written(rows, config, out_dir, control)
        except Cancelled:
            break
        for d in turn:
            o = unread.get(d) or done[0].get(d) or Outcome(d)
            _commit(o, out_dir, taken, as_copy)
            out.append(o)
        shutil.rmtree(done[1], ignore_errors=True)
        _log(out_dir, [log_entry("FINISHED", o.doc_id, o.rows) for o in out[-len(turn) :] if o.error is None])
        if control:
            control.report(len(out), len(asked))
    return out


def turns(doc_ids: list[str], size: int | None) -> list[list[str]]:
    size = size or max(len(doc_ids), 1)
    return [doc_ids[i : i + size] for i in range(0, len(doc_ids), size)]


class Cancelled(Exception):
    """The turn's jobs were cancelled; nothing of it was committed."""


@dataclass
class Control:
    """What another thread may ask of a batch: how far it is, and to end.

    The documents go in turns of ``turn``; ``progress`` is called after each with documents done, and all.
    ``cancel`` ends the batch before the next turn, and ``cancel(now=True)`` also stops the running turn's
    jobs, by their tag; either way the documents of finished turns stay as they are. ``share`` says how much
    of the running turn's tasks are done, by Spark's status tracker."""

    spark: SparkSession
    turn: int = 1000
    progress: Callable[[int, int], None] | None = None
    tag: str = field(default_factory=lambda: f"tabulon-batch-{uuid.uuid4().hex}")
    cancelled: bool = False

    def cancel(self, now: bool = False) -> None:
        self.cancelled = True
        if now:
            self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def report(self, done: int, total: int) -> None:
        if self.progress:
            self.progress(done, total)

    def share(self) -> float | None:
        """None while no stage is active."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = self.spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(self.tag)
        stages = {i for job in jobs if (info := tracker.getJobInfo(job)) for i in info.stageIds}
        active = [x for i in tracker.getActiveStageIds() if i in stages and (x := tracker.getStageInfo(i))]
        total = sum(x.numTasks for x in active)
        return sum(x.numCompletedTasks for x in active) / total if total else None


def _written(rows: dict[str, DataFrame], config: Config, out_dir: str, control: Control | None) -> tuple[dict[str, Outcome], str]:
    """Outcomes of a turn's documents by id, whose files are named as their tasks wrote them, and the folder that
    they are in, which is gone if the turn fails."""
    attempts = os.path.join(out_dir, f".attempts-{uuid.uuid4().hex}")
    os.makedirs(attempts)
    sc = rows["main"].sparkSession.sparkContext
    groups = rows["main"].groupBy("doc_id").cogroup(rows["unmapped"].groupBy("doc_id"))
    written = groups.applyInPandas(_writer(config, attempts, sinks.write_workbook), "doc_id string, workbook string, report string, rows long, failed long, error string, notes array<string>")
    if control:
        sc.addJobTag(control.tag)
    try:
        return {r["doc_id"]: Outcome(**r.asDict()) for r in written.collect()}, attempts
    except BaseException as e:
        shutil.rmtree(attempts, ignore_errors=True)
        if control and control.cancelled and isinstance(e, Exception):
            raise Cancelled from e
        raise
    finally:
        if control:
            sc.removeJobTag(control.tag)


def _commit(o: Outcome, out_dir: str, taken: set[str], as_copy: bool) -> None:
    """Gives a document's files, as its task wrote them, their final names, which it notes in ``taken``."""
    written, o.workbook, o.report = {"workbook": o.workbook, "report": o.report}, None, None
    if o.error:
        return
    try:
        for kind, ending in (("workbook", WORKBOOK), ("report", REPORT)):
            if not written[kind]:
                continue
            wanted = os.path.join(out_dir, base_name(o.doc_id) + ending)
            target = sinks.free_path(wanted, as_copy or wanted in taken, taken)
            os.replace(written[kind], target)
            taken.add(target)
            setattr(o, kind, target)
            if target != wanted:
                why = "another document of the batch has that name" if wanted in taken else "it is locked"
                o.notes.append(f"{os.path.basename(wanted)} was kept as {os.path.basename(target)}: {why}")
    except Exception as e:  # one document's failure is its own
        o.error = f"{type(e).__name__}: {e}"


def _writer(config: Config, folder: str, write_workbook: Callable) -> Callable:
    """A function of one document's parts and unmapped cells that writes its files into the folder, under
    names that no other attempt has."""
    names = transform.columns(config)

    def write(main: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        doc_id = (main if len(main) else rest)["doc_id"].iloc[0]
        out = Outcome(doc_id, rows=len(main), failed=int(main["__failed"].sum()))
        base = os.path.join(folder, f"{uuid.uuid4().hex}-{base_name(doc_id)}")
        try:
            main, review = main.sort_values("row_index"), review_table(rest)
            extra = [c for c in review.columns if c not in transform.KEYS]
            if main["__foreign"].any():
                out.notes.append(f"{main['__foreign'].sum()} rows are flagged as not English")
            if extra:
                out.notes.append(f"{len(extra)} columns could not be mapped: their cells are in the review sheet")
            if out.rows:
                sheets = {MAIN: main[list(names.values())].set_axis(list(names), axis=1)}
                if extra:
                    sheets[REVIEW] = review.sort_values(["page_no", "row_no"])[extra]
                out.workbook = write_workbook(base + WORKBOOK, sheets)
            if out.failed:
                failed = main[main["__failed"]].merge(review, how="left", on=transform.KEYS) if extra else main[main["__failed"]]
                shown = names | {c: c for c in extra}
                out.report = sinks.write_qc_rows(base + REPORT, list(shown), zip(failed["row_index"], failed[list(shown.values())].itertuples(index=False, name=None)))
        except Exception as e:  # one document's failure is its own
            out.error = f"{type(e).__name__}: {e}"
        return pd.DataFrame([vars(out)])

    return write


def mapping_report(mapping: DataFrame) -> DataFrame:
    """Distinct raw headers with target, method and score; unmapped ones first, for review."""
    shown = mapping.filter(~F.col("raw_header").isin(headers.CONTEXT_COLUMNS))
    return shown.orderBy(F.col("target").isNotNull(), "raw_header")
