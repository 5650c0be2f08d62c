"""Chat formatting in budgeted windows.

A conversation becomes windows of at most ``budget`` tokens (estimates, one expression). Prefix sums
of the turns' tokens choose turn-aligned spans: with a stride of the budget less the history and the
system turn, a turn that lies within one stride belongs to that stride's span, and one that crosses
into the next is a span of its own; so a span exceeds the stride only if a single turn does (it is
kept whole). Each window repeats the leading system turn and, of the span before, the last turns that
fit into ``history`` tokens. Only assistant turns that are new in a window are under its loss mask, so
each is a target once.

A long system turn takes its tokens from the history first, and never from the stride below half of
the budget. So windows exceed the budget in two cases only: by what a turn has beyond the stride, and
by what the system turn has beyond half of the budget. Without the second rule every turn would become
a window, each with the whole system turn.

By default rows move once, by conversation, whatever its length: running sums place each turn, spans are
made where the turns are, and a window takes its history from the span before it. A task goes through its
conversations turn by turn, and what it holds of one beyond a few thousand turns is on disk. A digest of a
conversation needs its bytes in that order in any case.

With ``spread``, a conversation's windows are made by many tasks, for whoever needs the windows alone and has
conversations beyond a task: sums are made in two levels, over blocks of ``BLOCK`` turn numbers and over the
blocks' sums; texts move by conversation and block, then by span, and repeated turns once more. The windows are
the same. Keys are columns without nulls, so that each step finds the rows where the one before has put them.

Template: ``### role``, a line feed, the text, a line feed, ``</turn>``, a line feed. In roles and
texts a backslash, ``</turn>`` and ``###`` (in roles also a line feed) are escaped, which
``unescape`` undoes.

Defined cases: null texts and roles are empty; turns are ordered by turn (null first), role and text,
so repeated rows are turns each; a turn of any length stays whole; a null conv_id is a conversation;
other columns are dropped; an empty table gives no windows; a conversation of a system turn alone is
one window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tabulon.llm.session import arrow, partitions, table

BUDGET, HISTORY, BLOCK = 512, 128, 64
CONTROL = [("\\", "\\\\"), ("</turn>", "\\E"), ("###", "\\H")]
BEGIN, END = "### ", "\n</turn>\n"
_BACK = {"\\": "\\", "E": "</turn>", "H": "###", "N": "\n"}


def escape(text: Column, line_feeds: bool = False) -> Column:
    for plain, escaped in CONTROL + [("\n", "\\N")] * line_feeds:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\([\\EHN])", lambda m: _BACK[m[1]], text)


def token_estimate(text: Column) -> Column:
    """Four bytes a token, and eight tokens for the marks of a turn."""
    return (F.floor((F.octet_length(text) + 3) / 4) + 8).cast("long")


#: Columns of a conversation's key: its id (0 if null) and whether it is null.
KEY = ["c", "nameless"]


def shares(system: Column, budget: int, history: int) -> tuple[Column, Column]:
    """Tokens of a span and of its history, beside a system turn of so many tokens."""
    floor = budget // 2
    repeated = F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget - floor) - system))
    return F.greatest(F.lit(budget) - system - repeated, F.lit(floor)), repeated


def _rows(turns: DataFrame) -> DataFrame:
    return turns.select(F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("nameless"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tokens", token_estimate(F.col("text")))


def _order(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(F.col("turn").asc_nulls_first(), "role", "text")


def _placed(rows: DataFrame) -> DataFrame:
    """Turns with their position, the tokens up to their end, and the text of the system turn that leads
    their conversation, if one does."""
    inner = _order(KEY)
    up_to = inner.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.col("role") == "system", F.col("text"))).over(up_to)
    numbered = rows.withColumns({"end": F.sum("tokens").over(up_to), "pos": F.row_number().over(inner) - 1, "first": first, "more": F.lead(F.lit(True)).over(inner)})
    return numbered.withColumn("system", F.when((F.col("pos") > 0) | F.col("more"), F.col("first")))


def _placed_by_blocks(rows: DataFrame) -> DataFrame:
    """The same, and their block, from sums of blocks: of each the tokens and turns before it."""
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    named = F.col("turn").isNotNull().alias("named")
    first = F.min(F.struct(named, "turn", "role"))
    said = F.min(F.when(F.col("role") == "system", F.struct(named, "turn", "text")))
    sums = rows.groupBy(*KEY, "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), first.alias("first"), said.alias("said"))
    whole = Window.partitionBy(*KEY)
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    leads = (F.min("first").over(whole)["role"] == "system") & (F.sum("n").over(whole) > 1)
    system = F.when(leads, F.min("said").over(whole)["text"])
    sums = sums.select(*KEY, "block", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), system.alias("system"))
    inner = _order([*KEY, "block"])
    up_to = inner.rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, [*KEY, "block"]).withColumns({"end": F.col("t0") + F.sum("tokens").over(up_to), "pos": F.col("n0") + F.row_number().over(inner) - 1})


def _spanned(placed: DataFrame, by: list[str], budget: int, history: int) -> DataFrame:
    """Turns but for the leading system turn, with their window and ``turn``: position, tokens before
    it and up to its end, role and text, and the system turn's text at the first of a window (and block)."""
    placed = placed.withColumn("begin", F.col("end") - F.col("tokens")).filter("pos > 0 OR system IS NULL")
    s_tokens = F.coalesce(token_estimate(F.col("system")), F.lit(0))
    stride, _ = shares(s_tokens, budget, history)
    from_, to = (F.floor((at - s_tokens) / stride) for at in (F.col("begin"), F.col("end") - 1))
    # never null, and known to be: else the optimiser filters one use of the spans and makes them twice
    body = placed.withColumn("window", F.coalesce((2 * from_ + (from_ != to).cast("long")).cast("long"), F.lit(0)))
    new = ~F.lag("window").over(_order(by)).eqNullSafe(F.col("window"))
    return body.select(*KEY, "window", F.struct("pos", "begin", "end", "role", "text", F.when(new, F.col("system")).alias("system")).alias("turn"))


def _spans(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """By span its turns, the system turn's text, and ``last``: the turns that the next span repeats."""
    spans = placed.groupBy(*KEY, "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    spans = spans.withColumn("system", F.get(F.filter(F.transform("turns", lambda t: t["system"]), lambda x: x.isNotNull()), 0))
    _, fits = shares(F.coalesce(token_estimate(F.col("system")), F.lit(0)), budget, history)
    return spans.withColumn("last", F.filter("turns", lambda t: F.element_at("turns", -1)["end"] - t["begin"] <= fits))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, spread: bool = False) -> DataFrame:
    """conv_id, window (ascending), n_repeated (leading turns that are not new), text, and loss: the
    character ranges of the text under the loss mask. Each conversation's windows are in one task, in order;
    with ``spread`` they are anywhere."""
    rows, after = _rows(turns), Window.partitionBy(*KEY).orderBy("window")
    if not spread:
        spans = _spans(_spanned(_placed(rows), KEY, budget, history), budget, history)
        spans = spans.withColumn("tail", F.lag("last").over(after))
        return _formatted(spans.sortWithinPartitions(*KEY, "window"))
    placed = _spanned(_placed_by_blocks(rows), [*KEY, "block"], budget, history)
    spans = _spans(placed, budget, history)
    follows = placed.select(*KEY, "window").distinct().withColumn("next", F.lead("window").over(after)).filter("next IS NOT NULL")
    tails = spans.select(*KEY, "window", F.col("last").alias("tail")).filter(F.size("tail") > 0).join(follows, [*KEY, "window"]).select(*KEY, F.col("next").alias("window"), "tail")
    return _formatted(spans.join(tails, [*KEY, "window"], "left"))


def _formatted(spans: DataFrame) -> DataFrame:
    joined = spans.withColumn("conv_id", F.when(~F.col("nameless"), F.col("c")))
    turn = lambda t, new: F.struct(t["role"].alias("role"), t["text"].alias("text"), new.alias("new"))
    starts = F.element_at("turns", 1)["pos"] == 1
    none = F.filter(F.array(turn(F.element_at("turns", 1), F.lit(True))), lambda _: F.lit(False))
    leading = F.struct(F.lit("system").alias("role"), F.col("system").alias("text"), starts.alias("new"))
    head = F.when(F.col("system").isNotNull(), F.array(leading)).otherwise(none)
    tail = F.coalesce(F.transform("tail", lambda t: turn(t, F.lit(False))), none)
    joined = joined.select("conv_id", "window", F.concat(head, tail, F.transform("turns", lambda t: turn(t, F.lit(True)))).alias("turns"))
    joined = joined.withColumn("marked", F.transform("turns", lambda t: F.struct(F.concat(F.lit(BEGIN), escape(t["role"], True), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["new"] & (t["role"] == "assistant")).alias("loss"))))
    at = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<begin:int,end:int>>)").alias("loss"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(m["head"])
        end = begin + F.length(m["body"])
        return F.struct((end + len(END)).alias("at"), F.when(m["loss"], F.concat(acc["loss"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))).otherwise(acc["loss"]).alias("loss"))

    text = F.array_join(F.transform("marked", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
    return joined.select("conv_id", "window", F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_repeated"), text.alias("text"), F.aggregate("marked", at, step)["loss"].alias("loss"))


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    out = []
    for piece in text.split(END)[:-1]:
        role, _, body = piece.removeprefix(BEGIN).partition("\n")
        out.append((unescape(role), unescape(body)))
    return out


def digests(formatted: DataFrame, dealt: bool = False) -> DataFrame:
    """What the windows of each conversation hold, read back in order as a stream: a task keeps the
    running digests of one conversation and one window. With ``dealt``, the windows of a conversation
    are in one task and in order already."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state = None

        def close() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        def table_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            out = []
            for conv_id, repeated, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss"))):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        out.append(close())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(text)
                # the repeated ones lead, but for a system turn that is new in the first window, where nothing is repeated
                for role, said in turns[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for r in loss:
                    said = unescape(text[r["begin"] : r["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if out:
                yield table_of(out)
        if state is not None:
            yield table_of([close()])

    spread = formatted.select("conv_id", "window", "n_repeated", "text", "loss")
    if not dealt:
        spread = spread.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    return arrow(spread, scan, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: A conversation whose texts hold the template's control strings.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(windows(turns), dealt=True)


#: The same rows in DuckDB, with the spans, the repeated turns and all lengths worked out again.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, (octet_length(encode(text)) + 3) // 4 + 8 AS tokens,
    4 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\E'), '###', '\H'), chr(10), '\N')) + 1
      + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\E'), '###', '\H')) + 9 AS chars
  FROM t
), p AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS e
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), h AS (SELECT conv_id, tokens AS s_tokens, chars AS s_chars FROM p WHERE pos = 0 AND role = 'system' AND n > 1),
b AS (
  SELECT p.*, e - tokens AS b, coalesce(s_tokens, 0) AS st, s_chars, greatest(0, least(128, 256 - coalesce(s_tokens, 0))) AS hist,
    greatest(512 - coalesce(s_tokens, 0) - greatest(0, least(128, 256 - coalesce(s_tokens, 0))), 256) AS stride
  FROM p LEFT JOIN h USING (conv_id) WHERE NOT (pos = 0 AND role = 'system' AND n > 1)
), s AS (
  SELECT *, 2 * ((b - st) // stride) + CASE WHEN (b - st) // stride <> (e - 1 - st) // stride THEN 1 ELSE 0 END AS win FROM b
), z AS (SELECT *, max(e) OVER (PARTITION BY conv_id, win) AS span_end, max(win) OVER (PARTITION BY conv_id) AS last_win FROM s),
f AS (
  SELECT conv_id, sum(chars) + sum(CASE WHEN win < last_win AND span_end - b <= hist THEN chars ELSE 0 END) + coalesce(max(s_chars), 0) * count(DISTINCT win) AS formatted_chars
  FROM z GROUP BY conv_id
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  max(formatted_chars)::BIGINT AS formatted_chars
FROM t JOIN f USING (conv_id) GROUP BY conv_id
"""
