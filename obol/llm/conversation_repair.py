"""Conversation structure repair: weighted CYK interval parsing over the turns of each conversation.

A repaired conversation's role initials match ``(s?(ua)+)?``.  The grammar in
Chomsky normal form has one symbol ``X[p, q]`` for each pair of states of that
pattern: ``X[p, q] -> X[p, r] X[r, q]`` for spans, and for a single turn the
edits Keep, Rerole and Delete, closed under insertion on both sides.  A cell
holds the least (cost, audit) with which a span of turns takes the pattern from
p to q; cells of spans are combined bottom-up by span length.

A symbol that stands for a pair of states gives the same least cell at every
split point, because each derivation is in some state r there.  Spans of up to
``SPAN`` turns are parsed with all split points; longer spans are joined from
``FAN`` neighbouring ones a round, in a Spark grouping of at most FAN rows, so
no task holds a long conversation's chart.  Two audits of one span and equal
cost are never proper prefixes of each other (both have one letter for each
turn, and more insertions cost more), so the least audit of a whole is made of
least audits of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obol.llm.common import ship, staged
from obol.operators.running import running

SPAN = 16
FAN = 16
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: States of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
STATES = range(4)
CELL = "array<struct<p:int,q:int,cost:bigint,audit:string>>"

Cells = dict[tuple[int, int], tuple[int, str]]


def _best(cells: Cells, at: tuple[int, int], value: tuple[int, str]) -> None:
    if at not in cells or value < cells[at]:
        cells[at] = value


def join(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans taken together."""
    out: Cells = {}
    for (p, r), (c1, a1) in left.items():
        for q in STATES:
            if (r, q) in right:
                c2, a2 = right[r, q]
                _best(out, (p, q), (c1 + c2, a1 + a2))
    return out


@lru_cache(1)
def inserted() -> Cells:
    """Insertion closure: an empty span from p to q by inserted user and assistant turns alone."""
    one: Cells = {(p, p): (0, "") for p in STATES}
    for (p, role), q in STEPS.items():
        if role != "s":
            _best(one, (p, q), (COST["I"], "I"))
    return join(join(one, one), one)


@lru_cache(1 << 8)
def turn(symbol: str) -> Cells:
    """Cells of one turn: its letter is the role initial, in upper case if truncated, ``-`` if it has to go."""
    out: Cells = {}
    extra = TRUNCATED if symbol.isupper() else 0
    for p in STATES:
        _best(out, (p, p), (COST["D"], "D"))
        if symbol != "-":
            for role in "sua":
                if (p, role) in STEPS:
                    if role == symbol.lower():
                        _best(out, (p, STEPS[p, role]), (COST["K"] + extra, "K"))
                    if role != "s":
                        _best(out, (p, STEPS[p, role]), (COST["R"] + extra, "R"))
    return join(join(inserted(), out), inserted())


@lru_cache(1 << 14)
def parse_span(symbols: str) -> Cells:
    """CYK over a short span: cells of all its parts, by length, with all split points."""
    n = len(symbols)
    if not n:
        return inserted()
    chart = {(i, i + 1): turn(s) for i, s in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cells: Cells = {}
            for k in range(i + 1, i + length):
                for at, value in join(chart[i, k], chart[k, i + length]).items():
                    _best(cells, at, value)
            chart[i, i + length] = cells
    return chart[0, n]


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells[0, q] for q in ACCEPT if (0, q) in cells)


def _as_rows(cells: Cells) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in sorted(cells.items())]


def _as_cells(rows: list[dict]) -> Cells:
    return {(r["p"], r["q"]): (r["cost"], r["audit"]) for r in rows}


_CELL_TYPE = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def key(conv: Column) -> Column:
    """Text that tells conversations apart, null from all others."""
    return F.when(conv.isNull(), F.lit("n")).otherwise(F.concat(F.lit("c"), conv.cast("string")))


def damage(rows: DataFrame) -> DataFrame:
    """Turns damaged by crc32("conv_id:turn") mod 20, nulls as one space.

    0 drops the turn, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of
    it, 3 repeats the turn, 4 makes its role user; all others stay.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    c = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"),
                    (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1)))
    return c.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_n")).drop("_n")


def placed(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with their place in the conversation, staged.

    Turns are ordered by ``turn``, nulls first, then role and text.  Null role
    or text is one space.
    """
    c = rows.select(key(F.col("conv_id")).alias("_c"), "conv_id", F.col("turn").cast("long").alias("turn"),
                    F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    c = c.withColumn("initial", F.substring("role", 1, 1))
    return staged(running(c, ["_c"], ["turn", "role", "text"], lasts=["turn", "initial"]).withColumnRenamed("_rn", "place"), "turns")


def marked(turns: DataFrame) -> DataFrame:
    """First fault, parse symbol and measures of every placed turn, staged without texts.

    ``fault`` is the first of blank, duplicate (role and text seen earlier in
    the conversation) and truncated, or null.
    """
    end = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    c = turns.select("_c", "place", "turn", "initial", "_prev_turn", "_prev_initial", (end == "").alias("_blank"), F.right(end, F.lit(1)).alias("_last"),
                     F.sha2(F.concat("role", F.lit("\0"), "text"), 256).alias("_same"))
    c = running(c, ["_c", "_same"], ["place"])
    fault = F.when(F.col("_blank"), "blank").when(F.col("_rn") > 1, "duplicate").when(~F.col("_last").isin(".", "!", "?"), "truncated")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return staged(c.withColumn("fault", fault).select(
        "_c", "place", "turn", "fault", symbol.alias("symbol"),
        ((F.col("place") > 1) & ~F.concat("_prev_initial", "initial").isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_prev_turn"))).alias("new_turn")), "marks")


def parsed(marks: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """Least cost and audit of every conversation: ``_c``, ``cost``, ``audit``."""
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_as_rows(parse_span(x)) for x in b.column(2).to_pylist()], _CELL_TYPE)],
                                             names=["_c", "at", "cells"])

    def wider(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [_as_rows(reduce(join, map(_as_cells, x))) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, _CELL_TYPE)], names=["_c", "at", "cells"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [cheapest(_as_cells(x)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in best], pa.int64()), pa.array([a for _, a in best], pa.string())],
                                             names=["_c", "cost", "audit"])

    def in_order(value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("_i", value))), lambda x: x[value])

    longest = marks.agg(F.max("place")).first()[0] or 0
    schema = f"_c string, at long, cells {CELL}"
    spans = marks.withColumn("_i", F.col("place")).groupBy("_c", F.floor((F.col("place") - 1) / span).alias("at")) \
        .agg(F.array_join(in_order("symbol"), "").alias("symbols")).mapInArrow(leaves, schema)
    count = -(-longest // span)
    while count > 1:
        spans = spans.withColumn("_i", F.col("at")).groupBy("_c", F.floor(F.col("at") / fan).alias("up")).agg(in_order("cells").alias("parts")) \
            .select("_c", F.col("up").alias("at"), "parts").mapInArrow(wider, schema)
        count = -(-count // fan)
    return spans.mapInArrow(whole, "_c string, cost long, audit string")


_ROLE = {"u": "user", "a": "assistant"}


def edits(audits: DataFrame) -> DataFrame:
    """One row for each letter of an audit: ``_c``, ``pos`` among the turns that remain, ``edit``, ``place`` of the turn
    it is about (null: inserted) and the new ``role`` (null: as it was).

    The roles follow from the audit: what remains alternates user and
    assistant, after a system turn if its number is odd.
    """
    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 1 << 16
        for b in batches:
            for conv, audit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                letter = np.frombuffer(audit.encode(), "S1")
                stays = letter != b"D"
                pos, place = np.cumsum(stays), np.cumsum(letter != b"I")
                shift = int(pos[-1]) % 2 if len(pos) else 0
                for lo in range(0, len(letter), step):
                    own = slice(lo, lo + step)
                    edit, p = letter[own], pos[own]
                    role = np.where((p - shift) % 2 == 1, _ROLE["u"], _ROLE["a"])
                    given = (edit == b"R") | (edit == b"I")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([conv] * len(edit), pa.string()), pa.array(p, pa.int64()), pa.array(edit.astype("U1").tolist(), pa.string()),
                         pa.array(place[own], pa.int64(), mask=edit == b"I"), pa.array(np.where(given, role, "").tolist(), pa.string(), mask=~given)],
                        names=["_c", "pos", "edit", "place", "new_role"])

    return audits.select("_c", "audit").mapInArrow(events, "_c string, pos long, edit string, place long, new_role string")


def repair(rows: DataFrame, span: int = SPAN, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Faults and cheapest edits of every conversation of ``rows`` (conv_id, turn, role, text), and the repaired turns.

    The first table has conv_id, gaps (turns missing between the first and the
    last), blank, duplicate, truncated, illegal (neighbours other than system
    user, user assistant, assistant user), cost and audit; the second conv_id,
    pos (1, 2, ...), role, text and edit of the turns that remain.

    Null conv_ids are one conversation; null turns come first and count for no
    gap; null roles and texts are one space; of equal turns the copies are
    duplicates; other columns are not read; an empty table gives two empty
    ones.  A conversation of any length is parsed in spans over many tasks.
    """
    spark = rows.sparkSession
    ship(spark)
    turns = placed(rows)
    marks = marked(turns)
    audits = staged(parsed(marks, span, fan), "audits")
    n = lambda cond: F.count(F.when(cond, 1))
    fault = F.col("fault")
    measures = marks.groupBy("_c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - n(F.col("new_turn")), F.lit(0).cast("long")).alias("gaps"),
        *[n(fault == x).alias(x) for x in ("blank", "duplicate", "truncated")], n(F.col("illegal")).alias("illegal"))
    ids = turns.where("place = 1").select("_c", "conv_id")
    summary = ids.join(measures, "_c").join(audits, "_c")
    kept = edits(audits).where("edit <> 'D'").join(turns.select("_c", "place", "role", "text"), ["_c", "place"], "left") \
        .select("_c", "pos", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")
    return summary, kept


def line_digests(kept: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's repaired ``role:text`` lines joined by newlines: ``_c``, ``sha256``.

    A digest reads its input in order, so one task hashes one conversation; it
    streams the sorted lines and holds a batch of them, never the whole.
    """
    lines = kept.select("_c", "pos", F.concat("role", F.lit(":"), "text").alias("line")).repartition("_c").sortWithinPartitions("_c", "pos").select("_c", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done: list[tuple[str, str]] = []
            for conv, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if conv != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield _digests(done)
        if now is not None:
            yield _digests([(now, state.hexdigest())])

    return lines.mapInArrow(run, "_c string, sha256 string")


def _digests(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], names=["_c", "sha256"])


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Measures, cost, audit and repaired_sha256 of every conversation of the damaged table.

    A conversation of which the damage leaves no turn has zeros, an empty audit
    and the digest of the empty text, as has one of which the repair keeps no
    turn for its digest.
    """
    summary, kept = repair(damage(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = conversations.select(key(F.col("conv_id")).alias("_c"), "conv_id").distinct()
    out = ids.join(summary.drop("conv_id"), "_c", "left").join(line_digests(kept), "_c", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
