"""Repair of conversation structure by weighted interval parsing.

A repaired conversation's role initials are ``(s?(ua)+)?``. The repair grammar is in
Chomsky normal form: its nonterminals are pairs of places in that pattern (where a span
of rows begins, where it ends), X_pq -> X_pr X_rq, and X_pq -> one row's edit, with
insertions closed over on both sides. A cell holds the cheapest (cost, audit) of a
nonterminal over a span, the audit being the edits' initials; cells are combined
bottom-up by span length.

- Every nonterminal names both ends of its span, so one split of a span gives the least
  over all splits: spans of 1, 2, 4, ... rows are the whole table.
- Two audits of the same span and ends cost the same only if they differ before the
  shorter one's end (what is left over would be insertions, which cost), so the order by
  (cost, audit) is kept by concatenation and the least cells are exact, ties included.

Work is spread by spans, not by conversations: rows get their place by range
partitions, ``WIDTH`` neighbouring rows make a span (one task's row), ``WIDTH`` spans make
the next level's, until each conversation is one span; a conversation with a third of
all rows takes a level or two more. Equal spans are parsed once a worker. The repaired rows
come from exploding the audits and joining them to the rows by place.

A conversation's audit is one value, as its result asks for. Its digest (``repaired_digests``)
is of the whole conversation in order, so one task reads its rows as a stream and keeps the
state of the hash only.

Defined results: null role or text counts as one blank; a null conversation id is a
conversation, too; a null turn comes first; rows of one turn are taken by role, then text;
repeated rows are duplicates; an empty table gives empty ones; extra columns are ignored,
whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import SPACES, Stages
from claimlens.operators.order import global_position

#: Rows of a span of the first level; spans of a span of the next one.
WIDTH = 64
RE_ROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: Rows of one batch of exploded edits.
EDITS = 1 << 16

#: Places in the pattern: before all, after s, after u, after a.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
PLACES, ENDS = 4, (BEGIN, ASSISTANT)
STEPS = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INITIALS, LEGAL = "sua?", ("su", "ua", "au")
#: A row's symbol: 4 * fault + initial, as a letter from A on.
SOUND, TRUNCATED, TO_DELETE = range(3)

Cells = tuple  # PLACES * PLACES of (cost, audit) or None


# ------------------------------------------------------------------ cells

def combined(x: Cells, y: Cells) -> Cells:
    """X_pq -> X_pr X_rq: the least of each pair of ends over the places between."""
    out = []
    for p, q in product(range(PLACES), repeat=2):
        best = None
        for r in range(PLACES):
            a, b = x[p * PLACES + r], y[r * PLACES + q]
            if a and b and (best is None or a[0] + b[0] <= best[0]):
                new = (a[0] + b[0], a[1] + b[1])
                best = new if best is None else min(best, new)
        out.append(best)
    return tuple(out)


def _cells(rules: dict) -> Cells:
    return tuple(rules.get((p, q)) for p, q in product(range(PLACES), repeat=2))


@lru_cache(1)
def inserted() -> Cells:
    """The empty span: nothing, or insertions of u and a."""
    stay = {(p, p): (0, "") for p in range(PLACES)}
    one = _cells(stay | {(p, q): (INSERT, "I") for (p, role), q in STEPS.items() if role != "s"})
    return combined(one, one)


@lru_cache(64)
def row_cells(symbol: str) -> Cells:
    """One row's edits, with insertions before and after it."""
    fault, initial = divmod(ord(symbol) - 65, 4)
    rules = {(p, p): (DELETE, "D") for p in range(PLACES)}
    if fault != TO_DELETE:
        more = CUT_SHORT if fault == TRUNCATED else 0
        for (p, role), q in STEPS.items():
            edits = [(more, "K")] if role == INITIALS[initial] else []
            edits += [(more + RE_ROLE, "R")] if role != "s" else []
            if edits:
                rules[p, q] = min(edits)
    return combined(combined(inserted(), _cells(rules)), inserted())


@lru_cache(1 << 16)
def _pair(left: str, right: str) -> Cells:
    return combined(parsed(left), parsed(right))


def parsed(symbols: str) -> Cells:
    """The cells of a span, from those of its spans of 1, 2, 4, ... rows."""
    if len(symbols) == 1:
        return row_cells(symbols)
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return _pair(symbols[:half], symbols[half:])


class Span(NamedTuple):
    cells: Cells
    first: str
    last: str
    illegal: int


def span_of(symbols: str) -> Span:
    roles = "".join(INITIALS[(ord(s) - 65) % 4] for s in symbols)
    return Span(parsed(symbols), roles[0], roles[-1], sum(a + b not in LEGAL for a, b in zip(roles, roles[1:])))


def joined(spans: list[Span]) -> Span:
    """Neighbouring spans as one, pair by pair."""
    while len(spans) > 1:
        spans = [Span(combined(a.cells, b.cells), a.first, b.last, a.illegal + b.illegal + (a.last + b.first not in LEGAL))
                 for a, b in zip(spans[::2], spans[1::2])] + (spans[-1:] if len(spans) % 2 else [])
    return spans[0]


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells[BEGIN * PLACES + q] for q in ENDS if cells[BEGIN * PLACES + q])


# ------------------------------------------------------------ rows to symbols

def _symbols(placed: DataFrame, stages: Stages) -> DataFrame:
    """(conv, pos, turn, fault, symbol): each row's first fault and its symbol, narrow."""
    ink, initial = F.rtrim("text", F.lit(SPACES)), F.substring("role", 1, 1)
    narrow = stages.write(placed.select(
        "conv", "pos", "turn", (ink == "").alias("blank"), (~F.substring(ink, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("same")), "narrow")
    first = narrow.groupBy("conv", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("cut"), "truncated")
    known = narrow.join(first, "pos", "left").select("conv", "pos", "turn", "initial", fault.alias("fault"))
    kind = F.when(F.col("fault").isNull(), SOUND).when(F.col("fault") == "truncated", TRUNCATED).otherwise(TO_DELETE)
    return stages.write(known.select("conv", "pos", "turn", "fault", F.char(65 + 4 * kind + F.col("initial")).alias("symbol")), "symbols")


# ------------------------------------------------------------------ parsing

_CELL = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
_SPAN = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("cells", pa.list_(_CELL)), ("first", pa.string()),
                   ("last", pa.string()), ("illegal", pa.int64())])
_SPAN_SQL = "at bigint, n bigint, cells array<struct<cost:bigint,audit:string>>, first string, last string, illegal bigint"


def _out(batch: pa.RecordBatch, spans: list[Span]) -> pa.RecordBatch:
    cells = [[None if c is None else {"cost": c[0], "audit": c[1]} for c in s.cells] for s in spans]
    new = [pa.array(cells, _SPAN.field("cells").type), *(pa.array([s[k] for s in spans], _SPAN.types[3 + k]) for k in (1, 2, 3))]
    return pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names=_SPAN.names)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _out(batch, [span_of(x) for x in batch.column("symbols").to_pylist()])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _out(batch, [joined([Span(tuple(c and (c["cost"], c["audit"]) for c in s["cells"]), s["first"], s["last"], s["illegal"])
                                   for s in spans]) for spans in batch.column("spans").to_pylist()])


def _whole_spans(symbols: DataFrame, facts: DataFrame, stages: Stages) -> DataFrame:
    """One span a conversation, of all its rows."""
    kind = symbols.schema["conv"].dataType.simpleString()
    rows = symbols.join(facts.select(F.col("conv").alias("of"), "start", "n"), F.col("conv").eqNullSafe(F.col("of")))
    at = F.col("pos") - F.col("start")
    # A group holds WIDTH rows or spans at most.
    spans = rows.groupBy("conv", F.floor(at / WIDTH).alias("at"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("x")) \
        .select("conv", "at", "n", F.array_join("x.symbol", "").alias("symbols")).mapInArrow(_parse, f"conv {kind}, {_SPAN_SQL}")
    held, done, level = WIDTH, [], 0
    spans = stages.write(spans, "spans0")
    longest = facts.agg(F.max("n")).first()[0] or 0
    while held < longest:
        done.append(spans.filter(F.col("n") <= held))
        more = spans.filter(F.col("n") > held).groupBy("conv", F.floor(F.col("at") / WIDTH).alias("up"), "n").agg(
            F.sort_array(F.collect_list(F.struct("at", "cells", "first", "last", "illegal"))).alias("spans"))
        held, level = held * WIDTH, level + 1
        spans = stages.write(more.select("conv", F.col("up").alias("at"), "n", "spans").mapInArrow(_combine, f"conv {kind}, {_SPAN_SQL}"),
                             f"spans{level}")
    for part in done:
        spans = spans.unionByName(part)
    return spans


# ----------------------------------------------------------------- operator

class Repair(NamedTuple):
    """``conversations``: conv, n, gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``rows``: conv, seq, edit (K, R or I), role, text: the repaired conversations' rows in order of seq."""
    conversations: DataFrame
    rows: DataFrame


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, seq, pos, edit, role) of each edit but deletions; role where the edit sets it."""
    for batch in batches:
        for k, (start, audit) in enumerate(zip(batch.column("start").to_pylist(), batch.column("audit").to_pylist())):
            edits = np.frombuffer(audit.encode(), np.uint8)
            new, gone = edits == ord("I"), edits == ord("D")
            pos = start + np.cumsum(~new) - 1
            seq = np.cumsum(~gone) - 1
            odd = int((~gone).sum()) % 2  # only a kept s makes the number of rows odd
            role = np.where((seq - odd) % 2 == 0, "user", "assistant")
            at = np.flatnonzero(~gone)
            for i in range(0, len(at), EDITS):
                own = at[i:i + EDITS]
                e = edits[own]
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[k].as_py()] * len(own), batch.column(0).type), pa.array(seq[own]),
                    pa.array(pos[own], mask=new[own]), pa.array([chr(x) for x in e], pa.string()),
                    pa.array(role[own].tolist(), pa.string(), mask=e == ord("K"))], names=["conv", "seq", "pos", "edit", "role"])


def repair(rows: DataFrame, stages: Stages, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest repair of every conversation: keep 0, new role 1, delete 2 (blank and duplicate
    rows must go), insert an empty row 5; a truncated row that stays costs 5 more."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"),
                        F.monotonically_increasing_id().alias("row"))  # so that equal rows can be dealt to several ranges
    placed = global_position(named, ["conv", F.col("turn").asc_nulls_first(), "role", "text", "row"], name="pos").drop("row")
    symbols = _symbols(placed, stages)
    told = lambda fault: F.count_if(F.coalesce(F.col("fault") == fault, F.lit(False))).alias(fault)
    facts = stages.write(symbols.groupBy("conv").agg(
        F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"), told("blank"), told("duplicate"), told("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")), "facts")
    spans = _whole_spans(symbols, facts, stages)
    # Of the places at the end, 0 or ASSISTANT may be the cheapest: the least (cost, audit).
    ends = F.array_min(F.filter(F.array(*(F.get("cells", F.lit(BEGIN * PLACES + q)) for q in ENDS)), lambda c: c.isNotNull()))
    best = spans.select(F.col("conv").alias("of"), "illegal", ends.alias("best"))
    found = stages.write(facts.join(best, F.col("conv").eqNullSafe(F.col("of"))).select(
        "conv", "start", "n", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"),
        F.col("best.audit").alias("audit")), "found")
    kind = rows.schema[conv].dataType.simpleString()
    edits = found.select("conv", "start", "audit").mapInArrow(_edits, f"conv {kind}, seq bigint, pos bigint, edit string, role string")
    own = placed.select("pos", F.col("role").alias("was"), "text")
    stay = edits.filter("edit <> 'I'").join(own, "pos").select("conv", "seq", "edit", F.coalesce("role", "was").alias("role"), "text")
    new = edits.filter("edit = 'I'").select("conv", "seq", "edit", "role", F.lit("").alias("text"))
    stages.drop("narrow")
    return Repair(found.drop("start"), stay.unionByName(new))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's lines; rows come in order."""
    now, state, seen = None, None, False
    for batch in batches:
        convs, out = batch.column(0).to_pylist(), []
        for c, role, text in zip(convs, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if not seen or c != now:
                if seen:
                    out.append((now, state.hexdigest()))
                now, state, seen = c, hashlib.sha256(), True
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if out:
            yield _digests(out, batch)
    if seen:
        yield _digests([(now, state.hexdigest())], batch)


def _digests(out: list, batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], batch.column(0).type), pa.array([d for _, d in out])],
                                      names=["conv", "repaired_sha256"])


def repaired_digests(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repaired rows: `role:text`, joined by line feeds."""
    kind = rows.schema["conv"].dataType.simpleString()
    return rows.repartition("conv").sortWithinPartitions("conv", "seq").select("conv", "role", "text") \
        .mapInArrow(_hashed, f"conv {kind}, repaired_sha256 string")


# ---------------------------------------------------------- digest columns

def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of `conv_id:turn` modulo 20 a row goes (0), loses its text (1) or its
    sentence ends (2), is there twice (3) or becomes the user's (4)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    named = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), k.alias("k")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Per original conversation: gaps, faults and illegal neighbours after the damage, and the cheapest
    repair's cost, audit and digest."""
    stages = Stages(conversations.sparkSession)
    found = repair(damaged(conversations), stages)
    hashes = repaired_digests(found.rows).withColumnRenamed("conv", "of")
    counts = found.conversations.drop("n").join(hashes, F.col("conv").eqNullSafe(F.col("of")), "left").drop("of")
    every = conversations.select("conv_id").distinct()
    none = hashlib.sha256(b"").hexdigest()
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(counts, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
