"""Conversation structure repair by cost layers of reachable grammar states.

A repaired conversation's role initials spell `(s?(ua)+)?`. Each row is kept, re-roled, or deleted, and
empty turns may be inserted anywhere; every edit has a cost. As in Wu and Manber's matching with errors,
a turn has one bitset of reachable grammar states for each cost, and all layers of a turn lie in one
integer, so an edit is a mask and a shift: by the state it leads to, and by its cost in layers. Layers
are counted from a turn's cheapest; those more than BAND - 1 above it are let go, since from any state
the grammar's end is at most that much dearer than from any other (an insert, and the deletion of a
system turn). The first layer of the last turn that holds an accepting state is the cost. A second pass
backwards keeps the bits from which that state is reached at exactly that cost, and a walk along them
takes the least letter at each step, which gives the least audit.

A conversation of very many rows is dealt to parts, in order. What a part costs from each state to each
state is a small matrix; the matrices of a conversation say what is left to pay after each part, and with
that every part finds its edits by itself, for each state that it may be entered in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, drop_table, materialize, named

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT is added for a truncated row that stays
BAND, STATES = 8, 4
#: Grammar states, one bit each: nothing yet, after a system turn, after a user's, after an assistant's (accepting, as is nothing).
_START, _SYSTEM, _USER, _ASSISTANT = (sum(1 << (STATES * k + s) for k in range(64)) for s in range(STATES))
_WHOLE = (1 << STATES * BAND) - 1
_LEGAL = {b"su", b"ua", b"au"}
#: What is left to pay at the end by state: empty turns up to an assistant's.
_END = (0, 2 * INSERT, INSERT, 0)
#: Rows of a conversation that one task takes; longer ones are dealt to parts.
LONG_ROWS = 100_000


def _kept(bits: int, initial: bytes) -> int:
    """Where a row of this initial leads to from a set of states."""
    if initial == b"u":
        return (bits & _START) << 2 | (bits & _SYSTEM) << 1 | (bits & _ASSISTANT) >> 1
    if initial == b"a":
        return (bits & _USER) << 1
    return (bits & _START) << 1 if initial == b"s" else 0


def _spoken(bits: int) -> int:
    """Where a user's or an assistant's turn leads to."""
    return _kept(bits, b"u") | _kept(bits, b"a")


def _kept_from(bits: int, initial: bytes) -> int:
    if initial == b"u":
        return (bits & _USER) >> 2 | (bits & _USER) >> 1 | (bits & _USER) << 1
    if initial == b"a":
        return (bits & _ASSISTANT) >> 1
    return (bits & _SYSTEM) >> 1 if initial == b"s" else 0


def _spoken_from(bits: int) -> int:
    return _kept_from(bits, b"u") | _kept_from(bits, b"a")


def _inserted(bits: int) -> int:
    """With what empty turns before the next row lead to: two of them at most, a third would only come back."""
    bits |= _spoken(bits) << STATES * INSERT
    return bits | _spoken(bits) << STATES * INSERT


def _step(now: int, initial: bytes, fault: int | None) -> int:
    """The states after a row, in layers of those before it. Blank and duplicate rows are deleted."""
    after = now << STATES * DELETE
    if fault not in (0, 1):
        more = CUT * (fault == 2)
        after |= _kept(now, initial) << STATES * (KEEP + more) | _spoken(now) << STATES * (REROLE + more)
    return _inserted(after)


def _forward(marks: list[tuple[bytes, int | None, int]], entry: int) -> tuple[list[int], list[int]]:
    """Reachable states before each row and at the end, and the cost of their first layer."""
    reach, base = [_inserted(1 << entry)], [0]
    for initial, fault, again in marks:
        after = _step(reach[-1], initial, fault)
        least = ((after & -after).bit_length() - 1) // STATES
        reach.append(after >> STATES * least & _WHOLE)
        base.append(base[-1] + least + DELETE * again)
    return reach, base


def _exits(reach: int, base: int) -> list[int | None]:
    """The least cost of each state among the layers; null for states that are not there."""
    own = [reach & mask for mask in (_START, _SYSTEM, _USER, _ASSISTANT)]
    return [base + ((x & -x).bit_length() - 1) // STATES if x else None for x in own]


def least_edits(marks: list[tuple[bytes, int | None, int]], entry: int = 0, tail: tuple[int, ...] = _END) -> tuple[int, str, int]:
    """(cost, audit, state at the end) of rows given by (initial of the role, fault, how often it is repeated).

    fault: 0 blank, 1 duplicate, 2 truncated, or None; repeats are deleted. tail: what each state costs from the end on, which the
    cost includes; empty turns after the last row are left to it. The audit is the least of the cheapest edits' initials: D, I, K, R.
    """
    reach, base = _forward(marks, entry)
    costs = [None if c is None else c + t for c, t in zip(_exits(reach[-1], base[-1]), tail, strict=True)]
    total = min(c for c in costs if c is not None)
    bits = sum(1 << STATES * (c - tail[e] - base[-1]) + e for e, c in enumerate(costs) if c == total)
    good = [0] * len(reach)
    for at in range(len(marks), -1, -1):
        for _ in range(2 * (at < len(marks))):
            bits |= _spoken_from(bits) >> STATES * INSERT & reach[at]
        good[at] = bits
        if at:
            initial, fault, again = marks[at - 1]
            bits <<= STATES * (base[at] - base[at - 1] - DELETE * again)
            before = bits >> STATES * DELETE
            if fault not in (0, 1):
                more = CUT * (fault == 2)
                before |= _kept_from(bits, initial) >> STATES * (KEEP + more) | _spoken_from(bits) >> STATES * (REROLE + more)
            # an empty turn after the row, before the next
            bits = before & reach[at - 1]
    audit, spot, at = [], 1 << entry, 0  # spot: the one bit of the walk's state, in the layers of turn `at`
    while at < len(marks):
        initial, fault, again = marks[at]
        shift = STATES * (base[at + 1] - base[at] - DELETE * again)
        steps = [("D", spot << STATES * DELETE >> shift & good[at + 1]), ("I", _spoken(spot) << STATES * INSERT & good[at])]
        if fault not in (0, 1):
            more = CUT * (fault == 2)
            steps += [("K", _kept(spot, initial) << STATES * (KEEP + more) >> shift & good[at + 1]), ("R", _spoken(spot) << STATES * (REROLE + more) >> shift & good[at + 1])]
        letter, spot = next(step for step in steps if step[1])
        audit.append(letter)
        if letter != "I":
            at += 1
            audit.append("D" * again)
    return total, "".join(audit), (spot.bit_length() - 1) % STATES


def _closing(state: int) -> str:
    """The empty turns that end a conversation in this state."""
    return "I" * (_END[state] // INSERT)


_STATE_OF = {b"s": 1, b"u": 2, b"a": 3}


def _edited(rows: Iterable[tuple[bytes, bytes]], audit: str, state: int = 0) -> list[dict[str, bytes]]:
    """What the edits make of rows (role, text), from a grammar state on."""
    out, rows = [], iter(rows)
    for edit in audit:
        role, text = (b"", b"") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = b"assistant" if state == 2 else b"user"
        state = _STATE_OF[role[:1]]
        out.append({"role": role, "text": text})
    return out


@dataclass(slots=True)
class Conversation:
    """The rows of a conversation, in order, as (role, text) bytes, and what the fold knows of them."""

    conv_id: int | None
    rows: list[tuple[bytes, bytes]] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)  # without nulls

    def repaired(self) -> tuple:
        """(conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired turns)."""
        seen, marks, counts = set(), [], [0, 0, 0]
        for row in self.rows:
            said = row[1].rstrip(WHITE)
            fault = 0 if not said else 1 if row in seen else 2 if said[-1] not in b".!?" else None
            seen.add(row)
            if fault is not None:
                counts[fault] += 1
            marks.append((row[0][:1], fault, 0))
        illegal = sum(a[0] + b[0] not in _LEGAL for a, b in zip(marks, marks[1:], strict=False))
        gaps = max(self.turns) - min(self.turns) + 1 - len(set(self.turns)) if self.turns else 0
        cost, audit, state = least_edits(marks)
        audit += _closing(state)
        return self.conv_id, 0, 1, gaps, *counts, illegal, cost, audit, _edited(self.rows, audit)


_SCHEMA = "conv_id long, part int, parts int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role: binary, text: binary>>"
_ARROW = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.list_(pa.struct([("role", pa.binary()), ("text", pa.binary())]))]
_NAMES = ["conv_id", "part", "parts", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation -> a row per conversation."""
    held: list[Conversation] = []  # the last may go on
    waiting = 0
    for batch in batches:
        for conv_id, turn, role, text, lost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not held or held[-1].conv_id != conv_id:
                if waiting > 4096:
                    yield _batch([c.repaired() for c in held], _ARROW, _NAMES)
                    held, waiting = [], 0
                held.append(Conversation(conv_id))
            if not lost:
                held[-1].rows.append((role, text))
                waiting += 1
                if turn is not None:
                    held[-1].turns.append(turn)
    if held:
        yield _batch([c.repaired() for c in held], _ARROW, _NAMES)


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows sorted by their first `width` columns -> (these, the rest of each row)."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != at:
                if held:
                    yield at, held
                at, held = row[:width], []
            held.append(row[width:])
    if held:
        yield at, held


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, part, at, initial, fault, again) by part -> (conv, part, costs from state to state, illegal pairs inside, first and last initial)."""
    for key, rows in _groups(batches, 2):
        marks = [r[1:] for r in rows]
        costs = [c for entry in range(STATES) for reach, base in [_forward(marks, entry)] for c in _exits(reach[-1], base[-1])]
        illegal = sum(a[0] + b[0] not in _LEGAL for a, b in zip(marks, marks[1:], strict=False)) + sum(r[2] for r in marks)
        yield _batch([(*key, costs, illegal, marks[0][0], marks[-1][0])], [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()], ["conv", "part", "costs", "illegal", "first", "last"])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrices of a conversation, by part -> (conv, part, parts, tail, cost, illegal): what is left to pay after each part, and the whole's sums."""
    for (conv,), rows in _groups(batches, 1):
        tail, tails = list(_END), []
        for _, costs, *_ in reversed(rows):
            tails.append(tail)
            tail = [min(c + t for c, t in zip(costs[STATES * e : STATES * e + STATES], tail, strict=True) if c is not None) for e in range(STATES)]
        illegal = sum(r[2] for r in rows) + sum(a[4] + b[3] not in _LEGAL for a, b in zip(rows, rows[1:], strict=False))
        out = [(conv, r[0], len(rows), t, tail[0], illegal) for r, t in zip(rows, reversed(tails), strict=True)]
        yield _batch(out, [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64()], ["conv", "part", "parts", "tail", "cost", "illegal"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, part, at, initial, fault, again, tail) by part -> (conv, part, entry, exit, audit) for each state that it may be entered in."""
    for key, rows in _groups(batches, 2):
        marks, tail = [r[1:4] for r in rows], tuple(rows[0][4])
        for entry in range(STATES):
            _, audit, leave = least_edits(marks, entry, tail)
            yield _batch([(*key, entry, leave, audit)], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()], ["conv", "part", "entry", "exit", "audit"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, part, entry, exit) of a conversation, by part -> (conv, part, entry, place, closing) as the parts follow one another."""
    for (conv,), rows in _groups(batches, 1):
        leave = {(part, entry): exit_ for part, entry, exit_ in rows}
        parts, state, out = sorted({part for part, *_ in rows}), 0, []
        for place, part in enumerate(parts):
            out.append((conv, part, state, place, ""))
            state = leave[part, state]
        out[-1] = (*out[-1][:4], _closing(state))
        yield _batch(out, [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()], ["conv", "part", "entry", "place", "closing"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, part, at, entry, audit, role, text, again) by part; the first has the audit and the state of entry -> (conv, part, turns)."""
    for key, rows in _groups(batches, 2):
        _, entry, audit, *_ = rows[0]
        texts = ((role, text) for _, _, _, role, text, again in rows[1:] for _ in range(1 + again))
        yield _batch([(*key, _edited(texts, audit, entry))], [pa.string(), pa.int32(), _ARROW[-1]], ["conv", "part", "turns"])


def _in_parts(rows: DataFrame, n_rows: int, long_rows: int) -> DataFrame:
    """The rows of long conversations -> what repair() returns, a row for each part.

    Equal rows are counted first, so any number of them is one row. Which of equal texts is the first is an aggregation by their hash.
    Rows are dealt to ranges of (conversation, turn, role, text); a part is what a range has of a conversation.
    """
    c = F.col
    once = rows.groupBy("conv_id", "turn", "role", "text").agg((F.count("*") - 1).alias("again")).withColumn("conv", F.coalesce(c("conv_id").cast("string"), F.lit("-")))
    once = once.withColumn("mark", F.sha2(F.concat(F.sha2("role", 256).cast("binary"), c("text")), 256)).withColumn("when", F.struct(c("turn").isNotNull(), "turn"))
    first = once.groupBy("conv", "mark").agg(F.min("when").alias("least"))
    said = F.btrim(c("text").cast("string"), F.lit(WHITE.decode()))
    ends = F.substring(said, -1, 1).isin(".", "!", "?")
    fault = F.when(said == "", 0).when(c("when") > c("least"), 1).when(~ends, 2)
    flagged = once.join(first, ["conv", "mark"]).select("conv", "conv_id", "turn", "role", "text", "again", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"))
    order = ("conv", c("turn").asc_nulls_first(), "role", "text")
    dealt = flagged.repartitionByRange(max(2, 2 * n_rows // long_rows), *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "repair-rows")
    by_part = lambda df, *more: df.repartition("conv", "part").sortWithinPartitions("conv", "part", *more)
    by_conv = lambda df: df.repartition("conv").sortWithinPartitions("conv", "part")
    marks = dealt.select("conv", "part", "at", "initial", "fault", c("again").cast("long").alias("again"))
    costs = by_part(marks, "at").mapInArrow(_matrices, "conv string, part int, costs array<long>, illegal long, first binary, last binary")
    tails = materialize(by_conv(costs).mapInArrow(_tails, "conv string, part int, parts int, tail array<long>, cost long, illegal long"), "repair-tails")
    traces = by_part(marks.join(tails.select("conv", "part", "tail"), ["conv", "part"]), "at").mapInArrow(_traces, "conv string, part int, entry int, exit int, audit string")
    traces = materialize(traces, "repair-traces")
    entered = by_conv(traces.select("conv", "part", "entry", "exit")).mapInArrow(_entries, "conv string, part int, entry int, place int, closing string")
    chosen = traces.drop("exit").join(entered, ["conv", "part", "entry"]).withColumn("audit", F.concat("audit", "closing"))
    heads = chosen.select("conv", "part", F.lit(-1).cast("long").alias("at"), "entry", "audit", F.lit(None).cast("binary").alias("role"), F.lit(None).cast("binary").alias("text"), F.lit(0).cast("long").alias("again"))
    texts = dealt.select("conv", "part", "at", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("audit"), "role", "text", c("again").cast("long").alias("again"))
    turns = by_part(heads.unionByName(texts), "at").mapInArrow(_applied, "conv string, part int, turns array<struct<role: binary, text: binary>>")
    times = c("again") + 1
    sums = dealt.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), F.coalesce(F.sum(F.when(c("fault") == 0, times)), F.lit(0)).alias("blank"),
        F.coalesce(F.sum(F.when(c("fault") == 1, times).when(c("fault").isNull() | (c("fault") == 2), c("again"))), F.lit(0)).alias("duplicate"), F.count_if(c("fault") == 2).alias("truncated"),
    )
    out = chosen.select("conv", "part", "place", "audit").join(tails, ["conv", "part"]).join(turns, ["conv", "part"]).join(sums, "conv")
    return out.select("conv_id", c("place").alias("part"), *_NAMES[2:])


def repair(conversations: DataFrame, lost_col: str | None = None, long_rows: int = LONG_ROWS) -> DataFrame:
    """(conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, turns array<struct<role, text>>): a row per conversation.

    Rows go by turn (nulls first), then role and text in bytes. Null roles and texts are one space; a
    null conv_id is a conversation of its own. Rows that lost_col marks only name their conversation: one
    without other rows has zeros, an empty audit and no turns. A row's first fault counts: blank,
    duplicate (role and text seen earlier), truncated (doesn't end in `.`, `!` or `?`). A role is known by
    its first letter; rows whose role starts otherwise can't be kept. Extra columns are ignored. One shuffle, by conversation.
    A conversation of more than long_rows rows comes in `parts` rows, numbered by `part`: audit and turns are each part's own
    stretch, the counts and the cost are those of the whole conversation. No task holds more than a part of it.
    """
    filled = lambda c: F.coalesce(named(conversations, c).cast("string"), F.lit(" ")).cast("binary").alias(c)
    lost = F.coalesce(named(conversations, lost_col), F.lit(False)) if lost_col else F.lit(False)
    rows = conversations.select(named(conversations, "conv_id").cast("long").alias("conv_id"), named(conversations, "turn").cast("long").alias("turn"), filled("role"), filled("text"), lost.alias("lost"))
    sizes = materialize(rows.filter("NOT lost").groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > long_rows).withColumnRenamed("conv_id", "long_id"), "repair-long")
    n_rows = sizes.agg(F.sum("n")).first()[0]
    same = rows["conv_id"].eqNullSafe(sizes["long_id"])
    if n_rows is None:
        drop_table(sizes)
    short = rows if n_rows is None else rows.join(sizes, same, "left_anti")
    found = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_fold, _SCHEMA)
    if n_rows is not None:
        found = found.unionByName(_in_parts(rows.filter("NOT lost").join(sizes, same, "left_semi"), n_rows, long_rows))
    texts = F.transform("turns", lambda t: F.struct(t.role.cast("string").alias("role"), t.text.cast("string").alias("text")))
    return found.withColumn("turns", texts)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations, by conversation and part, the last column their text -> a row per conversation; no more than a part's text is held."""
    held, audit, digest = None, [], sha256()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _, part, *counts, piece, told, some = row
            if held is not None and part == 0:
                yield _batch([(*held, "".join(audit), digest.hexdigest())], [*[pa.int64()] * 7, pa.string(), pa.string()], ["conv_id", *_NAMES[3:10], "repaired_sha256"])
                held, audit, digest = None, [], sha256()
            if held is None:
                held, begun = (row[0], *counts), False
            if some:
                digest.update(b"\n" * begun + told)
                begun = True
            audit.append(piece)
    if held is not None:
        yield _batch([(*held, "".join(audit), digest.hexdigest())], [*[pa.int64()] * 7, pa.string(), pa.string()], ["conv_id", *_NAMES[3:10], "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """What repair() returns -> (conv_id, gaps, ..., cost, audit, repaired_sha256): a row per conversation, of its repaired `role:text` lines joined by line ends."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    whole = repaired.filter("parts = 1").select("conv_id", *_NAMES[3:10], F.sha2(told.cast("binary"), 256).alias("repaired_sha256"))
    pieces = repaired.filter("parts > 1").select("conv_id", "part", *_NAMES[3:9], "audit", told.cast("binary").alias("told"), (F.size("turns") > 0).alias("some"))
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return whole.unionByName(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digest, schema))
