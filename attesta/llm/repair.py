"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed. The input acceptor reads a conversation as one symbol per row:
the initial of its role, or a row that has to go (blank or duplicate), marked if its text
is truncated. The edit transducer keeps (0), gives a row the role user or assistant (1),
deletes (2) or inserts an empty turn (5), and pays 5 for a truncated row that stays. The
grammar acceptor takes ``(s?(ua)+)?`` over role initials. The composition is never built:
its states (rows read, grammar state) are made as they are reached, in topological order.

The shortest path is taken over the weights (cost, label string), least cost first and then
the least string. Costs to go are found from the end; walking from the start, the first
label in ASCII order that lies on a cheapest path gives the least string, as a label names
one successor only, and no label string of a cheapest path is the beginning of another.

Conversations are streams of sorted rows. One pass over hashes finds faults and the path
(a byte per row is held), a second one applies it to the texts, row by row. Different
conversations with one symbol string share one search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What counts as white space, and what ends a sentence.
SPACE = " \t\n\x0b\x0c\r"
_INK = r"[^\x20\x09-\x0D]"
STOPS = ".!?"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states: start, after system, after user, after assistant; the accepting ones.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a new label may take in a state, and the state after it.
_NEW = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
_FAR = 1 << 60
#: Rows of results per Arrow batch.
_ROWS = 4096
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): ``df`` with planted faults. Null texts and roles
    are one space. By crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops
    the row (it stays with ``gone`` set, to name its conversation), 1 empties the text, 2
    removes its stops, 3 repeats the row, 4 makes it a user's."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


@lru_cache(1 << 16)
def cheapest(symbols: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, ties to the ASCII-least string of initials.
    A symbol is ``x`` for a row that has to go or its role's initial (``o`` for others),
    in upper case if the row is truncated."""
    to_go = [_closed([0 if q in ACCEPTING else _FAR for q in range(4)])]
    for symbol in reversed(symbols):
        after = to_go[-1]
        to_go.append(_closed([min(c + after[p] for _, c, p in _arcs(q, symbol)) for q in range(4)]))
    to_go.reverse()
    audit, state, i = [], START, 0
    while i < len(symbols) or state not in ACCEPTING:
        left = to_go[i][state]
        steps = [(label, cost, p, i + 1) for label, cost, p in (_arcs(state, symbols[i]) if i < len(symbols) else ())]
        steps.append(("I", INSERT, _NEW[state][1], i))
        label, _, state, i = min((s for s in steps if s[1] + to_go[s[3]][s[2]] == left), key=lambda s: s[0])
        audit.append(label)
    return to_go[0][START], "".join(audit)


@lru_cache(None)
def _arcs(state: int, symbol: str) -> tuple[tuple[str, int, int], ...]:
    """(label, cost, next state) of the edits that read ``symbol`` in a grammar state."""
    arcs = [("D", DELETE, state)]
    if symbol != "x":
        stay = TRUNCATED if symbol.isupper() else 0
        if (state, symbol.lower()) in _NEXT:
            arcs.append(("K", stay, _NEXT[state, symbol.lower()]))
        arcs.append(("R", REROLE + stay, _NEW[state][1]))
    return tuple(arcs)


def _closed(costs: list[int]) -> list[int]:
    """Costs to go where insertions may come first; two in a row lead back, so that
    two rounds reach every state."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_NEW[q][1]]) for q, c in enumerate(costs)]
    return costs


def _flags(rows: DataFrame) -> DataFrame:
    """Adds hashes of role and text, blank, truncated and the role's initial."""
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    hashes = {n: F.xxhash64(F.lit(i), "role", "text") for i, n in enumerate(("one", "two"))}
    return rows.withColumns({**hashes, "blank": ~F.col("text").rlike(_INK), "cut": ~last.isin(*STOPS), "initial": F.substring("role", 1, 1)})


def reports(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every
    conversation of ``rows`` (conv_id, turn, role, text, gone), by turn, nulls first, ties
    by hashes of role and text. A row's first fault counts: blank, a role and text seen
    earlier, no stop at the end. ``gaps`` are absent turns between the least and the
    greatest; ``illegal`` counts neighbours whose initials aren't su, ua or au.
    Conversations whose rows are all gone have zeros and an empty audit."""
    flagged = _flags(rows).select("conv_id", "turn", "gone", "one", "two", "blank", "cut", "initial").repartition("conv_id")
    seen = W.partitionBy("conv_id", "gone", "one", "two").orderBy(F.asc_nulls_first("turn"))
    flagged = flagged.withColumn("again", F.row_number().over(seen) > 1)
    # Equal rows stay in the order in which they were numbered.
    order = ["conv_id", F.asc_nulls_first("turn"), "one", "two", "again"]
    stream = flagged.select("conv_id", "turn", "gone", "blank", "again", "cut", "initial", "one", "two").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
        out, held = [], None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:7]]
            for conv, *row in zip(*columns, strict=True):
                if held is None or conv != held.conv:
                    if held is not None:
                        out.append(held.report())
                    held = _Reader(conv)
                held.read(*row)
            if len(out) >= _ROWS:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if held is not None:
            out.append(held.report())
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return stream.mapInArrow(run, f"conv_id long, {_REPORT}")


class _Reader:
    """Counts of one conversation while its rows pass, and its symbols."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.symbols = conv, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def read(self, turn: int | None, gone: bool, blank: bool, again: bool, cut: bool, initial: str) -> None:
        if gone:
            return
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        symbol = initial if initial in ("s", "u", "a") else "o"
        if blank:
            self.blank, symbol = self.blank + 1, "x"
        elif again:
            self.duplicate, symbol = self.duplicate + 1, "x"
        elif cut:
            self.truncated, symbol = self.truncated + 1, symbol.upper()
        self.symbols += symbol.encode()

    def report(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        cost, audit = cheapest(self.symbols.decode())
        return self.conv, min(gaps, (1 << 63) - 1), self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, edit, role, text) in the order of the repaired conversations, deleted rows
    included, each conversation after a row with its report and no edit. The order holds
    until the next exchange."""
    names = [x.split()[0] for x in _REPORT.split(", ")]
    turns = _flags(rows.filter("NOT gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "one", "two", "role", "text", F.lit(None).cast(f"struct<{_REPORT.replace(' ', ':').replace(',:', ',')}>").alias("report"))
    zero = F.lit(0).cast("long")
    heads = found.select("conv_id", F.lit(0).alias("kind"), zero.alias("turn"), zero.alias("one"), zero.alias("two"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct(*names).alias("report"))
    order = ["conv_id", "kind", F.asc_nulls_first("turn"), "one", "two"]
    stream = turns.unionByName(heads).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "report")
    schema = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("report", stream.limit(0).toArrow().schema.field("report").type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state = None, "", 0, START

        def inserted() -> Iterator[tuple]:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                role, state = _NEW[state]
                at += 1
                yield conv, "I", role, "", None

        for batch in batches:
            out = []
            for next_conv, role, text, report in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if report is not None:
                    out += inserted()
                    conv, audit, at, state = next_conv, report["audit"], 0, START
                    out.append((conv, None, None, None, report))
                    continue
                out += inserted()
                edit = audit[at]
                at += 1
                if edit == "R":
                    role, state = _NEW[state]
                elif edit == "K":
                    state = _NEXT[state, role[:1]]
                out.append((conv, edit, role, text, None))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.record_batch([pa.array([], f.type) for f in schema], schema=schema)
        if out := list(inserted()):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return stream.mapInArrow(run, f"conv_id long, edit string, role string, text string, report struct<{_REPORT.replace(' ', ':').replace(',:', ',')}>")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, numbered
    from 1, with the edit that each came by (K, R or I). ``rows`` as for ``reports``."""
    edited = _edited(rows, reports(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            places = []
            for edit in batch.column(1).to_pylist():
                place = 0 if edit is None else place + (edit != "D")
                places.append(place)
            yield pa.record_batch([batch.column(0), pa.array(places, pa.int64()), *batch.columns[1:4]], names=["conv_id", "place", "edit", "role", "text"])

    return edited.mapInArrow(run, "conv_id long, place long, edit string, role string, text string").filter("edit <> 'D'")


def digests(rows: DataFrame) -> DataFrame:
    """The reports of ``rows`` with ``repaired_sha256``: SHA-256 of the repaired turns as
    ``role:text``, newline-joined."""
    edited = _edited(rows, reports(rows))
    names = [x.split()[0] for x in _REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, first = None, None, True
        types = [*[pa.int64()] * 7, pa.string(), pa.string()]
        for batch in batches:
            out = []
            for conv, edit, role, text, report in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if report is not None:
                    if held is not None:
                        out.append((*held, digest.hexdigest()))
                    held, digest, first = (conv, *[report[n] for n in names]), hashlib.sha256(), True
                elif edit != "D":
                    digest.update((("" if first else "\n") + role + ":" + text).encode())
                    first = False
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", *names, "repaired_sha256"])
        if held is not None:
            yield pa.record_batch([pa.array([c], t) for c, t in zip((*held, digest.hexdigest()), types, strict=True)], names=["conv_id", *names, "repaired_sha256"])

    return edited.mapInArrow(run, f"conv_id long, {_REPORT}, repaired_sha256 string")
