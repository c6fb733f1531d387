"""Chat formatting (13): a finite-state machine over roles, text segments with loss flags, and the way back.

A :class:`Template` declares the marks around turns, each role's label and loss flag, and the machine: which role may
follow in which state, and in which states a conversation may end. :func:`format_conversations` walks the machine over
the turns and emits *segments* ``(conv_id, seq, text, loss, fault)``: opening mark, body and closing mark of each turn and
one last, empty segment, which carries a fault if the conversation must not end there. The texts of a conversation's
segments, one after the other, are the formatted conversation; ``loss`` tells which of them a model is trained on.

Control strings inside texts are escaped by a backslash, and backslashes by another, so the output splits into the same
turns again: :func:`read_back` parses the formatted text with no knowledge of the input and digests what it finds.

A conversation's rows are brought together and sorted, then streamed: a task holds one turn at a time, however many rows a
conversation has (its digest is one chain, so that much of it stays in one task). Rows that share conversation and turn go
by role and text, repeated rows are turns of their own, null turns come first. A null text or role is the empty string.
A null ``conv_id`` is a conversation like any other. A role the template does not know, or one out of order, is a fault
of its segment; it is formatted all the same, so nothing is lost. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column kinds in Spark and in Arrow.
KINDS = {
    "long": (T.LongType(), pa.int64()),
    "string": (T.StringType(), pa.string()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "spans": (T.ArrayType(T.StructType().add("start", "long").add("end", "long")), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
}

#: Rows of an Arrow batch that a task sends on, and the characters after which it sends earlier.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 22


@dataclass(frozen=True)
class Role:
    label: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks, roles and the machine. ``follows[state][role]`` is the next state; ``ends`` are the states to stop in.

    A turn reads ``turn_open label label_close text turn_close between``. A role without a label stands as ``other`` and
    its own name.
    """

    roles: dict[str, Role] = field(default_factory=lambda: {"system": Role("System"), "user": Role("User"), "assistant": Role("Assistant", loss=True)})
    follows: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    )
    ends: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    turn_open: str = "### "
    label_close: str = ": "
    turn_close: str = "</turn>"
    between: str = "\n"
    other: str = "?"

    def __post_init__(self):
        marks = [self.turn_open, self.label_close, self.turn_close]
        if not all(marks) or any("\\" in m for m in marks) or len(set(marks)) < 3:
            raise ValueError("the three marks must differ, not be empty and hold no backslash")
        for a in marks:  # else a text's last characters and a mark could read as another mark
            if any(a[k:].startswith(b) or b.startswith(a[k:]) for b in marks for k in range(1, len(a))):
                raise ValueError(f"another mark may begin inside {a!r}")
        labels = [r.label for r in self.roles.values()]
        if len(set(labels)) < len(labels) or not all(labels) or any(x.startswith(self.other) or self.escape(x, in_label=True) != x for x in labels):
            raise ValueError("labels must differ, hold no mark and not begin as that of an unknown role")

    def _pattern(self, in_label: bool) -> re.Pattern:
        marks = [self.turn_open, self.turn_close] + [self.label_close] * in_label
        return re.compile(r"\\(?:.|\Z)|" + "|".join(map(re.escape, marks)), re.DOTALL)

    @cached_property
    def in_text(self) -> re.Pattern:
        """An escaped character, or a mark that is none of the text's own."""
        return self._pattern(False)

    @cached_property
    def in_label(self) -> re.Pattern:
        return self._pattern(True)

    @cached_property
    def role_of(self) -> dict[str, str]:
        return {r.label: name for name, r in self.roles.items()}

    def escape(self, text: str, in_label: bool = False) -> str:
        text = text.replace("\\", "\\\\")
        for mark in [self.turn_open, self.turn_close] + [self.label_close] * in_label:
            text = text.replace(mark, "\\" + mark)
        return text

    def opening(self, role: str) -> str:
        known = self.roles.get(role)
        return self.turn_open + (known.label if known else self.other + self.escape(role, in_label=True)) + self.label_close

    def step(self, state: str, role: str) -> tuple[str, str | None]:
        """The machine's next state and the fault, if the role must not stand here; after a fault it goes on from that role."""
        after = self.follows.get(state, {}).get(role)
        if after is not None:
            return after, None
        known = role if role in self.follows else state
        return known, f"{role!r} after {state}" if role in self.roles else f"unknown role {role!r}"


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Reader:
    """Takes formatted text apart as it arrives, holding no more than the turn it is in."""

    def __init__(self, template: Template):
        self.template, self.buffer, self.at = template, "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """The turns ``(role, text)`` that end in this piece."""
        self.buffer += piece
        t = self.template
        while True:
            if not self.buffer.startswith(t.turn_open):
                if t.turn_open.startswith(self.buffer):
                    return
                raise ValueError(f"no turn begins at {self.buffer[:40]!r}")
            close = next(self._marks(t), None)
            if close is None or len(self.buffer) < close.end() + len(t.between):
                return
            if not self.buffer.startswith(t.between, close.end()):
                raise ValueError(f"no end of a turn at {self.buffer[close.end() :][:40]!r}")
            yield self._turn(self.buffer[len(t.turn_open) : close.start()])
            self.buffer, self.at = self.buffer[close.end() + len(t.between) :], 0

    def _marks(self, t: Template) -> Iterator[re.Match]:
        for m in t.in_text.finditer(self.buffer, max(self.at, len(t.turn_open))):
            if m[0] == t.turn_close:
                yield m
            elif m[0] == t.turn_open:
                raise ValueError("a turn begins inside a turn")
            elif len(m[0]) < 2:
                return  # what it escapes is still to come
            else:
                self.at = m.end()

    def _turn(self, raw: str) -> tuple[str, str]:
        t = self.template
        close = next((m for m in t.in_label.finditer(raw) if m[0] == t.label_close), None)
        if close is None:
            raise ValueError(f"no label in {raw[:40]!r}")
        label = raw[: close.start()]
        role = unescape(label[len(t.other) :]) if label.startswith(t.other) else t.role_of[label]
        return role, unescape(raw[close.end() :])

    def finish(self) -> None:
        if self.buffer:
            raise ValueError(f"unfinished turn {self.buffer[:40]!r}")


def arrange(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, text_at: int | None = None) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    columns = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        chars += len(row[text_at]) if text_at is not None else 0
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield columns()
            held, chars = [], 0
    if held:
        yield columns()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):  # a few rows as Python objects at a time
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True)


def streamed(rows: DataFrame, work, columns: list[tuple[str, str]], text_at: int | None = None) -> DataFrame:
    """``work`` over each partition's rows in their order; it yields rows of ``conv_id`` and ``columns``."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType)])
    for name, kind in columns:
        schema = schema.add(name, KINDS[kind][0])

    def run(batches):
        first = next(batches, None)
        if first is None:
            return

        def every():
            yield first
            yield from batches

        out = pa.schema([("conv_id", first.schema.field(0).type), *[(name, KINDS[kind][1]) for name, kind in columns]])
        yield from batches_of(work(rows_of(every())), out, text_at)

    return rows.mapInArrow(run, schema)


def format_conversations(rows: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments ``(conv_id, seq, text, loss, fault)`` of all rows; a conversation's lie in one partition, in order."""
    t = template or Template()
    given = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(turns):
        seen, conv, seq, state = False, None, 0, t.start
        last = lambda: (conv, seq, "", False, None if state in t.ends else f"ends after {state}")
        for conv_id, _, role, text in turns:
            if seen and conv_id != conv:
                yield last()
            if not seen or conv_id != conv:
                seen, conv, seq, state = True, conv_id, 0, t.start
            state, fault = t.step(state, role)
            known = t.roles.get(role)
            yield conv, seq, t.opening(role), False, fault
            yield conv, seq + 1, t.escape(text), bool(known and known.loss), None
            yield conv, seq + 2, t.turn_close + t.between, False, None
            seq += 3
        if seen:
            yield last()

    return streamed(arrange(given, "turn", "role", "text"), work, [("seq", "long"), ("text", "string"), ("loss", "boolean"), ("fault", "string")], text_at=2)


def grouped(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Neighbouring rows of one conversation, streamed."""
    row = next(rows, None)
    while row is not None:
        conv, ended = row[0], []

        def mine(row=row, conv=conv, ended=ended):
            while row is not None and row[0] == conv:
                yield row
                row = next(rows, None)
            ended.append(row)

        group = mine()
        yield conv, group
        for _ in group:
            pass
        row = ended[0]


def read_back(segments: DataFrame, template: Template | None = None, arranged: bool = False) -> DataFrame:
    """What a reader finds in the formatted text, per conversation.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_faults, first_fault)``. The turns' digest
    is over role, line feed, text, line feed of each; the loss digest over all text with the flag, unescaped. With
    ``arranged``, the rows lie as :func:`format_conversations` leaves them, and are not shuffled again.
    """
    t = template or Template()
    given = segments.select("conv_id", "seq", "text", "loss", "fault")

    def work(rows):
        for conv, group in grouped(rows):
            reader, turns, loss = Reader(t), hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = n_faults = 0
            first = None
            for _, _, text, flag, fault in group:
                chars += len(text)
                for role, said in reader.feed(text):
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode())
                if flag:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                if fault is not None:
                    n_faults, first = n_faults + 1, first if n_faults else fault
            reader.finish()
            yield conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_faults, first

    columns = [("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long"), ("n_faults", "long"), ("first_fault", "string")]
    return streamed(given if arranged else arrange(given, "seq"), work, columns)


def joined(segments: DataFrame, arranged: bool = False) -> DataFrame:
    """A row a conversation, for conversations that fit one: ``(conv_id, text, loss_spans, n_faults)``; spans are code points, end exclusive."""
    given = segments.select("conv_id", "seq", "text", "loss", "fault")

    def work(rows):
        for conv, group in grouped(rows):
            parts, spans, at, n_faults = [], [], 0, 0
            for _, _, text, flag, fault in group:
                if flag and text:
                    spans.append({"start": at, "end": at + len(text)})
                parts.append(text)
                at += len(text)
                n_faults += fault is not None
            yield conv, "".join(parts), spans, n_faults

    return streamed(given if arranged else arrange(given, "seq"), work, [("text", "string"), ("loss_spans", "spans"), ("n_faults", "long")], text_at=1)
