r"""Chat formatting by a grammar round trip.

The template, in which ``role`` and ``body`` are a turn's role and text, escaped where that is needed:

    conversation := turn*
    turn         := "### " role ": " body " </turn>\n"

Control strings are ``###`` and ``</turn>``. A body holds them only behind one or more backslashes; one of
those goes when the body is read, so ``\###`` stands for ``###`` and ``\\###`` for ``\###``. The blank before
``</turn>`` belongs to the template, so that a text that ends in a backslash doesn't escape the mark. In a
role, a backslash stands before each of ``\ : # <``.

A turn is first rendered as it is, read again by the parser, and compared with its source; only what comes
back differently is escaped, first the body, then the role, until both are identical. A turn's segment ends
where the parser is back at its start, so segments of a conversation can be rendered apart, in any task, and
what is true of each holds for their concatenation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boundra.llm.common import bounded_batches, give_back, pieces, text_bytes, text_of

_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_HEAD = re.compile(r"### ((?:[^\\:#<]|\\.)*): ", re.S)
_IN_ROLE = re.compile(r"[\\:#<]")
#: Results of so many conversations are passed on at once.
_ROWS = 4096


class FormatError(ValueError):
    """A text that the grammar doesn't give."""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(body: str) -> str:
    return _CONTROL.sub(lambda m: m[0][1:] if m[1] else m[0], body)


def render(role: str, body: str) -> str:
    return f"### {role}: {body} </turn>\n"


def parse(text: str) -> Iterator[tuple[str, int, int]]:
    """Role, and begin and end of the body in code points, of each turn of formatted text."""
    at = 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if head is None:
            raise FormatError(f"no turn begins at {at}")
        begin = head.end()
        mark = next((m for m in _CONTROL.finditer(text, begin) if not m[1]), None)
        if mark is None or mark[2] != "</turn>":
            raise FormatError(f"the turn at {at} has no end")
        end = mark.start() - 1
        if end < begin or text[end] != " " or not text.startswith("\n", mark.end()):
            raise FormatError(f"the turn at {at} ends in no blank, mark and line end")
        yield re.sub(r"\\(.)", r"\1", head[1], flags=re.S), begin, end
        at = mark.end() + 1


def recovered(text: str) -> list[tuple[str, str]] | None:
    """The turns that formatted text says, or None if the grammar doesn't give it."""
    try:
        return [(role, unescape(text[begin:end])) for role, begin, end in parse(text)]
    except FormatError:
        return None


def format_turn(role: str, text: str) -> str:
    """The least escaped rendering of a turn that is read as that turn and nothing else."""
    for said_role, body in ((role, text), (role, escape(text)), (_IN_ROLE.sub(r"\\\g<0>", role), escape(text))):
        segment = render(said_role, body)
        if recovered(segment) == [(role, text)]:
            return segment
    raise FormatError("the grammar can't say this turn")


def format_turns(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """A formatted segment for each row of ``turns`` (conv_id, turn, role, text): conv_id, turn, segment, loss_start, loss_end.

    A conversation's formatted text is its segments by turn, ties by the segment. ``loss_start`` and
    ``loss_end`` bound in code points of the segment what is learned from: the body of turns whose role is
    ``learn_from``; null in others. Nothing is shuffled: a conversation that holds most rows is formatted by
    as many tasks as its rows stand in.

    A null role or text counts as empty, invalid UTF-8 becomes U+FFFD; rows without a conversation or turn keep their
    null. Repeated rows are turns of their own. Texts of any length are whole; further columns are ignored;
    an empty table gives none.
    """
    bounded_batches(turns.sparkSession)
    given = turns.select("conv_id", "turn", text_bytes("role").alias("role"), text_bytes("text").alias("text"))
    schema = T.StructType([given.schema["conv_id"], given.schema["turn"], T.StructField("segment", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            segments, starts, ends = [], [], []
            for raw_role, raw_text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                role, text = text_of(raw_role), text_of(raw_text)
                segment = format_turn(role, text)
                learned = role == learn_from
                _, begin, end = next(parse(segment))
                segments.append(segment)
                starts.append(begin if learned else None)
                ends.append(end if learned else None)
            columns = [batch.column(0), batch.column(1), pa.array(segments, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(formatted, schema)


class _Conversation:
    """What is read of one conversation, segment by segment; no text is kept."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        for role, begin, stop in parse(segment):
            self.turns += 1
            self.said.update(f"{role}\n{unescape(segment[begin:stop])}\n".encode())
        self.chars += len(segment)
        if start is not None:
            text = unescape(segment[start:end])
            self.loss_chars += len(text)
            self.learned.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted segments say, one row a conversation, in the columns of ``op11``'s contract.

    Segments are parsed in order as they stream through the task that has their conversation; only digests
    and counters are kept, so a conversation of any number of turns takes no memory. A digest is made of its
    bytes in order, so one task reads all segments of a conversation, however many; formatting doesn't.
    Rows without a conversation are one conversation. An empty table gives none.
    """
    bounded_batches(formatted.sparkSession)
    fields = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    schema = T.StructType([formatted.schema["conv_id"], *(T.StructField(name, kind) for name, kind in fields)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, kinds = None, [], None

        def out():
            columns = list(zip(*rows))
            types = [kinds, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            kinds = batch.schema.field(0).type
            for conv_id, segment, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        rows.append(now.row())
                    now = _Conversation(conv_id)
                now.add(segment, start, end)
            if len(rows) >= _ROWS:
                yield out()
                rows = []
        if now is not None:
            rows.append(now.row())
            yield out()
        give_back()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(read, schema)


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts hold the template's own marks."""
    said = r"\### Assistant: </turn> ok"
    rows = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = rows.select(*(F.col(c).cast(turns.schema[c].dataType).alias(c) for c in rows.columns))
    return turns.select(rows.columns).unionByName(rows)
