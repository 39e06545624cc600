"""Chat formatting with a grammar round trip.

Turns are rendered with a template of control strings and read again by a
deterministic parser.  A turn that is read differently from the source is escaped and
rendered again, once, since a turn is read alone; then the whole conversation is read and
compared, so the work is linear in its text.  Escaping
puts a backslash after the first character of each control string of a text (and one
more where backslashes already stand there), so it is undone exactly.  A turn ends at
the first closing string of its own role, so only texts that hold this string, or
that look escaped, are ever changed.

The loss mask is the span of every assistant text, markers left out.

Rows: turns go by (turn, role, text); a null text or role is empty; repeated rows
are turns of their own; a null id is a conversation like others; columns that the
operator doesn't name are not read; an empty table gives an empty one.  A conversation
is one value: its turns come to one task one after another and its text must fit there
(under 2 GB).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Opening and closing control strings of the roles; other roles are named in their opening.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": ("<s>[OUT] ", " </s>"), "system": ("<s><<SYS>> ", " <</SYS>>")}
OTHER = ("<s>[ROLE ", "] ", " [/ROLE]")
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|OUT\]|</?SYS>>|/?ROLE\b)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|OUT\]|</?SYS>>|/?ROLE\b)")
_ROLE = re.compile(r"[A-Za-z0-9_.-]*\Z")
#: Characters of formatted text that a task holds before it hands them on.
OUT_CHARS = 16 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _dressed(role: str, text: str) -> str:
    """A turn with the control strings of its role."""
    if role in MARKS:
        begin, end = MARKS[role]
    else:
        name = role if _ROLE.match(role) and not role.startswith("0x") else "0x" + role.encode("utf-8").hex()
        begin, end = f"{OTHER[0]}{name}{OTHER[1]}", OTHER[2]
    return f"{begin}{text}{end}"


def read(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end of the rendered text) of each turn, as far as the grammar holds."""
    at = 0
    while at < len(formatted):
        for role, (begin, end) in MARKS.items():
            if formatted.startswith(begin, at):
                start = at + len(begin)
                break
        else:
            close = formatted.find(OTHER[1], at)
            if not formatted.startswith(OTHER[0], at) or close < 0:
                return
            name, end, start = formatted[at + len(OTHER[0]) : close], OTHER[2], close + len(OTHER[1])
            if not _ROLE.match(name):
                return
            try:
                role = bytes.fromhex(name[2:]).decode("utf-8") if name.startswith("0x") else name
            except ValueError:
                return
        stop = formatted.find(end, start)
        if stop < 0:
            return
        yield role, unescape(formatted[start:stop]), start, stop
        at = stop + len(end)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """All turns that ``read`` finds."""
    return list(read(formatted))


def format_turn(role: str, text: str) -> str:
    """The rendered turn whose parse is identical to the source, escaped only if it is in conflict.

    A turn ends at the first closing string of its role, so what it is read as does not
    depend on the turns beside it.
    """
    for said in (text, escape(text)):
        turn = _dressed(role, said)
        if [(t[0], t[1]) for t in read(turn)] == [(role, text)]:
            return turn
    raise ValueError("a turn can't be rendered")


def format_conversation(turns: list[tuple[str, str]]) -> str:
    """The rendered text whose parse is identical to ``turns``."""
    formatted = "".join(format_turn(role, text) for role, text in turns)
    if [(t[0], t[1]) for t in read(formatted)] != turns:
        raise ValueError("a conversation can't be rendered")
    return formatted


_SPANS = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to a row for each conversation, turn by turn; a conversation may go on in the next batch."""
    now: tuple[int | None] | None = None
    turns: list[tuple[str, str]] = []
    out: list[tuple] = []
    size = 0

    def end() -> None:
        formatted = format_conversation(turns)
        out.append((now[0], formatted, [{"role": r, "start": a, "end": b} for r, _, a, b in read(formatted)]))
        turns.clear()

    def told() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], _SPANS)], names=["conv_id", "formatted", "spans"])
        out.clear()
        return batch

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if (conv,) != now:
                if now is not None:
                    end()
                    size += len(out[-1][1])
                    if size > OUT_CHARS:
                        yield told()
                        size = 0
                now = (conv,)
            turns.append((role, text))
    if now is not None:
        end()
        yield told()


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, spans): rendered conversations; a span is the place of a turn's text, its role with it.

    Spark sorts the turns of whole conversations into tasks, which read them one after another.
    """
    turns = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return turns.mapInArrow(_format, "conv_id long, formatted string, spans array<struct<role: string, start: int, end: int>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for conv, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans")), strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans if s["role"] == "assistant")
            told = "".join(f"{t[0]}\n{t[1]}\n" for t in turns)
            rows.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted text finds: turns, their digest, and the text under the loss mask."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
