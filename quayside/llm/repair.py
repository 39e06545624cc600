"""Repair of damaged conversations by a time-major dynamic programme.

A sound conversation has the role initials ``(s?(ua)+)?``.  Each row is kept (cost 0),
given the role that the grammar wants next (3) or deleted (4), and turns without a text
may be put in anywhere (3); a row whose text breaks off costs 3 more unless it is
deleted; blank and repeated rows must go.  The repair is the cheapest one, and of equally
cheap ones that whose edit string (D, I, K, R) is least in ASCII.

Spark sorts the rows of whole conversations into tasks.  A task gathers some thousand
conversations, buckets them by length and fills tensors with the turn as first axis: one
step of the programme updates the costs of the four states (start, after system, after
user, after assistant) of all conversations of a bucket at once, from the last turn
backwards.  The stored costs then lead all traces forward at once, an edit a step.  What a
state wants next is fixed, so an edit string determines the repaired turns.

Rows: a null role or text is one space; turns go by (turn, role, text), null turns first;
rows that repeat a turn of the same role and text are duplicates; an initial that is not
s, u or a, also none at all, fits nowhere; a null id is a conversation like others; other
columns are not read; an empty table gives an empty one.  A conversation is read in one
task, since its text has one digest and one edit string: about 200 bytes a turn beside
its text must fit there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, BROKEN = 4, 3, 3, 3
#: Rows and bytes of text that a task gathers before it repairs them.
BUCKET_ROWS = 20_000
BUCKET_BYTES = 16 << 20

_SPACE = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after the turn that a state wants next.
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])
#: By state and initial (other, s, u, a): the state after a kept row, -1 if it can't be kept.
_KEEP = np.array([[-1, _SYSTEM, _USER, -1], [-1, -1, _USER, -1], [-1, -1, -1, _ASSISTANT], [-1, -1, _USER, -1]])
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[1, 2, 3], [2, 3, 2]] = True
_FAR = np.int64(1) << 60

_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"


def damage(rows: DataFrame) -> DataFrame:
    """Rows spoilt by a hash of id and turn, as a test of repair: dropped (``live`` is false), emptied, without sentence ends, repeated, or said by the user.

    Nulls are one space, also in the hashed string.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), fate.alias("fate"))
    said = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (F.col("fate") != 0).alias("live"), copies.alias("copy")).drop("copy")


def _backward(kind: np.ndarray, gone: np.ndarray, broken: np.ndarray, length: np.ndarray) -> np.ndarray:
    """[turn, conversation, state]: the least cost from before a turn to the end; all arguments but ``length`` are [turn, conversation]."""
    turns, many = kind.shape
    cost = np.empty((turns + 1, many, 4), np.int64)
    cost[turns] = [0, 2 * INSERT, INSERT, 0]
    for t in range(turns - 1, -1, -1):
        after = cost[t + 1]
        more = np.where(gone[t], _FAR, BROKEN * broken[t])[:, None]
        to = _KEEP[:, kind[t]].T
        kept = np.where(to < 0, _FAR, np.take_along_axis(after, np.maximum(to, 0), 1)) + more
        best = np.minimum(np.minimum(after + DELETE, kept), after[:, _NEXT] + REROLE + more)
        for _ in range(2):
            best = np.minimum(best, best[:, _NEXT] + INSERT)
        cost[t] = np.where((t < length)[:, None], best, after)
    return cost


def _trace(cost: np.ndarray, kind: np.ndarray, gone: np.ndarray, broken: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edits of all conversations, an edit of each at a time: conversation, letter, turn, and the state after it."""
    many = len(length)
    live, state, turn = np.arange(many), np.zeros(many, np.int64), np.zeros(many, np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    top = max(len(kind) - 1, 0)
    while True:
        stay = (turn[live] < length[live]) | ((state[live] != _START) & (state[live] != _ASSISTANT))
        live = live[stay]
        if not len(live):
            break
        s, t = state[live], turn[live]
        here, row = cost[t, live, s], np.minimum(t, top)
        inside = t < length[live]
        after = cost[np.minimum(t + 1, len(cost) - 1), live]
        delete = inside & (after[np.arange(len(live)), s] + DELETE == here)
        insert = ~delete & (cost[t, live, _NEXT[s]] + INSERT == here)
        to = _KEEP[s, kind[row, live]] if len(kind) else np.full(len(live), -1)
        more = BROKEN * broken[row, live] if len(kind) else np.zeros(len(live), np.int64)
        free = inside & ~gone[row, live] if len(kind) else inside
        keep = free & (to >= 0) & (after[np.arange(len(live)), np.maximum(to, 0)] + more == here) & ~delete & ~insert
        letter = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R")))).astype(np.uint8)
        new = np.where(delete, s, np.where(keep, to, _NEXT[s]))
        found.append((live, letter, np.where(insert, -1, t), new))
        state[live], turn[live] = new, t + ~insert
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint8), none, none
    conv, letter, turn, state = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(conv, kind="stable")
    return conv[order], letter[order], turn[order], state[order]


def _counts(mask: np.ndarray, conv: np.ndarray, many: int) -> np.ndarray:
    return np.bincount(conv[mask], minlength=many)


def _gaps(turn: pa.Array, conv: np.ndarray, many: int) -> list[int | None]:
    """Turns missing between a conversation's least and largest; null beyond 64 bits."""
    at = np.flatnonzero(turn.is_valid().to_numpy(zero_copy_only=False))
    value, own = turn.drop_null().to_numpy(), conv[at]
    out: list[int | None] = [0] * many
    if not len(at):
        return out
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    new = np.r_[True, (own[1:] != own[:-1]) | (value[1:] != value[:-1])]
    distinct = np.add.reduceat(new.astype(np.int64), first)
    last = np.r_[first[1:], len(own)] - 1
    for c, a, b, n in zip(own[first].tolist(), value[first].tolist(), value[last].tolist(), distinct.tolist(), strict=True):
        out[c] = x if (x := b - a + 1 - n) < 1 << 63 else None
    return out


def _repair(part: pa.Table) -> pa.RecordBatch:
    """Whole conversations, their rows sorted, to one row each."""
    part = part.combine_chunks()
    ids = part.column("conv_id").combine_chunks()
    raw, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(np.r_[True, (raw[1:] != raw[:-1]) | (known[1:] != known[:-1])])
    many = len(begins)
    conv = np.repeat(np.arange(many), np.diff(np.r_[begins, len(raw)]))
    live = np.flatnonzero(part.column("live").to_numpy())
    rows, conv = part.take(pa.array(live)).combine_chunks(), conv[live]
    array = lambda c: rows.column(c).combine_chunks() if len(rows) else pa.array([], rows.schema.field(c).type)
    kind, blank, open_end = (array(c).to_numpy(zero_copy_only=False) for c in ("kind", "blank", "broken"))
    kind, blank, open_end = kind.astype(np.int64), blank.astype(bool), open_end.astype(bool)
    code = [array(c).dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("role", "text")]
    place = np.lexsort((np.arange(len(conv)), code[1], code[0], conv))
    same = np.zeros(len(conv), bool)
    if len(conv):
        a, b = place[1:], place[:-1]
        same[a] = (conv[a] == conv[b]) & (code[0][a] == code[0][b]) & (code[1][a] == code[1][b])
    again, broken = same & ~blank, ~blank & ~same & open_end
    pair = (conv[1:] == conv[:-1]) & ~_LEGAL[kind[:-1], kind[1:]] if len(conv) else np.zeros(0, bool)
    length = np.bincount(conv, minlength=many)
    start = np.cumsum(length) - length
    cost, edits = np.zeros(many, np.int64), []
    size = np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)
    for bucket in np.unique(size):
        own = np.flatnonzero(size == bucket)
        n = length[own]
        turns = int(n.max(initial=0))
        at = np.minimum(start[own][None, :] + np.minimum(np.arange(turns)[:, None], np.maximum(n - 1, 0)[None, :]), max(len(conv) - 1, 0))
        tensor = [x[at] if turns else np.zeros((0, len(own)), x.dtype) for x in (kind, blank | again, broken)]
        ahead = _backward(*tensor, n)
        cost[own] = ahead[0, :, _START]
        c, letter, turn, state = _trace(ahead, *tensor, n)
        edits.append((own[c], letter, np.where(turn < 0, -1, start[own][c] + turn), state))
    who, letter, row, state = (np.concatenate(x) for x in zip(*edits, strict=True))
    order = np.argsort(who, kind="stable")
    who, letter, row, state = who[order], letter[order], row[order], state[order]
    ends = np.searchsorted(who, np.arange(many + 1))
    told = letter.tobytes().decode("ascii")
    audit = [told[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    put = letter != ord("D")
    own, row, kept, state = who[put], row[put], letter[put] == ord("K"), state[put]
    index = lambda ok: pa.array(np.maximum(row, 0), mask=~ok)
    role = pc.if_else(pa.array(kept), array("role").take(index(kept)), pa.array(np.where(state == _USER, "user", "assistant").astype(object), pa.string()))
    text = array("text").take(index(row >= 0)).fill_null("")
    offsets = pa.array(np.searchsorted(own, np.arange(many + 1)).astype(np.int32))
    turns = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([role, text], ["role", "text"]))
    numbers = [_counts(blank, conv, many), _counts(again, conv, many), _counts(broken, conv, many), _counts(pair, conv[1:], many) if len(conv) else np.zeros(many, np.int64), cost]
    columns = [ids.take(pa.array(begins)), pa.array(_gaps(array("turn"), conv, many), pa.int64()), *[pa.array(x.astype(np.int64)) for x in numbers], pa.array(audit, pa.string()), turns]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")[:8]] + ["repaired"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gathers whole conversations from sorted rows until a bucket is full."""
    held: list[pa.RecordBatch] = []
    size = [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size = [size[0] + batch.num_rows, size[1] + batch.column("text").nbytes]
        if size[0] < BUCKET_ROWS and size[1] < BUCKET_BYTES:
            continue
        rows = pa.Table.from_batches(held)
        ids = rows.column("conv_id").combine_chunks()
        raw, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        edge = np.flatnonzero((raw[1:] != raw[:-1]) | (known[1:] != known[:-1]))
        if len(edge):  # the last conversation may go on
            yield _repair(rows.slice(0, int(edge[-1]) + 1))
            rows = rows.slice(int(edge[-1]) + 1)
        held = rows.to_batches()
        size = [rows.num_rows, 0]
    if held:
        yield _repair(pa.Table.from_batches(held))


def repair(rows: DataFrame, live: Column | None = None) -> DataFrame:
    """Per conversation: what is wrong with it, the cost and string of its cheapest edits, and the repaired turns.

    ``rows`` has (conv_id, turn, role, text).  Rows where ``live`` is false only name their
    conversation, which has a row in the result even if none of its rows is live.
    """
    shown = F.rtrim(F.col("text"), F.lit(_SPACE))
    first = F.substring("role", 1, 1)
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), (F.lit(True) if live is None else live).alias("live")
    )
    kind = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    rows = rows.withColumns({"kind": kind, "blank": shown == "", "broken": ~F.substring(shown, -1, 1).isin(".", "!", "?")})
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_stream, _OUT)
