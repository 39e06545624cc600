"""Vectorised text primitives for Arrow batches.

Everything works on the UTF-8 bytes of a whole batch at once: word boundaries,
word hashes and hashes of runs of words are numpy array expressions, so no
Python loop runs per word.  Words are runs of bytes other than 0x20 and
0x09-0x0D; these separators are single bytes in UTF-8, so cutting bytes equals
cutting characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the temporary arrays (about 60 x this).
SLICE_BYTES = 1 << 20
#: Where copies inside a slice are worth finding.
WIDE_SLICE_BYTES = 2 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_B = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _B)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
#: Powers kept between calls, by base; more than a slice needs are made anew.
_held: dict[int, np.ndarray] = {}
_HELD_POWERS = WIDE_SLICE_BYTES * 5 // 4


def powers(n: int, base: np.uint64 = _B) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64, at least n of them."""
    known = _held.get(int(base))
    if known is None or len(known) < n:
        known = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256), base)]), dtype=np.uint64)
        if n <= _HELD_POWERS:
            _held[int(base)] = known
    return known


def per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many places of each row are set."""
    return np.array([np.count_nonzero(mask[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)


def _scalar_power(n: int) -> np.uint64:
    return np.uint64(pow(int(_C), n, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a batch, digits as 0, controls that separate as spaces and U+0000 as U+0001, and the rows' offsets in characters."""
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    point[(point >= 48) & (point < 58)] = 48
    point[(point >= 9) & (point < 14)] = 32
    point[point == 0] = 1
    return point, np.r_[0, np.cumsum((data & 0xC0) != 0x80)][off]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most ``limit`` bytes of text, or one row; at the end Arrow's spare memory goes back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        del batch, off
    pa.default_memory_pool().release_unused()


class Words(NamedTuple):
    """Words of a batch: byte bounds, hash, and ``first[d]`` .. ``first[d + 1]`` of row d."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SEPARATOR) -> Words:
    """All words of a batch, divided by bytes that ``separator`` marks; a row's end also ends a word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(off), np.int64))
    inside = ~separator[data]
    full = np.flatnonzero(np.diff(off))
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[off[full]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[off[full + 1] - 1] = False
    begins = inside & ~before
    start, end = np.flatnonzero(begins), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, off)
    if not len(start):
        return Words(start, end, np.zeros(0, np.uint64), first)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * powers(n)[:n], out=total[1:])
    return Words(start, end, mix((total[end] - total[start]) * powers(n, _INVERSE)[start]), first)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries, n - k + 1 of them, by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total, level, length, done = None, h, 1, 0
    rest = k
    while rest:
        if rest & 1:
            part = level[done : done + len(h) - k + 1] * _scalar_power(done)
            total = part if total is None else total + part
            done += length
        rest >>= 1
        if rest:
            level = level[:-length] + level[length:] * _scalar_power(length)
            length *= 2
    return mix(total + np.uint64(k))


def run_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (word index) and hash of every k consecutive words inside one row."""
    h = runs(w.hash, k)
    if not len(h):
        return np.zeros(0, np.int64), h
    room = np.repeat(w.first[1:], np.diff(w.first))[: len(h)] - np.arange(len(h))
    at = np.flatnonzero(room >= k)
    return at, h[at]


def spans_to_mask(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which of n positions are covered by [a, a + length) for an a in ``at``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def pack(arrays: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([a if isinstance(a, bytes) else a.tobytes() for a in arrays], pa.binary())
