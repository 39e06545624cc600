"""Bounded-space online packing of token sequences.

Each partition streams its documents.  A fixed number of windows is open: full
windows are cut off a document first, what remains goes whole into the open
window that it fills best, and when none has room the fullest is emitted and a
new one opened.  Memory is that of the open windows, whatever the partition
holds.  The windows still open at a partition's end are merged with those of a
few neighbouring partitions, best fit by falling length.

Rows: a null or empty text is its end token alone; repeated rows are separate
documents; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import materialise

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(1)
def _encoder(json_path: str | None, ranks_path: str | None):
    """Text to ids of the byte-level BPE in ``json_path``.

    The same merges run several times faster from their rank file; a text that
    holds the string of a special token takes the general path.
    """
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path or P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(json_path or P.path("byte_bpe_50k.json"))
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    return encode


class Windows:
    """At most ``most`` open windows of ``capacity``; emitted ones are handed to ``out``."""

    def __init__(self, capacity: int, most: int, first_id: int, out: list):
        self.capacity, self.most, self.next, self.out = capacity, most, first_id, out
        self.rooms: list[tuple[int, int]] = []  # (room left, id), rising
        self.pieces: dict[int, list[tuple]] = {}

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def whole(self, piece: tuple) -> None:
        """A piece that fills a window by itself."""
        self.out.append((*piece, self._new(), 0, False))

    def place(self, piece: tuple) -> None:
        """Best fit; if none fits, the fullest leaves."""
        length = piece[2]
        at = bisect.bisect_left(self.rooms, (length, -1))
        if at == len(self.rooms):
            if len(self.rooms) == self.most:
                self.emit(0)
            window, room = self._new(), self.capacity
            self.pieces[window] = []
        else:
            room, window = self.rooms.pop(at)
        self.pieces[window].append((*piece, window, self.capacity - room))
        if room > length:
            bisect.insort(self.rooms, (room - length, window))
        else:
            self.out.extend((*p, False) for p in self.pieces.pop(window))

    def emit(self, at: int, is_open: bool = False) -> None:
        _, window = self.rooms.pop(at)
        self.out.extend((*p, is_open) for p in self.pieces.pop(window))


def _place_documents(capacity: int, most: int, end_id: int, paths: tuple):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "is_open"]

    def batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = _encoder(*paths), []
        windows = Windows(capacity, most, TaskContext.get().partitionId() << 36, rows)
        for part in K.slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    (windows.whole if len(piece) == capacity else windows.place)((doc_id, at, len(piece), zlib.crc32(piece), len(ids)))
            if rows:
                yield batch(rows)
                rows.clear()
        while windows.rooms:
            windows.emit(0, True)
        if rows:
            yield batch(rows)

    return run


def _merge_leftovers(capacity: int):
    def run(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        rows: list = []
        windows = Windows(capacity, len(left) + 1, (1 << 62) + (int(key[0]) << 32), rows)
        left = left.astype(object).where(left.notna(), None)
        for p in sorted(left.itertuples(index=False), key=lambda p: (-p.length, p.sequence_id, p.offset)):
            windows.place((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens))
        while windows.rooms:
            windows.emit(0)
        out = pd.DataFrame([r[:7] for r in rows], columns=[c.split()[0] for c in PIECE.split(", ")])
        return out.astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, open_windows: int = 64, end_id: int = 1, merge: int = 16, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Packs token sequences into windows; one row per piece of a document.

    ``merge``: how many partitions' leftover windows are packed together.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = materialise(rows.mapInArrow(_place_documents(capacity, open_windows, end_id, (json_path, ranks_path)), PIECE + ", is_open boolean"))
    lot = F.shiftright("sequence_id", 36) / merge
    left = placed.where("is_open").withColumn("lot", lot.cast("long"))
    merged = left.groupBy("lot").applyInPandas(_merge_leftovers(capacity), PIECE)
    return placed.where("not is_open").drop("is_open").unionByName(merged)
