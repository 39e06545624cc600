"""Substring dedup with prefix-partitioned suffix trees.

A suffix starts at every word.  Its prefix runs up to the end of the least-hash
``gram`` of its first ``window`` words (the anchor), so prefixes vary in length,
equal windows always carry equal prefixes, and the neighbouring suffixes that
share an anchor travel as one row.

1. Spark counts the anchors.  A suffix whose anchor occurs once has no repeat and
   goes no further, which is nearly all text without copies.
2. Anchors met more often than ``group_runs`` would be groups beyond a task's
   memory: their suffixes get the longest prefix there is, the whole window, and
   counting these prefixes (partial sums, then a join that is split where it is
   skewed) answers them, however often a passage occurs.
3. All other groups fit memory.  They are dealt to tasks by their measured total,
   and each becomes a suffix tree: the suffixes at the anchors sorted by their words,
   with the common prefix lengths of neighbours.  A node at depth ``d`` is a run of
   neighbours with at least ``d`` words in common; with ``window - d`` equal words
   to the left of the anchor it is an internal node of depth ``window``, a repeat.
   Repeats at consecutive words join to maximal ones.

Words in the trees are 32-bit hashes, whole windows and anchors 64-bit ones: equality
of two windows is that of all their words' hashes.

Rows: a null text or one shorter than the window has no repeat; repeated rows
are repeats of each other; a very long text is one row of a task, about 60 times its
bytes in memory; other columns are left alone, but one with the name of an output
column gives way to it; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import materialise

_GRAM = 8
_HEAD = np.dtype([("row", "<i8"), ("at", "<i4"), ("lead", "u1"), ("n", "u1")])
_PLACE = np.dtype([("row", "<i8"), ("at", "<i4")])
#: Runs of suffixes that one prefix may have before its suffixes are split by whole windows.
GROUP_RUNS = 4096
#: Bytes of suffixes dealt to one task.
TASK_BYTES = 16 << 20


def _anchors(h: np.ndarray, span: int) -> np.ndarray:
    """Index of the first least value of each ``span`` consecutive ones."""
    value, index, length = h, np.arange(len(h)), 1
    while length < span:
        step = min(length, span - length)
        left = value[:-step] <= value[step:]
        value, index = np.where(left, value[:-step], value[step:]), np.where(left, index[:-step], index[step:])
        length += step
    return index


def _runs(w: K.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes that share an anchor: text, first word in the text, number of suffixes, anchor (word index); and the anchors' hashes."""
    rows = len(w.first) - 1
    many = np.maximum(np.diff(w.first) - window + 1, 0)
    doc = np.repeat(np.arange(rows), many)
    if not len(doc):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    gram = K.runs(w.hash, _GRAM)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + w.first[doc]
    anchor = _anchors(gram, window - _GRAM + 1)[at]
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    n = np.diff(np.r_[cut, len(doc)])
    return doc[cut], at[cut] - w.first[doc[cut]], n, anchor[cut], gram[anchor[cut]]


def _heads(window: int):
    """(key, row, at) of each run of suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            doc, at, _, _, key = _runs(K.words(*K.text_bytes(part.column("text"))), window)
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part.column("row").to_numpy()[doc]), pa.array(at.astype(np.int32))], names=["key", "row", "at"])

    return run


def _chosen(part: pa.RecordBatch, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of a batch that its column ``live`` names."""
    live = part.column("live")
    place = np.repeat(np.arange(part.num_rows), live.value_lengths().to_numpy())
    wanted = np.unique(place << 32 | live.flatten().to_numpy().astype(np.int64))
    own = doc << 32 | at
    return np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _segments(window: int, buckets: int):
    """The words that the chosen runs cover, by the bucket of their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            w = K.words(*K.text_bytes(part.column("text")))
            doc, at, n, anchor, key = _runs(w, window)
            if not len(doc):
                continue
            bucket = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            take = _chosen(part, doc, at)
            take = take[np.argsort(bucket[take], kind="stable")]
            doc, at, n, anchor, bucket = doc[take], at[take], n[take], anchor[take], bucket[take]
            first = at + w.first[doc]
            head = np.zeros(len(take), _HEAD)
            head["row"], head["at"], head["lead"], head["n"] = part.column("row").to_numpy()[doc], at, anchor - first, n
            word = (w.hash >> np.uint64(32)).astype("<u4")[_spread(first, n + window - 1)]
            edge = np.r_[0, np.cumsum(n + window - 1)]
            lot = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(take) else take
            ends = np.r_[lot[1:], len(take)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[lot]), K.pack([len(head[a:b]).to_bytes(4, "little") + head[a:b].tobytes() + word[edge[a] : edge[b]].tobytes() for a, b in zip(lot, ends, strict=True)])], names=["bucket", "payload"]
            )

    return run


def _windows(window: int):
    """(prefix, n, places) of the distinct suffixes of the chosen runs in a slice, the prefix the whole window; a place is a row and a first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, limit=K.WIDE_SLICE_BYTES):
            w = K.words(*K.text_bytes(part.column("text")))
            doc, at, n, _, _ = _runs(w, window)
            if not len(doc):
                continue
            take = _chosen(part, doc, at)
            doc, each = np.repeat(doc[take], n[take]), _spread(at[take], n[take])
            prefix = K.runs(w.hash, window)[each + w.first[doc]]
            order = np.argsort(prefix, kind="stable")
            place = np.zeros(len(order), _PLACE)
            place["row"], place["at"], prefix = part.column("row").to_numpy()[doc[order]], each[order], prefix[order]
            lot = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
            ends = np.r_[lot[1:], len(prefix)]
            for i in range(0, len(lot), 20_000):
                a, b = lot[i : i + 20_000], ends[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(prefix[a].view(np.int64)), pa.array(b - a), K.pack([place[x:y] for x, y in zip(a, b, strict=True)])], names=["prefix", "n", "places"])

    return run


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of repeated windows in the form in which the trees give theirs."""
    for batch in batches:
        if batch.num_rows:
            place = np.concatenate([np.frombuffer(x.as_buffer(), _PLACE) for x in batch.column("places")])
            yield from _marks(place["row"], place["at"])


def _marks(row: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(row, payload): the first words of repeated windows, by row."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order].astype("<i4")
    lot = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    ends = np.r_[lot[1:], len(row)]
    for i in range(0, len(lot), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(row[lot[i : i + 20_000]]), K.pack([at[a:b] for a, b in zip(lot[i : i + 20_000], ends[i : i + 20_000], strict=True)])], names=["row", "payload"])


def suffix_tree(words: np.ndarray, anchor: np.ndarray, right: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``anchor`` (indices into ``words``, each with ``right`` words known), sorted, and the words each shares with the one before, at most ``depth``.

    Nodes of the tree at depth ``d`` are the maximal runs of suffixes whose common
    lengths within the run are at least ``d``.
    """
    step = np.arange(depth)
    label = np.where(step < right[:, None], words[np.minimum(anchor[:, None] + step, len(words) - 1)], 0).astype("<u4")
    order = np.argsort(label.view(f"S{4 * depth}")[:, 0], kind="stable")
    label, right = label[order], right[order]
    unequal = label[1:] != label[:-1]
    common = np.where(unequal.any(1), unequal.argmax(1), depth)
    return order, np.r_[0, np.minimum(common, np.minimum(right[1:], right[:-1]))]


def _deep_nodes(window: int):
    """The leaves below internal nodes of depth ``window`` of the groups in one partition, by row of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, held = [], []
        for batch in batches:
            for x in batch.column("payload"):
                raw = x.as_buffer()
                size = int.from_bytes(raw[:4].to_pybytes(), "little")
                heads.append(np.frombuffer(raw, _HEAD, size, 4))
                held.append(np.frombuffer(raw, "<u4", -1, 4 + size * _HEAD.itemsize))
        if not heads:
            return
        head, word = np.concatenate(heads), np.concatenate(held)
        del heads, held
        lead, n = head["lead"].astype(np.int64), head["n"].astype(np.int64)
        size = n + window - 1
        anchor = np.cumsum(size) - size + lead
        order, common = suffix_tree(word, anchor, size - lead, window)
        head, lead, n, anchor = head[order], lead[order], n[order], anchor[order]
        left = np.zeros(len(head), np.uint64)
        rows, places = [], []
        for back in range(window - _GRAM + 1):  # suffixes that start this many words before the anchor
            if back:
                left = left * np.uint64(0x9E3779B97F4A7C15) + K.mix(word[np.maximum(anchor - back, 0)].astype(np.uint64) + np.uint64(1))
            leaf = np.flatnonzero((back <= lead) & (back > lead - n))
            if len(leaf) < 2:
                continue
            node = np.cumsum(common < window - back)
            inner = K.mix(K.mix(node[leaf].astype(np.uint64)) + left[leaf])
            s = np.sort(inner)
            twice = np.unique(s[1:][s[1:] == s[:-1]])
            if len(twice):
                hit = leaf[twice[np.minimum(np.searchsorted(twice, inner), len(twice) - 1)] == inner]
                rows.append(head["row"][hit])
                places.append(head["at"][hit] + lead[hit] - back)
        if rows:
            yield from _marks(np.concatenate(rows), np.concatenate(places))

    return run


def repeated_windows(rows: DataFrame, window: int, group_runs: int = GROUP_RUNS) -> DataFrame:
    """(row, payload): the first words of the windows of (row, text, ...) that occur elsewhere too, as little-endian 32-bit numbers."""
    heads = rows.select("row", "text").mapInArrow(_heads(window), "key long, row long, at int")
    # written, so that the joins with these counts are between plain shuffles, which Spark splits where they are skewed
    counts = materialise(heads.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    live = materialise(heads.join(counts, "key").select("row", "at", (F.col("n") > group_runs).alias("large")))
    buckets = live.count() * (_HEAD.itemsize + 4 * (window + window // 2)) // TASK_BYTES + 1

    def with_texts(large: bool) -> DataFrame:
        chosen = live.where("large" if large else "not large").groupBy("row").agg(F.collect_list("at").alias("live"))
        return rows.join(chosen, "row")

    marks = with_texts(False).mapInArrow(_segments(window, buckets), "bucket int, payload binary").repartitionById(buckets, "bucket").mapInArrow(_deep_nodes(window), "row long, payload binary")
    if not live.where("large").isEmpty():
        windows = materialise(with_texts(True).mapInArrow(_windows(window), "prefix long, n long, places binary"))
        again = materialise(windows.groupBy("prefix").agg(F.sum("n").alias("n")).where("n > 1").select("prefix"))
        marks = marks.unionByName(windows.join(again, "prefix").select("places").mapInArrow(_by_row, "row long, payload binary"))
    return marks


def _cut(window: int, layout: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            data, off = K.text_bytes(part.column("text"))
            w = K.words(data, off)
            total, marks = np.diff(w.first), part.column("marks")
            at = [np.zeros(0, np.int64)]
            for i in np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False)):
                for x in marks[i].values:
                    at.append(np.frombuffer(x.as_buffer(), "<i4").astype(np.int64) + w.first[i])
            gone = K.spans_to_mask(len(w.start), np.concatenate(at), window)
            kept = ~gone
            left = np.add.reduceat(np.r_[kept, False].astype(np.int64), w.first[:-1]) * (total > 0) if len(total) else total
            word = np.flatnonzero(gone if layout else kept)
            edge = np.zeros(len(data) + 1, np.int32)
            out = data.copy()
            if layout:  # a lost word takes the separators up to the next word along
                after = np.minimum(np.r_[w.start[1:], len(data)][word], np.repeat(off[1:], total)[word])
                np.add.at(edge, w.start[word], 1)
                np.add.at(edge, after, -1)
                take = np.cumsum(edge[:-1]) == 0
            else:  # one space after each kept word that another follows in its row
                owner = w.doc[word]
                more = np.r_[owner[1:] == owner[:-1], False] if len(word) else np.zeros(0, bool)
                np.add.at(edge, w.start[word], 1)
                np.add.at(edge, w.end[word] + more, -1)
                take = np.cumsum(edge[:-1]) > 0
                out[w.end[word[more]]] = 0x20
            ends = np.r_[0, np.cumsum(take)][off]
            text = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out[take])]).cast(pa.string())
            columns = [part.column(c) for c in part.schema.names if c not in ("text", "marks")]
            yield pa.RecordBatch.from_arrays([*columns, text, pa.array(total), pa.array(total - left)], names=[*[c for c in part.schema.names if c not in ("text", "marks")], "kept_text", "n_words", "n_removed"])

    return run


def remove_repeats(
    docs: DataFrame,
    window: int = 35,
    text: str = "text",
    keep: list[str] | None = None,
    layout: bool = False,
    names: tuple[str, str, str] = ("kept_text", "n_words", "n_removed"),
    group_runs: int = GROUP_RUNS,
) -> DataFrame:
    """Removes each word covered by a window of ``window`` words that starts anywhere else too.

    Returns the columns ``keep`` (default: all but the text) and, under ``names``, the
    text left (kept words joined by one space; with ``layout`` the text's own
    separators stay), the number of words and the number removed.  All occurrences of
    a repeat go, the first as well.  A column of ``keep`` with one of these names gives
    way to it.
    """
    if not _GRAM < window < 256:
        raise ValueError(f"window must be over {_GRAM} and under 256 words")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names and (c != text or keep is not None)]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("row", F.xxhash64(*[c for c, kind in rows.dtypes if kind in ("bigint", "int", "string")]))
    marks = repeated_windows(rows, window, group_runs).groupBy("row").agg(F.collect_list("payload").alias("marks"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`c{i}` {kinds[f'c{i}']}" for i in range(len(keep))), "kept_text string, n_words long, n_removed long"])
    out = rows.join(marks, "row", "left").drop("row").mapInArrow(_cut(window, layout), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(n) for c, n in zip(("kept_text", "n_words", "n_removed"), names, strict=True)])
