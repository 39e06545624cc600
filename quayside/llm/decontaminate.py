"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised to words (ASCII letters in lower case, digits, and everything
beyond ASCII), cut to overlapping segments of bounded length and dealt to shards of at
most about ``SHARD_WORDS`` words.  One task builds the automaton of a shard: its states
are the classes of equally placed word runs of all items, each with its greatest length
and the link to its longest proper suffix class.

Training texts stream past the automaton.  For each word the longest run that ends there
and occurs in an item is tracked: a word that goes on follows a transition, another one
falls back along links.  All runs of known words of a batch are walked at once, one word
of each in a step.  Where the length reaches ``least`` words, or a whole shorter item ends,
the words covered are hit, and the state names the items.  Hit spans are cut out of texts;
texts of which more than a share is hit are rejected.

A shard's automaton is broadcast: its size is bounded by ``SHARD_WORDS`` (about 100 bytes a
word), and each further shard is a further pass over the texts in the same job.

Rows: a null text has no words and isn't hit; an item without words matches nothing; an
item without an id hits words, but is not listed; items that share an id are one item;
rows that repeat each other are judged each; a very long text is one row of a task, about
60 times its bytes in memory; columns of documents go along but for names of result
columns; no items or no documents give unhit or no rows.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import materialise

#: Words of test items in one automaton, and in one segment of a long item.
SHARD_WORDS = 200_000
SEGMENT_WORDS = 4096
#: Words that a walk goes on for; longer runs are cut and walked side by side.
STRIDE = 512
#: Passes over the texts in one job.
PASSES = 4

_OTHER = np.ones(256, bool)
_OTHER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, K.Words]:
    data, off = K.text_bytes(column)
    return data, off, K.words(K.LOWER[data], off, _OTHER)


# automata


class Automaton:
    """Suffix automaton of many word sequences, as sorted arrays."""

    def __init__(self, sequences: list[np.ndarray], names: list[str | None], least: int):
        """``sequences`` hold word hashes; one shorter than ``least`` counts as a whole only."""
        self.least = least
        self.vocabulary = np.unique(np.concatenate(sequences)) if sequences else np.zeros(0, np.uint64)
        known = sorted({n for n in names if n is not None})
        self.names, place = known, {n: i for i, n in enumerate(known)} | {None: -1}
        tokens = [np.searchsorted(self.vocabulary, s).tolist() for s in sequences]
        step, link, length = [{}], [-1], [0]
        for sequence in tokens:
            last = 0
            for token in sequence:
                last = self._extend(step, link, length, last, token)
        up = [0] * len(link)
        for v in sorted(range(1, len(link)), key=length.__getitem__):
            if length[v] >= least:
                up[v] = v if length[link[v]] < least else up[link[v]]
        windows, whole = set(), set()
        for sequence, name in zip(tokens, names, strict=True):
            state, item = 0, place[name]
            for n, token in enumerate(sequence, 1):
                state = step[state][token]
                if n >= least:
                    windows.add((up[state], item))
            if 0 < len(sequence) < least:
                whole.add((state, len(sequence), item))
        size = np.int64(max(len(self.vocabulary), 1))
        edges = sorted((v * int(size) + c, to) for v, row in enumerate(step) if v for c, to in row.items())
        self.key = np.array([e[0] for e in edges], np.int64)
        self.to = np.array([e[1] for e in edges], np.int32)
        self.root = np.zeros(size, np.int32)
        for c, to in step[0].items():
            self.root[c] = to
        self.link, self.length, self.up = np.maximum(np.array(link, np.int32), 0), np.array(length, np.int32), np.array(up, np.int32)
        self.window = self._table(sorted(windows), len(link))
        self.whole = self._table(sorted(whole), len(link))
        near = [0] * len(link)  # the longest suffix class, itself included, that holds a short item
        for v in sorted(range(1, len(link)), key=length.__getitem__):
            near[v] = v if self.whole[0][v + 1] > self.whole[0][v] else near[link[v]]
        self.near = np.array(near, np.int32)

    @staticmethod
    def _extend(step: list[dict], link: list[int], length: list[int], last: int, token: int) -> int:
        def copy(p: int, q: int) -> int:
            """The part of class q that follows p, as a class of its own."""
            step.append(step[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = len(step) - 1
            while p >= 0 and step[p].get(token) == q:
                step[p][token] = len(step) - 1
                p = link[p]
            return len(step) - 1

        if token in step[last]:
            q = step[last][token]
            return q if length[q] == length[last] + 1 else copy(last, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and token not in step[p]:
            step[p][token] = new
            p = link[p]
        if p >= 0:
            q = step[p][token]
            link[new] = q if length[q] == length[p] + 1 else copy(p, q)
        return new

    @staticmethod
    def _table(rows: list[tuple], states: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by state: where each state's begin, and the rest of the columns."""
        held = np.array(rows or np.zeros((0, 3)), np.int64)
        return np.searchsorted(held[:, 0], np.arange(states + 1)), held[:, 1:]

    def tokens(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def follow(self, token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and longest matching length at each word; lengths from ``least`` on may be reported shorter, but not below it."""
        n = len(token)
        state, size = np.zeros(n, np.int32), np.zeros(n, np.int32)
        known = token >= 0
        begins = np.zeros(n, bool)
        begins[1:] = known[1:] & ~known[:-1]
        starts = first[:-1][np.diff(first) > 0]
        begins[starts] = known[starts]
        ends = np.ones(n, bool)
        ends[:-1] = ~known[1:]
        ends[starts[1:] - 1] = True
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends & known) + 1
        many = -(-(end - begin) // STRIDE)
        piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own = np.repeat(begin, many) + piece * STRIDE
        warm = np.minimum(piece * STRIDE, self.least - 1)  # words before a cut that a run over it may need
        total = np.minimum(own + STRIDE, np.repeat(end, many)) - own + warm
        order = np.argsort(-total, kind="stable")
        begin, warm, total = (own - warm)[order], warm[order], total[order]
        width, s, m = np.int64(len(self.root)), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for t in range(int(total.max(initial=0))):
            live = np.searchsorted(-total, -t, "left")
            c = token[begin[:live] + t]
            todo = np.arange(live)
            while len(todo):
                at = s[todo]
                base = at == 0
                now = todo[base]
                s[now], m[now] = self.root[c[now]], 1
                todo = todo[~base]
                if not len(todo):
                    break
                wanted = at[~base] * width + c[todo]
                place = np.minimum(np.searchsorted(self.key, wanted), max(len(self.key) - 1, 0))
                found = self.key[place] == wanted if len(self.key) else np.zeros(len(todo), bool)
                on = todo[found]
                s[on], m[on] = self.to[place[found]], m[on] + 1
                todo = todo[~found]
                s[todo] = self.link[s[todo]]
                m[todo] = self.length[s[todo]]
            put = np.flatnonzero(warm[:live] <= t)
            state[begin[put] + t], size[begin[put] + t] = s[put], m[put]
        return state, size

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words lie in an occurrence of an item's window or of a short item; and pairs of text and item."""
        state, size = self.follow(self.tokens(words), first)
        at = np.flatnonzero((size >= self.least) | (self.near[state] > 0))
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
        long = size[at] >= self.least
        cover = np.where(long, self.least, 0).astype(np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        named = np.unique(np.c_[doc[long], self.up[state[at[long]]]], axis=0)
        pairs.append(self._spread(named[:, 0], named[:, 1], self.window)[:, :2])
        # short items that end here: those of the state itself up to the matched length, then those of all its suffix classes
        codes, back = np.unique(self.near[state[at]].astype(np.int64) << 32 | np.where(self.near[state[at]] == state[at], size[at], 1 << 20), return_inverse=True)
        now, most, longest = codes >> 32, codes & 0xFFFFFFFF, np.zeros(len(codes), np.int64)
        carried = np.arange(len(codes))
        listed: list[np.ndarray] = []
        while len(carried):
            rows = self._spread(carried, now[carried], self.whole)
            rows = rows[rows[:, 1] <= most[rows[:, 0]]]
            np.maximum.at(longest, rows[:, 0], rows[:, 1])
            listed.append(rows[:, [0, 2]])
            now[carried], most[carried] = self.near[self.link[now[carried]]], 1 << 20
            carried = carried[now[carried] > 0]
        cover = np.maximum(cover, longest[back])
        if listed:
            rows = np.concatenate(listed)
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            table = np.searchsorted(rows[:, 0], np.arange(len(codes) + 1)), rows[:, 1:]
            seen = np.unique(np.c_[doc, back.reshape(-1)], axis=0)
            pairs.append(self._spread(seen[:, 0], seen[:, 1], table)[:, :2])
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at + 1 - cover, 1)
        np.add.at(edge, at + 1, -1)
        found = np.unique(np.concatenate(pairs), axis=0)
        return np.cumsum(edge[:-1]) > 0, *found[found[:, 1] >= 0].T

    @staticmethod
    def _spread(owner: np.ndarray, state: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(owner, columns) of the rows that a table has for each state."""
        first, rows = table
        n = first[state + 1] - first[state]
        place = np.repeat(first[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.c_[np.repeat(owner, n), rows[place]]


def _segments(least: int, size: int):
    """Items as sequences of word hashes, long ones cut so that no window is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            _, _, w = _words(part.column("text"))
            names = part.column("name").to_pylist()
            out = []
            for name, a, b in zip(names, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                for at in range(a, max(b - least + 1, a + 1), size):
                    end = min(at + size + least - 1, b)
                    if end > at:
                        out.append((name, w.hash[at:end].tobytes(), (end - at)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], names=["name", "words", "n"])

    return run


def _build(least: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sequences = [np.frombuffer(x, np.uint64) for x in rows.column("words").to_pylist()]
        built = Automaton(sequences, rows.column("name").to_pylist(), least)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([pickle.dumps(built)], pa.binary())})

    return run


def automata(items: DataFrame, least: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(shard, automaton): pickled automata of all items, written to the shared folder."""
    named = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    parts = materialise(named.mapInArrow(_segments(least, SEGMENT_WORDS), "name string, words binary, n long").distinct())
    shards = (parts.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS + 1
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("name", "words"), F.lit(shards)))
    built = materialise(dealt.groupBy("shard").applyInArrow(_build(least), "shard long, automaton binary"))
    if built.isEmpty():  # texts are read all the same: their words are counted
        built = items.sparkSession.createDataFrame([(0, pickle.dumps(Automaton([], [], least)))], "shard long, automaton binary")
    return built


# texts


def _pass(shared: Broadcast, text: str, spans: str, items: str, n_words: str):
    """Adds what one automaton finds to a batch's spans and items."""
    held: list[Automaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(pickle.loads(shared.value))
        automaton = held[0]
        for part in K.slices(batches, text):
            _, _, w = _words(part.column(text))
            mask, doc, item = automaton.hits(w.hash, w.first)
            known = part.column(spans)
            if known.null_count < len(known):
                owner, edge = np.repeat(np.arange(len(known)), known.fill_null([]).value_lengths().to_numpy()), known.flatten()
                for d, a, b in zip(owner.tolist(), edge.field("start").to_pylist(), edge.field("end").to_pylist(), strict=True):
                    mask[w.first[d] + a : w.first[d] + b] = True
            first = np.zeros(len(mask) + 1, bool)
            first[w.first] = True
            begin = np.flatnonzero(mask & (first[:-1] | ~np.r_[False, mask[:-1]])) if len(mask) else np.zeros(0, np.int64)
            end = np.flatnonzero(mask & (first[1:] | ~np.r_[mask[1:], False])) + 1 if len(mask) else begin
            owner = np.searchsorted(w.first, begin, "right") - 1
            kind = part.schema.field(spans).type
            edges = pa.StructArray.from_arrays([pa.array((x - w.first[owner]).astype(np.int32)) for x in (begin, end)], fields=list(kind.value_type))
            places = lambda own: pa.array(np.searchsorted(own, np.arange(part.num_rows + 1)).astype(np.int32))
            names = pa.ListArray.from_arrays(places(doc), pa.array(automaton.names, pa.string()).take(pa.array(item)))
            if part.column(items).null_count < part.num_rows:
                names = pa.array([(x or []) + y for x, y in zip(part.column(items).to_pylist(), names.to_pylist(), strict=True)], names.type)
            new = {spans: pa.ListArray.from_arrays(places(owner), edges).cast(kind), items: names.cast(part.schema.field(items).type), n_words: pa.array(np.diff(w.first))}
            yield pa.RecordBatch.from_arrays([new.get(f.name, part.column(i)) for i, f in enumerate(part.schema)], names=part.schema.names)

    return run


def _cut(text: str, spans: str, least: int):
    """Texts without spans of at least ``least`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, text):
            data, off, w = _words(part.column(text))
            raw, kept = data.tobytes(), []
            for r, found in enumerate(part.column(spans).to_pylist()):
                pieces, at = [], int(off[r])
                for span in found:
                    if span["end"] - span["start"] >= least:
                        pieces.append(raw[at : w.start[w.first[r] + span["start"]]])
                        at = int(w.end[w.first[r] + span["end"] - 1])
                kept.append(b"".join([*pieces, raw[at : off[r + 1]]]).decode("utf-8"))
            place = part.schema.get_field_index(text)
            yield part.set_column(place, part.schema.field(place).name, pa.array(kept, pa.string()))

    return run


def find(docs: DataFrame, items: DataFrame, least: int = 10, text: str = "text") -> DataFrame:
    """Documents with n_words, n_hit, ``items`` (their ids as sorted strings), ``spans`` (in words) and ``contaminated``."""
    spark, told = docs.sparkSession, ("n_words", "n_hit", "items", "spans", "contaminated")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in told])
    rows = rows.withColumns({text: F.col(text).cast("string"), "n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast("array<struct<start: int, end: int>>"), "items": F.lit(None).cast("array<string>")})
    built = automata(items, least)
    for i, shard in enumerate(sorted(r.shard for r in built.select("shard").collect())):
        if i and i % PASSES == 0:
            rows = materialise(rows)
        held = built.where(F.col("shard") == shard).first().automaton
        rows = rows.mapInArrow(_pass(spark.sparkContext.broadcast(held), text, "spans", "items", "n_words"), rows.schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.withColumns({"items": F.array_sort(F.array_distinct("items")), "n_hit": hit, "contaminated": hit > 0})


def remove(found: DataFrame, span_limit: int = 10, coverage_limit: float = 0.5, text: str = "text") -> DataFrame:
    """Rows of ``find`` with spans of at least ``span_limit`` words cut out of their texts; those with a greater share of hit words go."""
    kept = found.where(F.col("n_hit") <= F.col("n_words") * coverage_limit)
    return kept.mapInArrow(_cut(text, "spans", span_limit), kept.schema)
