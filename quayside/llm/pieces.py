"""N-best encoding and decoding with a SentencePiece vocabulary.

A text is a lattice: its nodes are byte places, its edges the pieces that match
there, and a path's score is the sum of its pieces' scores.  No piece reaches
over the start of a run of spaces, so every path passes there and the lattice
falls apart into chunks; equal chunks of a slice are one.

Forward Viterbi scores of all chunks are array operations over the places of the
same distance from their chunk's start.  With backward scores they give, for
each chunk, the loss of its second-best path.  The n best paths of a text can
only leave the best one in the n - 1 chunks of least such loss; these are
searched backward by A-star, with the forward scores as exact heuristics, and
their answers are combined best first.

Rows: a null or empty text has no piece; repeated rows are encoded each.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

_SPACE = 0x20
#: Bits of a hash that choose a place in a length's table.
_TOP = 18


def _prefix(data: np.ndarray) -> np.ndarray:
    return np.r_[np.uint64(0), np.cumsum(K._BYTE[data] * K.powers(len(data) + 1)[: len(data)], dtype=np.uint64)]


def _span_hash(prefix: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return K.mix((prefix[at + length] - prefix[at]) * K.powers(len(prefix), K._INVERSE)[at] + np.asarray(length, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _start_hash(data: np.ndarray, n: int) -> np.ndarray:
    """16 bits of the first n (1 to 3) bytes at every place but the last two."""
    x = data[:-2].astype(np.uint32)
    if n > 1:
        x |= data[1:-1].astype(np.uint32) << 8
    if n > 2:
        x |= data[2:].astype(np.uint32) << 16
    return (x * np.uint32(2654435761)) >> np.uint32(16)


def _top(h: np.ndarray) -> np.ndarray:
    """The leading bits of a hash."""
    return (h >> np.uint64(64 - _TOP)).astype(np.uint32)


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order; small keys are sorted by radix."""
    return np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")


class Vocabulary:
    """Pieces as bytes (a space for the word mark), their scores, and a hash index by length."""

    def __init__(self, pieces: list[tuple[int, bytes, float]], byte_ids: dict[int, int], unknown: int):
        self.bytes = {i: b for i, b, _ in pieces} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.unknown = unknown
        # pieces that a user added carry a score far below all learned ones
        least = min((s for _, _, s in pieces if s > -1e8), default=0.0)
        self.byte_score = least - 10.0
        self.byte_ids = np.array([byte_ids.get(b, unknown) for b in range(256)], np.int32)
        by_length: dict[int, list] = {}
        for i, b, s in pieces:
            by_length.setdefault(len(b), []).append((int(_span_hash(_prefix(np.frombuffer(b, np.uint8)), np.zeros(1, np.int64), len(b))[0]), i, s))
        self.lengths = sorted(by_length)
        if len(self.lengths) > 64:
            raise ValueError("pieces of more than 64 different lengths")
        self.index, self.first = {}, {}
        # a bit per length: which lengths a piece with these first bytes (by hash) can have, which fit into so much room
        self.starts = {n: np.zeros(1 << 16, np.uint64) for n in (1, 2, 3)}
        self.fits = np.zeros(256, np.uint64)
        for bit, n in enumerate(self.lengths):
            rows = sorted(by_length[n])
            h, i, s = zip(*rows, strict=True)
            h = np.array(h, np.uint64)
            self.index[n] = (h, np.array(i, np.int32), np.array(s))
            self.first[n] = np.full(1 << _TOP, -1, np.int32)
            self.first[n][_top(h)[::-1]] = np.arange(len(h))[::-1]
            self.fits[n:] |= np.uint64(1 << bit)
            for x in i:
                self.starts[min(n, 3)][_start_hash(np.frombuffer(self.bytes[x] + b"\0\0", np.uint8), min(n, 3))[0]] |= np.uint64(1 << bit)

    @classmethod
    def load(cls, model_path: str | None = None) -> Vocabulary:
        import sentencepiece

        if model_path is None:
            import public_tokenizers

            model_path = public_tokenizers.path("piece_bpe_32k.model")
        m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces, byte_ids = [], {}
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                byte_ids[int(m.id_to_piece(i)[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                pieces.append((i, m.id_to_piece(i).replace("▁", " ").encode("utf-8"), m.get_score(i)))
        return cls(pieces, byte_ids, m.unk_id())

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: one space, that which encoding puts first, goes."""
        raw = b"".join(map(self.bytes.get, ids)) if self.unknown not in ids else b"".join(self.bytes.get(i, b"\xef\xbf\xbd") for i in ids)
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with one space before each text, chunk bounds (n + 1), and the first chunk of each row (rows + 1)."""
    full = np.diff(off) > 0
    with_space = np.insert(data, off[:-1][full], _SPACE)
    off = off + np.r_[0, np.cumsum(full)]
    space = with_space == _SPACE
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[off[:-1][full]] = True
    start = np.flatnonzero(begins)
    return with_space, np.r_[start, len(with_space)], np.searchsorted(start, off)


class Lattice:
    """All lattices of a set of different chunks laid one after the other; node = byte place."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary):
        self.bounds, n = bounds, len(data)
        size = np.diff(bounds)
        # chunk c has size[c] + 1 nodes, from node[c] on
        self.node = np.r_[0, np.cumsum(size + 1)]
        start_of = np.repeat(bounds[:-1], size)
        room = np.repeat(size, size) - (np.arange(n) - start_of)
        lead = (data & 0xC0) != 0x80
        width = np.where(data < 0xC0, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        prefix, covered = _prefix(data), ~lead
        at, length, piece, score = [], [], [], []
        may = np.zeros(n, np.uint64)
        for m, bits in vocabulary.starts.items():
            may |= bits[_start_hash(np.r_[data, np.zeros(2, np.uint8)], m)]
        may &= vocabulary.fits[np.minimum(room, 255).astype(np.uint8) * lead]
        for bit, m in enumerate(vocabulary.lengths):
            h, i, s = vocabulary.index[m]
            own = np.flatnonzero(may & np.uint64(1 << bit))
            if len(own):
                x = _span_hash(prefix, own, m)
                k = vocabulary.first[m][_top(x)]
                likely = np.flatnonzero(k >= 0)
                own, x, k = own[likely], x[likely], k[likely]
                off = np.flatnonzero(h[k] != x)  # the few whose place holds several
                k[off] = np.minimum(np.searchsorted(h, x[off]), len(h) - 1)
                hit = h[k] == x
                own, k = own[hit], k[hit]
                covered[own[width[own] == m]] = True
                at.append(own), length.append(np.full(len(own), m)), piece.append(i[k]), score.append(s[k])
        # characters without a piece are spelled in bytes
        own = np.flatnonzero(~covered)
        own = np.concatenate([own[width[own] > j] + j for j in range(4)])
        own = np.sort(own[own < n])
        at.append(own), length.append(np.ones(len(own), int)), piece.append(vocabulary.byte_ids[data[own]]), score.append(np.full(len(own), vocabulary.byte_score))
        at, self.piece, self.score = np.concatenate(at), np.concatenate(piece), np.concatenate(score)
        length = np.concatenate(length)
        chunk = np.repeat(np.arange(len(size)), size)[at]
        self.tail = at + chunk  # node of byte place p in chunk c: p + c
        self.head = self.tail + length
        step = at - start_of[at] + length
        order = _order((step << 6) | (63 - np.minimum(length, 63)))
        for name in ("tail", "head", "piece", "score"):
            setattr(self, name, getattr(self, name)[order])
        self.chunk, step = chunk[order], step[order]
        self._viterbi(step, size)

    def _viterbi(self, step: np.ndarray, size: np.ndarray) -> None:
        nodes = int(self.node[-1])
        f, self.back = np.full(nodes, -np.inf), np.full(nodes, -1, np.int64)
        f[self.node[:-1]] = 0
        cut = np.searchsorted(step, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            head, value = self.head[a:b], f[self.tail[a:b]] + self.score[a:b]
            np.maximum.at(f, head, value)
            best = np.flatnonzero(value == f[head])[::-1]
            self.back[head[best]] = a + best  # of equal ones the longest piece
        self.forward = f
        # backward, by the distance to the chunk's end
        g = np.full(nodes, -np.inf)
        g[self.node[1:] - 1] = 0
        left = self.node[1:][self.chunk] - 1 - self.tail
        order = _order(left)
        cut = np.searchsorted(left[order], np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            e = order[a:b]
            np.maximum.at(g, self.tail[e], self.score[e] + g[self.head[e]])
        # best paths, all at once from the ends
        at, owner, used = self.node[1:] - 1, np.arange(len(size)), []
        at, owner = at[size > 0], owner[size > 0]
        while len(at):
            e = self.back[at]
            used.append(np.stack([owner, e]))
            at = self.tail[e]
            on = at > self.node[owner]
            at, owner = at[on], owner[on]
        owner, edge = np.concatenate(used[::-1], 1) if used else np.zeros((2, 0), np.int64)
        order = np.argsort(owner, kind="stable")  # paths, one chunk after the other
        self.best_edges = edge[order]
        self.best_first = np.searchsorted(owner[order], np.arange(len(size) + 1))
        self.best = self.forward[self.node[1:] - 1]
        other = np.ones(len(self.tail), bool)
        other[self.best_edges] = False
        second = np.full(len(size), -np.inf)
        np.maximum.at(second, self.chunk[other], (f[self.tail] + self.score + g[self.head])[other])
        self.loss = self.best - second

    def prepare(self, chunks: np.ndarray) -> None:
        """Brings the edges of the chunks that will be searched together."""
        need = np.zeros(len(self.best), bool)
        need[chunks] = True
        e = np.flatnonzero(need[self.chunk])
        self._edges = e[np.argsort(self.chunk[e], kind="stable")]
        self._edge_chunk = self.chunk[self._edges]

    def n_best(self, chunk: int, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a chunk: A-star from its end, the forward score of a node is what is exactly left."""
        a, b = np.searchsorted(self._edge_chunk, [chunk, chunk + 1])
        e, into = self._edges[a:b], {}
        for head, *edge in zip(*(x.tolist() for x in (self.head[e], self.tail[e], self.piece[e], self.score[e], self.forward[self.tail[e]])), strict=True):
            into.setdefault(head, []).append(edge)
        start, out, count = int(self.node[chunk]), [], 0
        queue = [(-float(self.best[chunk]), 0, 0.0, int(self.node[chunk + 1]) - 1, ())]
        while queue and len(out) < n:
            _, _, done, node, path = heapq.heappop(queue)
            if node == start:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((done, ids))
                continue
            for tail, piece, score, left in into[node]:
                count -= 1  # of equal paths the newest goes on: it is the nearest to its start
                heapq.heappush(queue, (-round(done + score + left, 6), count, done + score, tail, (piece, path)))
        return out


def encode_batch(column: pa.Array, vocabulary: Vocabulary, n: int = 1) -> list[list[tuple[float, np.ndarray]]]:
    """The n best (score, ids) of each text, best first; an empty text has one empty path."""
    data, off = K.text_bytes(column)
    if not len(data):
        return [[(0.0, np.zeros(0, np.int32))] for _ in range(len(column))]
    data, bounds, first = chunks(data, off)
    h = _span_hash(_prefix(data), bounds[:-1], np.diff(bounds))
    _, where, kind = np.unique(h, return_index=True, return_inverse=True)
    size = np.diff(bounds)[where]
    own = np.r_[0, np.cumsum(size)]
    flat = data[np.repeat(bounds[:-1][where] - own[:-1], size) + np.arange(own[-1])]
    lattice = Lattice(flat, own, vocabulary)
    many = np.diff(lattice.best_first)
    out, cache = [], {}
    picks = [_to_search(lattice.loss[kind[a:b]], n) for a, b in zip(first[:-1], first[1:], strict=True)]
    lattice.prepare(kind[np.concatenate([a + pick for a, pick in zip(first[:-1], picks, strict=True)])])
    for a, b, pick in zip(first[:-1], first[1:], picks, strict=True):
        k = kind[a:b]
        if not len(k):
            out.append([(0.0, np.zeros(0, np.int32))])
            continue
        m = many[k]
        edge = lattice.best_edges[np.repeat(lattice.best_first[k] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())]
        ids, best = lattice.piece[edge], float(lattice.best[k].sum())
        paths = [(best, ids)]
        if n > 1:
            ends = np.cumsum(m)
            options = []
            for p in pick:
                c = int(k[p])
                if c not in cache:
                    # of equal best paths the one of the forward scores stands first
                    first_ids = lattice.piece[lattice.best_edges[lattice.best_first[c] : lattice.best_first[c + 1]]].tolist()
                    cache[c] = [(float(lattice.best[c]), first_ids), *[x for x in lattice.n_best(c, n) if x[1] != first_ids]][:n]
                options.append(cache[c])
            for _, choice in _combine([[o[0] for o in x] for x in options], n)[1:]:
                parts, at = [], 0
                score = best
                for j in np.argsort(pick):
                    if choice[j]:
                        p, (s, own_ids) = pick[j], options[j][choice[j]]
                        score += s - options[j][0][0]
                        parts += [ids[at : ends[p] - m[p]], np.array(own_ids, np.int32)]
                        at = ends[p]
                paths.append((score, np.concatenate([*parts, ids[at:]])))
        out.append(paths)
    return out


def _to_search(loss: np.ndarray, n: int) -> np.ndarray:
    """The n - 1 chunks of a text whose second-best paths lose least, those first that lose less."""
    if n < 2:
        return np.zeros(0, np.int64)
    pick = np.argpartition(loss, n - 2)[: n - 1] if len(loss) >= n else np.arange(len(loss))
    pick = pick[np.isfinite(loss[pick])]
    return pick[np.lexsort((pick, loss[pick]))]


def _combine(scores: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best ways to choose one option of each list, options falling by score."""
    start = (0,) * len(scores)
    queue, seen, out = [(0.0, start)], {start}, []
    while queue and len(out) < n:
        loss, choice = heapq.heappop(queue)
        out.append((-loss, choice))
        for j, x in enumerate(scores):
            if choice[j] + 1 < len(x):
                more = (*choice[:j], choice[j] + 1, *choice[j + 1 :])
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(queue, (loss + x[choice[j]] - x[choice[j] + 1], more))
    return out


def _encode(shared, n: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for part in K.slices(batches, limit=K.WIDE_SLICE_BYTES):
            paths = encode_batch(part.column("text"), vocabulary, n)
            kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([[{"score": s, "ids": x.astype(np.int32)} for s, x in p] for p in paths], kind)], names=[*keep, "paths"])

    return run


def encode(docs: DataFrame, n: int = 1, text: str = "text", model_path: str | None = None) -> DataFrame:
    """All columns but the text, and ``paths``: its n best (score, ids).  A column of that name gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    keep = [c for c in docs.columns if c not in (text, "paths")]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    own = [f"c{i}" for i in range(len(keep))]
    out = rows.mapInArrow(_encode(shared, n, own), ", ".join(x for x in (kinds, "paths array<struct<score: double, ids: array<int>>>") if x))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "paths")


def _report(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for part in K.slices(batches, limit=K.WIDE_SLICE_BYTES):
            paths = encode_batch(part.column("text"), vocabulary, n)
            data, off = K.text_bytes(part.column("text"))
            same = [vocabulary.decode(p[0][1].tolist()).encode() == data[a:b].tobytes() for p, a, b in zip(paths, off[:-1], off[1:], strict=True)]
            columns = [
                pa.array([len(p[0][1]) for p in paths], pa.int64()),
                pa.array([zlib.crc32(p[0][1].astype("<u4").tobytes()) for p in paths], pa.int64()),
                pa.array([[s for s, _ in p] for p in paths], pa.list_(pa.float64())),
                pa.array([[zlib.crc32(x.astype("<u4").tobytes()) for _, x in p] for p in paths], pa.list_(pa.int64())),
                pa.array(same),
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_pieces", "ids_crc32", "scores", "paths_crc32", "decoded"])

    return run


def encode_report(docs: DataFrame, n: int = 4, doc_id: str = "doc_id", text: str = "text", model_path: str | None = None) -> DataFrame:
    """Digest of the n best paths of every text, and whether decoding the best gives the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(_report(shared, n), f"doc_id {kind}, n_pieces long, ids_crc32 long, scores array<double>, paths_crc32 array<long>, decoded boolean")
