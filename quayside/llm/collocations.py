"""Phrase collocation mining with sketch bounds and Aho-Corasick automata.

1. Texts become words in lower case with a space between words and a line end between
   pieces, packed in chunks and written once; the chunks of one language and task form
   lots of about ``LOT_BYTES``.
2. Each lot counts its runs of one to ``longest`` words in the cells of a sketch (one row
   of hash cells, as many as the corpus needs) and sends its non-empty cells to the tasks
   that hold the sketch, dealt by the cells' leading bits.  A sum is an upper bound of the
   counts of all runs in its cell; the cells that reach ``least`` go back to their lots.
3. A lot's runs in such cells are its candidates.  They are compiled into automata of at
   most ``GROUP_KEYS`` keys, guarded by a space at both ends, which scan the lot and count
   overlapping occurrences.  A task does so for several lots of a language and adds them
   up; Spark sums these exact counts and applies the threshold.
4. Phrases are scored by joins with the counts of their parts, single words salted;
   phrases inside a longer one of nearly the same count are dropped; the first ones of a
   language are found in levels, none of which sorts a whole language in one task.

No candidate set and no sketch is broadcast: a lot meets only what occurs in it.

Rows: a null text is empty; a null language is ``und``; repeated rows count each; equal
scores go by count, then by the phrase's bytes; a very long text is one lot's, about 60
times its bytes in memory; other columns are not read; an empty table gives an empty one.
The sketch compares runs by hash, which can only add candidates: counts are of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import materialise

#: Bytes of text in a lot, and in the lots of a language that one task counts; keys in one automaton.
LOT_BYTES = 20 << 20
TASK_BYTES = 96 << 20
GROUP_KEYS = 200_000
#: Bits of a cell beside its bucket, and cells for each word of the corpus.
CELL_BITS = 24
CELLS_PER_WORD = 16
#: Bytes of cells in a task that sums them.
SUM_BYTES = 64 << 20
#: Phrases that a task adds up before it hands them on.
HELD_PHRASES = 500_000
#: Salts of single words in joins, and phrases that one task ranks.
SALTS = 16
RANKED = 200_000

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _PIECE.copy()
_APART[[0x20, 0x09]] = True
_SPACED = np.zeros(256, bool)
_SPACED[[0x20, 0x0A]] = True


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def normalise(column: pa.Array) -> tuple[bytes, int]:
    """The words of all rows, each followed by a space, or by a line end where its piece ends; and their number."""
    data, off = K.text_bytes(column)
    data = K.LOWER[data]
    w = K.words(data, off, _APART)
    if not len(w.start):
        return b"", 0
    out = np.r_[data, 0][_spread(w.start, w.end - w.start + 1)]
    before = np.r_[0, np.cumsum(_PIECE[data])]
    cut = np.ones(len(w.start), bool)
    cut[:-1] = (before[w.start[1:]] > before[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
    out[np.cumsum(w.end - w.start + 1) - 1] = np.where(cut, 0x0A, 0x20)
    return out.tobytes(), len(w.start)


def _lots(lot_bytes: int):
    """Chunks of normalised text, each of one language, numbered by lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        made, part_id, pack = 0, TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
        for part in K.slices(batches):
            rows = []
            langs = part.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = part.column("text").filter(pa.compute.equal(langs.indices, i))
                text, n = normalise(own)
                lot = held.setdefault(lang, [-1, lot_bytes])
                if lot[1] >= lot_bytes:
                    lot[:] = [part_id << 32 | made, 0]
                    made += 1
                lot[1] += len(text)
                rows.append((lot[0], lang, n, len(text), pack.compress(text)))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["lot", "lang", "n", "size", "payload"])

    return run


class Runs:
    """Words of a normalised text, and the hashes of its runs inside pieces."""

    def __init__(self, text: bytes, lang: str):
        self.text, data = text, np.frombuffer(text, np.uint8)
        self.words = K.words(data, np.array([0, len(data)]), _SPACED)
        ends = np.flatnonzero(_SPACED[data])
        self.cuts = np.r_[0, np.cumsum(data[ends] == 0x0A)] if len(data) else np.zeros(1, np.int64)
        name = np.frombuffer(lang.encode() or b"\0", np.uint8)
        self.salt = K.words(name, np.array([0, len(name)]), np.zeros(256, bool)).hash[0]

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of k words."""
        h = K.runs(self.words.hash, k)
        at = np.flatnonzero(self.cuts[k - 1 : k - 1 + len(h)] == self.cuts[: len(h)])
        return at, K.mix(h[at] ^ self.salt)


def _cells(least: int, longest: int, bits: int, cell_bits: int, lot_bytes: int):
    """(lot, lang, bucket, payload): the sorted cells of a lot in a bucket, as differences by byte planes, and their counts up to ``least``."""

    def emit(lot: int, lang: str, found: list[np.ndarray]) -> Iterator[tuple[int, str, int, bytes]]:
        cell, count = np.unique(np.concatenate(found) >> np.uint64(64 - bits - cell_bits), return_counts=True)
        bucket, rest = (cell >> np.uint64(cell_bits)).astype(np.int64), (cell & np.uint64((1 << cell_bits) - 1)).astype("<u4")
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        count = -(-np.minimum(count, least) * _unit(least) // least)  # rounded up: sums stay upper bounds
        count = count.astype(np.uint8)
        step = np.r_[rest[:1], rest[1:] - rest[:-1]]
        step[first] = rest[first]
        planes = step.view(np.uint8).reshape(-1, 4)[:, :3]
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cell)], strict=True):
            yield lot, lang, int(bucket[a]), planes[a:b].T.tobytes() + count[a:b].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[np.ndarray]] = {}
        size, unpack = 0, zstandard.ZstdDecompressor()

        def flush() -> Iterator[pa.RecordBatch]:
            for (lot, lang), found in held.items():
                rows = list(emit(lot, lang, found))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["lot", "lang", "bucket", "payload"])

        for batch in batches:
            for lot, lang, payload in zip(*(batch.column(c).to_pylist() for c in ("lot", "lang", "payload")), strict=True):
                text = unpack.decompress(payload)
                if not text:
                    continue
                runs = Runs(text, lang)
                held.setdefault((lot, lang), []).extend(runs.of(k)[1] for k in range(1, longest + 1))
                size += len(text)
                if size >= lot_bytes:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


def _unit(least: int) -> int:
    """What counts up to ``least`` are scaled to, so that a byte holds one."""
    return min(least, 255)


def _sums(least: int):
    """The cells of each lot whose sums reach ``least``; rows come sorted by bucket."""

    def reach(bucket: int, rows: list[tuple[int, str, bytes]]) -> list[tuple[int, str, int, int, bytes]]:
        cells, counts = [], []
        for _, _, payload in rows:
            raw = np.frombuffer(payload, np.uint8).reshape(4, -1)
            step = np.zeros((raw.shape[1], 4), np.uint8)
            step[:, :3] = raw[:3].T
            cells.append(np.cumsum(step.view("<u4")[:, 0], dtype=np.uint32))
            counts.append(raw[3])
        lot = np.repeat(np.arange(len(rows)), [len(c) for c in cells])
        cell, count = np.concatenate(cells), np.concatenate(counts)
        order = np.argsort(cell, kind="stable")
        sorted_cell = cell[order]
        first = np.flatnonzero(np.r_[True, sorted_cell[1:] != sorted_cell[:-1]])
        total = np.add.reduceat(count[order].astype(np.int64), first)
        good = np.repeat(total >= _unit(least), np.diff(np.r_[first, len(cell)]))
        place = order[good]
        place = place[np.argsort(lot[place], kind="stable")]
        ends = np.searchsorted(lot[place], np.arange(len(rows) + 1))
        return [(*rows[i][:2], 0, bucket, cell[place[a:b]].astype("<u4").tobytes()) for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def told() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["lot", "lang", "kind", "bucket", "payload"])

        for batch in batches:
            for lot, lang, bucket, payload in zip(*(batch.column(c).to_pylist() for c in ("lot", "lang", "bucket", "payload")), strict=True):
                if bucket != now and rows:
                    out += reach(now, rows)
                    rows = []
                    if len(out) >= 1000:
                        yield told()
                        out = []
                now = bucket
                rows.append((lot, lang, payload))
        if rows:
            out += reach(now, rows)
        if out:
            yield told()

    return run


def _candidates(chunks: list[Runs], cells: np.ndarray, longest: int, shift: int) -> list[str]:
    """The distinct runs of a lot in the given cells."""
    hashes, chunk, first, size = [], [], [], []
    low = np.uint64((1 << 22) - 1)
    maybe = np.zeros(1 << 22, bool)  # most runs are told by their cell's last bits
    maybe[cells & low] = True
    for i, runs in enumerate(chunks):
        for k in range(1, longest + 1):
            at, h = runs.of(k)
            likely = np.flatnonzero(maybe[h >> np.uint64(shift) & low])
            once, place = np.unique(h[likely], return_index=True)
            cell = once >> np.uint64(shift)
            good = np.flatnonzero(cells[np.minimum(np.searchsorted(cells, cell), len(cells) - 1)] == cell)
            hashes.append(once[good])
            first.append(at[likely[place[good]]])
            chunk.append(np.full(len(good), i))
            size.append(np.full(len(good), k))
    h, place = np.unique(np.concatenate(hashes), return_index=True)
    chunk, first, size = (np.concatenate(x)[place] for x in (chunk, first, size))
    out = []
    for i, a, k in zip(chunk.tolist(), first.tolist(), size.tolist(), strict=True):
        w = chunks[i].words
        out.append(chunks[i].text[w.start[a] : w.end[a + k - 1]].decode("utf-8"))
    return sorted(out)


def _occurrences(texts: list[str], phrases: list[str], group: int) -> np.ndarray:
    """How often each phrase occurs in guarded texts, overlaps included."""
    counts = np.zeros(len(phrases), np.int64)
    for at in range(0, len(phrases), group):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, phrase in enumerate(phrases[at : at + group], at):
            automaton.add_word(f" {phrase} ", i)
        automaton.make_automaton()
        for text in texts:
            found = np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64)
            counts += np.bincount(found, minlength=len(phrases))
    return counts


def _count(longest: int, bits: int, cell_bits: int, group: int):
    """(lang, phrase, words, a), added up over the lots of a language in a task; a lot's rows come together, its cells before its chunks."""
    shift = 64 - bits - cell_bits

    def lot(lang: str, cells: list[tuple[int, bytes]], payloads: list[bytes], held: dict[str, int]) -> None:
        unpack = zstandard.ZstdDecompressor()
        chunks = [Runs(t, lang) for p in payloads if (t := unpack.decompress(p))]
        if not chunks or not cells:
            return
        wanted = np.sort(np.concatenate([np.uint64(b << cell_bits) | np.frombuffer(p, "<u4").astype(np.uint64) for b, p in cells]))
        phrases = _candidates(chunks, wanted, longest, shift)
        texts = [" " + c.text.replace(b"\n", b" \n ").decode("utf-8") for c in chunks]
        del chunks, wanted
        for phrase, n in zip(phrases, _occurrences(texts, phrases, group).tolist(), strict=True):
            held[phrase] = held.get(phrase, 0) + n

    def told(lang: str, held: dict[str, int]) -> Iterator[pa.RecordBatch]:
        phrases, counts = list(held), np.fromiter(held.values(), np.int64)
        held.clear()
        for at in range(0, len(phrases), 50_000):
            part = phrases[at : at + 50_000]
            size = np.array([p.count(" ") + 1 for p in part], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(size), pa.array(counts[at : at + 50_000])], names=["lang", "phrase", "words", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lang, cells, payloads = None, "", [], []
        held: dict[str, int] = {}
        for batch in batches:
            for own, kind, bucket, name, payload in zip(*(batch.column(c).to_pylist() for c in ("lot", "kind", "bucket", "lang", "payload")), strict=True):
                if own != now:
                    lot(lang, cells, payloads, held)
                    if name != lang or len(held) >= HELD_PHRASES:
                        yield from told(lang, held)
                    now, lang, cells, payloads = own, name, [], []
                if kind:
                    payloads.append(payload)
                else:
                    cells.append((bucket, payload))
        lot(lang, cells, payloads, held)
        yield from told(lang, held)
        pa.default_memory_pool().release_unused()

    return run


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all runs of up to ``longest`` words found ``least`` times or more, and (lang, n) of all words; both written."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    lots = materialise(rows.mapInArrow(_lots(LOT_BYTES), "lot long, lang string, n long, size long, payload binary"))
    totals = materialise(lots.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).withColumn("groups", F.expr(f"size div {TASK_BYTES} + 1")))
    words, many = totals.agg(F.sum("n"), F.sum("groups")).first()
    bits = min(max((CELLS_PER_WORD * max(words or 0, 1)).bit_length() - CELL_BITS, 4), 20)
    tasks = lambda need: max(int(spark.conf.get("spark.sql.shuffle.partitions")), need + 1)
    cells = lots.select("lot", "lang", "payload").mapInArrow(_cells(least, longest, bits, CELL_BITS, LOT_BYTES), "lot long, lang string, bucket int, payload binary")
    summed = cells.repartition(tasks(3 * longest * (words or 0) // SUM_BYTES), "bucket").sortWithinPartitions("bucket")
    back = summed.mapInArrow(_sums(least), "lot long, lang string, kind int, bucket int, payload binary")
    chunks = lots.select("lot", "lang", F.lit(1).alias("kind"), F.lit(0).alias("bucket"), "payload")
    met = back.unionByName(chunks).join(totals.select("lang", "groups"), "lang").withColumn("group", F.pmod(F.xxhash64("lot"), F.col("groups")))
    met = met.repartition(tasks(2 * (many or 0)), "lang", "group").sortWithinPartitions("lang", "group", "lot", "kind")
    found = met.select("lot", "lang", "kind", "bucket", "payload").mapInArrow(_count(longest, bits, CELL_BITS, GROUP_KEYS), "lang string, phrase string, words int, a long")
    counts = found.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("a").alias("a")).where(F.col("a") >= least)
    return materialise(counts), totals.select("lang", "n")


def _part(words: str, start: object, length: object):
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame, longest: int = 4, scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words and more, by their lowest-scoring cut."""
    phrases = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("k").alias("size"), _part("w", F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), (F.col("words") - F.col("k")).alias("size"), _part("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))
    parts = cuts.select("lang", "phrase", "words", "a", "k", F.inline(sides)).withColumn("salt", F.when(F.col("size") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    held = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"), F.explode(salts).alias("salt"))
    met = parts.join(held, ["lang", "part", "salt"])
    wide = lambda c: c.cast("decimal(20,0)")
    cuts_of = range(1, longest)
    found = met.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), *[F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{name}{k}") for k in cuts_of for s, name in enumerate("lr")])
    both = found.withColumns({f"under{k}": wide(F.col(f"l{k}")) + wide(F.col(f"r{k}")) for k in cuts_of}).withColumn("over", F.lit(scale).cast("decimal(10,0)") * wide(F.col("a")))
    # a cut that a phrase is too short for has no score
    cuts = F.array_compact(F.array(*[F.when(F.col(f"under{k}").isNotNull(), F.struct(F.expr(f"over div under{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts_of]))
    return both.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def covered(counts: DataFrame, longest: int = 4) -> DataFrame:
    """(lang, phrase, longer): the greatest count of a longer phrase that holds the phrase."""
    phrases = counts.where("words > 2").withColumn("w", F.split("phrase", " "))
    sizes = phrases.select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = sizes.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    return inner.select("lang", "a", _part("w", F.col("at"), F.col("size")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language, with ``rank``; levels of salted groups keep every task small."""
    order = "score desc, a desc, phrase"
    groups = rows.count() // RANKED + 1
    while True:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(groups))
        rows = rows.withColumn("_salt", salt).withColumn("rank", F.expr(f"row_number() over (partition by lang, _salt order by {order})")).where(F.col("rank") <= top).drop("_salt")
        if groups == 1:
            return rows
        groups = groups * top // RANKED + 1


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    counts, totals = phrase_counts(docs, least, longest)
    rows = scored(counts, longest).join(covered(counts, longest), ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = materialise(rows.where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * share)))
    return _first(kept, top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
