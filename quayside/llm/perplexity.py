"""Quality rules with an n-gram perplexity verdict.

Spark counts every character n-gram of all texts per language, over all code points.
Modified Kneser-Ney smoothing is joins and sums over these counts, with the
discounts of each language.

Texts fall into two folds by a hash of the text, and each is scored by the model
that counted the other fold of its language: its own n-grams, and those of its
exact copies, don't vouch for it.  The n-grams to be scored are those counted, so
a join gives each the probability that the other fold's model has for it, back-off
included, and these stand under 64-bit hashes.

Neither the model nor the texts pass through one place.  Texts are dealt to lots of
one language and fold and of bounded size; the distinct n-grams of a lot fetch
their probabilities by a shuffled join, and each lot is scored with the sorted hash
array of its own n-grams.

Each language then gets a lower and an upper bound of perplexity around the shortest
interval that holds half of its distinct texts, which up to half of junk can't carry
away.  A text outside its language's band may be prose of two languages, or hold a
passage in another: the same counts of all languages together are a second model, with
bands for each language of their own, and a text goes only if it lies outside both.

Rows: a null or empty text has no words and fails the base rules; a null language is
the language ``und``; repeated rows count as often as they stand there; a very long
text is one row of its lot, about 60 times its bytes in memory; columns that the
operator doesn't name are not read, whatever they are called; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import materialise

#: The symbols of an n-gram, oldest first; an n-gram of order n has the last n of them.
SYMBOLS = ("a", "b", "c", "d")
ORDER = len(SYMBOLS)
#: Code points there are: what no count has seen is spread over all of them.
ALPHABET = 0x110000
#: The model of all languages; those of single ones are 64-bit hashes of their names.
ALL = 0
#: Width of either side of a band in halves of the shortest half (0.67 sigma of a normal spread).  README has the rates on planted junk.
WIDTH = 12.0
#: Least half of a shortest half, in nats a character, where texts hardly differ.
LEAST_SPREAD = 0.01
#: Discount of each count where the counts show none: half of it.
LEAST_DISCOUNT = 0.5
#: Bytes of text in a lot.
LOT_BYTES = 8 << 20
#: Distinct n-grams that a task holds before it hands them on.
HELD_GRAMS = 2_000_000

_SYMBOL_BYTES = np.zeros(256, bool)
_SYMBOL_BYTES[list(b"#*$%&|<>")] = True
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, ORDER + 1)]


def _before(point: np.ndarray, at: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Of each character, the symbols ``order - 1``, ... 1 and 0 places before it; 0 stands for what is before a text."""
    place = np.arange(len(point)) - np.repeat(at[:-1], np.diff(at))
    return [np.where(place >= j, np.concatenate([np.zeros(min(j, len(point)), point.dtype), point[: len(point) - j]]), 0) for j in range(order - 1, -1, -1)]


def gram_keys(seed: np.ndarray, symbols: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams under their model's seed."""
    total = seed.astype(np.uint64)
    for factor, symbol in zip(_FACTORS, symbols, strict=True):
        total = total + K.mix(symbol + np.uint64(1)) * factor
    return K.mix(total)


def _seed(model: np.ndarray, fold: np.ndarray) -> np.ndarray:
    return K.mix(model.astype(np.int64).view(np.uint64) * np.uint64(2) + fold.astype(np.uint64))


def _distinct(point: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The distinct n-grams of a slice by ``kind`` (a small number of each row): kind, symbols and count of each."""
    seen = np.zeros(ALPHABET, bool)
    seen[point] = True
    alphabet = np.r_[np.uint32(0), np.flatnonzero(seen).astype(np.uint32)]
    bits = int(len(alphabet) - 1).bit_length()
    number = np.zeros(ALPHABET, np.uint32)
    number[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    symbols = _before(number[point], at)
    of = np.repeat(kind, np.diff(at))
    if ORDER * bits + int(kind.max(initial=0)).bit_length() <= 64:
        packed = of.astype(np.uint64)
        for x in symbols:
            packed = packed << np.uint64(bits) | x.astype(np.uint64)
        packed.sort()
        cut = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
        count, packed = np.diff(np.r_[cut, len(packed)]), packed[cut]
        mask = np.uint64((1 << bits) - 1)
        symbols = [packed >> np.uint64(bits * (ORDER - 1 - i)) & mask for i in range(ORDER)]
        of = packed >> np.uint64(bits * ORDER)
    else:  # more symbols than fit a word
        rows, count = np.unique(np.stack([of, *symbols], 1), axis=0, return_counts=True)
        of, symbols = rows[:, 0], list(rows[:, 1:].T)
    return of.astype(np.int64), [alphabet[x] for x in symbols], count


def _kinds(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A small number for each pair of model and fold in a batch: of each row, and the pairs."""
    model, fold = part.column("model").to_numpy(), part.column("fold").to_numpy()
    pairs, kind = np.unique(np.stack([model, fold.astype(np.int64)], 1), axis=0, return_inverse=True)
    return kind.reshape(-1), pairs[:, 0], pairs[:, 1]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one task: a row per language, fold and n-gram."""
    held: list[tuple] = []

    def merged() -> None:
        key, model, fold, n, *symbols = (np.concatenate(x) for x in zip(*held, strict=True))
        key, first, of = np.unique(key, return_index=True, return_inverse=True)
        held[:] = [(key, model[first], fold[first], np.bincount(of, n).astype(np.int64), *(x[first] for x in symbols))]

    def rows() -> Iterator[pa.RecordBatch]:
        merged()
        _, model, fold, n, *symbols = held.pop()
        for i in range(0, len(n), 50_000):
            j = slice(i, i + 50_000)
            columns = [pa.array(model[j]), pa.array(fold[j].astype(np.int32)), *(pa.array(x[j].astype(np.int32)) for x in symbols), pa.array(n[j])]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "fold", *SYMBOLS, "n"])

    for part in K.slices(batches):
        point, at = K.code_points(*K.text_bytes(part.column("text")))
        if not len(point):
            continue
        kind, model, fold = _kinds(part)
        of, symbols, n = _distinct(point, at, kind)
        held.append((gram_keys(_seed(model[of], fold[of]), symbols), model[of], fold[of], n, *symbols))
        if len(held) > 8:
            merged()
            if len(held[0][0]) > HELD_GRAMS:
                yield from rows()
    if held:
        yield from rows()


def count_grams(texts: DataFrame) -> DataFrame:
    """(model, fold, a, b, c, d, n) over all rows of (text, model, fold)."""
    kinds = ", ".join(f"{x} int" for x in SYMBOLS)
    counted = texts.select("text", "model", "fold").mapInArrow(_count_grams, f"model long, fold int, {kinds}, n long")
    return counted.groupBy("model", "fold", *SYMBOLS).agg(F.sum("n").alias("n"))


def levels(counts: DataFrame) -> list[DataFrame]:
    """The Kneser-Ney counts of each order from 1 on: below the highest, how many symbols an n-gram was seen after."""
    out = [counts]
    for n in range(ORDER - 1, 0, -1):
        out.insert(0, materialise(out[0].groupBy("model", "fold", *SYMBOLS[ORDER - n :]).agg(F.count("*").alias("n"))))
    return out


def discounts(counted: list[DataFrame], least: float) -> DataFrame:
    """(order, model, fold, d1, d2, d3): the modified Kneser-Ney discounts of counts one, two and more, from the numbers of counts one to four; ``least`` of a count where they show none.

    Written: a row for each order, model and fold, whose measured size lets Spark leave the n-grams where they are when it joins them.
    """
    c = {k: F.col(f"c{k}") for k in (1, 2, 3, 4)}
    y = F.coalesce(F.try_divide(c[1], c[1] + 2 * c[2]), F.lit(0.0))
    found = {k: F.least(F.lit(float(k)), k - (k + 1) * y * F.try_divide(c[k + 1], c[k])) for k in (1, 2, 3)}
    found = {k: F.when(c[k] > 0, x) for k, x in found.items()}
    few = [level.where("n <= 4").select(F.lit(i).alias("order"), "model", "fold", "n") for i, level in enumerate(counted, 1)]
    numbers = reduce(DataFrame.unionByName, few).groupBy("order", "model", "fold").agg(*[F.count_if(F.col("n") == k).alias(f"c{k}") for k in (1, 2, 3, 4)])
    return materialise(numbers.select("order", "model", "fold", *[F.when(found[k] > 0, found[k]).otherwise(least * k).alias(f"d{k}") for k in (1, 2, 3)]))


def probabilities(scored: list[DataFrame], counted: list[DataFrame], least: float = LEAST_DISCOUNT) -> DataFrame:
    """(model, fold, a, b, c, d, p): of each n-gram of ``scored`` its interpolated probability by the counts ``counted`` of the same model and fold.

    Both are levels, lowest first.  A discount of zero would leave nothing for unseen n-grams.
    Each order is a plan of its own over written tables, which keeps the plans, and what the
    driver holds to revise them, small.
    """
    below, cuts = None, discounts(counted, least)
    cut = F.coalesce(F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")), F.least("n", F.lit(3)) * least)
    for n, (own, level) in enumerate(zip(scored, counted, strict=True), 1):
        names = list(SYMBOLS[ORDER - n :])
        level = level.join(cuts.where(F.col("order") == n).drop("order"), ["model", "fold"], "left").withColumn("cut", cut)
        context = level.groupBy("model", "fold", *names[:-1]).agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("gamma"))
        p = own.select("model", "fold", *names).join(level.select("model", "fold", *names, (F.col("n") - F.col("cut")).alias("left")), ["model", "fold", *names], "left")
        p = p.join(context, ["model", "fold", *names[:-1]], "left")
        p = p.withColumn("lower", F.lit(1.0 / ALPHABET)) if below is None else p.join(below.withColumnRenamed("p", "lower"), ["model", "fold", *names[1:]])
        below = p.select("model", "fold", *names, (F.coalesce(F.col("left") / F.col("total"), F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("lower")).alias("p"))
        if n < ORDER:
            below = materialise(below)
    return below


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key = gram_keys(_seed(b.column("model").to_numpy(), b.column("fold").to_numpy()), [b.column(x).to_numpy().astype(np.uint32) for x in SYMBOLS])
        logs = [pa.array(np.log(b.column(c).to_numpy()).astype(np.float32)) for c in ("p", "p_all")]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *logs], names=["key", "logp", "logp_all"])


def cross_scores(counts: DataFrame) -> DataFrame:
    """(key, logp, logp_all) of each counted n-gram, by the other fold's model of its language and by that of all languages.

    The model of all languages is one model more in the same chain of joins.
    """
    together = counts.groupBy(F.lit(ALL).cast("long").alias("model"), "fold", *SYMBOLS).agg(F.sum("n").alias("n"))
    own = levels(counts.unionByName(materialise(together)))
    p = materialise(probabilities(own, [x.withColumn("fold", 1 - F.col("fold")) for x in own]))
    of_all = p.where(F.col("model") == ALL).select("fold", *SYMBOLS, F.col("p").alias("p_all"))
    return p.where(F.col("model") != ALL).join(of_all, ["fold", *SYMBOLS]).mapInArrow(_keyed, "key long, logp float, logp_all float")


class SortedHashes:
    """A sorted array of 64-bit hashes; a table of the first place of each leading part finds one in a step or two."""

    def __init__(self, hashes: np.ndarray):
        self.shift = np.uint64(64 - max(8, int(len(hashes)).bit_length()))
        self.keys = np.r_[hashes, hashes[-1:] ^ np.uint64(1)] if len(hashes) else np.zeros(1, np.uint64)
        self.first = np.searchsorted(hashes >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        part = (h >> self.shift).astype(np.int64)
        at, end = self.first[part], self.first[part + 1]
        out = np.where((self.keys[at] == h) & (at < end), at, -1)
        todo = np.flatnonzero((out < 0) & (at + 1 < end))
        step = 1
        while len(todo):
            place = at[todo] + step
            hit = self.keys[place] == h[todo]
            out[todo[hit]] = place[hit]
            todo = todo[~hit & (place + 1 < end[todo])]
            step += 1
        return out


def base_rules(column: pa.Array, w: K.Words | None = None) -> dict[str, np.ndarray]:
    """Counts of each row: words, characters in words, symbols, repeated lines, words in repeated 3-word windows.

    ``w``: the column's words, where they are known.
    """
    data, off = K.text_bytes(column)
    w = K.words(data, off) if w is None else w
    total, rows = np.diff(w.first), len(column)

    def repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        key = K.mix(h + K.mix(doc.astype(np.uint64)))
        return key

    inside = ~K.SEPARATOR[data]
    out = {"n_words": total, "word_chars": K.per_row(inside & ((data & 0xC0) != 0x80), off), "n_symbols": K.per_row(_SYMBOL_BYTES[data], off)}
    # lines: cut at \n and at the rows' ends
    n_dup = np.zeros(rows, np.int64)
    if len(data):
        start = np.unique(np.r_[off[:-1][np.diff(off) > 0], np.flatnonzero(data == 10) + 1])
        start = start[start < len(data)]
        size = np.diff(np.r_[start, len(data)])
        total_to = np.r_[np.uint64(0), np.cumsum(K._BYTE[data] * K.powers(len(data))[: len(data)])]
        end = start + size - (data[start + size - 1] == 10)
        has_word = np.diff(np.searchsorted(w.start, np.r_[start, len(data)])) > 0
        line = ((total_to[end] - total_to[start]) * K.powers(len(data), K._INVERSE)[start])[has_word]
        doc = np.searchsorted(off, start[has_word], "right") - 1
        key = np.sort(repeated(doc, line))
        order = np.argsort(repeated(doc, line), kind="stable")
        same = np.r_[False, key[1:] == key[:-1]]
        np.add.at(n_dup, doc[order[same]], 1)
    out["n_dup_lines"] = n_dup
    at, h = K.run_hashes(w, 3)
    covered = np.zeros(len(w.start), bool)
    if len(at):
        key = repeated(np.repeat(np.arange(rows), np.maximum(total - 2, 0)), h)
        s = np.sort(key)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            covered = K.spans_to_mask(len(w.start), at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key], 3)
    out["n_repeat_words"] = K.per_row(covered, w.first)
    return out


def count_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """(doc_id, counts..., base_failed): the base rules alone."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            rules = base_rules(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(rules[c]) for c in _RULES)], names=["doc_id", *_RULES])

    kind = docs.schema[doc_id].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _RULES))
    return counted.withColumn("base_failed", _failed(min_words, repeat_percent))


def _failed(min_words: int, repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


_RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_KEPT = ("doc_id", "lang", "row", "content")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd bytes with their length, for the way to their lots; a row that repeats one of its task stays behind."""
    codec = pa.Codec("zstd", 1)
    seen: set[int] = set()
    for part in K.slices(batches):
        fresh = [not (r in seen or seen.add(r)) for r in part.column("row").to_pylist()]
        part = part.filter(pa.array(fresh))
        data, off = K.text_bytes(part.column("text"))
        raw = data.tobytes()
        zipped = [codec.compress(raw[a:b], asbytes=True) for a, b in zip(off[:-1], off[1:], strict=True)]
        names = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(zipped, pa.binary()), pa.array(np.diff(off))], names=[*names, "zipped", "size"])


def _texts(lot: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of a lot with their texts, in slices."""
    codec = pa.Codec("zstd", 1)
    lot = lot.combine_chunks()
    size = lot["size"].to_numpy()
    at = 0
    while at < lot.num_rows:
        end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), K.SLICE_BYTES, "right")))
        texts = [codec.decompress(x.as_buffer(), int(n), asbytes=True) for x, n in zip(lot["zipped"].slice(at, end - at), size[at:end], strict=True)]
        text = pa.array(texts, pa.binary()).cast(pa.string())
        part = lot.slice(at, end - at).drop_columns(["zipped"]).append_column("text", text).combine_chunks()
        yield part.to_batches()[0]
        at = end


def _grams_of_lot(lot: pa.Table) -> pa.Table:
    """(lot, key) of the distinct n-grams of a lot."""
    held: list[np.ndarray] = []
    for part in _texts(lot):
        point, at = K.code_points(*K.text_bytes(part.column("text")))
        if len(point):
            kind, model, fold = _kinds(part)
            of, symbols, _ = _distinct(point, at, kind)
            held.append(gram_keys(_seed(model[of], fold[of]), symbols))
    key = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
    return pa.table({"lot": pa.array(np.full(len(key), lot["lot"][0].as_py(), np.int64)), "key": pa.array(key.view(np.int64))})


def _score_lot(lot: pa.Table, scores: pa.Table) -> pa.Table:
    """Rule counts and nats a character of each row of a lot, with the sorted hash array of the lot's n-grams."""
    # a row that several tasks sent is scored once
    lot = lot.take(pa.array(np.sort(np.unique(lot["row"].to_numpy(), return_index=True)[1])))
    key = scores["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    known = SortedHashes(key[order])
    models = [np.r_[scores[c].to_numpy()[order], np.float32(0)] for c in ("logp", "logp_all")]
    out = []
    for part in _texts(lot):
        rules = base_rules(part.column("text"))
        point, at = K.code_points(*K.text_bytes(part.column("text")))
        seed = np.repeat(_seed(part.column("model").to_numpy(), part.column("fold").to_numpy()), np.diff(at))
        place = known.find(gram_keys(seed, _before(point, at)))
        nats = [pa.array(-np.diff(np.r_[0.0, np.cumsum(logp[place], dtype=np.float64)][at]) / np.maximum(np.diff(at), 1)) for logp in models]
        out.append(pa.RecordBatch.from_arrays([*(part.column(c) for c in _KEPT), *(pa.array(rules[c]) for c in _RULES), *nats], names=[*_KEPT, *_RULES, "nats", "nats_all"]))
    if not out:
        lot = lot.select(_KEPT).slice(0, 0)
        for c in _RULES:
            lot = lot.append_column(c, pa.array([], pa.int64()))
        return lot.append_column("nats", pa.array([], pa.float64())).append_column("nats_all", pa.array([], pa.float64()))
    return pa.Table.from_batches(out)


def _shortest_half(bins):
    """The band's centre and spread of one language, from its histogram."""
    bins = bins.sort_values("bin")
    at, upto = bins["bin"].to_numpy(), np.cumsum(bins["count"].to_numpy())
    before, half = np.r_[0, upto[:-1]], upto[-1] // 2 + 1
    end = np.searchsorted(upto, before + half)
    start = np.flatnonzero(end < len(at))
    size = at[end[start]] - at[start]
    best = start[size == size.min()]
    centre = np.mean([(at[i] + at[end[i]]) / 2000 for i in best])
    # few texts show less than their language's spread
    spread = max(size.min() / 2000, LEAST_SPREAD) * (1 + 5 / max(1, upto[-1] - 1))
    return bins.head(1)[["lang"]].assign(centre=centre, spread=spread)


def bands(scored: DataFrame, width: float = WIDTH, nats: str = "nats") -> DataFrame:
    """(lang, low, high): bounds of nats a character, from a histogram of all distinct texts that passed the base rules."""
    texts = scored.where("not base_failed").groupBy("lang", "content").agg(F.min(F.round(F.col(nats) * 1000).cast("long")).alias("bin"))
    found = texts.groupBy("lang", "bin").count().groupBy("lang").applyInPandas(_shortest_half, "lang string, centre double, spread double")
    return found.select("lang", (F.col("centre") - width * F.col("spread")).alias("low"), (F.col("centre") + width * F.col("spread")).alias("high"))


def in_lots(rows: DataFrame, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """Rows of (text, model, fold, row, ...) with their texts packed and ``lot``: rows of one model and fold, about ``lot_bytes`` of text."""
    sizes = rows.groupBy("model", "fold").agg((F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / lot_bytes + 1).cast("long").alias("parts"))
    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes if c != "text")
    packed = rows.mapInArrow(_packed, f"{kinds}, zipped binary, size long")
    return packed.join(materialise(sizes), ["model", "fold"]).withColumn("lot", F.xxhash64("model", "fold", F.pmod("row", "parts"))).drop("parts")


def row_key(doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Column:
    """A hash that rows share only if they are judged alike."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.coalesce(F.col(lang), F.lit("und")))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """``verdicts`` for each row of ``docs``: rows that repeat each other have the same."""
    found = verdicts(docs, doc_id, text, lang, **how).drop("doc_id")
    return docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text, lang).alias("row")).join(found, "row")


def verdicts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    min_words: int = 50,
    repeat_percent: int = 50,
    width: float = WIDTH,
    lot_bytes: int = LOT_BYTES,
) -> DataFrame:
    """Rule counts, perplexity and verdict of each distinct (doc_id, text, lang): the columns of op4's contract and ``perplexity``, ``row``.

    ``row`` is their ``row_key``.  However often a row is repeated, it is packed once a
    task and scored once, so no lot fills with its copies.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    fold: Column = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    rows = rows.select("*", row_key().alias("row"), F.xxhash64("text").alias("content"), F.xxhash64("lang").alias("model"), fold.alias("fold"))
    scores = materialise(cross_scores(materialise(count_grams(rows))))
    lots = in_lots(rows, lot_bytes)
    fetched = lots.groupBy("lot").applyInArrow(_grams_of_lot, "lot long, key long").join(scores, "key").select("lot", "key", "logp", "logp_all")
    kind = docs.schema[doc_id].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _RULES)
    scored = lots.groupBy("lot").cogroup(fetched.groupBy("lot")).applyInArrow(_score_lot, f"doc_id {kind}, lang string, row long, content long, {counts}, nats double, nats_all double")
    scored = materialise(scored.withColumn("base_failed", _failed(min_words, repeat_percent)))
    # one row per language, written: Spark sees its size and broadcasts it only where that is small
    of_all = bands(scored, width, "nats_all").withColumnsRenamed({"low": "low_all", "high": "high_all"})
    out = scored.join(materialise(bands(scored, width).join(of_all, "lang")), "lang", "left")
    kept = ~F.col("base_failed") & (F.col("nats").between(F.col("low"), F.col("high")) | F.col("nats_all").between(F.col("low_all"), F.col("high_all")))
    return out.select("doc_id", *_RULES, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), F.exp("nats").alias("perplexity"), "row")
