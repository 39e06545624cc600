"""Quality classifier from weak labels.

Heuristic labellers each vote good, bad or nothing on every document, good where
their statistic is as low as in ordinary prose, bad where it is as high as a defect
makes it.  The votes of a document are one pattern; there are at most
``3 ** labellers`` patterns, so their counts over all documents are a small table.
Expectation-maximisation on that table estimates the share of good documents, how
often each labeller is right on good and on bad documents, and each pattern's
posterior; a weak prior of ``PRIOR_VOTES`` votes only keeps rates off 0 and 1.  The
posteriors of a bounded sample of documents train a hashed linear scorer on byte
trigrams and binned statistics, which scores all.

Rows: a null or empty text gets the votes of an empty text; repeated rows count
as often as they stand there, but train once; a very long text is one row of a task,
about 60 times its bytes in memory; other columns are carried along, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .perplexity import base_rules

#: Documents that train the scorer, at most about this many: half dealt evenly over the
#: vote patterns, half by their counts, and weighed so that each pattern counts as it stands in the data.
TRAIN_ROWS = 4000
BITS = 16
_MASK = np.uint32((1 << BITS) - 1)
_BINS = 12

#: Per labeller: the statistic, votes bad at or above, votes good at or below.  The lower
#: bounds are what prose stays under (its largest percent may lie above, where there is no
#: vote); the upper ones stand where a defect fills a third to a half of a text.
LABELLERS = (
    ("symbols", 0.30, 0.02),
    ("upper", 0.50, 0.15),
    ("shouts", 0.20, 0.02),
    ("repeats", 0.40, 0.10),
    ("copies", 0.50, 0.15),
    ("bars", 0.20, 0.02),
    ("unended", 0.998, 0.96),
    ("dup_lines", 0.50, 0.10),
    ("odd", 0.30, 0.02),
)
#: The label model's start and, with the weight of PRIOR_VOTES votes, its prior: how often a
#: labeller sees a bad document (it may know one defect of many) and how often a good one.
START_BAD, START_GOOD = 0.4, 0.9
PRIOR_VOTES = 10.0
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *range(0x09, 0x0E), *b" .,;:'?()\"-"]] = True


def statistics(column: pa.Array) -> np.ndarray:
    """One row per document, one column per labeller; each is a share, mostly of the words."""
    data, off = K.text_bytes(column)
    w = K.words(data, off)
    rules = base_rules(column, w)

    def count(byte: bytes) -> np.ndarray:
        return K.per_row(data == ord(byte), off)

    words = np.maximum(rules["n_words"], 1)
    upper = K.per_row(data - np.uint8(65) < 26, off)
    letters = upper + K.per_row(data - np.uint8(97) < 26, off)
    # distinct words of each row: sort by (row, hash)
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    distinct = np.bincount(d[new], minlength=len(column)) if len(h) else np.zeros(len(column), np.int64)
    lines = np.maximum(count(b"\n") + 1, 1)
    long_enough = rules["n_words"] >= 20
    return np.stack(
        [
            rules["n_symbols"] / words / 3,
            upper / np.maximum(letters, 1),
            count(b"!") / words / 2,
            np.where(rules["n_words"] >= 40, rules["n_repeat_words"] / words, 0.0),
            np.where(rules["n_words"] >= 50, 1 - distinct / words, 0.0) ** 2,
            count(b"|") / words,
            np.where(long_enough, 1 - count(b".") / words, 0.96),
            np.where(lines >= 6, rules["n_dup_lines"] / lines, 0.0),
            K.per_row(~_PLAIN[data], off) / words,
        ],
        1,
    )


def votes(stats: np.ndarray) -> np.ndarray:
    """0 bad, 1 good, 2 no vote, for each document and labeller."""
    _, bad, good = zip(*LABELLERS, strict=True)
    return np.where(stats >= np.array(bad), 0, np.where(stats <= np.array(good), 1, 2))


def _pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


class LabelModel(NamedTuple):
    """Posterior of good for each pattern; rates at which each labeller is right on bad and on good documents where it votes; share of good documents."""

    posterior: np.ndarray
    right_on_bad: np.ndarray
    right_on_good: np.ndarray
    share: float

    @property
    def accuracy(self) -> np.ndarray:
        return self.share * self.right_on_good + (1 - self.share) * self.right_on_bad


def fit_labellers(pattern: np.ndarray, count: np.ndarray, rounds: int = 500, prior_votes: float = PRIOR_VOTES) -> LabelModel:
    """Expectation-maximisation over vote patterns.

    Labellers are independent given the class; one that does not vote says nothing.
    One that is wrong on most of its votes counts for the other class.
    """
    n = len(LABELLERS)
    v = pattern[:, None] // 3 ** np.arange(n) % 3
    bad, good, voted = v == 0, v == 1, v != 2
    on_bad, on_good, share = np.full(n, START_BAD), np.full(n, START_GOOD), 0.5
    for _ in range(rounds):
        for_good = np.log(share) + good @ np.log(on_good) + bad @ np.log(1 - on_good)
        for_bad = np.log(1 - share) + bad @ np.log(on_bad) + good @ np.log(1 - on_bad)
        post = 1 / (1 + np.exp(np.clip(for_bad - for_good, -50, 50)))
        of_bad, of_good = (1 - post) * count, post * count
        was = np.r_[on_bad, on_good, share]
        on_bad = (of_bad @ bad + prior_votes * START_BAD) / (of_bad @ voted + prior_votes)
        on_good = (of_good @ good + prior_votes * START_GOOD) / (of_good @ voted + prior_votes)
        share = (of_good.sum() + 1) / (count.sum() + 2)
        if np.abs(np.r_[on_bad, on_good, share] - was).max() < 1e-9:
            break
    return LabelModel(post, on_bad, on_good, float(share))


def _hashed(data: np.ndarray) -> np.ndarray:
    """The slot of the byte trigram that starts at each byte but the last two."""
    b = data.astype(np.uint32)
    return ((b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(2654435761) >> np.uint32(12)) & _MASK


def _bins(stats: np.ndarray) -> np.ndarray:
    """The slots of the binned statistics, which are features like the others."""
    level = np.minimum((np.clip(stats, 0, 1) * _BINS).astype(np.int64), _BINS - 1)
    return (K.mix((np.arange(stats.shape[1]) * 64 + level + 1).astype(np.uint64)) & np.uint64(_MASK)).astype(np.int64)


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches):
        p, n = np.unique(_pattern(votes(statistics(part.column("text")))), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pattern", "n"])


def _train_rows(shared):
    """The chosen rows with their features: a row is chosen if its hash lies under the rate of its pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates = shared.value
        for part in K.slices(batches):
            stats = statistics(part.column("text"))
            pattern, row = _pattern(votes(stats)), part.column("row").to_numpy()
            part_of = K.mix(row.view(np.uint64)) / 2.0**64
            take = np.flatnonzero(part_of < np.array([rates[p] for p in pattern.tolist()]))
            take = take[np.unique(row[take], return_index=True)[1]]
            if not len(take):
                continue
            data, off = K.text_bytes(part.column("text"))
            slots, values = [], []
            for i in take:
                h = _hashed(data[off[i] : off[i + 1]]) if off[i + 1] - off[i] > 2 else np.zeros(0, np.uint32)
                s, n = np.unique(h, return_counts=True)
                slots.append(np.r_[s, _bins(stats[i : i + 1])[0]].astype("<i4"))
                values.append(np.r_[n / max(len(h), 1) * 4, np.ones(stats.shape[1])].astype("<f4"))
            yield pa.RecordBatch.from_arrays([pa.array(row[take]), pa.array(pattern[take].astype(np.int64)), K.pack(slots), K.pack(values)], names=["row", "pattern", "slots", "values"])

    return run


def fit_scorer(slots: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, count: np.ndarray | None = None, epochs: int = 8, rate: float = 0.3, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by AdaGrad; a row weighs as ``count`` documents, and the classes the same in all."""
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    b, b2 = 0.0, 1e-6
    count = np.ones(len(target)) if count is None else count / count.mean()
    share = np.clip((target * count).mean(), 0.02, 0.98)
    weight = count * (target / (2 * share) + (1 - target) / (2 * (1 - share)))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(slots)):
            z = w[slots[i]] @ values[i] + b
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[i]) * weight[i]
            g = e * values[i] + ridge * w[slots[i]]
            g2[slots[i]] += g * g
            w[slots[i]] -= rate * g / np.sqrt(g2[slots[i]])
            b2 += e * e
            b -= rate * e / np.sqrt(b2)
    return w.astype(np.float32), float(b)


def _score(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, by_pattern, share = shared.value
        for part in K.slices(batches):
            data, off = K.text_bytes(part.column("text"))
            size = np.diff(off)
            stats = statistics(part.column("text"))
            total = np.r_[0.0, np.cumsum(w[_hashed(data)], dtype=np.float64)] if len(data) > 2 else np.zeros(1)
            # trigrams that start in a row's last two bytes belong to no row
            last = len(total) - 1
            gram = total[np.minimum(np.maximum(off[1:] - 2, off[:-1]), last)] - total[np.minimum(off[:-1], last)]
            z = 4 * gram / np.maximum(size - 2, 1) + w[_bins(stats)].sum(1) + b
            posterior = [by_pattern.get(p, share) for p in _pattern(votes(stats)).tolist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(posterior, pa.float64())], names=[*keep, "score", "posterior"])

    return run


def fit(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float, dict[int, float], float]:
    """The scorer's weights and bias, the posterior of good by vote pattern and the share of good documents, from (text, row)."""
    # at most 3 ** labellers rows
    counts = rows.select("text").mapInArrow(_vote_rows, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    if counts.empty:
        return np.zeros(1 << BITS, np.float32), 0.0, {}, 0.5
    pattern, n = counts["pattern"].to_numpy(), counts["n"].to_numpy()
    model = fit_labellers(pattern, n)
    by_pattern = dict(zip(pattern.tolist(), model.posterior.tolist(), strict=True))
    wanted = train_rows / 2 * (1 / len(n) + n / n.sum())
    rates = dict(zip(pattern.tolist(), np.minimum(1.0, wanted / n).tolist(), strict=True))
    shared = rows.sparkSession.sparkContext.broadcast(rates)
    chosen = rows.select("text", "row").mapInArrow(_train_rows(shared), "row long, pattern long, slots binary, values binary")
    sample = chosen.groupBy("row").agg(*[F.first(c).alias(c) for c in ("pattern", "slots", "values")]).toPandas().sort_values(["pattern", "row"])
    if sample.empty:
        return np.zeros(1 << BITS, np.float32), 0.0, by_pattern, model.share
    arrays = lambda c, kind: [np.frombuffer(x, kind) for x in sample[c]]
    stands_for = sample["pattern"].map(dict(zip(pattern.tolist(), n.tolist(), strict=True))) / sample.groupby("pattern")["row"].transform("size")
    weights = fit_scorer(arrays("slots", "<i4"), arrays("values", "<f4"), sample["pattern"].map(by_pattern).to_numpy(), stands_for.to_numpy())
    return *weights, by_pattern, model.share


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("row"))


def quality_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_above: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score, posterior, kept) of each row: the scorer's probability, the label model's, and the verdict."""
    rows = _rows(docs, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, train_rows))
    kind = docs.schema[doc_id].dataType.simpleString()
    scored = rows.mapInArrow(_score(shared, ["doc_id"]), f"doc_id {kind}, score double, posterior double")
    return scored.select("doc_id", "score", "posterior", (F.col("score") >= keep_above).alias("kept"))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_above: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns; scoring carries them along, so nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(_rows(docs, doc_id, text), train_rows))
    own = {f"c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for n, c in own.items()], F.col(text).alias("text"))
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in own.items())
    scored = rows.mapInArrow(_score(shared, list(own)), f"{kinds}, score double, posterior double")
    return scored.where(F.col("score") >= keep_above).select(*[F.col(n).alias(c) for n, c in own.items()])
