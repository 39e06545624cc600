"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (1 to 3).  Document
frequencies come from all learnable rows.  The weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample and
calibrated by one temperature on a held-back part of it.

Every language has at least one training text, so none is lost however many there are.
Training takes 16 bytes a slot and language on the driver; languages that would need more
than ``model_bytes`` are refused before anything is trained.  Tasks get the weights that the
penalties left, as sorted slots and values of each language.

Rows: a null or empty text or one without a letter is ``und`` with score 0; a null
language teaches nothing; repeated rows count as often as they stand there, but train
once; equal scores go to the language first by name; a very long text is one row of a
task, about 60 times its bytes in memory; columns that the operator doesn't name are not
read; an empty table gives an empty one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import materialise

#: Distinct texts that train the weights, about this many and at least one of every language.
TRAIN_ROWS = 6000
#: What training may take on the driver: some 1 MB a language.
MODEL_BYTES = 4 << 30
BITS = 16
ORDERS = (1, 2, 3)
SCALE = 12.0


def _lower(data: np.ndarray) -> np.ndarray:
    return K.LOWER[data]


def slots(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order the slot of the n-gram that ends at each character; the rows' offsets in characters."""
    point, at = K.code_points(_lower(data), off)
    place = np.arange(len(point)) - np.repeat(at[:-1], np.diff(at))
    gram, out = np.zeros(len(point), np.uint64), []
    for n in ORDERS:  # 21 bits a code point; 0 is what is before a text
        back = n - 1
        gram |= np.where(place >= back, np.concatenate([np.zeros(min(back, len(point)), np.uint64), point[: len(point) - back].astype(np.uint64)]), np.uint64(0)) << np.uint64(21 * back)
        out.append((K.mix(gram + np.uint64(n << 61)) & np.uint64((1 << BITS) - 1)).astype(np.int32))
    return out, at


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: how many of its documents hold each slot."""
    df, rows = np.zeros(1 << BITS, np.int64), 0
    for part in K.slices(batches):
        found, at = slots(*K.text_bytes(part.column("text")))
        rows += part.num_rows
        for i in range(0, part.num_rows, 64):
            j = min(i + 64, part.num_rows)
            seen = np.zeros((j - i, 1 << BITS), bool)
            of = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
            for h in found:
                seen[of, h[at[i] : at[j]]] = True
            df += seen.sum(0)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), K.pack([df.astype("<i8")])], names=["rows", "df"])


def _add_up(parts: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, "<i8") for x in parts["df"]], axis=0)
    return pd.DataFrame({"rows": [parts["rows"].sum()], "df": [total.astype("<i8").tobytes()]})


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches):
        found, at = slots(*K.text_bytes(part.column("text")))
        out_s, out_n = [], []
        for i in range(part.num_rows):
            s, n = np.unique(np.concatenate([h[at[i] : at[i + 1]] for h in found]), return_counts=True)
            out_s.append(s.astype("<i4"))
            out_n.append((n / max(at[i + 1] - at[i], 1)).astype("<f4"))
        yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("row"), K.pack(out_s), K.pack(out_n)], names=["lang", "row", "slots", "tf"])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, batch: int = 8) -> np.ndarray:
    """Follow-the-regularised-leader for softmax regression; row 2 ** BITS holds the biases."""
    n = np.zeros(((1 << BITS) + 1, classes))
    z = np.zeros_like(n)

    def weights(i: np.ndarray) -> np.ndarray:
        own = z[i]
        w = -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(own) <= l1, 0.0, w)

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = [rows[j] for j in order[k : k + batch]]
            touched = np.unique(np.concatenate([s for s, _, _ in part]))
            w, g = weights(touched), np.zeros((len(touched), classes))
            for s, x, y in part:
                at = np.searchsorted(touched, s)
                logit = x @ w[at]
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[y] -= 1
                g[at] += x[:, None] * p
            g /= len(part)
            sigma = (np.sqrt(n[touched] + g * g) - np.sqrt(n[touched])) / alpha
            z[touched] += g - sigma * w
            n[touched] += g * g
    return weights(np.arange((1 << BITS) + 1))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, on a geometric grid."""
    def loss(t: float) -> float:
        v = logits / t
        v = v - v.max(1, keepdims=True)
        return float((np.log(np.exp(v).sum(1)) - v[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.05, 20, 120), key=loss) if len(y) else 1.0


_letters: list[np.ndarray] = []


def _has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][off]
    return np.diff(np.r_[0, np.cumsum(_letters[0][point])][at]) > 0


class Model(NamedTuple):
    """Languages, the slots and values of each one's weights (idf and temperature folded in), and biases."""

    names: list[str]
    slots: list[np.ndarray]
    values: list[np.ndarray]
    bias: np.ndarray


class TooManyLanguages(ValueError):
    """The model would be larger than the driver was given for it."""


def _predict(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at_slot, value, bias = shared.value
        w = np.zeros(1 << BITS, np.float32)
        for part in K.slices(batches):
            data, off = K.text_bytes(part.column("text"))
            found, at = slots(data, off)
            size = np.maximum(np.diff(at), 1)[:, None]
            logit = np.zeros((part.num_rows, len(names)))
            for c in range(len(names)):
                w[at_slot[c]] = value[c]
                for h in found:
                    logit[:, c] += np.diff(np.r_[0.0, np.cumsum(w[h], dtype=np.float64)][at])
                w[at_slot[c]] = 0
            logit = logit / size + bias
            p = np.exp(logit - logit.max(1, keepdims=True)) if len(names) else np.ones((part.num_rows, 1))
            p /= p.sum(1, keepdims=True)
            sure = _has_letter(data, off) & (len(names) > 0)
            lang = np.array([*names, "und"], object)[np.where(sure, p.argmax(1), len(names))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(np.where(sure, p.max(1), 0.0))], names=[*keep, "lang_pred", "score"])

    return run


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, model_bytes: int = MODEL_BYTES) -> Model:
    """The model of (text, lang)."""
    spread = F.spark_partition_id() % 64
    df = labelled.select("text").mapInArrow(_document_frequencies, "rows long, df binary").withColumn("lot", spread).groupBy("lot").applyInPandas(_add_up, "rows long, df binary").toPandas()
    if df.empty:
        return Model([], [], [], np.zeros(0))
    total = _add_up(df)
    rows = int(total["rows"][0])
    idf = np.log((1 + rows) / (1 + np.frombuffer(total["df"][0], "<i8")))
    # half of the rows dealt evenly over the languages, half by their sizes; copies of a text count once
    row = F.xxhash64("lang", "text")
    place = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    # the first to be dealt is trained in any case
    sizes = materialise(labelled.select("lang", row.alias("row")).distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min_by("row", F.struct(place, "row")).alias("first")))
    many, total = sizes.agg(F.count("*"), F.sum("n")).first()
    if many * ((1 << BITS) + 1) * 16 > model_bytes:
        raise TooManyLanguages(f"{many} languages need {many * ((1 << BITS) + 1) * 16} bytes, the model may take {model_bytes}")
    rate = (train_rows / 2 * (1 / (F.col("n") * many) + 1 / F.lit(total)) * (1 << 30)).cast("long")
    sample = labelled.select("text", "lang", row.alias("row")).join(sizes.select("lang", "first", rate.alias("most")), "lang").where((place < F.col("most")) | (F.col("row") == F.col("first"))).select("text", "lang", "row").dropDuplicates(["row"])
    sample = sample.mapInArrow(_train_rows, "lang string, row long, slots binary, tf binary").toPandas().sort_values(["row", "slots"])
    names = sorted(sample["lang"].unique())
    index, data = {x: i for i, x in enumerate(names)}, []
    for lang, s, tf in zip(sample["lang"], sample["slots"], sample["tf"], strict=True):
        s, tf = np.frombuffer(s, "<i4"), np.frombuffer(tf, "<f4").astype(float)
        data.append((np.r_[s, 1 << BITS], np.r_[tf * idf[s] * SCALE, 1.0], index[lang]))
    # a fifth is held back for the temperature, but no language's first text
    seen, held, trained = set(), [], []
    for i, x in enumerate(data):
        (held if i % 5 == 4 and x[2] in seen else trained).append(x)
        seen.add(x[2])
    w = fit_ftrl(trained, len(names))
    logits = np.array([x @ w[s] for s, x, _ in held]) if held else np.zeros((0, len(names)))
    t = fit_temperature(logits, np.array([y for _, _, y in held], int))
    own, values = [], []
    for c in range(len(names)):
        own.append(np.flatnonzero(w[:-1, c]).astype(np.int32))
        values.append((w[own[-1], c] * (idf * SCALE)[own[-1]] / t).astype(np.float32))
    return Model(names, own, values, w[-1] / t)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, lang_pred and score of each row of (text, ...)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(_predict(shared, keep), f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out: Column | None = None, train_rows: int = TRAIN_ROWS, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from rows that are not ``held_out`` and have a language."""
    held = F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1 if held_out is None else held_out, F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held.alias("held_out"))
    model = fit(rows.where("not held_out and lang is not null and text is not null").select("text", "lang"), train_rows, model_bytes)
    return predict(rows, model, ["doc_id", "held_out"])
