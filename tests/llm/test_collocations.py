"""Collocations against plain counting, with awkward rows."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split("[.,;:!?\x0a-\x0d]", low) if (w := re.findall("[^\x20\x09]+", p))]


def plain(docs, least, longest, top, share):
    f, n = defaultdict(Counter), Counter()
    for _, lang, text in docs:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        counts = {p: a for p, a in counts.items() if a >= least}
        longer = Counter()
        for p, a in counts.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows = []
        for p, a in counts.items():
            if len(p) > 1 and not 100 * longer[p] >= share * a:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        rows.sort()
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(rows[:top], 1)]
    return sorted(out)


def random_docs(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "a", "É", "é", "b2", "x\x00y", "漢", "of"]
    say = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " ; "]) for _ in range(rng.randrange(40)))
    docs = [(i, rng.choice(["en", "de", None, ""]), say()) for i in range(40)]
    return docs + [(i, "en", "of the of the of the of the") for i in range(5)] + [(1, "en", None), (2, None, ""), (3, "en", ". , \n"), docs[0], docs[0]]


@pytest.mark.parametrize("seed", range(3))
def test_collocations_match_plain(spark, seed):
    docs = random_docs(seed)
    got = C.collocations(spark.createDataFrame(docs, SCHEMA), least=3, longest=4, top=25, share=80)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 3, 4, 25, 80)


def test_small_lots_groups_and_levels(spark, monkeypatch):
    docs = random_docs(7)
    for name, value in {"LOT_BYTES": 300, "GROUP_KEYS": 11, "RANKED": 20, "SUM_BYTES": 500, "TASK_BYTES": 700}.items():
        monkeypatch.setattr(C, name, value)
    got = C.collocations(spark.createDataFrame(docs, SCHEMA).repartition(3), least=4, longest=3, top=6, share=60)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 4, 3, 6, 60)


def test_counts_beyond_candidates_are_exact(spark, monkeypatch):
    """A sketch of few cells lets everything pass; the result stays the same."""
    monkeypatch.setattr(C, "CELL_BITS", 4)
    monkeypatch.setattr(C, "CELLS_PER_WORD", 0)
    docs = random_docs(11)
    got = C.collocations(spark.createDataFrame(docs, SCHEMA), least=3, longest=4, top=50, share=80)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 3, 4, 50, 80)


def test_thresholds_beyond_a_byte(spark):
    docs = [(i, "en", "p q r " * (i % 9) + "x") for i in range(120)]
    for least in (300, 479, 480, 481):
        got = C.collocations(spark.createDataFrame(docs, SCHEMA).repartition(5), least=least, longest=3, top=9, share=101)
        assert sorted(tuple(r) for r in got.collect()) == plain(docs, least, 3, 9, 101)


def test_normalised_text():
    text, n = C.normalise(pa.array(["A  b\tC. d", None, "", "...", "e\x0bf g"]))
    assert (text, n) == (b"a b c\nd\ne\nf g\n", 7)


def test_scores_are_exact_beyond_64_bits(spark):
    big = (1 << 62) - 1
    counts = spark.createDataFrame([("en", "a", 1, (1 << 63) - 1), ("en", "b", 1, (1 << 63) - 3), ("en", "a b", 2, big)], "lang string, phrase string, words int, a long")
    assert C.scored(counts).first().score == 2_000_000 * big // ((1 << 64) - 4)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "en", "a b a b a b")], SCHEMA).withColumns({c: F.lit("z") for c in ("phrase", "lot", "payload", "w", "n")})
    assert C.collocations(docs.limit(0), 2).count() == 0
    assert [(r.phrase, r.a) for r in C.collocations(docs, 2, 2).orderBy("rank").collect()] == [("a b", 3), ("b a", 2)]
    assert C.collocations(docs, 30).count() == 0
