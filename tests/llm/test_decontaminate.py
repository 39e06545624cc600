"""The suffix automaton and decontamination against plain searches, with awkward rows."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.llm import decontaminate as D
from quayside.llm import textkernel as K


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, least):
    """By document: words, hit positions, items."""
    windows = {}
    for name, text in items:
        w = words(text)
        k = min(len(w), least)
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(None if name is None else str(name))
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (names := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= names
        out.append((len(w), sorted(hit), sorted(found - {None})))
    return out


SEQUENCE = st.lists(st.integers(0, 3), max_size=14)


@settings(max_examples=150, deadline=None)
@given(st.lists(SEQUENCE, max_size=6), st.lists(SEQUENCE, min_size=1, max_size=4), st.integers(2, 5), st.integers(1, 9))
def test_longest_matches(items, docs, least, stride):
    hashes = K.mix(np.arange(5, dtype=np.uint64) + np.uint64(1))
    built = D.Automaton([hashes[s] for s in items if s], [str(i) for i, s in enumerate(items) if s], least)
    first = np.r_[0, np.cumsum([len(d) for d in docs])]
    token = built.tokens(hashes[np.concatenate([np.array(d, int) for d in docs])])
    held, D.STRIDE = D.STRIDE, stride
    try:
        _, size = built.follow(token, first)
    finally:
        D.STRIDE = held
    runs = {tuple(s[i:j]) for s in items for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    at = 0
    for d in docs:
        for p in range(len(d)):
            longest = max((k for k in range(1, p + 2) if tuple(d[p + 1 - k : p + 1]) in runs), default=0)
            assert min(size[at], least) == min(longest, least) and size[at] <= longest
            at += 1


def check(spark, docs, items, least):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.find(rows, held, least).collect()}
    for i, (n, hit, found) in enumerate(plain(docs, items, least)):
        r = got[i]
        covered = [p for s in r.spans for p in range(s.start, s.end)]
        assert (r.n_words, covered, r.n_hit, r["items"], r.contaminated) == (n, hit, len(hit), found, bool(hit)), (docs[i], r)


def random_texts(seed):
    rng = random.Random(seed)
    say = lambda n, size: " ".join(rng.choice("abcdefgh"[:size]) for _ in range(n))
    items = [(i, say(rng.randrange(0, 14), 4)) for i in range(12)] + [(None, "h h h h"), (3, "g g g g g g"), (7, None), (8, "!?"), (9, "a")]
    docs = [say(rng.randrange(0, 60), 6) for _ in range(20)] + [None, "", "...", "H-h,h;H", "g_g.g g\ng g", "é É ü"]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_find_matches_plain(spark, seed):
    docs, items = random_texts(seed)
    check(spark, docs, items, 4)


def test_many_shards_and_cut_items(spark, monkeypatch):
    docs, items = random_texts(5)
    long = [f"w{i % 37}" for i in range(400)]
    items.append((99, " ".join(long)))
    docs += [" ".join(long[a : a + 30]) for a in range(0, 370, 23)]
    monkeypatch.setattr(D, "SHARD_WORDS", 60)
    monkeypatch.setattr(D, "SEGMENT_WORDS", 16)
    monkeypatch.setattr(D, "PASSES", 2)
    assert D.automata(spark.createDataFrame(items, "item_id long, text string"), 4).count() > 4
    check(spark, docs, items, 4)


def test_empty_sides_extra_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (None, None, None)], "doc_id long, text string, items string").withColumn("n_hit", F.lit("y")).withColumn("own", F.lit(5))
    items = spark.createDataFrame([(4, "b c")], "item_id long, text string")
    got = D.find(docs, items, 10).collect()
    assert sorted((r.n_words, r.n_hit, r.own, tuple(r["items"])) for r in got) == [(0, 0, 5, ()), (4, 2, 5, ("4",)), (4, 2, 5, ("4",))]
    assert [r.n_hit for r in D.find(docs, items.limit(0), 10).collect()] == [0, 0, 0]
    assert D.find(docs.limit(0), items, 10).count() == 0


def test_remove_cuts_long_spans_and_drops_covered_texts(spark):
    text = "One, two THREE four. Five six; seven eight nine ten -- eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, text), (2, "two three four five"), (3, "é ü")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three four five"), (2, "nine")], "item_id long, text string")
    found = D.find(docs, items, 4)
    kept = {r.doc_id: r.text for r in D.remove(found, span_limit=4, coverage_limit=0.5).collect()}
    assert kept == {1: "One,  six; seven eight nine ten -- eleven twelve thirteen fourteen", 3: "é ü"}
    assert {r.doc_id: r.text for r in D.remove(found, span_limit=5, coverage_limit=1.0).collect()} == {1: text, 2: "two three four five", 3: "é ü"}


def test_very_long_text(spark):
    text = "x " * 300_000 + "a b c d e f g h i j k" + " y" * 1000
    got = D.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x x x x x x x x x x x")], "item_id long, text string"), 10).first()
    assert (got.n_words, got.n_hit, got["items"]) == (301_011, 300_010, ["1", "2"])
