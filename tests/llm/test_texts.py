"""Operators on documents against brute force, with awkward rows and columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.llm import jaccard, langid, packing, perplexity, substrings, textkernel, weaklabels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = {i: i + 32 for i in range(65, 91)}
#: Columns that clash with names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, bucket int, node string, word string, marks string, c0 string, kept string, score double"


def _prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): prose, near and exact copies, shared passages, odd separators, null, empty, very long, repeated rows."""
    rng = random.Random(3)
    texts = [_prose(rng, rng.randrange(1, 300)) for _ in range(40)]
    shared = _prose(rng, 60)
    texts += [f"{_prose(rng, 40)}\n{shared}\t{_prose(rng, 30)}" for _ in range(4)]
    base = _prose(rng, 200).split(" ")
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += [texts[0]] * 3 + ["", " \n\t ", "one two", "one two", "Éa b \x0b\x0c ünï 漢字 🙂", _prose(rng, 20_000, 100_000), "z " * 300, _prose(rng, 35), "a\n\nb\na\n b\nb"]
    out = list(enumerate(texts)) + [(900, None), (901, None)]
    return out + [out[5], out[5], (7, texts[8])]  # repeated rows, and one id with two texts


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, ("en", "de", None)[i % 3], "s", len(t or ""), -1, 3, "n", "w", "m", "c", "k", 0.5) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    return WORD.findall((text or "").translate(ASCII) if lower else text or "")


def test_words_and_runs_match_a_regex():
    rng = random.Random(1)
    texts = ["", None, "é" * 70_000, *("".join(rng.choice("ab \n\x0bé🙂") for _ in range(rng.randrange(80))) for _ in range(200))]
    data, off = textkernel.text_bytes(pa.array(texts))
    w = textkernel.words(data, off)
    want = [words(t) for t in texts]
    assert [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == [x for t in want for x in t]
    assert list(np.diff(w.first)) == [len(t) for t in want]
    for k in (1, 3, 5, 35):
        at, h = textkernel.run_hashes(w, k)
        runs = [tuple(t[i : i + k]) for t in want for i in range(len(t) - k + 1)]
        assert len(at) == len(runs) and len(set(zip(runs, h.tolist(), strict=True))) == len(set(runs)) == len(set(h.tolist()))


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * n for n in (1, 5, 100, 0, 3)] + [None]), "i": list(range(6))})
    parts = list(textkernel.slices(iter([batch]), limit=6))
    assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(6)) and [p.num_rows for p in parts][:2] == [2, 1]


# op9


def removed(all_words, window):
    count = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("window, group_runs", [(35, substrings.GROUP_RUNS), (35, 3), (10, 2)])
def test_substrings(spark, docs, rows, window, group_runs):
    out = substrings.remove_repeats(docs.select("doc_id", "text", "marks", "row"), window, group_runs=group_runs)
    got = Counter((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in out.collect())
    all_words = [words(t) for _, t in rows]
    want = Counter((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)) for (i, _), w, gone in zip(rows, all_words, removed(all_words, window), strict=True))
    assert got == want and sum(x[3] for x in got) > 0


def test_substrings_keep_the_layout(spark):
    rng = random.Random(5)
    shared = _prose(rng, 40)
    df = spark.createDataFrame([(1, f"a\n\nb {shared}\nc\td"), (2, f"{shared} e"), (3, "x  y\n")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substrings.remove_repeats(df, 35, layout=True).collect()}
    assert got == {1: "a\n\nb c\td", 2: "e", 3: "x  y\n"}


def test_substrings_empty(empty):
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_columns_with_names_of_its_own(spark):
    df = spark.createDataFrame([(1, "a b", 7, "k", 9)], "doc_id long, text string, n_words int, kept_text string, other int")
    out = substrings.remove_repeats(df).collect()
    assert [r.asDict() for r in out] == [{"doc_id": 1, "other": 9, "kept_text": "a b", "n_words": 2, "n_removed": 0}]


def test_suffix_tree_nodes_are_the_common_prefixes():
    """Runs of neighbours with common length d or more are the sets of suffixes with equal first d words, at every d."""
    rng = np.random.default_rng(3)
    word = rng.integers(1, 4, 400).astype("<u4")
    anchor, right = rng.permutation(350)[:200], rng.integers(3, 12, 200)
    order, common = substrings.suffix_tree(word, anchor, right, 12)
    assert sorted(order.tolist()) == list(range(200))
    for d in range(1, 13):
        node = np.cumsum(common < d)
        got, want = defaultdict(set), defaultdict(set)
        for place, i in enumerate(order.tolist()):
            if right[i] >= d:
                got[node[place]].add(i)
                want[tuple(word[anchor[i] : anchor[i] + d])].add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_passage_in_all_documents_is_dealt_over_tasks(spark):
    """Its suffixes are counted by whole windows; no tree gets a group above the size asked for."""
    rng = random.Random(21)
    shared = _prose(rng, 80)
    rows = [(i, f"{_prose(rng, 40, 10**6)} {shared} {_prose(rng, 40, 10**6)}") for i in range(120)]
    df = spark.createDataFrame(rows, "row long, text string").repartition(6)
    heads = df.mapInArrow(substrings._heads(35), "key long, row long, at int")
    groups = {r.n: r.groups for r in heads.groupBy("key").count().groupBy("count").count().toDF("n", "groups").collect()}
    assert max(groups) >= 120
    got = {r.row: {int(x) for b in r.marks for x in np.frombuffer(b, "<i4")} for r in substrings.repeated_windows(df, 35, group_runs=16).groupBy("row").agg(F.collect_list("payload").alias("marks")).collect()}
    assert got == {i: set(range(40, 40 + 46)) for i, _ in rows}


# op6


def components(rows, k=5, percent=75):
    sets = []
    for i, t in rows:
        w = words(t, True)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(least[find(n)], i)
    return Counter((i, len(x), least[find(n)]) for n, (i, x) in enumerate(sets))


@pytest.mark.parametrize("short, block", [(48, 384), (1, 3)])
def test_jaccard(docs, rows, monkeypatch, short, block):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = Counter(tuple(r) for r in jaccard.similar_components(docs).collect())
    assert got == components(rows)


def test_jaccard_with_few_token_bits(spark, monkeypatch):
    """Shingles of one set that share a token lose no link, however often that happens."""
    plain = jaccard._tokens
    monkeypatch.setattr(jaccard, "_tokens", lambda h, buckets: np.unique(plain(h, buckets) & ((0x7FFF << 32) | 0x1F)))
    rng = random.Random(4)
    rows = []
    for i in range(12):
        base = _prose(rng, rng.choice([8, 30, 150, 400]), 10**6).split(" ")
        for j in range(4):
            copy = list(base)
            for _ in range(max(1, len(base) // 40)):
                copy[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            rows.append((10 * i + j, " ".join(copy)))
    got = Counter(tuple(r) for r in jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == components(rows)


def test_jaccard_chain_over_hubs(spark):
    """Near copies that link with few others: components are chains, not stars."""
    rng = random.Random(9)
    base, rows = _prose(rng, 120, 10**6).split(" "), []
    for i in range(60):
        for _ in range(2):
            base[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(base)))
    got = Counter(tuple(r) for r in jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == components(rows)


def test_jaccard_empty(empty):
    assert jaccard.similar_components(empty).count() == 0


# op4


def test_base_rules_match_plain_counts(rows):
    column = pa.array([t for _, t in rows])
    got = perplexity.base_rules(column)
    for n, (_, t) in enumerate(rows):
        t = t or ""
        w, seen, dup = words(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count, hit = Counter(windows), set()
        for i, x in enumerate(windows):
            if count[x] > 1:
                hit |= {i, i + 1, i + 2}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit))
        assert tuple(int(got[c][n]) for c in perplexity._RULES) == want


def plain_kneser_ney(texts):
    """The interpolated probability of an n-gram, by definition."""
    order = perplexity.ORDER
    count = Counter(tuple("\0" * (order - 1) + t)[i : i + order] for t in texts for i in range(len(t)))
    levels = [count]
    for _ in range(order - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))

    def discount(c, k):
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        d = min(k, k - (k + 1) * y * n[k + 1] / n[k]) if n[k] else 0.0
        return d if d > 0 else perplexity.LEAST_DISCOUNT * k

    def p(g):
        c = levels[len(g) - 1]
        same = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        low = p(g[1:]) if len(g) > 1 else 1 / perplexity.ALPHABET
        total = sum(same.values())
        if not total:
            return low
        return max(0, c[g] - discount(c, min(c[g], 3)) if c[g] else 0) / total + sum(discount(c, min(v, 3)) for v in same.values()) / total * low

    return p


def test_kneser_ney_matches_a_plain_model(spark):
    """Every n-gram of fold 0 under the model of fold 1 and the other way round, with symbols of all planes."""
    folds = [["abcab", "abd", "bca bca", "aab", "ccc", "漢字漢", "a🙂b"], ["abc", "bca aab aab", "字漢漢", "xyz", "ab🙂"]]
    df = spark.createDataFrame([(t, 7, f) for f in (0, 1) for t in folds[f]], "text string, model long, fold int")
    own = perplexity.levels(perplexity.count_grams(df))
    got = perplexity.probabilities(own, [x.selectExpr("*", "1 - fold as other").drop("fold").withColumnRenamed("other", "fold") for x in own]).collect()
    want = {}
    for f in (0, 1):
        p = plain_kneser_ney(folds[1 - f])
        for t in folds[f]:
            for i in range(len(t)):
                g = tuple("\0" * (perplexity.ORDER - 1) + t)[i : i + perplexity.ORDER]
                want[f, g] = p(g)
    assert {(r.fold, tuple(chr(r[x]) for x in perplexity.SYMBOLS)): pytest.approx(r.p) for r in got} == want


def test_scores_are_sums_of_log_probabilities(spark):
    """Lots, packed texts and hash arrays give what the plain model gives for each text, lots split or not."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["ab", "abc", "漢字", "c🙂", "bca"]) for _ in range(rng.randrange(50, 60))) for _ in range(30)] + ["", None]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    fold = {r.doc_id: r.f for r in df.selectExpr("doc_id", "pmod(xxhash64(text), 2) as f").collect()}
    model = [plain_kneser_ney([t for i, t in enumerate(texts) if t and fold[i] == f]) for f in (0, 1)]
    for lot_bytes in (perplexity.LOT_BYTES, 500):
        got = {r.doc_id: r.perplexity for r in perplexity.quality_rules(df, lot_bytes=lot_bytes).collect()}
        for i, t in enumerate(texts):
            padded = tuple("\0" * (perplexity.ORDER - 1) + (t or ""))
            nats = [-np.log(model[1 - fold[i]](padded[j : j + perplexity.ORDER])) for j in range(len(t or ""))]
            assert got[i] == pytest.approx(np.exp(np.mean(nats)) if nats else 1.0, rel=1e-4)


def test_many_symbols_in_one_slice():
    """More symbols than four fit 64 bits."""
    point = np.array([c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000], np.uint32)
    at = np.array([0, 70_000, len(point)])
    of, symbols, n = perplexity._distinct(point, at, np.array([0, 1]))
    want = perplexity._before(point, at)
    assert set(zip(of.tolist(), *(x.tolist() for x in symbols), strict=True)) == set(zip(np.repeat([0, 1], np.diff(at)).tolist(), *(x.tolist() for x in want), strict=True)) and n.sum() == len(point)


def test_quality_rules(docs, rows):
    out = perplexity.quality_rules(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in out) > 20


def test_perplexity_band_rejects_noise(spark):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "warm", "mats", "today", "quietly"]) + rng.choice(["", "s", "ed"]) + str(rng.randrange(40)) for _ in range(80)), "en") for i in range(60)]
    noise = [(100 + i, " ".join("".join(chr(rng.randrange(0x400, 0xF00)) for _ in range(7)) for _ in range(80)), "en") for i in range(2)]
    kept = {r.doc_id: r.kept for r in perplexity.quality_rules(spark.createDataFrame(good + noise, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i, *_ in good) and not kept[100] and not kept[101]


@pytest.mark.parametrize("share", [0.1, 0.33])
@pytest.mark.parametrize("kind", ["letters", "copies", "near"])
def test_perplexity_band_rejects_much_junk(spark, share, kind):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice(["ta", "ren", "o", "shi", "lum", "e", "dor", "ka"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    good = [" ".join(rng.choice(vocabulary) for _ in range(100)) for _ in range(120)]
    base = [letters() for _ in range(100)]
    junk = []
    for _ in range(round(len(good) * share / (1 - share))):
        near = [letters() if rng.random() < 0.05 else x for x in base]
        junk.append(" ".join({"letters": [letters() for _ in range(100)], "copies": base, "near": near}[kind]))
    out = perplexity.quality_rules(spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string").selectExpr("*", "'en' as lang")).collect()
    assert not any(r.base_failed for r in out)
    kept = {r.doc_id: r.kept for r in out}
    assert not any(kept[i] for i in range(len(good), len(kept))) and sum(kept[i] for i in range(len(good))) >= 0.98 * len(good)


def test_prose_of_two_languages_stays(spark):
    """Half of a text in another language is no junk; random letters in the same place are."""
    rng = random.Random(17)
    vocabularies = [["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(300)] for parts in (["ta", "ren", "o", "shi", "lum", "dor"], ["ß", "ech", "ung", "wü", "zer", "plk"])]
    prose = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    rows = [(200 * k + i, prose(v, 100), "ab"[k]) for k, v in enumerate(vocabularies) for i in range(150)]
    rows += [(1000 + i, f"{prose(vocabularies[0], 50)} {prose(vocabularies[1], 50)}", "a") for i in range(10)]
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows += [(2000 + i, f"{prose(vocabularies[0], 50)} {' '.join(noise() for _ in range(50))}", "a") for i in range(10)]
    kept = {r.doc_id: r.kept for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] == (i < 2000) for i, *_ in rows)


def test_repeated_rows_are_packed_once_a_task(spark):
    """A third of all rows repeat one row, some under another language: each has its verdict, and a task packs it once."""
    rows = [(i, f"{'lorem ipsum dolor sit amet ' * 12}{i}", "la") for i in range(60)] + [(999, "same words over and over again, " * 20, "la")] * 30 + [(999, "same words over and over again, " * 20, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = perplexity.quality_rules(df).collect()
    assert len(out) == len(rows) and len({r.row for r in out}) == 62
    assert len({(r.n_words, r.kept, r.perplexity) for r in out if r.doc_id == 999}) <= 2
    judged = df.select("doc_id", "text", "lang", perplexity.row_key().alias("row"), F.lit(0).cast("long").alias("model"), F.lit(0).alias("fold"), F.lit(0).cast("long").alias("content"))
    assert perplexity.in_lots(judged).where("doc_id = 999").count() <= 2 * 3


def test_quality_rules_empty(empty):
    assert perplexity.quality_rules(empty).count() == 0


# op1, op2


def test_quality_scores_rows_and_labels(spark, docs, rows, empty):
    out = weaklabels.quality_scores(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in out)
    assert weaklabels.quality_scores(empty).count() == 0
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in weaklabels.quality_scores(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    right = sum(got[r.doc_id] == (r.quality == 1) for r in labels)
    clean = [got[r.doc_id] for r in labels if r.quality == 1]
    assert right >= 0.97 * len(labels) and sum(clean) >= 0.99 * len(clean)


@pytest.mark.parametrize("share, missing", [(0.5, 0.0), (0.8, 0.3)])
def test_label_model_finds_accuracies(share, missing):
    """With the production defaults, a labeller worse than chance among them."""
    rng = np.random.default_rng(4)
    n, skill = 20_000, np.array([0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.3, 0.55, 0.9])
    truth = rng.random(n) < share
    votes = np.where(rng.random((n, len(skill))) < skill, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((n, len(skill))) < missing] = 2
    p, c = np.unique(weaklabels._pattern(votes), return_counts=True)
    model = weaklabels.fit_labellers(p, c)
    for found in (model.right_on_bad, model.right_on_good, model.accuracy):
        assert np.abs(found - skill).max() < 0.04
    assert abs(model.share - share) < 0.02
    guess = dict(zip(p.tolist(), model.posterior > 0.5, strict=True))
    assert np.mean([guess[x] == t for x, t in zip(weaklabels._pattern(votes).tolist(), truth, strict=True)]) > 0.96


def test_label_model_matches_plain_em():
    """One loop per document instead of arrays over patterns."""
    rng = np.random.default_rng(8)
    k, votes = len(weaklabels.LABELLERS), rng.choice([0, 1, 2], (60, len(weaklabels.LABELLERS)), p=[0.2, 0.6, 0.2])
    a, b, share = [weaklabels.START_BAD] * k, [weaklabels.START_GOOD] * k, 0.5
    for _ in range(500):
        post = []
        for v in votes:
            good, bad = share, 1 - share
            for j, x in enumerate(v):
                good *= {0: 1 - b[j], 1: b[j], 2: 1}[x]
                bad *= {0: a[j], 1: 1 - a[j], 2: 1}[x]
            post.append(good / (good + bad))
        w = weaklabels.PRIOR_VOTES
        for j in range(k):
            a[j] = (sum(1 - q for q, v in zip(post, votes, strict=True) if v[j] == 0) + w * weaklabels.START_BAD) / (sum(1 - q for q, v in zip(post, votes, strict=True) if v[j] != 2) + w)
            b[j] = (sum(q for q, v in zip(post, votes, strict=True) if v[j] == 1) + w * weaklabels.START_GOOD) / (sum(q for q, v in zip(post, votes, strict=True) if v[j] != 2) + w)
        share = (sum(post) + 1) / (len(post) + 2)
    p, c = np.unique(weaklabels._pattern(votes), return_counts=True)
    model = weaklabels.fit_labellers(p, c)
    got = dict(zip(p.tolist(), model.posterior.tolist(), strict=True))
    assert [got[x] for x in weaklabels._pattern(votes).tolist()] == pytest.approx(post, abs=1e-5)


def test_scorer_matches_plain_adagrad():
    rng = np.random.default_rng(5)
    slots = [rng.choice(50, 6, replace=False) for _ in range(40)]
    values = [rng.random(6) for _ in slots]
    target, count = rng.random(40), rng.integers(1, 9, 40).astype(float)
    got, bias = weaklabels.fit_scorer(slots, values, target, count, epochs=2)
    w, g2, b, b2 = defaultdict(float), defaultdict(lambda: 1e-6), 0.0, 1e-6
    c = count / count.mean()
    share = (target * c).mean()
    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(40):
            z = sum(w[s] * v for s, v in zip(slots[i], values[i], strict=True)) + b
            e = (1 / (1 + np.exp(-z)) - target[i]) * c[i] * (target[i] / (2 * share) + (1 - target[i]) / (2 * (1 - share)))
            for s, v in zip(slots[i], values[i], strict=True):
                g = e * v + 1e-6 * w[s]
                g2[s] += g * g
                w[s] -= 0.3 * g / np.sqrt(g2[s])
            b2 += e * e
            b -= 0.3 * e / np.sqrt(b2)
    assert bias == pytest.approx(b) and all(got[s] == pytest.approx(x, abs=1e-5) for s, x in w.items())


def test_scores_of_rows_match_a_plain_sum(spark):
    """What a task computes over the bytes of a slice is the linear score of each text by itself."""
    rng = np.random.default_rng(6)
    w, bias = rng.normal(size=1 << weaklabels.BITS).astype(np.float32), 0.3
    texts = ["", None, "ab", "abc", "Äh, 漢字 und mehr. " * 9, "a | b\n" * 30, "x" * 500]

    class Shared:
        value = (w, bias, {}, 0.5)

    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    (out,) = weaklabels._score(Shared, ["text"])(iter([batch]))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        stats = weaklabels.statistics(pa.array([t], pa.string()))
        grams = [float(w[((raw[j] | raw[j + 1] << 8 | raw[j + 2] << 16) * 2654435761 % 2**32 >> 12) & (1 << weaklabels.BITS) - 1]) for j in range(len(raw) - 2)]
        z = 4 * sum(grams) / max(len(raw) - 2, 1) + float(w[weaklabels._bins(stats)].sum()) + bias
        assert out.column("score")[i].as_py() == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-6)


def test_ftrl_matches_a_plain_version():
    """Follow-the-regularised-leader with both penalties, one weight at a time."""
    rng = np.random.default_rng(2)
    rows = [(np.r_[np.sort(rng.choice(40, 5, replace=False)), 1 << langid.BITS], np.r_[rng.random(5) * 3, 1.0], int(rng.integers(3))) for _ in range(30)]
    got = langid.fit_ftrl(rows, 3, epochs=2, batch=4)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    n, z = defaultdict(float), defaultdict(float)

    def weight(i, c):
        return 0.0 if abs(z[i, c]) <= l1 else -(z[i, c] - np.sign(z[i, c]) * l1) / ((beta + np.sqrt(n[i, c])) / alpha + l2)

    order = np.random.default_rng(11)
    for _ in range(2):
        p = order.permutation(30)
        for k in range(0, 30, 4):
            part, g = [rows[j] for j in p[k : k + 4]], defaultdict(float)
            for s, x, y in part:
                e = np.exp([sum(weight(i, c) * v for i, v in zip(s, x, strict=True)) for c in range(3)])
                for c in range(3):
                    for i, v in zip(s, x, strict=True):
                        g[i, c] += v * (e[c] / e.sum() - (c == y)) / len(part)
            old = {key: weight(*key) for key in g}
            for key, d in g.items():
                sigma = (np.sqrt(n[key] + d * d) - np.sqrt(n[key])) / alpha
                z[key] += d - sigma * old[key]
                n[key] += d * d
    assert all(got[i, c] == pytest.approx(weight(i, c), abs=1e-9) for i, c in n)
    assert (got == 0).mean() > 0.99


def test_temperature_is_the_best_of_a_fine_search():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(300, 4)) * 6
    y = np.array([rng.choice(4, p=np.exp(v / 2.5) / np.exp(v / 2.5).sum()) for v in logits])
    loss = lambda t: -np.mean([np.log(np.exp(v[k] / t) / np.exp(v / t).sum()) for v, k in zip(logits, y, strict=True)])
    t = langid.fit_temperature(logits, y)
    assert abs(t - 2.5) < 0.5 and loss(t) <= min(loss(x) for x in np.linspace(0.5, 10, 400)) + 1e-4


def test_language_features_tell_symbols_of_all_planes_apart():
    data, off = textkernel.text_bytes(pa.array(["漢", "字", "かな", "🙂"]))
    found, at = langid.slots(data, off)
    assert len(set(found[0].tolist())) == 5 and at.tolist() == [0, 1, 2, 4, 5]


def test_language_id(spark, docs, rows, empty):
    out = langid.identify(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert und == {i for i, t in rows if not any(c.isalpha() for c in t or "")}
    assert langid.identify(empty).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in real.collect()}
    held = [r for r in langid.identify(real).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_id_ignores_held_out_rows_and_null_languages(spark):
    rows = [(i, "aaa bbb " * 5 if i % 2 else "xyz zyx " * 5, "aa" if i % 2 else "xx") for i in range(60)]
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    spoilt = [(i, t, "wrong" if i in held else lang) for i, t, lang in rows] + [(1000, "aaa", None)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(spoilt, "doc_id long, text string, lang string")).collect()}
    assert {got[i] for i in held} <= {"aa", "xx"} and all(got[i] == lang for i, _, lang in rows) and got[1000] == "aa"


def test_language_id_loses_no_language_of_many(spark):
    """More languages than training rows: each is learned, also beside one that holds a third of all rows."""
    word = lambda k: "".join(chr(0x4E00 + 5 * k + j) for j in range(4))
    rows = [(i, " ".join([word(i % 150)] * 6), f"l{i % 150:03d}") for i in range(1200)] + [(2000 + i, f"hot text {i}", "hot") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, train_rows=60).collect()}
    assert set(got.values()) == {lang for _, _, lang in rows}
    assert sum(got[i] == lang for i, _, lang in rows) > 0.95 * len(rows)
    with pytest.raises(langid.TooManyLanguages):
        langid.identify(docs, model_bytes=100 << 20)


def test_language_id_learns_rare_languages_among_copies(spark):
    """A hot text and few rows of a language: both are learned."""
    rng = random.Random(1)
    rows = [(i, "la la lu le " * 20, "aa") for i in range(600)] + [(1000 + i, _prose(rng, 30), "bb") for i in range(600)] + [(5000 + i, " ".join(rng.choice(["xyz", "zyx", "qqu", "xqz"]) for _ in range(30)), "cc") for i in range(6)]
    rows += [(9000, "zyx qqu xyz xqz zyx xyz", None)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=60).collect()}
    assert all(got[i] == lang for i, _, lang in rows if lang) and got[9000] == "cc"


# op10


def test_packing(docs, rows, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out = packing.pack(docs, capacity=256, open_windows=4, merge=2).collect()
    whole = Counter()
    for _, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        whole[len(ids)] += 1
    assert sum(r.length for r in out) == sum(n * m for n, m in whole.items())
    assert Counter(r.doc_tokens for r in out if r.start == 0) == whole
    windows = defaultdict(list)
    for r in out:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= 256
    assert packing.pack(empty).count() == 0


def test_packing_ids_and_special_strings(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["plain text", "a<|endoftext|>b", "  spaces\n\n\tand 12345 tabs ", "naïve 漢字 🙂", "x" * 3000]
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=512).collect()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_ids_are_those_of_the_tokenizers_library_for_all_of_unicode():
    """The rank file gives the ids that the tokenizer file gives: every code point alone, inside a word and after a space, and mixtures."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, encode, rng = Tokenizer.from_file(path("byte_bpe_50k.json")), packing._encoder(None, None), random.Random(31)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}1" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    texts += ["".join(rng.choice(points[:3000] if rng.random() < 0.5 else points) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice(["'s", "'LL", "  ", "\n\n", "\t", "12", "½", "é", "e\u0301", "ß", "ǅ", "\u200d", "\u00a0", "\u3000", "x"]) for _ in range(rng.randrange(20))) for _ in range(3000)]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == want.ids


def test_windows_emit_the_fullest_when_none_fits():
    out: list = []
    w = packing.Windows(10, 2, 0, out)
    for n in (6, 7):
        w.place(("d", 0, n, 0, n))
    w.place(("d", 0, 5, 0, 5))
    assert [(r[2], r[5]) for r in out] == [(7, 1)] and len(w.rooms) == 2
    w.place(("d", 0, 4, 0, 4))  # best fit fills the window of 6 exactly
    assert [(r[2], r[5]) for r in out[1:]] == [(6, 0), (4, 0)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "substring_dedup", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in P.STAGES:
        out = stage(spark, seen[-1], sf)
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(spark.read.parquet(f"{tmp_path}/{len(seen)}"))
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    rows = {n: {r.doc_id: r.text for r in df.collect()} for n, df in enumerate(seen[:-1])}
    assert set(rows[4]) <= set(rows[3]) <= set(rows[2]) <= set(rows[1]) <= set(rows[0])
    groups = components([(i, rows[2][i]) for i in sorted(rows[2])])
    assert set(rows[3]) == {i for i, _, c in groups if i == c}
    ids = sorted(rows[3])
    cut = dict(zip(ids, removed([words(rows[3][i]) for i in ids], 35), strict=True))
    for i in ids:
        left = [x for x, g in zip(words(rows[3][i]), cut[i], strict=True) if not g]
        assert words(rows[4].get(i)) == left
        if not any(cut[i]):
            assert rows[4][i] == rows[3][i]
    assert {r.doc_id for r in seen[-1].collect()} == set(rows[4])
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()
    assert sum(r.doc_id in rows[1] for r in labels) >= 0.98 * len(labels)
    assert hashlib.sha256(b"").hexdigest()


def test_one_of_each(spark):
    rng = random.Random(8)
    a, b = _prose(rng, 80, 10**6), _prose(rng, 80, 10**6)
    rows = [(5, a), (3, a + " x"), (3, b), (None, b), (None, "only here"), (9, None), (9, None), (7, ""), (4, "q r"), (4, "q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = jaccard.one_of_each(df.selectExpr("*", "1 as row", "2 as _row", "3 as `group`"))
    assert clash.columns == ["doc_id", "text", "row", "_row", "group"]
    assert Counter(tuple(r)[:2] for r in clash.collect()) == Counter(map(tuple, jaccard.one_of_each(df).collect()))
    got = jaccard.one_of_each(df).collect()
    assert Counter(map(tuple, got)) == Counter([(3, a + " x"), (3, b), (None, "only here"), (9, None), (7, ""), (4, "q r")])
