"""Every pipeline stage on awkward rows: nulls, empty and long texts, repeats, clashing columns, an empty table."""

import os
import random

import pytest

import corpus_pipeline as P

#: Names that stages and operators use for columns of their own.
CLASH = "row long, _row long, kept boolean, kept_text string, n_words long, n_removed long, score double, c0 string, marks string, lot long, model long, fold int, bucket int, node long, live long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def _rows():
    rng = random.Random(7)
    word = ["".join(rng.choice(["ta", "re", "no", "shi", "lu"]) for _ in range(rng.randrange(1, 4))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(word) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    texts = [prose(rng.randrange(60, 200)) for _ in range(60)]
    texts += [texts[0], f"{texts[1]} end", None, "", " \n", "one two", prose(30_000), "| # | * " * 60]
    out = [(i, t, ("en", "de", None)[i % 3], None if i % 5 == 0 else "s", len(t or "")) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[4], None, None, None), (None, None, None, None, None), (5, texts[6], "en", "s", 1)]
    return [(*r, 1, 2, True, "k", 3, 4, 0.5, "c", "m", 5, 6, 7, 8, 9, 10) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_awkward_rows(spark, docs, name, stage):
    out = stage(spark, docs, "")
    rows = [r.asDict() for r in out.collect()]
    if name == "packing":
        assert sum(r["length"] for r in rows if r["start"] == 0) > 0 and {r["doc_id"] for r in rows} == {r[0] for r in _rows()}
        return
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    ids = {r["doc_id"] for r in rows}
    assert len(ids) > 40 and all((r["row"], r["_row"], r["kept_text"], r["n_words"], r["live"]) == (1, 2, "k", 3, 10) for r in rows)
    texts = [r["text"] for r in rows]
    if name == "quality_rules":
        assert None not in texts and "" not in texts and "one two" not in texts
        assert sum(r["doc_id"] == 3 for r in rows) in (0, 3)
    if name == "near_duplicates":
        assert sum(r["doc_id"] == 3 for r in rows) == 1 and 60 not in ids and 0 in ids
        assert texts.count(None) == 2 and texts.count("") == 1
    if name == "substring_dedup":
        assert None not in texts and 0 not in ids and 3 not in ids and 66 in ids
        assert all(r["n_chars"] == len(r["text"]) for r in rows)


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_empty_table(spark, docs, name, stage):
    assert stage(spark, docs.where("false"), "").count() == 0


def test_run_leaves_one_table(spark):
    """The whole pipeline; only its result stays in the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.agg({"length": "max"}).first()[0] <= 2048
    assert len(set(os.listdir(folder)) - held) == 1
