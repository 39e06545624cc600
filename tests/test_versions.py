import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.sinks import versions
from quayside.sinks.versions import MergeError, Versions


def pairs(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def names(held, number):
    return {r["_file"] for r in held.files(number).collect()}


def test_filter_never_misses_and_seldom_errs():
    rng = np.random.default_rng(1)
    seen, other = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 5000)
    f = versions.bloom(seen)
    assert versions.may_hold(f, seen).all() and versions.may_hold(f, other).mean() < 0.03
    assert not versions.may_hold(versions.bloom(np.array([], dtype=np.int64)), other).any()


def test_filter_of_a_whole_file_takes_little_memory():
    hashes = np.random.default_rng(2).integers(-(2**62), 2**62, versions.FILE_ROWS)
    tracemalloc.start()
    try:
        f, most = versions.bloom(hashes), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert versions.may_hold(f, hashes).all() and most < 40e6


def test_upsert_rewrites_only_the_files_of_its_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FILE_ROWS", 50)
    rows = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("a"), "id").alias("v"))
    held = Versions(spark, f"{tmp_path}/r")
    first = held.create(rows, "k", buckets=8)
    assert (first.inserted, first.updated, first.rewritten, first.kept) == (1000, 0, 0, 0) and len(names(held, 1)) >= 20
    old = held.read(1)
    second = held.upsert(spark.createDataFrame([("n", 5), ("m", 2000)], "v string, k long"))
    assert (second.inserted, second.updated, second.rewritten) == (1, 1, 1) and second.kept == len(names(held, 1)) - 1
    assert len(names(held, 1) - names(held, 2)) == 1 and len(names(held, 2) - names(held, 1)) == 2
    want = {i: f"a{i}" for i in range(1000)} | {5: "n", 2000: "m"}
    assert pairs(held.read()) == sorted(want.items())
    assert pairs(old) == pairs(rows) == pairs(held.read(1))
    # only new keys: nothing is rewritten
    third = held.upsert(spark.createDataFrame([(3000, "z")], "k long, v string"))
    assert (third.inserted, third.updated, third.rewritten) == (1, 0, 0) and names(held, 2) < names(held, 3)
    fourth = held.compact(most=1)
    assert pairs(held.read()) == sorted((want | {3000: "z"}).items()) and (fourth.inserted, fourth.updated) == (0, 0)
    assert [held.version(i).version for i in held.versions()] == [1, 2, 3, 4]


def test_text_keys_empty_relations_and_repeats(spark, tmp_path):
    shape = "k string, v int"
    held = Versions(spark, f"{tmp_path}/r")
    held.create(spark.createDataFrame([], shape), "k", buckets=4)
    assert held.read().count() == 0 and held.read().columns == ["k", "v"]
    held.upsert(spark.createDataFrame([("a", 1), ("", None)], shape))
    held.upsert(spark.createDataFrame([], shape))
    last = held.upsert(spark.createDataFrame([("a", 2)], shape))
    assert (last.version, last.updated, last.inserted) == (4, 1, 0) and pairs(held.read()) == [("", None), ("a", 2)]
    for bad in ([("b", 1), ("b", 1)], [(None, 1)]):
        with pytest.raises(MergeError):
            held.upsert(spark.createDataFrame(bad, shape))
    with pytest.raises(FileExistsError):
        held.create(spark.createDataFrame([], shape), "k")
    assert held.versions() == [1, 2, 3, 4]


def test_a_version_without_a_record_does_not_exist(spark, tmp_path, monkeypatch):
    held = Versions(spark, f"{tmp_path}/r")
    rows = spark.range(20).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    held.create(rows, "k", buckets=2)

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(held.folder, "put", crash)
        with pytest.raises(OSError):
            held.upsert(spark.createDataFrame([(1, "b")], "k long, v string"))
    assert held.versions() == [1] and pairs(held.read()) == pairs(rows)
    assert held.upsert(spark.createDataFrame([(1, "c")], "k long, v string")).version == 2
    assert dict(pairs(held.read()))[1] == "c"
