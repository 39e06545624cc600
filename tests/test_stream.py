"""The stream contract, against a small model and end to end over files."""

from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.streaming import classify as C
from quayside.streaming import consumer, decode, keyed

T0 = datetime(2026, 1, 1, tzinfo=UTC)


def event(n, minutes=0.0, load=10.0, lag=2):
    at = T0 + timedelta(minutes=minutes)
    return (f"evt-000001-{n:06d}", 1, "QC-001", "TM-001", at, at + timedelta(seconds=lag), "ACTIVE", True, load, 40.0)


def records(spark, events, first=0):
    rows = spark.createDataFrame([(*e, i + first) for i, e in enumerate(events)], decode.EVENT + ", o long")
    sent = decode.encode(rows, "telemetry").withColumn("i", F.monotonically_increasing_id())
    offsets = rows.select("o").withColumn("i", F.monotonically_increasing_id())
    return sent.join(offsets, "i").select("key", "value", "headers", "topic", F.lit(0).alias("partition"), F.col("o").alias("offset"))


def model(log, stored, mark, late=300):
    first, out = {}, []
    for key, digest, at in log:
        if key in first:
            out.append("duplicate" if first[key] == digest else "conflict")
            continue
        first[key] = digest
        if key in stored:
            out.append("duplicate" if stored[key] == digest else "conflict")
        else:
            out.append("late" if mark is not None and at < mark - timedelta(seconds=late) else "accepted")
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 2), st.integers(0, 20)), min_size=1, max_size=14), st.dictionaries(st.integers(0, 4), st.integers(0, 2), max_size=3), st.one_of(st.none(), st.integers(0, 20)))
def test_classification_model(spark, log, stored, mark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = spark.createDataFrame([((str(k), at(m)), str(d), "t", 0, i) for i, (k, d, m) in enumerate(log)], "event struct<event_id: string, ingestion_timestamp: timestamp>, digest string, topic string, partition int, offset long")
    held = spark.createDataFrame([(str(k), str(d)) for k, d in stored.items()], "event_id string, digest string")
    got = C.classify(rows, held, None if mark is None else F.lit(at(mark)))
    want = model([(str(k), str(d), at(m)) for k, d, m in log], {str(k): str(d) for k, d in stored.items()}, None if mark is None else at(mark))
    assert [r.outcome for r in got.orderBy("offset").collect()] == want


def test_equality_with_the_bound_is_on_time(spark):
    rows = spark.createDataFrame([(("a", T0), "d", "t", 0, 0), (("b", T0 - timedelta(microseconds=1)), "d", "t", 0, 1)], "event struct<event_id: string, ingestion_timestamp: timestamp>, digest string, topic string, partition int, offset long")
    got = C.classify(rows, spark.createDataFrame([], "event_id string, digest string"), F.lit(T0 + timedelta(seconds=300)))
    assert {r.event_id: r.outcome for r in got.collect()} == {"a": "accepted", "b": "late"}


def test_decode_contract(spark):
    good = records(spark, [event(1)])
    assert decode.decode(good).first().event.event_id == "evt-000001-000001"
    bad = {
        "json": good.withColumn("value", F.encode(F.lit("not-json"), "utf-8")),
        "extra": good.withColumn("value", F.encode(F.regexp_replace(F.decode("value", "utf-8"), r"^\{", '{"x":1,'), "utf-8")),
        "headers": good.withColumn("headers", F.slice("headers", 1, 1)),
        "load": records(spark, [event(1, load=101.0)]),
        "times": records(spark, [event(1, lag=-1)]),
    }
    for name, rows in bad.items():
        assert decode.decode(rows).first().event is None, name


def test_stream_end_to_end(spark, tmp_path):
    junk = records(spark, [event(9)]).withColumn("value", F.encode(F.lit("not-json"), "utf-8")).withColumn("key", F.lit(None).cast("binary"))
    go = lambda run, **more: consumer.consume(
        spark, f"{tmp_path}/log", topic="telemetry", bronze_dir=f"{tmp_path}/bronze", state_dir=f"{tmp_path}/state", checkpoint_dir=f"{tmp_path}/cp", run_id=run, **({"dead_letter_dir": f"{tmp_path}/dlq"} | more)
    )
    consumer.write_records(records(spark, [event(0), event(0), event(1, 10)]), f"{tmp_path}/log")
    first = go("r1")
    assert (first.consumed, first.bronze_rows, first.duplicates, first.dead_letters) == (3, 2, 1, 0)
    second = records(spark, [event(2, 0), event(0, load=11.0)], 3).unionByName(junk.withColumn("offset", F.lit(5).cast("long")))
    consumer.write_records(second, f"{tmp_path}/log")
    with pytest.raises(Exception, match="rejects"):
        go("r2", dead_letter_dir=None)
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/bronze/telemetry_events").count() == 2
    third = go("r3")
    assert (third.consumed, third.late, third.conflicts, third.invalid, third.dead_letters, third.bronze_rows) == (3, 1, 1, 1, 3, 0)
    consumer.write_records(records(spark, [event(2, 0), event(0)], 6), f"{tmp_path}/log")
    assert go("r4").duplicates == 2  # a late event was remembered, and the first state was kept
    letters = [__import__("json").loads(r.value) for r in spark.read.parquet(f"{tmp_path}/dlq").collect()]
    assert sorted(x["reason_code"] for x in letters) == ["duplicate_conflict", "invalid_telemetry", "late_event"]
    assert {r.run_id: r.status for r in consumer.StreamState(spark, f"{tmp_path}/state", "telemetry").runs().collect()} == {"r1": "succeeded", "r2": "failed", "r3": "succeeded", "r4": "succeeded"}
    with pytest.raises(ValueError):
        go("r1")


def _go(spark, root, run, **more):
    how = {"dead_letter_dir": f"{root}/dlq", "keyed": True} | more
    return consumer.consume(spark, f"{root}/log", topic="telemetry", bronze_dir=f"{root}/bronze", state_dir=f"{root}/state", checkpoint_dir=f"{root}/cp", run_id=run, **how)


def _held(spark, root):
    return sorted((r.event_id, r.digest) for r in keyed.stored(spark, f"{root}/cp").collect())


def _tables(spark, root):
    told = consumer.StreamState(spark, f"{root}/state", "telemetry").events()
    letters = spark.read.parquet(f"{root}/dlq").select(F.get_json_object("value", "$.source_offset").alias("o"), "reason_code")
    bronze = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/bronze/telemetry_events").select("event_id", "load_percent")
    return [sorted(map(tuple, df.collect()), key=str) for df in (told.select("event_id", "digest", "outcome"), letters, bronze)]


def _three_batches(spark, root):
    junk = records(spark, [event(9)]).withColumn("value", F.encode(F.lit("not-json"), "utf-8")).withColumn("key", F.lit(None).cast("binary"))
    consumer.write_records(records(spark, [event(0), event(0), event(1, 10), event(0, load=12.0)]), f"{root}/log")
    yield
    consumer.write_records(records(spark, [event(2, 0), event(0, load=11.0), event(0, load=11.0), event(3, 11)], 4).unionByName(junk.withColumn("offset", F.lit(8).cast("long"))), f"{root}/log")
    yield
    consumer.write_records(records(spark, [event(2, 0), event(0), event(3, 11, load=1.0)], 9), f"{root}/log")
    yield


def test_state_by_key_gives_what_tables_give(spark, tmp_path):
    for how in (True, False):
        root = f"{tmp_path}/{how}"
        reports = [_go(spark, root, f"r{i}", keyed=how) for i, _ in enumerate(_three_batches(spark, root))]
        assert [(r.bronze_rows, r.duplicates, r.conflicts, r.late, r.invalid) for r in reports] == [(2, 1, 1, 0, 0), (1, 1, 1, 1, 1), (0, 2, 1, 0, 0)]
    assert _tables(spark, f"{tmp_path}/True") == _tables(spark, f"{tmp_path}/False")
    held = consumer.StreamState(spark, f"{tmp_path}/False/state", "telemetry").events()
    assert _held(spark, f"{tmp_path}/True") == sorted((r.event_id, r.digest) for r in held.collect())


@pytest.mark.parametrize("point", consumer.WRITES)
def test_state_by_key_after_a_crash(spark, tmp_path, point):
    def crash(write, batch):
        if write == point and int(batch) == 1:
            raise RuntimeError("lost")

    for i, _ in enumerate(_three_batches(spark, f"{tmp_path}/a")):
        _go(spark, f"{tmp_path}/a", f"r{i}")
    for i, _ in enumerate(_three_batches(spark, f"{tmp_path}/b")):
        if i == 1:
            with pytest.raises(Exception, match="lost"):
                _go(spark, f"{tmp_path}/b", "crashed", after=crash)
        _go(spark, f"{tmp_path}/b", f"r{i}")
    assert _tables(spark, f"{tmp_path}/a") == _tables(spark, f"{tmp_path}/b") and _held(spark, f"{tmp_path}/a") == _held(spark, f"{tmp_path}/b")


def test_neighbours_share_a_call_to_the_state_store():
    calls = []

    class Held:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    held = Held()
    remember = keyed._Remember()
    remember.init(type("Handle", (), {"getValueState": lambda self, *_: held})())
    rows = pd.DataFrame([(f"e{i:02d}", 0, 200 - i, f"d{i}") for i in range(100)] + [("e07", 0, 1, "first")], columns=["event_id", "partition", "offset", "digest"])
    told = pd.concat(remember.handleInputRows(("e",), iter([rows[:60], rows[60:]]), None))
    assert calls == ["get", "update"] and told["stored"].isna().all() and len(told) == 101
    told = pd.concat(remember.handleInputRows(("e",), iter([rows]), None))
    assert calls == ["get", "update", "get"] and list(told["stored"])[6:8] == ["d6", "first"]


def test_a_hot_event_is_taken_in_chunks(spark, tmp_path):
    """One event is most of a batch: its first row by offset counts, whatever chunk brings it."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        hot = spark.range(200).select(F.struct(F.lit("evt-000001-000001").alias("event_id")).alias("e"), (199 - F.col("id")).alias("o"))
        one = decode.encode(spark.createDataFrame([event(1)], decode.EVENT), "telemetry")
        sent = one.crossJoin(hot.select("o")).withColumn("value", F.when(F.col("o") % 2 == 1, F.encode(F.regexp_replace(F.decode("value", "utf-8"), '"load_percent":10.0', '"load_percent":11.0'), "utf-8")).otherwise(F.col("value")))
        consumer.write_records(sent.select("key", "value", "headers", "topic", F.lit(0).alias("partition"), F.col("o").alias("offset")), f"{tmp_path}/log")
        report = _go(spark, tmp_path, "r")
        assert (report.bronze_rows, report.duplicates, report.conflicts) == (1, 99, 100)
        assert len(_held(spark, tmp_path)) == 1 and _tables(spark, tmp_path)[2] == [("evt-000001-000001", 10.0)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)



def test_a_cached_batch_keeps_the_source_of_rejects_only(spark):
    """Bytes of accepted records and repeats are not carried on; those of rejects are, as they came."""
    sent = records(spark, [event(0), event(0), event(0, load=11.0), event(1, load=101.0)])
    got = C.source_of_rejects(C.classify(decode.decode(sent), spark.createDataFrame([], "event_id string, digest string"), None)).orderBy("offset").collect()
    assert [r.outcome for r in got] == ["accepted", "duplicate", "conflict", "invalid"]
    source = sent.orderBy("offset").collect()
    assert [(r.key, r.value, r.headers) for r in got] == [(None, None, None)] * 2 + [(r.key, r.value, r.headers) for r in source[2:]]


def test_headers_and_names_in_any_order_and_no_others(spark):
    good = records(spark, [event(1)])
    text = F.decode("value", "utf-8")
    renamed = F.encode(F.regexp_replace(text, '"state"', '"stat"'), "utf-8")
    twice = F.encode(F.regexp_replace(text, r"^\{", '{"schema_version":1,'), "utf-8")
    other = F.array(F.element_at("headers", 1), F.element_at("headers", 1))
    cases = {"reversed": ("headers", F.reverse("headers"), True), "one twice": ("headers", other, False), "none": ("headers", F.lit(None).cast("array<struct<name: string, value: binary>>"), False)}
    cases |= {"ten names": ("value", renamed, False), "a name twice": ("value", twice, True), "not text": ("headers", F.transform("headers", lambda h: F.struct(h["name"].alias("name"), F.unhex(F.lit("FF")).alias("value"))), False)}
    for name, (column, value, valid) in cases.items():
        assert (decode.decode(good.withColumn(column, value)).first().event is not None) == valid, name
