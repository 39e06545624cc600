"""The message log: commits, offsets, bounds, restarts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.sources import log
from quayside.streaming import consumer, decode
from test_stream import event


def messages(spark, first, n, keyed=True):
    key = F.encode(F.col("id").cast("string"), "utf-8") if keyed else F.lit(None).cast("binary")
    header = F.array(F.struct(F.lit("h").alias("name"), F.encode(F.lit("x"), "utf-8").alias("value")))
    return spark.range(first, first + n).select(key.alias("key"), F.encode(F.concat(F.lit("v"), F.col("id")), "utf-8").alias("value"), header.alias("headers"), F.lit("t").alias("topic"))


def batches(spark, folder, name, **bound):
    got = []
    rows = log.stream(spark, f"{folder}/log", f"{folder}/{name}-planned", **bound)
    query = rows.writeStream.foreachBatch(lambda df, i: got.append(df.select("partition", "offset").collect())).option("checkpointLocation", f"{folder}/{name}-offsets").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [[tuple(r) for r in b] for b in got]


def test_offsets_are_dense_and_values_return(spark, tmp_path):
    for first in (0, 100, 200):
        log.append(messages(spark, first, 40), f"{tmp_path}/log", partitions=3)
    rows = log.read(spark, f"{tmp_path}/log").collect()
    assert sorted(r.value.decode() for r in rows) == sorted(f"v{i}" for a in (0, 100, 200) for i in range(a, a + 40))
    for p in {r.partition for r in rows}:
        own = sorted(r.offset for r in rows if r.partition == p)
        assert own == list(range(len(own)))
    assert rows[0].headers[0].name == "h" and rows[0].topic == "t"
    log.append(messages(spark, 0, 3, keyed=False), f"{tmp_path}/log", partitions=3)
    assert log.read(spark, f"{tmp_path}/log").where("key is null").count() == 3


def test_parts_without_a_commit_do_not_exist(spark, tmp_path):
    """What a task that ran twice, or a failed write, leaves behind is never read."""
    log.append(messages(spark, 0, 10), f"{tmp_path}/log", partitions=2)
    writer = log._Writer(f"{tmp_path}/log")
    batch = pa.table({"key": [b"k"], "value": [b"v"], "headers": pa.array([[]], log._HEADERS), "topic": ["t"], "partition": pa.array([0], pa.int32()), "offset": pa.array([0], pa.int64())}).to_batches()
    twice = [writer.write(iter(batch)), writer.write(iter(batch))]
    assert log.read(spark, f"{tmp_path}/log").count() == 10
    writer.commit([twice[1], None])
    assert log.read(spark, f"{tmp_path}/log").count() == 11
    writer.abort([twice[0]])
    assert log.read(spark, f"{tmp_path}/log").count() == 11


def test_bounds_by_messages_and_commits(spark, tmp_path):
    assert not any(batches(spark, tmp_path, "none", messages=10))
    for first, n in ((0, 30), (30, 5), (35, 25)):
        log.append(messages(spark, first, n).withColumn("partition", (F.decode("key", "utf-8").cast("int") % 2).cast("int")), f"{tmp_path}/log", by="value")
    by_messages = batches(spark, tmp_path, "m", messages=14)
    assert [len(b) for b in by_messages][:4] == [14, 14, 14, 14] and sum(map(len, by_messages)) == 60
    assert len({x for b in by_messages for x in b}) == 60
    assert [len(b) for b in batches(spark, tmp_path, "c", commits=1)] == [30, 5, 25]
    assert [len(b) for b in batches(spark, tmp_path, "all")] == [60]
    # a restarted stream goes on where it stood
    assert [len(b) for b in batches(spark, tmp_path, "r", messages=20, run_limit=33)] == [20, 13]
    assert sum(len(b) for b in batches(spark, tmp_path, "r", messages=20)) == 27
    assert batches(spark, tmp_path, "r", messages=20) == []


def test_tasks_are_ranges_of_offsets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "TASK_MESSAGES", 7)
    parts = [log.Part(0, 0, 20, "a"), log.Part(1, 0, 3, "b"), log.Part(0, 20, 10, "c")]
    got = [(r.part.file, r.start, r.end) for r in log._ranges(parts, {0: 4}, {0: 25, 1: 3})]
    assert got == [("a", 4, 11), ("a", 11, 18), ("a", 18, 20), ("b", 0, 3), ("c", 20, 25)]


def test_consumer_bounds_and_fewer_messages(spark, tmp_path):
    rows = spark.createDataFrame([event(i, i) for i in range(10)], decode.EVENT)
    log.append(decode.encode(rows, "telemetry"), f"{tmp_path}/log", partitions=2)
    go = lambda run, **more: consumer.consume_log(spark, f"{tmp_path}/log", checkpoint_dir=f"{tmp_path}/cp", topic="telemetry", bronze_dir=f"{tmp_path}/bronze", state_dir=f"{tmp_path}/state", dead_letter_dir=f"{tmp_path}/dead", run_id=run, allowed_lateness_seconds=10_000, **more)
    first = go("r1", messages=4, max_messages=6)
    assert (first.consumed, first.committed_batches, first.bronze_rows) == (6, 2, 6)
    with pytest.raises(consumer.FewerMessages, match="4 of 5"):
        go("r2", messages=100, max_messages=5)
    state = consumer.StreamState(spark, f"{tmp_path}/state", "telemetry")
    assert state.events().count() == 10
    assert {r.run_id: (r.status, r.consumed) for r in state.runs().collect()} == {"r1": ("succeeded", 6), "r2": ("failed", 4)}


def test_a_partition_is_written_by_several_tasks_in_order(spark, tmp_path):
    """Ranges of a partition are parts of their own, and offsets follow the order over all of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log.append(messages(spark, 0, 400), f"{tmp_path}/log", partitions=1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    (parts,) = log.Folder(f"{tmp_path}/log").commits()
    assert len(parts) > 1 and sum(p.count for p in parts) == 400
    keys = [r.key for r in log.read(spark, f"{tmp_path}/log").orderBy("offset").collect()]
    assert len(keys) == 400 and keys == sorted(keys)


def test_rows_become_messages_in_the_tasks_that_write_them(spark, tmp_path, monkeypatch):
    """Rows are dealt, sampled and sorted before they are messages; nothing is written but the log, which is as before."""
    events = spark.createDataFrame([event(i, i) for i in range(50)], decode.EVENT)
    log.append(decode.encode(events, "telemetry"), f"{tmp_path}/a", partitions=3)
    monkeypatch.setattr(log, "written", lambda df: pytest.fail("messages were written before they were sorted"))
    log.append(events.withColumn("key", F.encode("event_id", "utf-8")), f"{tmp_path}/b", partitions=3, encode=lambda rows: decode.encode(rows, "telemetry", "partition"))
    a, b = (sorted((r.partition, r.offset, bytes(r.key), bytes(r.value)) for r in log.read(spark, f"{tmp_path}/{x}").collect()) for x in "ab")
    assert len(a) == 50 and a == b
