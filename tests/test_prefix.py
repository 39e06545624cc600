"""Global ranks, ticks of a replay, digest trees and batches of imports against plain Python."""

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from quayside.operators import prefix, replay, verify
from quayside.sources import keyset, records

T0 = datetime(2026, 1, 1, tzinfo=UTC)


def test_ranks_over_ranges_with_ties_and_nulls(spark):
    rows = [(i * 7919 % 5000 if i % 50 else None, i) for i in range(5000)]
    got = prefix.ranked(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.rank)] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    same = prefix.ranked(spark.createDataFrame([(1,)] * 50, "a long"), "a")
    assert sorted(r.rank for r in same.collect()) == list(range(50))
    assert prefix.ranked(spark.createDataFrame([], "a long"), "a").count() == 0


def test_no_range_holds_over_its_share(spark):
    """All rows in one hour, even at one time: ranges split by key."""
    rows = spark.range(20_000).select(F.lit(T0).alias("updated_at"), F.format_string("k%06d", "id").alias("k"))
    ranges = rows.repartitionByRange(4, "updated_at", "k").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 8000
    got = keyset.batches(rows, "k", size=37).groupBy("batch").agg(F.count("*").alias("n"), F.min("k").alias("k")).orderBy("batch").collect()
    assert [r.n for r in got] == [37] * 540 + [20] and got[3].k == "k000111"


def test_ticks_show_what_the_clock_shows(spark):
    times = [T0 + timedelta(seconds=s) for s in (0, 0, 5, 6, 6, 6, 20, 31)]
    events = spark.createDataFrame([(t,) for t in times], "event_timestamp timestamp")
    got = replay.as_of(replay.ticks(events, 4000), events, "speed", "tick").collect()
    for speed in replay.SPEEDS:
        clock, own = replay.Clock(tuple(times), speed=speed).start(), sorted((r for r in got if r.speed == speed), key=lambda r: r.tick)
        for r in own:
            assert (r.applied, r.last_applied.replace(tzinfo=UTC), r.complete) == (clock.applied, max(t for t in times[: clock.applied]), clock.status == "complete"), (speed, r)
            clock = clock.tick(4000)
        assert own[-1].complete and not any(r.complete for r in own[:-1])
    none = events.limit(0)
    assert replay.as_of(replay.ticks(none, 4000), none, "speed", "tick").count() == 0


def test_tree_levels_add_up_and_differences_are_named(spark):
    rows = [(i, None if i % 9 == 0 else i / 7, f"t{i % 5}") for i in range(3000)]
    left = spark.createDataFrame(rows, "k long, x double, t string")
    leaves = verify.digest_tree(left, "k")
    root = leaves
    for _ in range(verify.LEAF_BITS // verify.NODE_BITS):
        root = verify.above(root)
    assert [(r.node, r.rows) for r in root.collect()] == [(0, 3000)]
    changed = [(k, 1.5 if k == 17 else x, t) for k, x, t in rows if k not in (5, 6)] + [(9999, 0.0, "n"), (42, 6.0, "t2")]
    right = spark.createDataFrame(changed, "k long, x double, t string").repartition(3)
    assert verify.differing_nodes(leaves, verify.digest_tree(left.repartition(5), "k")).count() == 0
    got = {(r.k, r.problem) for r in verify.differences(left, right, "k").collect()}
    assert got == {(5, "missing_right"), (6, "missing_right"), (9999, "missing_left"), (17, "changed"), (42, "changed")}


def test_keys_repeat_inside_a_batch_only(spark):
    row = '{"alarm_id": "alm-%06d"}'
    lines = spark.createDataFrame([(i, i // 4, row % (i % 4 % 3)) for i in range(8)], "row_index long, batch long, raw string")
    known = {"equipment_id": spark.createDataFrame([], "equipment_id string")}
    found = lambda **how: sorted(r.row_index for r in records.import_issues(lines, "alarms", known, **how).where("problem = 'repeated in this batch'").collect())
    assert found(batch="batch") == [3, 7]
    assert found() == [3, 4, 5, 6, 7]
