from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.operators import documents, explore, observe, replay
from quayside.sinks import upsert
from quayside.sources import records

T0 = datetime(2026, 1, 1, tzinfo=UTC)


def test_nulls_stay_last_both_ways_and_ties_are_stable(spark):
    rows = spark.createDataFrame([(0, None), (1, 2.0), (2, 1.0), (3, 2.0)], "idx int, v double")
    order = lambda d: [r.idx for r in explore.sorted_rows(rows, F.col("v"), d).collect()]
    assert order(False) == [2, 1, 3, 0] and order(True) == [1, 3, 2, 0]


def test_incident_views(spark):
    rows = spark.createDataFrame([("i1", "QC-001", "MINOR", "RESOLVED", T0, T0 + timedelta(minutes=60), "a"), ("i2", "QC-001", "CRITICAL", "OPEN", T0, None, "a"), ("i3", "QC-002", "MAJOR", "RESOLVED", T0 + timedelta(days=1), T0 + timedelta(days=1, minutes=90), "b")], "incident_id string, equipment_id string, severity string, status string, opened_at timestamp, resolved_at timestamp, root_cause string")
    r = explore.incident_summary(rows).first()
    assert (r.total_count, r.open_count, r.average_resolution_minutes) == (3, 1, 75.0)
    assert [(x.root_cause, x["count"]) for x in explore.recurring_causes(rows).collect()] == [("a", 2)]
    assert [x.incident_id for x in explore.incident_pulse(rows).collect()] == ["i2", "i3", "i1"]
    assert [x.incident_id for x in explore.sort_incidents(rows, "severity", True, "incident_id").collect()] == ["i2", "i3", "i1"]
    assert [x["count"] for x in explore.incidents_per_day(rows).collect()] == [2, 1]


def test_equipment_pulse_order(spark):
    rows = spark.createDataFrame([("a", True, None, 5), ("b", True, 0.5, None), ("c", True, 0.5, 9), ("d", False, 0.9, 1)], "equipment_id string, available boolean, availability double, downtime_minutes long")
    assert [r.equipment_id for r in explore.equipment_pulse(rows).collect()] == ["d", "c", "b"]


def test_activity_runs(spark):
    e = [("QC-001", f"e{i}", T0 + timedelta(minutes=i), s, s != "D") for i, s in enumerate("AABBAD")]
    rows = spark.createDataFrame(e, "equipment_id string, event_id string, event_timestamp timestamp, state string, available boolean")
    assert [r.event_id for r in explore.activity_runs(rows, "QC-001").orderBy("event_id").collect()] == ["e0", "e2", "e4", "e5"]


def test_health(spark):
    rows = spark.createDataFrame([(10, 9, 1, 1, "PASS"), (10, 9, 1, 1, "FAIL"), (10, 9, 0, 0, "PASS"), (10, 9, 1, 2, "PASS")], "bronze_rows long, silver_rows long, quarantine_rows long, rejected long, test_status string")
    state = lambda age: [r.health_status for r in documents.health(rows, age).collect()]
    assert state(24.0) == ["healthy", "invalid", "invalid", "invalid"] and state(24.1)[0] == "stale" and state(-5.0)[0] == "healthy"


def test_replay_clock():
    t = tuple(T0 + timedelta(seconds=s) for s in (0, 0, 10, 20))
    c = replay.Clock(t).start()
    assert (c.applied, c.status) == (2, "running")
    assert c.at_speed(2.0).tick(5000).applied == 3 and c.at_speed(3.0).speed == 1.0
    end = c.tick(60_000)
    assert (end.status, end.now, end.applied) == ("complete", t[-1], 4)
    assert c.pause().tick(1000) == c.pause() and replay.Clock(()).start().status == "idle"


def test_run_metrics_and_text(spark):
    schema = "run_id string, status string, started_at timestamp, finished_at timestamp, consumed long, bronze_rows long, committed_batches long, duplicates long, late long, dead_letters long, error_message string"
    rows = spark.createDataFrame([("a", "succeeded", T0, T0 + timedelta(seconds=5), 3, None, 1, 0, 0, 0, None), ("b", "failed", T0, T0 - timedelta(seconds=5), 1, 1, 1, 0, 0, 0, " x \n y ")], schema)
    r = observe.run_metrics(rows, F.lit(T0)).first().asDict()
    assert (r["runs_failed"], r["consumed_total"], r["bronze_rows_total"], r["last_run_id"], r["last_run_duration_seconds"]) == (1, 4, 1, "b", 0.0)
    assert "# TYPE quayside_stream_consumed_total counter\nquayside_stream_consumed_total 4\n" in observe.prometheus(r)
    assert [x.error_message for x in observe.run_history(rows).collect()] == ["x y", None]


def test_scalars(spark):
    r = spark.range(1).select(
        S.parse_utc(F.lit("2026-01-01T00:00:00Z")).alias("a"), S.parse_utc(F.lit("2026-01-01T00:00:00+02:00")).alias("b"), S.iso_micros(F.lit(T0)).alias("c"), S.percent_label(F.lit(0.5)).alias("d"),
        S.count_label(F.lit(None)).alias("e"), S.duration_label(F.lit(125)).alias("f"), S.base64_line(F.encode(F.lit("x" * 100), "utf-8")).alias("g"), S.event_key(F.lit(1234567)).alias("h"),
        S.seconds_between(F.lit(T0 + timedelta(seconds=0.9)), F.lit(T0 + timedelta(seconds=1.1))).alias("i"), S.round_half_even(F.lit(2.5), 0).alias("j"), S.cursor_slug(F.lit(T0), F.lit("k")).alias("k"),
    ).first()
    assert r.a is not None and r.b is None and r.c == "2026-01-01T00:00:00.000000Z" and r.d == "50.0%" and r.e == "Unavailable" and r.f == "2m 5s"
    assert "\n" not in r.g and r.h == "evt-000001-234567" and r.i == 1 and r.j == 2.0 and r.k == "20260101T000000.000000Z-k"


def test_import_issues(spark):
    good = '{"terminal_id":"TM-001","name":"N","timezone_name":"UTC","created_at":"2026-01-01T00:00:00Z","updated_at":"2026-01-01T00:00:00Z"}'
    rows = records.records(spark, [good, good, "nope", good.replace("TM-001", "TM-1"), good.replace('"name":"N"', '"nom":"N"'), good.replace("00:00:00Z\"}", "00:00:00\"}")])
    got = sorted((r.row_index, r.field, r.problem) for r in records.import_issues(rows, "terminals", {}).collect())
    assert got == [
        (1, "terminal_id", "repeated in this batch"), (2, "", "not a JSON object"), (3, "terminal_id", "not a valid string"), (4, "name", "missing field"), (4, "nom", "unknown field"),
        (4, "terminal_id", "repeated in this batch"), (5, "terminal_id", "repeated in this batch"), (5, "updated_at", "not a valid timestamp"),
    ]


def test_import_issues_parses_a_row_once(spark):
    """No rule, join or explosion moves below the parser, where each would parse the row again for each field."""
    plan = records.import_issues(records.records(spark, ['{"terminal_id":"TM-001"}']), "terminals", {})._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "problems" in plan


def test_upsert(spark, tmp_path):
    held, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    m = upsert.merge(held, new, "k")
    assert sorted(map(tuple, m.rows.collect())) == [(1, "a"), (2, "c"), (3, "d")] and tuple(upsert.counts(m).first()) == (1, 1)
    assert spark.read.parquet(upsert.write_merged(m, f"{tmp_path}", 1)).count() == 3
