from datetime import datetime

import pytest

from quayside import adapters
from quayside.operators import documents, kpi, verify
from quayside.schemas import KPI_COLUMNS
from quayside.sources import generators


def test_portability_fixture(spark):
    f = generators.portability_fixture(spark)
    kpis = kpi.overview_kpis(f["telemetry"], f["movements"], f["incidents"], f["alarms"])
    assert tuple(kpis.columns) == tuple(KPI_COLUMNS)
    r = kpis.first()
    assert (r.scheduled_intervals, r.available_intervals, r.active_intervals, r.available_time_minutes) == (4, 3, 2, 15)
    assert (r.resolved_incident_count, r.repair_minutes, r.qualifying_failure_count) == (1, 10.0, 1)
    assert (r.throughput, r.average_dwell_minutes, r.availability) == (1, 30.0, 0.75)
    assert r.utilization == pytest.approx(2 / 3) and r.mttr_minutes == 10 and r.mtbf_hours == pytest.approx(1 / 3)
    assert (r.active_incidents, r.critical_alarms) == (1, 1)
    assert documents.kpi_violations(kpis).isEmpty()


def test_sequential_pairing_differs_from_minmax(spark):
    f = generators.portability_fixture(spark)
    mean = lambda p: kpi.movement_metrics(kpi.movement_pairs(f["movements"], p)).first().average_dwell_minutes
    assert mean("minmax") == 30.0 and mean("sequential") == 15.0


def test_empty_denominators_are_null(spark):
    f = generators.portability_fixture(spark)
    none = f["telemetry"].where("false")
    assert kpi.overview_kpis(none, f["movements"], f["incidents"], f["alarms"]).count() == 0
    assert kpi.availability(none).first().value is None
    assert set(kpi.case_kpis(0, 0, 0, 0.0, 0, 0.0, 0).values()) == {None}
    assert kpi.case_kpis(3, 4, 2, 30.0, 1, 8.0, 2) == {"availability": 0.75, "utilization": 2 / 3, "mttr_minutes": 30.0, "mtbf_hours": 4.0}


def test_attribution_by_equipment(spark):
    f = generators.portability_fixture(spark)
    other = f["telemetry"].selectExpr("replace(event_id, 'evt-000001', 'evt-000002') event_id", "'QC-002' equipment_id", "'TM-002' terminal_id", "event_timestamp", "state", "available", "load_percent", "temperature_c")
    t = f["telemetry"].unionByName(other)
    moved = f["incidents"].selectExpr("incident_id", "'QC-002' equipment_id", "severity", "status", "opened_at", "resolved_at", "root_cause")
    by = lambda a: {r.terminal_id: r.resolved_incident_count for r in kpi.overview_kpis(t, f["movements"], moved, f["alarms"], attribution=a).collect()}
    assert by("reference") == {"TM-001": 1, "TM-002": 0} and by("equipment") == {"TM-001": 0, "TM-002": 1}


def test_plan_shapes(spark, capsys):
    from quayside.plans.catalogue import QUERIES

    QUERIES["telemetry_state_summary"](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
    QUERIES["incident_pulse_top3"](spark, "/root/testdata/sf0.001").explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_compare(spark):
    f = generators.portability_fixture(spark)["telemetry"]
    assert verify.compare(f, f.orderBy("state")) == "match"
    assert verify.compare(f, f.where("state <> 'IDLE'")) == "row_count_mismatch"
    assert verify.compare(f, f.withColumn("state", f.event_id)) == "result_hash_mismatch"
    assert verify.compare(f, f.drop("state")) == "schema_mismatch"
    assert verify.result_hash(f) == verify.result_hash(f.orderBy("state"))


@pytest.mark.parametrize("attribution", ["reference", "equipment"])
def test_no_join_broadcasts_incidents_or_alarms(spark, attribution):
    """Joins have equal keys, and incidents and alarms are never the built side of one."""
    sf = "/root/testdata/sf0.001"
    read = (adapters.telemetry, adapters.movements, adapters.incidents, adapters.alarms)
    df = kpi.overview_kpis(*(f(spark, sf) for f in read), attribution=attribution)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_alarms_at_the_ends_of_a_period(spark):
    """Whole hours are counted by the hour, the first and last hour one by one, both ends included."""
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    telemetry = [("TM-001", "QC-001", at(1, 30)), ("TM-001", "QC-001", at(5, 10)), ("TM-002", "QC-002", at(3, 15)), ("TM-002", "QC-002", at(3, 45)), ("TM-003", "QC-003", at(2, 50)), ("TM-003", "QC-003", at(3, 5))]
    opened = [at(h, m) for h in range(7) for m in (0, 5, 10, 15, 29, 30, 45, 50, 59)]
    t = spark.createDataFrame([(*r, "ACTIVE", True) for r in telemetry], "terminal_id string, equipment_id string, event_timestamp timestamp, state string, available boolean")
    a = spark.createDataFrame([("QC-001", "CRITICAL", o) for o in opened] * 2 + [("QC-001", "INFO", at(4, 0)), ("QC-001", "CRITICAL", None)], "equipment_id string, severity string, opened_at timestamp")
    got = {r.terminal_id: r.critical_alarms for r in kpi.alarm_metrics(a, t).collect()}
    ends = {"TM-001": (at(1, 30), at(5, 10)), "TM-002": (at(3, 15), at(3, 45)), "TM-003": (at(2, 50), at(3, 5))}
    assert got == {k: 2 * sum(s <= o <= e for o in opened) for k, (s, e) in ends.items()}
