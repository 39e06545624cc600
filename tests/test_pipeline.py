import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quayside.plans import pipeline
from quayside.schemas import TABLES
from quayside.sinks import bronze, publish
from quayside.sources import generators, keyset, tables


def test_whole_path_and_rerun(spark, tmp_path):
    source = generators.operational_seed(spark)
    at = datetime(2026, 9, 3, tzinfo=UTC)
    manifest = pipeline.run(spark, source, f"{tmp_path}/work", f"{tmp_path}/out", "run-1", at)
    shown = publish.load(f"{tmp_path}/out")
    assert {v["status"] for v in shown.values()} == {"ready"}
    quality = shown["quality"]["data"]
    assert (quality["bronze_rows"], quality["silver_rows"], quality["quarantine_rows"]) == (305, 305, 0)
    over = shown["overview"]["data"]
    assert over["scheduled_intervals"] == 288 and over["throughput"] == 4 and over["mttr_minutes"] == 30.0 and over["mtbf_hours"] == 24.0
    assert over["active_incidents"] == 1 and over["critical_alarms"] == 1 and over["operating_hours"] == 24.0
    (machine,) = publish.rows(spark, f"{tmp_path}/out", "equipment", "equipment_id string, alarm_count long").collect()
    assert (machine.equipment_id, machine.alarm_count) == ("QC-001", 3)
    assert manifest["quality_status"] == quality["dbt_test_status"] == "PASS"
    # nothing new: the cursors stand at the end
    assert pipeline.extract(source, f"{tmp_path}/work/bronze", keyset.CursorStore(f"{tmp_path}/work/cursors.json"), "run-2") == 0
    assert manifest["snapshot_id"] == "run-1" and json.loads((tmp_path / "out/manifest.json").read_text()) == manifest


def test_events_beyond_one_file_are_published_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(publish, "MOST_DOCUMENTS", 100)
    monkeypatch.setattr(publish, "PART_ROWS", 50)
    source = generators.operational_seed(spark)
    at = datetime(2026, 9, 3, tzinfo=UTC)
    manifest = pipeline.run(spark, source, f"{tmp_path}/work", f"{tmp_path}/out", "run-1", at)
    want = [r.event_id for r in source["telemetry_events"].select("event_id").orderBy("event_id").collect()]
    parts = manifest["datasets"]["event-replay"]["parts"]
    assert len(want) > 100 and manifest["record_counts"]["event-replay"] == len(want) and max(x["rows"] for x in parts) <= 50
    folder = tmp_path / "out" / manifest["datasets"]["event-replay"]["path"]
    assert [json.loads(x)["event_id"] for p in parts for x in (folder / p["name"]).read_text().splitlines()] == want
    assert sorted(r.event_id for r in publish.rows(spark, f"{tmp_path}/out", "event-replay", "event_id string").collect()) == want
    # the same rows again keep the snapshot, other rows are refused
    overview = publish.load(f"{tmp_path}/out")["overview"]["data"]
    events = spark.createDataFrame([(x,) for x in want], "event_id string")
    go = lambda df: publish.publish(f"{tmp_path}/again", {"overview": overview, "event-replay": df}, snapshot_id="s", quality_status="PASS", period=("a", "b"), generated_at=at)
    assert go(events.orderBy("event_id")) == go(events.repartition(3).orderBy("event_id"))
    with pytest.raises(publish.PublishError):
        go(events.where(F.col("event_id") != want[0]))
    (folder / f".{parts[0]['name']}.crc").unlink()
    (folder / parts[0]["name"]).write_text("{}\n")
    assert publish.load(f"{tmp_path}/out")["event-replay"]["status"] == "malformed"
    with pytest.raises(publish.PublishError):
        publish.rows(spark, f"{tmp_path}/out", "event-replay", "event_id string")


def test_simulator_is_deterministic(spark):
    a, b = (generators.simulate(42, "QC-001", "TM-001", 50, datetime(2026, 1, 1, tzinfo=UTC)) for _ in range(2))
    assert a == b and a != generators.simulate(43, "QC-001", "TM-001", 50, datetime(2026, 1, 1, tzinfo=UTC))
    assert all(r["available"] == (r["state"] not in ("UNAVAILABLE", "MAINTENANCE")) for r in a)
    assert generators.simulate_fleet(spark, 1, 3, 4, datetime(2026, 1, 1, tzinfo=UTC)).count() == 12


def test_keyset_ties_and_pages(spark):
    t = datetime(2026, 1, 1, tzinfo=UTC)
    rows = spark.createDataFrame([(f"k{i:03d}", t + timedelta(minutes=i // 40)) for i in range(100)], "k string, updated_at timestamp")
    seen, cursor = [], keyset.FIRST
    while got := keyset.page(rows, "k", cursor, 37).collect():
        seen += [r.k for r in got]
        cursor = (got[-1].updated_at.replace(tzinfo=UTC), got[-1].k)
    assert seen == [f"k{i:03d}" for i in range(100)]
    by = {r.k: r.batch for r in keyset.batches(rows, "k", size=37).collect()}
    assert by == {f"k{i:03d}": i // 37 for i in range(100)}


def test_cursor_store(tmp_path):
    store, t = keyset.CursorStore(f"{tmp_path}/c.json"), datetime(2026, 1, 1, 1, 2, 3, 456, tzinfo=UTC)
    assert store.get("alarms") == keyset.FIRST
    store.put("alarms", (t, "a"))
    assert store.get("alarms") == (t, "a") and store.get("equipment") == keyset.FIRST
    with pytest.raises(ValueError):
        store.put("alarms", (t - timedelta(seconds=1), "z"))


def test_write_once(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    assert bronze.write_once(a, f"{tmp_path}/t") is True
    assert bronze.write_once(a.orderBy("b"), f"{tmp_path}/t") is False
    with pytest.raises(bronze.BronzeConflict):
        bronze.write_once(a.where("a = 1"), f"{tmp_path}/t")


def test_failed_publish_keeps_the_manifest(tmp_path):
    doc = {"terminal_id": "TM-001", "source_period_start": "a", "source_period_end": "b", "availability": {"available_intervals": 1, "scheduled_intervals": 2, "value": 0.5}}
    go = lambda name, d: publish.publish(f"{tmp_path}", {"overview": d}, snapshot_id=name, quality_status="PASS", period=("a", "b"), generated_at=datetime(2026, 1, 1, tzinfo=UTC))
    first = go("s1", doc)
    with pytest.raises(publish.PublishError):
        go("s2", doc | {"availability": {"available_intervals": 3, "scheduled_intervals": 2, "value": 1.5}})
    with pytest.raises(publish.PublishError):
        go("s1", doc | {"terminal_id": "TM-002"})
    assert json.loads((tmp_path / "manifest.json").read_text()) == first and not list(tmp_path.glob(".staging*"))


def test_empty_bronze_table_keeps_its_schema(spark, tmp_path):
    rows = tables.read_bronze(spark, f"{tmp_path}", "alarms")
    assert rows.count() == 0 and set(TABLES["alarms"].all_columns) < set(rows.columns)
    assert tables.staging(rows, "alarms").columns == list(TABLES["alarms"].all_columns)


def test_layers_are_counted_while_they_are_written(spark, tmp_path):
    """A key that a third of all rows repeat, rejected terminals, and relations without a row."""
    source = generators.operational_seed(spark)
    rows = source["telemetry_events"].withColumns({c: F.col("ingestion_timestamp") for c in ("created_at", "updated_at") if c not in source["telemetry_events"].columns})
    hot = rows.limit(1).crossJoin(spark.range(150).select(F.col("id").alias("_n"))).withColumn("updated_at", F.col("updated_at") + F.make_dt_interval(secs=F.col("_n") + 1)).drop("_n")
    at = F.lit(datetime(2026, 9, 3, tzinfo=UTC))
    wrong = rows.where(F.substring("event_id", -6, 6).cast("int") % 2 == 0).withColumn("terminal_id", F.lit("TM-999"))
    for name, df in source.items():
        bronze.bronze_rows(df, name, "run-1", at).write.parquet(f"{tmp_path}/bronze/{name}/run=run-1")
    for run, df in (("run-2", hot), ("run-3", wrong)):
        bronze.bronze_rows(df, "telemetry_events", run, at).write.parquet(f"{tmp_path}/bronze/telemetry_events/run={run}")
    n = pipeline.refine(spark, f"{tmp_path}/bronze", f"{tmp_path}/silver", f"{tmp_path}/quarantine")
    read = lambda kind: [spark.read.parquet(f"{tmp_path}/{kind}/{name}") for name in TABLES]
    rejected = read("quarantine")
    assert (n.silver_rows, n.quarantine_rows) == (sum(df.count() for df in read("silver")), sum(df.count() for df in rejected))
    assert n.bronze_rows == 305 + 150 + wrong.count()
    codes = spark.read.parquet(*[f"{tmp_path}/quarantine/{name}" for name in TABLES]).select(F.explode("reason_codes").alias("c")).groupBy("c").count()
    assert n.reason_counts == {r.c: r["count"] for r in codes.collect()} and n.reason_counts["DUPLICATE_KEY"] >= 150 and n.reason_counts["REFERENCE_INVALID"] > 0
