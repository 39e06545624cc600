import json
from datetime import UTC, datetime

import pytest

from quayside.operators import kpi, presentation
from quayside.plans import benchmark, bundles, service
from quayside.sinks import catalog
from quayside.sources import generators, registry
from quayside.streaming.config import StreamConfig


def test_benchmark_engines_agree(spark, tmp_path):
    report = benchmark.run(spark, f"{tmp_path}", "smoke", warmups=0, repetitions=2)
    assert [r["engine"] for r in report["results"]] == ["spark", "duckdb"]
    benchmark.write_report(report, f"{tmp_path}/r.json")
    assert benchmark.read_report(f"{tmp_path}/r.json") == report
    with pytest.raises(ValueError, match="disagree"):
        benchmark.check_report(report | {"results": [report["results"][0], report["results"][1] | {"result_hash": "x"}]})
    assert benchmark.p95([float(i) for i in range(1, 21)]) == 19.0 and benchmark.p95([3.0]) == 3.0


def test_bundles(spark, tmp_path):
    f = generators.portability_fixture(spark)
    made = bundles.make(f, f"{tmp_path}/a")
    assert bundles.check(spark, f, f"{tmp_path}/a") == made
    bundles.make(f, f"{tmp_path}/b", pairing="sequential")
    assert bundles.compare(f"{tmp_path}/a", f"{tmp_path}/a")["reason"] == "match" and bundles.compare(f"{tmp_path}/a", f"{tmp_path}/b")["reason"] == "result_hash_mismatch"
    with pytest.raises(bundles.BundleError, match="input"):
        bundles.check(spark, f | {"alarms": f["alarms"].where("false")}, f"{tmp_path}/a")
    (tmp_path / "a/result.json").write_text("[]")
    with pytest.raises(bundles.BundleError, match="result"):
        bundles.check(spark, f, f"{tmp_path}/a")
    with pytest.raises(bundles.BundleError, match="leaves"):
        bundles.inside(f"{tmp_path}/a", "../b/result.json")


def test_registry_and_results(spark, tmp_path):
    text = json.dumps({"t": [{"name": "a", "type": "INT64", "mode": "REQUIRED"}, {"name": "b", "type": "TIMESTAMP", "mode": "NULLABLE"}]})
    made = registry.load_registry(text, ("t",))["t"]
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in made] == [("a", "bigint", False), ("b", "timestamp", True)]
    for bad in (text.replace("INT64", "INT"), text.replace('"b"', '"a"'), text.replace('"t"', '"u"')):
        with pytest.raises(ValueError):
            registry.load_registry(bad, ("t",))
    spark.range(3).createOrReplaceTempView("three")
    assert registry.render(spark, "select count(*) as n from identifier(:t)", t="three").first().n == 3
    with pytest.raises(ValueError):
        registry.render(spark, "select 1 from identifier(:t)", t="a; drop")
    f = generators.portability_fixture(spark)
    kpis = kpi.overview_kpis(f["telemetry"], f["movements"], f["incidents"], f["alarms"])
    assert registry.has_columns(kpis) and not registry.has_columns(kpis.drop("throughput"))
    row = kpis.first().asDict()
    row = {k: v.strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(v, datetime) else v for k, v in row.items()}
    (tmp_path / "r.json").write_text(json.dumps([row]))
    assert registry.read_results(spark, f"{tmp_path}/r.json").first().asDict() == kpis.first().asDict()


def test_views_tables_and_labels(spark):
    f = generators.portability_fixture(spark)
    kpis = kpi.overview_kpis(f["telemetry"], f["movements"], f["incidents"], f["alarms"])
    catalog.register({"mart_kpis": kpis, "stg_alarms": f["alarms"]}, tables=("mart_kpis",))
    assert spark.table("mart_kpis").count() == 1 and spark.table("stg_alarms").count() == 2
    catalog.create_tables(spark)
    assert spark.table("incidents").count() == 0
    label = presentation.kpi_labels(kpis).first()
    assert (label.availability, label.average_dwell, label.throughput) == ("75.0%", "30.0 min", "1")
    assert presentation.replay_labels(f["telemetry"]).orderBy("event_id").first().label == "00:00 QC-001 is ACTIVE (available)"
    view = presentation.IncidentView.from_params({"q": " x ", "severity": "odd", "sort": "severity", "dir": "asc"})
    assert (view.query, view.severity, view.sort, view.direction) == ("x", "all", "severity", "asc")
    assert presentation.EquipmentView.from_params({"sort": "nope"}).sort == "equipment_id"
    assert presentation.scope("TM-9", "a", "b", {}).label == "TM-9"


def test_stream_config():
    c = StreamConfig.from_env({"QUAYSIDE_TOPIC": "t", "QUAYSIDE_BATCH_SIZE": "7"})
    assert c.reader_options()["maxOffsetsPerTrigger"] == "7" and c.writer_options()["kafka.acks"] == "all"
    for bad in ({"topic": " "}, {"batch_size": 0}, {"dead_letter_topic": "t"}):
        with pytest.raises(ValueError):
            StreamConfig(**({"servers": "s", "topic": "t"} | bad))


def test_service(spark, tmp_path):
    assert service.status(spark)["status"] == "ok" and service.schema()["alarms"][0]["required"]
    assert service.stream_runs(spark, f"{tmp_path}/none", "t").status == "absent"
    held = generators.operational_seed(spark)
    line = '{"terminal_id":"TM-002","name":"S","timezone_name":"UTC","created_at":"2026-01-01T00:00:00Z","updated_at":"2026-01-01T00:00:00Z"}'
    merge, issues = service.import_lines(spark, "terminals", [line], held)
    assert issues.isEmpty() and merge.rows.count() == 2 and merge.inserted.count() == 1
    merge, issues = service.import_lines(spark, "terminals", [line, "x"], held)
    assert merge is None and issues.count() == 1
    r = service.Refresher(spark, f"{tmp_path}/w", f"{tmp_path}/o")
    r._lock.acquire()
    with pytest.raises(service.Busy):
        r.refresh("r1")
    assert datetime.now(UTC) and not (tmp_path / "o").exists()
