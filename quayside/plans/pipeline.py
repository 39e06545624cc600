"""The batch path: source relations to Bronze, Silver, Gold and a published snapshot."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import iso_seconds
from ..operators import documents, kpi, silver
from ..schemas import DOCUMENT_SCHEMAS, TABLES
from ..sinks import bronze as bronze_sink
from ..sinks import publish
from ..sources import keyset, tables


class PipelineError(RuntimeError):
    """A stage failed; what was published before stays."""


@dataclass(frozen=True)
class Layers:
    bronze_rows: int
    silver_rows: int
    quarantine_rows: int
    reason_counts: dict[str, int]


def extract(source: dict[str, DataFrame], bronze_dir: str, cursors: keyset.CursorStore, run_id: str, batch_size: int = 1000) -> int:
    """Drains every table from its cursor into Bronze, then moves the cursor."""
    total = 0
    for name, rows in source.items():
        spec = TABLES[name]
        new = keyset.batches(rows, spec.key, cursors.get(name), batch_size)
        last = rows.where(keyset.after("updated_at", spec.key, cursors.get(name))).agg(F.max(F.struct("updated_at", spec.key)).alias("m")).first()["m"]
        if last is None:
            continue
        total += bronze_sink.write_batches(new, name, bronze_dir, run_id)
        at = last["updated_at"]
        cursors.put(name, (at.replace(tzinfo=UTC) if at.tzinfo is None else at, last[spec.key]))
    return total


def refine(spark: SparkSession, bronze_dir: str, silver_dir: str, quarantine_dir: str) -> Layers:
    """Bronze to Silver and quarantine; fails if a row got lost on the way."""
    return refined(spark, {name: tables.read_bronze(spark, bronze_dir, name) for name in TABLES}, silver_dir, quarantine_dir)


def refined(spark: SparkSession, raw: dict[str, DataFrame], silver_dir: str, quarantine_dir: str, references: dict[str, DataFrame] | None = None) -> Layers:
    """As ``refine``, from Bronze rows by table, and identifiers that they may refer to if not those of ``raw``.

    Each table is judged once, into a folder under Silver that the next run replaces.
    Rows of Silver and quarantine are counted by the tasks that write them; Bronze is
    counted apart, from its files, so that the balance is no tautology.
    """

    def keep(name: str, judged: DataFrame) -> DataFrame:
        to = f"{silver_dir}/_judged/{name}"
        judged.write.mode("overwrite").parquet(to)
        return spark.read.schema(judged.schema).parquet(to)

    n = good = held = 0
    reasons: Counter[str] = Counter()
    for name, (accepted, rejected) in silver.transform(raw, keep, references).items():
        good += bronze_sink.write_silver(accepted, name, silver_dir)
        bad, codes = bronze_sink.write_quarantine(rejected, name, quarantine_dir)
        held += bad
        reasons.update(codes)
        n += raw[name].count()
    if n != good + held:
        raise PipelineError(f"Bronze has {n} rows, Silver and quarantine {good} + {held}")
    return Layers(n, good, held, dict(reasons))


def gold(spark: SparkSession, silver_dir: str, attribution: kpi.Attribution = "reference", pairing: kpi.Pairing = "minmax") -> dict[str, DataFrame]:
    """Typed Silver relations and the KPI relation."""
    out = {name: tables.staging(spark.read.parquet(f"{silver_dir}/{name}"), name) for name in TABLES}
    out["overview_kpis"] = kpi.overview_kpis(out["telemetry_events"], out["container_movements"], out["incidents"], out["alarms"], attribution, pairing)
    return out


def export(relations: dict[str, DataFrame], layers: Layers, out_dir: str, snapshot_id: str, generated_at: datetime | None = None) -> dict:
    """Publishes the five datasets, incidents and events in parts; the quality document has the true counts."""
    kpis = relations["overview_kpis"].persist()
    try:
        status = "PASS" if documents.kpi_violations(kpis).isEmpty() else "FAIL"
        if status == "FAIL":
            raise PipelineError("the KPI relation contradicts itself")
        balanced = "PASS" if layers.bronze_rows == layers.silver_rows + layers.quarantine_rows else "FAIL"
        telemetry = relations["telemetry_events"]
        period = kpis.agg(iso_seconds(F.min("source_period_start")).alias("a"), iso_seconds(F.max("source_period_end")).alias("b")).first()
        overviews = publish.documents(documents.overview(kpis).orderBy("terminal_id"))
        datasets = {
            "overview": overviews[0] if len(overviews) == 1 else overviews,
            "equipment": documents.equipment(telemetry, relations["alarms"], kpis),
            "incidents": documents.incidents(documents.incidents_with_terminal(relations["incidents"], telemetry)),
            "event-replay": documents.replay_events(telemetry),
            "quality": {"bronze_rows": layers.bronze_rows, "silver_rows": layers.silver_rows, "quarantine_rows": layers.quarantine_rows, "reason_counts": layers.reason_counts, "dbt_test_status": status},
        }
        return publish.publish(out_dir, datasets, snapshot_id=snapshot_id, quality_status=balanced, period=(period["a"], period["b"]), generated_at=generated_at, schemas=DOCUMENT_SCHEMAS)
    finally:
        kpis.unpersist()


def run(spark: SparkSession, source: dict[str, DataFrame], work_dir: str, out_dir: str, run_id: str, generated_at: datetime | None = None) -> dict:
    """The whole path over source relations; returns the manifest."""
    stage = "extract"
    try:
        extract(source, f"{work_dir}/bronze", keyset.CursorStore(f"{work_dir}/cursors.json"), run_id)
        stage = "refine"
        layers = refine(spark, f"{work_dir}/bronze", f"{work_dir}/silver", f"{work_dir}/quarantine")
        stage = "gold"
        relations = gold(spark, f"{work_dir}/silver")
        stage = "export"
        return export(relations, layers, out_dir, run_id, generated_at)
    except PipelineError:
        raise
    except Exception as error:
        raise PipelineError(f"stage {stage} failed: {error}") from error
