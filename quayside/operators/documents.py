"""Relations shaped as the published documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import iso_seconds, ratio, same_number
from ..schemas import DOWN_STATES
from .kpi import INTERVAL_MINUTES


def overview(kpis: DataFrame) -> DataFrame:
    """KPI rows with text times and availability nested."""
    nested = F.struct("available_intervals", "scheduled_intervals", F.col("availability").alias("value"))
    return kpis.withColumns({"schema_version": F.lit(1), "source_period_start": iso_seconds("source_period_start"), "source_period_end": iso_seconds("source_period_end"), "availability": nested}).drop("available_time_minutes")


def current_state(telemetry: DataFrame) -> DataFrame:
    """The newest row of each equipment; of equal times that with the least event_id."""
    w = W.partitionBy("equipment_id").orderBy(F.col("event_timestamp").desc(), "event_id")
    return telemetry.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def equipment(telemetry: DataFrame, alarms: DataFrame, kpis: DataFrame | None = None) -> DataFrame:
    """Current state, alarms and downtime of each equipment, with its terminal's ratios if ``kpis`` is given."""
    newest = current_state(telemetry).select("equipment_id", "terminal_id", F.col("state").alias("current_state"), "available")
    down = telemetry.groupBy("equipment_id").agg((F.count_if(F.col("state").isin(*DOWN_STATES)) * INTERVAL_MINUTES).alias("downtime_minutes"))
    raised = alarms.groupBy("equipment_id").agg(F.count("*").alias("alarm_count"))
    out = newest.join(down, "equipment_id").join(raised, "equipment_id", "left").withColumn("alarm_count", F.coalesce("alarm_count", F.lit(0)))
    if kpis is not None:
        out = out.join(kpis.select("terminal_id", "availability", "utilization", "mttr_minutes", "mtbf_hours"), "terminal_id", "left")
    return out.orderBy("equipment_id")


def incidents_with_terminal(incidents: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Incidents with the least terminal of their equipment; those without telemetry are left out.

    Telemetry is reduced to one row per equipment before the join.
    """
    terminals = telemetry.groupBy("equipment_id").agg(F.min("terminal_id").alias("terminal_id"))
    return incidents.drop("terminal_id").join(terminals, "equipment_id")


def incidents(rows: DataFrame) -> DataFrame:
    times = {"opened_at": iso_seconds("opened_at"), "resolved_at": iso_seconds("resolved_at")}
    return rows.withColumns(times).select("incident_id", "equipment_id", "terminal_id", "severity", "status", "opened_at", "resolved_at", "root_cause").orderBy("incident_id")


def replay_events(telemetry: DataFrame) -> DataFrame:
    return telemetry.select("event_id", "equipment_id", "terminal_id", iso_seconds("event_timestamp").alias("event_timestamp"), "state", "available").orderBy("event_id")


def layer_counts(relations: dict[str, DataFrame], telemetry: DataFrame) -> DataFrame:
    """Rows of each relation and the distinct equipment and terminals of telemetry, (relation, row_count)."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("relation"), "row_count") for name, df in relations.items()]
    parts += [telemetry.agg(F.count_distinct(c).alias("row_count")).select(F.lit(f"distinct_{c}").alias("relation"), "row_count") for c in ("equipment_id", "terminal_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kpi_violations(kpis: DataFrame) -> DataFrame:
    """KPI rows that contradict themselves; none is the passing case."""
    counts = (F.col("available_intervals") > F.col("scheduled_intervals")) | (F.col("active_intervals") > F.col("scheduled_intervals")) | (F.col("scheduled_intervals") < 0)
    outside = lambda c: F.coalesce(~F.col(c).between(0, 1), F.lit(False))
    ratios = ~same_number("availability", ratio("available_intervals", "scheduled_intervals")) | ~same_number("utilization", ratio("active_intervals", "available_intervals"))
    period = F.col("source_period_end") < F.col("source_period_start")
    return kpis.where(counts | outside("availability") | ratios | period)


def health(quality: DataFrame, age_hours: float, stale_after_hours: float = 24.0) -> DataFrame:
    """Status of quality rows (bronze_rows, silver_rows, quarantine_rows, rejected, test_status).

    Failed tests come first, then layers, then reasons, then age; an age at the
    limit is not stale.
    """
    layers = F.col("bronze_rows") == F.col("silver_rows") + F.col("quarantine_rows")
    reasons = F.col("rejected") == F.col("quarantine_rows")
    status = (
        F.when(F.col("test_status") != "PASS", "invalid").when(~layers, "invalid").when(~reasons, "invalid").when(F.greatest(F.lit(0.0), F.lit(age_hours)) > stale_after_hours, "stale").otherwise("healthy")
    )
    return quality.select("*", layers.alias("layers_valid"), reasons.alias("reasons_valid"), status.alias("health_status"))
