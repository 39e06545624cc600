"""Filters, sorts, groupings and top-k lists over published records."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import minutes_between
from ..schemas import SEVERITY_RANK


def severity_rank(c: str = "severity") -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SEVERITY_RANK.items()))[F.col(c)]


def duration_minutes() -> Column:
    """Exact minutes from opening to resolution; null while open."""
    micros = F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("opened_at").cast("timestamp"))
    return micros / F.lit(60_000_000.0)


def _matches(query: str, text: Column) -> Column:
    query = query.strip().lower()
    return F.lower(text).contains(query) if query else F.lit(True)


def _is(column: str, wanted: str) -> Column:
    return F.lit(True) if wanted in ("", "all") else F.col(column) == wanted


def filter_equipment(rows: DataFrame, query: str = "", terminal: str = "all") -> DataFrame:
    """Trimmed, case-insensitive part of the id; blank or "all" filters nothing."""
    return rows.where(_matches(query, F.col("equipment_id")) & _is("terminal_id", terminal.strip()))


def filter_incidents(rows: DataFrame, query: str = "", terminal: str = "all", severity: str = "all") -> DataFrame:
    text = F.concat_ws(" ", "incident_id", "equipment_id", "root_cause")
    return rows.where(_matches(query, text) & _is("terminal_id", terminal) & _is("severity", severity))


def sorted_rows(rows: DataFrame, by: Column, descending: bool = False, tie: str = "idx") -> DataFrame:
    """Nulls last in either direction; equal values keep the order of ``tie``."""
    return rows.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), tie)


def sort_incidents(rows: DataFrame, column: str, descending: bool = False, tie: str = "idx") -> DataFrame:
    by = {"severity": severity_rank(), "duration_minutes": duration_minutes()}.get(column, F.col(column))
    return sorted_rows(rows, by, descending, tie)


def incident_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_count"), F.count_if(F.col("status") == "OPEN").alias("open_count"), F.avg(duration_minutes()).alias("average_resolution_minutes"))


def incidents_per_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.to_date("opened_at").alias("date")).agg(F.count("*").alias("count")).orderBy("date")


def recurring_causes(rows: DataFrame) -> DataFrame:
    """Causes seen more than once, most frequent first."""
    return rows.groupBy("root_cause").agg(F.count("*").alias("count")).where("count > 1").orderBy(F.desc("count"), "root_cause")


def equipment_pulse(rows: DataFrame, k: int = 3) -> DataFrame:
    """Unavailable first, then least availability, then most downtime."""
    return rows.orderBy("available", F.col("availability").asc_nulls_last(), F.col("downtime_minutes").desc_nulls_last(), "equipment_id").limit(k)


def incident_pulse(rows: DataFrame, k: int = 3) -> DataFrame:
    """Open first, then severity, then the newest."""
    return rows.orderBy((F.col("status") == "OPEN").desc(), severity_rank().desc(), F.col("opened_at").desc(), "incident_id").limit(k)


def activity_runs(events: DataFrame, equipment_id: str | None = None) -> DataFrame:
    """First event of each run of equal (state, available) per equipment, in time order."""
    if equipment_id is not None:
        events = events.where(F.col("equipment_id") == equipment_id)
    w = W.partitionBy("equipment_id").orderBy("event_timestamp", "event_id")
    now = F.struct("state", "available")
    return events.withColumn("_before", F.lag(now).over(w)).where(F.col("_before").isNull() | (F.col("_before") != now)).drop("_before")


def incidents_of(rows: DataFrame, equipment_id: str) -> DataFrame:
    return rows.where(F.col("equipment_id") == equipment_id).orderBy(F.desc("opened_at"), "incident_id")


def lookup(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(F.col(key) == value).limit(1)


def incident_context(incidents: DataFrame, equipment: DataFrame) -> DataFrame:
    """Every incident with its equipment's current record, if there is one."""
    side = equipment.select("equipment_id", "current_state", "available", "alarm_count", "downtime_minutes")
    return incidents.join(side, "equipment_id", "left")


def value_range(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.min(column).alias("least"), F.max(column).alias("most"))


def in_scope(terminal: str, range_: str, scope: str) -> bool:
    """Whether a filter choice lies in what a snapshot holds: its terminal, and a day."""
    return terminal in ("all", scope) and range_ == "24h"


#: What a query string may choose.
CHOICES = {
    "severity": ("all", "MINOR", "MAJOR", "CRITICAL"),
    "direction": ("asc", "desc"),
    "incident_sort": ("incident_id", "opened_at", "severity", "status", "duration_minutes"),
    "equipment_sort": ("equipment_id", "terminal_id", "current_state", "availability", "utilization", "alarm_count", "downtime_minutes", "mttr_minutes", "mtbf_hours"),
}


def choose(kind: str, value: str | None, default: str) -> str:
    return value if value in CHOICES[kind] else default


def mean_repair(rows: DataFrame) -> DataFrame:
    """Mean repair minutes by severity, second boundaries counted."""
    return rows.where(F.col("status") == "RESOLVED").groupBy("severity").agg(F.avg(minutes_between("opened_at", "resolved_at")).alias("mean_repair_minutes"))
