"""Texts and choices a reader of the relations meets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_label, minutes_label, percent_label
from .explore import choose


def kpi_labels(kpis: DataFrame) -> DataFrame:
    """KPI figures as texts; a null reads Unavailable."""
    return kpis.select(
        "terminal_id",
        percent_label("availability").alias("availability"),
        percent_label("utilization").alias("utilization"),
        count_label("throughput").alias("throughput"),
        minutes_label("average_dwell_minutes").alias("average_dwell"),
        minutes_label("mttr_minutes").alias("mttr"),
    )


def replay_labels(events: DataFrame) -> DataFrame:
    text = F.format_string("%s %s is %s (%s)", F.date_format("event_timestamp", "HH:mm"), "equipment_id", "state", F.when(F.col("available"), "available").otherwise("not available"))
    return events.select("event_id", text.alias("label"))


@dataclass(frozen=True)
class Scope:
    """What a snapshot covers: its terminal, a label for it, and its period."""

    terminal: str
    label: str
    period: str


def scope(terminal: str, start: str, end: str, names: Mapping[str, str]) -> Scope:
    return Scope(terminal, names.get(terminal, terminal), f"{start} to {end}")


@dataclass(frozen=True)
class IncidentView:
    """An incident list's choices; anything outside the allowed ones falls back to its default."""

    query: str = ""
    terminal: str = "all"
    severity: str = "all"
    sort: str = "opened_at"
    direction: str = "desc"

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> IncidentView:
        return cls(params.get("q", "").strip(), params.get("terminal", "all"), choose("severity", params.get("severity"), "all"), choose("incident_sort", params.get("sort"), "opened_at"), choose("direction", params.get("dir"), "desc"))


@dataclass(frozen=True)
class EquipmentView:
    query: str = ""
    terminal: str = "all"
    sort: str = "equipment_id"
    direction: str = "asc"

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> EquipmentView:
        return cls(params.get("q", "").strip(), params.get("terminal", "all"), choose("equipment_sort", params.get("sort"), "equipment_id"), choose("direction", params.get("dir"), "asc"))
