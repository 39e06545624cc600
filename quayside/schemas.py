"""Registry of the canonical relations: columns, keys, references, enumerations.

Everything that validates, reads, writes or documents a table derives from here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Identifiers, enumerations and reason codes of the data contract.
ID_PATTERNS = {
    "terminal_id": r"^TM-[0-9]{3}$",
    "equipment_id": r"^[A-Z]{2,4}-[0-9]{3}$",
    "event_id": r"^evt-[0-9]{6}-[0-9]{6}$",
    "alarm_id": r"^alm-[0-9]{6}$",
    "incident_id": r"^inc-[0-9]{6}$",
    "maintenance_order_id": r"^mnt-[0-9]{6}$",
    "movement_id": r"^mov-[0-9]{6}$",
}
ENUMS = {
    "equipment_type": ("QUAY_CRANE", "RTG", "REACH_STACKER"),
    "state": ("IDLE", "ACTIVE", "WARNING", "UNAVAILABLE", "MAINTENANCE"),
    "severity": ("INFO", "WARNING", "CRITICAL", "MINOR", "MAJOR"),
    "status": ("OPEN", "RESOLVED", "PLANNED", "IN_PROGRESS", "COMPLETED"),
    "movement_type": ("GATE_IN", "GATE_OUT", "LOAD", "DISCHARGE"),
}
DOWN_STATES = ("UNAVAILABLE", "MAINTENANCE")
UP_STATES = ("IDLE", "ACTIVE", "WARNING")
ENTRY_MOVES = ("GATE_IN", "LOAD")
EXIT_MOVES = ("GATE_OUT", "DISCHARGE")
SEVERITY_RANK = {"MINOR": 1, "MAJOR": 2, "CRITICAL": 3}
REASON_CODES = ("SCHEMA_INVALID", "RANGE_INVALID", "REFERENCE_INVALID", "TEMPORAL_INVALID", "DUPLICATE_KEY")

_TEXT, _TIME = T.StringType(), T.TimestampType()
LINEAGE = (("source_table", _TEXT), ("extraction_run_id", _TEXT), ("source_updated_at", _TIME), ("extracted_at", _TIME))


@dataclass(frozen=True)
class Table:
    """One relation: its columns in order, key, references and time order."""

    name: str
    key: str
    columns: dict[str, T.DataType]
    nullable: frozenset[str] = frozenset()
    references: tuple[str, ...] = ()
    orders: tuple[tuple[str, str], ...] = ()
    descriptions: dict[str, str] = field(default_factory=dict)

    @property
    def all_columns(self) -> dict[str, T.DataType]:
        return self.columns | {"created_at": _TIME, "updated_at": _TIME}

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, t, c in self.nullable, {"description": self.descriptions.get(c, c.replace("_", " "))}) for c, t in self.all_columns.items()])

    @property
    def bronze(self) -> T.StructType:
        """The relation with lineage, all nullable: Bronze holds rows as they came."""
        return T.StructType([T.StructField(c, t, True) for c, t in (*self.all_columns.items(), *LINEAGE)])


#: The seven relations of the data contract, their columns in order.
_LIST = (
    Table("terminals", "terminal_id", {"terminal_id": _TEXT, "name": _TEXT, "timezone_name": _TEXT}),
    Table(
        "equipment",
        "equipment_id",
        {"equipment_id": _TEXT, "terminal_id": _TEXT, "equipment_type": _TEXT, "commissioning_date": T.DateType()},
        references=("terminal_id",),
    ),
    Table(
        "telemetry_events",
        "event_id",
        {
            "event_id": _TEXT,
            "schema_version": T.ShortType(),
            "equipment_id": _TEXT,
            "terminal_id": _TEXT,
            "event_timestamp": _TIME,
            "ingestion_timestamp": _TIME,
            "state": _TEXT,
            "available": T.BooleanType(),
            "load_percent": T.DecimalType(5, 2),
            "temperature_c": T.DecimalType(6, 2),
        },
        references=("equipment_id", "terminal_id"),
        orders=(("event_timestamp", "ingestion_timestamp"),),
    ),
    Table(
        "alarms",
        "alarm_id",
        {"alarm_id": _TEXT, "equipment_id": _TEXT, "severity": _TEXT, "code": _TEXT, "opened_at": _TIME, "cleared_at": _TIME},
        nullable=frozenset({"cleared_at"}),
        references=("equipment_id",),
        orders=(("opened_at", "cleared_at"),),
    ),
    Table(
        "incidents",
        "incident_id",
        {"incident_id": _TEXT, "equipment_id": _TEXT, "severity": _TEXT, "status": _TEXT, "opened_at": _TIME, "resolved_at": _TIME, "root_cause": _TEXT},
        nullable=frozenset({"resolved_at"}),
        references=("equipment_id",),
        orders=(("opened_at", "resolved_at"),),
    ),
    Table(
        "maintenance_orders",
        "maintenance_order_id",
        {"maintenance_order_id": _TEXT, "equipment_id": _TEXT, "status": _TEXT, "started_at": _TIME, "completed_at": _TIME},
        nullable=frozenset({"completed_at"}),
        references=("equipment_id",),
        orders=(("started_at", "completed_at"),),
    ),
    Table(
        "container_movements",
        "movement_id",
        {"movement_id": _TEXT, "terminal_id": _TEXT, "equipment_id": _TEXT, "movement_type": _TEXT, "container_ref": _TEXT, "event_timestamp": _TIME},
        references=("terminal_id", "equipment_id"),
    ),
)
TABLES = {t.name: t for t in _LIST}

#: Output of the KPI relation, in order.
KPI_COLUMNS = [
    "terminal_id",
    "source_period_start",
    "source_period_end",
    "available_intervals",
    "scheduled_intervals",
    "active_intervals",
    "available_time_minutes",
    "resolved_incident_count",
    "repair_minutes",
    "qualifying_failure_count",
    "operating_hours",
    "throughput",
    "average_dwell_minutes",
    "availability",
    "utilization",
    "mttr_minutes",
    "mtbf_hours",
    "active_incidents",
    "critical_alarms",
]
KPI_INTEGERS = frozenset(
    {
        "available_intervals",
        "scheduled_intervals",
        "active_intervals",
        "available_time_minutes",
        "resolved_incident_count",
        "qualifying_failure_count",
        "throughput",
        "active_incidents",
        "critical_alarms",
    }
)


def _record(required: dict[str, dict], **more: object) -> dict:
    """An object that has exactly these properties."""
    return {"type": "object", "additionalProperties": False, "required": list(required), "properties": required} | more


def _null_if_zero(count: str, value: str) -> dict:
    return {"if": {"properties": {count: {"const": 0}}}, "then": {"properties": {value: {"type": "null"}}}}


_COUNT, _AMOUNT = {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0}
_SHARE, _KNOWN_AMOUNT = {"type": ["number", "null"], "minimum": 0, "maximum": 1}, {"type": ["number", "null"], "minimum": 0}
_UTC, _FLAG = {"type": "string", "format": "date-time", "pattern": "Z$"}, {"type": "boolean"}
_ID = {c: {"type": "string", "pattern": p} for c, p in ID_PATTERNS.items()}
_STATES = {"type": "string", "enum": list(ENUMS["state"])}

# Names, types and limits of the published documents.
DOCUMENT_SCHEMAS = {
    "overview": _record(
        {
            "schema_version": {"const": 1},
            "terminal_id": _ID["terminal_id"],
            "source_period_start": _UTC,
            "source_period_end": _UTC,
            "available_intervals": _COUNT,
            "scheduled_intervals": _COUNT,
            "active_intervals": _COUNT,
            "availability": _record(
                {"available_intervals": _COUNT, "scheduled_intervals": _COUNT, "value": _SHARE},
                allOf=[
                    _null_if_zero("scheduled_intervals", "value"),
                    {"if": {"properties": {"scheduled_intervals": {"minimum": 1}}}, "then": {"properties": {"value": {"type": "number"}}}},
                ],
            ),
            "utilization": _SHARE,
            "throughput": _COUNT,
            "average_dwell_minutes": _KNOWN_AMOUNT,
            "mttr_minutes": _KNOWN_AMOUNT,
            "mtbf_hours": _KNOWN_AMOUNT,
            "resolved_incident_count": _COUNT,
            "repair_minutes": _AMOUNT,
            "qualifying_failure_count": _COUNT,
            "operating_hours": _AMOUNT,
            "active_incidents": _COUNT,
            "critical_alarms": _COUNT,
        },
        allOf=[_null_if_zero("available_intervals", "utilization"), _null_if_zero("resolved_incident_count", "mttr_minutes"), _null_if_zero("qualifying_failure_count", "mtbf_hours")],
    ),
    "equipment": _record(
        {
            "equipment_id": _ID["equipment_id"],
            "terminal_id": _ID["terminal_id"],
            "current_state": _STATES,
            "available": _FLAG,
            "availability": _SHARE,
            "utilization": _SHARE,
            "alarm_count": _COUNT,
            "downtime_minutes": _AMOUNT,
            "mttr_minutes": _KNOWN_AMOUNT,
            "mtbf_hours": _KNOWN_AMOUNT,
        }
    ),
    "incidents": _record(
        {
            "incident_id": _ID["incident_id"],
            "equipment_id": _ID["equipment_id"],
            "terminal_id": _ID["terminal_id"],
            "severity": {"type": "string", "enum": ["MINOR", "MAJOR", "CRITICAL"]},
            "status": {"type": "string", "enum": ["OPEN", "RESOLVED"]},
            "opened_at": _UTC,
            "resolved_at": {"type": ["string", "null"], "pattern": "Z$"},
            "root_cause": {"type": "string", "minLength": 1},
        }
    ),
    "event-replay": _record(
        {"event_id": _ID["event_id"], "equipment_id": _ID["equipment_id"], "terminal_id": _ID["terminal_id"], "event_timestamp": _UTC, "state": _STATES, "available": _FLAG},
    ),
    "quality": _record(
        {"bronze_rows": _COUNT, "silver_rows": _COUNT, "quarantine_rows": _COUNT, "reason_counts": {"type": "object", "additionalProperties": _COUNT}, "dbt_test_status": {"const": "PASS"}},
    ),
}
