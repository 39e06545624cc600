"""Deterministic data: a telemetry simulator, the benchmark fixture, small fixtures."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import event_key, padded
from ..schemas import ENUMS, TABLES, UP_STATES

STEP = timedelta(minutes=5)
#: Chances of the next state, by present state; each row sums to 1.
MOVES = {
    "IDLE": {"IDLE": 0.55, "ACTIVE": 0.40, "MAINTENANCE": 0.05},
    "ACTIVE": {"ACTIVE": 0.80, "IDLE": 0.12, "WARNING": 0.08},
    "WARNING": {"ACTIVE": 0.55, "WARNING": 0.30, "UNAVAILABLE": 0.15},
    "UNAVAILABLE": {"UNAVAILABLE": 0.40, "MAINTENANCE": 0.60},
    "MAINTENANCE": {"MAINTENANCE": 0.50, "IDLE": 0.50},
}
_LOAD = {"IDLE": (0, 15), "ACTIVE": (40, 95), "WARNING": (60, 100), "UNAVAILABLE": (0, 0), "MAINTENANCE": (0, 0)}
_HEAT = {"IDLE": (22, 35), "ACTIVE": (40, 75), "WARNING": (70, 105), "UNAVAILABLE": (20, 40), "MAINTENANCE": (20, 30)}


def simulate(seed: int, equipment_id: str, terminal_id: str, count: int, start: datetime) -> list[dict]:
    """A machine's telemetry, one row every five minutes: a Markov chain over states."""
    if count < 0 or start.tzinfo is None:
        raise ValueError("count must not be negative and start must name its time zone")
    rng, state, out = random.Random(f"{seed}:{equipment_id}"), "IDLE", []
    for i in range(count):
        at = start + i * STEP
        out.append(
            {
                "event_id": f"evt-{seed % 10**6:06d}-{i:06d}",
                "schema_version": 1,
                "equipment_id": equipment_id,
                "terminal_id": terminal_id,
                "event_timestamp": at,
                "ingestion_timestamp": at + timedelta(seconds=2),
                "state": state,
                "available": state in UP_STATES,
                "load_percent": Decimal(f"{rng.uniform(*_LOAD[state]):.2f}"),
                "temperature_c": Decimal(f"{rng.uniform(*_HEAT[state]):.2f}"),
            }
        )
        state = rng.choices(list(MOVES[state]), list(MOVES[state].values()))[0]
    return out


def simulate_fleet(spark: SparkSession, seed: int, machines: int, count: int, start: datetime) -> DataFrame:
    """Many machines' telemetry, each simulated in the task that its row falls to."""
    spec = TABLES["telemetry_events"].struct.names[:10]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["telemetry_events"].struct if f.name in spec)

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        n = int(key[0])
        return pd.DataFrame(simulate(seed + n, f"QC-{n % 1000:03d}", f"TM-{n % 4 + 1:03d}", count, start))[spec]

    return spark.range(machines).groupBy("id").applyInPandas(run, kinds)


def benchmark_fixture(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Telemetry made of row numbers alone, for benchmarks of any size."""
    i = F.col("id")
    which = F.pmod(i + seed, F.lit(5))
    states = F.array(*[F.lit(s) for s in ENUMS["state"]])
    return spark.range(rows).select(
        event_key(i).alias("event_id"),
        padded("EQ-", i % 32).alias("equipment_id"),
        padded("TM-", i % 4 + 1).alias("terminal_id"),
        F.timestamp_seconds(F.lit(1_767_225_600) + i * 300).alias("event_timestamp"),
        F.element_at(states, (which + 1).cast("int")).alias("state"),
        (which < 3).alias("available"),
        (F.pmod(i * 17 + seed, F.lit(10_001)) / F.lit(100.0)).alias("load_percent"),
        (F.lit(-20.0) + F.pmod(i * 29 + seed, F.lit(17_001)) / F.lit(100.0)).alias("temperature_c"),
    )


def _at(minutes: float, day: datetime = datetime(2026, 1, 1, tzinfo=UTC)) -> datetime:
    return day + timedelta(minutes=minutes)


def portability_fixture(spark: SparkSession) -> dict[str, DataFrame]:
    """Thirteen rows over four relations that pin the KPI semantics down."""
    rows = {
        "telemetry": (
            "event_id string, equipment_id string, terminal_id string, event_timestamp timestamp, state string, available boolean, load_percent double, temperature_c double",
            [(f"evt-000001-{i:06d}", "QC-001", "TM-001", _at(5 * i), s, s in UP_STATES, 10.0 * i, 30.0) for i, s in enumerate(("ACTIVE", "ACTIVE", "IDLE", "MAINTENANCE"))],
        ),
        "movements": (
            "movement_id string, terminal_id string, equipment_id string, movement_type string, container_ref string, event_timestamp timestamp",
            [
                ("mov-000001", "TM-001", "QC-001", "GATE_IN", "CONT-000001", _at(0)),
                ("mov-000002", "TM-001", "QC-001", "LOAD", "CONT-000001", _at(15)),
                ("mov-000003", "TM-001", "QC-001", "GATE_OUT", "CONT-000001", _at(30)),
                ("mov-000004", "TM-001", "QC-001", "LOAD", "CONT-000002", _at(5)),
                ("mov-000005", "TM-001", "QC-001", "LOAD", "CONT-000003", _at(10)),
            ],
        ),
        "incidents": (
            "incident_id string, equipment_id string, severity string, status string, opened_at timestamp, resolved_at timestamp, root_cause string",
            [("inc-000001", "QC-001", "CRITICAL", "RESOLVED", _at(2), _at(12), "brake"), ("inc-000002", "QC-001", "WARNING", "OPEN", _at(6), None, "sensor")],
        ),
        "alarms": (
            "alarm_id string, equipment_id string, severity string, code string, opened_at timestamp, cleared_at timestamp",
            [("alm-000001", "QC-001", "CRITICAL", "A1", _at(5), None), ("alm-000002", "QC-001", "WARNING", "A2", _at(6), _at(9))],
        ),
    }
    return {name: spark.createDataFrame(data, schema) for name, (schema, data) in rows.items()}


def operational_seed(spark: SparkSession, seed: int = 42) -> dict[str, DataFrame]:
    """The seven operational relations of one terminal and one machine for a day: 305 rows."""
    day = datetime(2026, 9, 2, tzinfo=UTC)
    m = lambda x: _at(x, day)
    stamp = lambda at: (at, at)
    telemetry = [(*r.values(), *stamp(r["ingestion_timestamp"])) for r in simulate(seed, "QC-001", "TM-001", 288, day)]
    rows = {
        "terminals": [("TM-001", "North Quay", "UTC", *stamp(day))],
        "equipment": [("QC-001", "TM-001", "QUAY_CRANE", day.date(), *stamp(day))],
        "telemetry_events": telemetry,
        "alarms": [(f"alm-{i:06d}", "QC-001", s, f"A-{i}", m(60 * i), m(60 * i + 10) if i < 3 else None, *stamp(m(60 * i))) for i, s in enumerate(("WARNING", "CRITICAL", "INFO"), 1)],
        "incidents": [("inc-000001", "QC-001", "CRITICAL", "RESOLVED", m(100), m(130), "brake", *stamp(m(130))), ("inc-000002", "QC-001", "MINOR", "OPEN", m(300), None, "sensor", *stamp(m(300)))],
        "maintenance_orders": [("mnt-000001", "QC-001", "COMPLETED", m(100), m(130), *stamp(m(130))), ("mnt-000002", "QC-001", "IN_PROGRESS", m(310), None, *stamp(m(310)))],
        "container_movements": [
            (f"mov-{2 * i + j + 1:06d}", "TM-001", "QC-001", kind, f"CONT-{i:06d}", m(10 * i + (60 + 5 * (i % 2)) * j), *stamp(m(10 * i + 65 * j))) for i in range(4) for j, kind in enumerate(("GATE_IN", "GATE_OUT"))
        ],
    }
    return {name: spark.createDataFrame(data, TABLES[name].struct) for name, data in rows.items()}
