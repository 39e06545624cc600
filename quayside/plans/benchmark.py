"""The summary benchmark: fixture, protocol, report, agreement of engines."""

from __future__ import annotations

import json
import math
import statistics
import time
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import kpi, verify
from ..sources import generators

# Rows of each profile.
PROFILES = {"smoke": 10_000, "small": 100_000, "medium": 1_000_000, "large": 5_000_000}
SEED = 42
WINDOW = (datetime(2026, 1, 1, tzinfo=UTC), datetime(2027, 1, 1, tzinfo=UTC))


def p95(samples: list[float]) -> float:
    """Nearest rank."""
    return sorted(samples)[math.ceil(0.95 * len(samples)) - 1]


def timed(run: Callable[[], object], warmups: int = 1, repetitions: int = 3) -> tuple[object, list[float]]:
    """The result and the seconds of each measured run."""
    if warmups < 0 or repetitions < 1:
        raise ValueError("no run is measured")
    for _ in range(warmups):
        run()
    times = []
    for _ in range(repetitions):
        began = time.perf_counter()
        out = run()
        times.append(time.perf_counter() - began)
    return out, times


def prepare(spark: SparkSession, folder: str, profile: str) -> str:
    path = f"{folder}/{profile}-{SEED}.parquet"
    generators.benchmark_fixture(spark, PROFILES[profile], SEED).write.mode("ignore").option("compression", "zstd").parquet(path)
    return path


def spark_engine(spark: SparkSession, path: str) -> Callable[[], list]:
    return lambda: [r.asDict() for r in kpi.state_summary(spark.read.parquet(path), *WINDOW).collect()]


def duckdb_engine(path: str) -> Callable[[], list]:
    import duckdb

    sql = f"""select terminal_id, state, count(*) as event_count, cast(sum(case when available then 1 else 0 end) as bigint) as available_event_count, round(avg(load_percent), 6) as average_load_percent,
 round(avg(temperature_c), 6) as average_temperature_c from read_parquet('{path}/*.parquet') where event_timestamp >= timestamptz '{WINDOW[0].isoformat()}' and event_timestamp < timestamptz '{WINDOW[1].isoformat()}'
 group by terminal_id, state order by terminal_id, state"""
    return lambda: duckdb.connect().execute(sql).df().to_dict("records")


def run(spark: SparkSession, folder: str, profile: str = "smoke", warmups: int = 1, repetitions: int = 3, engines: tuple[str, ...] = ("spark", "duckdb")) -> dict:
    """Measures the engines on one fixture; they must agree on the result."""
    path, results = prepare(spark, folder, profile), []
    for name in engines:
        out, times = timed(spark_engine(spark, path) if name == "spark" else duckdb_engine(path), warmups, repetitions)
        result = verify.result_hash(spark.createDataFrame([{k: v for k, v in r.items()} for r in out]))
        median = statistics.median(times)
        results.append({"engine": name, "result_hash": result, "median_seconds": median, "p95_seconds": p95(times), "rows_per_second": PROFILES[profile] / median})
    if len({r["result_hash"] for r in results}) > 1:
        raise ValueError("the engines disagree")
    fixture = verify.fingerprint(spark.read.parquet(path)).select(F.col("fingerprint")).first()[0]
    return {"schema_version": 1, "profile": profile, "rows": PROFILES[profile], "seed": SEED, "fixture_fingerprint": fixture, "warmups": warmups, "repetitions": repetitions, "results": results}


def check_report(report: dict) -> dict:
    """A report as it was written, or an error that says what is wrong."""
    if report.get("schema_version") != 1 or report.get("profile") not in PROFILES or report.get("rows") != PROFILES[report["profile"]]:
        raise ValueError("not a report of a known profile")
    for r in report.get("results") or [{}]:
        if not all(isinstance(r.get(k), (int, float)) and not isinstance(r[k], bool) and math.isfinite(r[k]) and r[k] > 0 for k in ("median_seconds", "p95_seconds", "rows_per_second")):
            raise ValueError("a measurement must be a positive number")
    if len({r["result_hash"] for r in report["results"]}) != 1:
        raise ValueError("the engines disagree")
    return report


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(check_report(report), sort_keys=True, indent=1) + "\n", encoding="utf-8")


def read_report(path: str) -> dict:
    return check_report(json.loads(Path(path).read_text(encoding="utf-8")))
