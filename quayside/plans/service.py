"""What a local service offers, as plain functions: status, schema, runs, refresh, import."""

from __future__ import annotations

import threading
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..operators.observe import run_history
from ..schemas import TABLES
from ..sinks import upsert
from ..sources import generators, records
from ..streaming.consumer import StreamState
from . import pipeline


class Busy(RuntimeError):
    """A refresh is running."""


class RunHistory(NamedTuple):
    """``status`` is ready, absent, malformed or unavailable; ``rows`` only where ready."""

    status: str
    rows: DataFrame | None


def status(spark: SparkSession) -> dict[str, str]:
    return {"status": "ok", "spark": spark.version}


def schema() -> dict[str, list[dict]]:
    """Columns of every importable relation."""
    return {name: [{"name": f.name, "type": f.dataType.simpleString(), "required": not f.nullable, "description": f.metadata["description"]} for f in t.struct] for name, t in TABLES.items()}


def stream_runs(spark: SparkSession, state_dir: str, topic: str, most: int = 10) -> RunHistory:
    try:
        rows = StreamState(spark, state_dir, topic).runs()
        if rows.isEmpty():
            return RunHistory("absent", None)
        if not rows.where("run_id is null or status is null or status not in ('running', 'succeeded', 'failed')").isEmpty():
            return RunHistory("malformed", None)
        return RunHistory("ready", run_history(rows, most))
    except Exception as error:
        return RunHistory("malformed" if "CANNOT_READ" in str(error) or "FAILED_READ" in str(error) else "unavailable", None)


class Refresher:
    """Runs the pipeline, one run at a time."""

    def __init__(self, spark: SparkSession, work_dir: str, out_dir: str):
        self.spark, self.work_dir, self.out_dir = spark, work_dir, out_dir
        self._lock = threading.Lock()

    def refresh(self, run_id: str, source: dict[str, DataFrame] | None = None) -> dict:
        if not self._lock.acquire(blocking=False):
            raise Busy("a refresh is running")
        try:
            return pipeline.run(self.spark, source or generators.operational_seed(self.spark), f"{self.work_dir}/{run_id}", self.out_dir, run_id)
        finally:
            self._lock.release()


def import_lines(spark: SparkSession, table: str, lines: list[str], held: dict[str, DataFrame]) -> tuple[upsert.Merge | None, DataFrame]:
    """The merge of JSON records into a relation, or None with the issues: all or nothing."""
    rows = records.records(spark, lines)
    references = {c: held["terminals" if c == "terminal_id" else "equipment"].select(c) for c in TABLES[table].references}
    found = records.import_issues(rows, table, references)
    if not found.isEmpty():
        return None, found
    new = records.normalise(rows, table).drop("row_index", "problems")
    return upsert.merge(held[table], new, TABLES[table].key), found
