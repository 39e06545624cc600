"""Run metrics, run history and timing statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import one_line

STATUSES = ("running", "succeeded", "failed")
COUNTERS = ("consumed", "bronze_rows", "committed_batches", "duplicates", "late", "dead_letters")


def run_metrics(runs: DataFrame, now: Column) -> DataFrame:
    """One row: runs by status, counter sums that skip nulls, and the latest run with its duration (at least 0)."""
    latest = F.max_by(F.struct("run_id", "status", "started_at", "finished_at"), F.struct("started_at", "run_id")).alias("latest")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{c}_total") for c in COUNTERS]
    row = runs.agg(*[F.count_if(F.col("status") == s).alias(f"runs_{s}") for s in STATUSES], *sums, latest)
    end = F.coalesce("latest.finished_at", now)
    seconds = F.greatest(F.lit(0.0), (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("latest.started_at").cast("timestamp"))) / F.lit(1e6))
    return row.select("*", F.col("latest.run_id").alias("last_run_id"), F.col("latest.status").alias("last_run_status"), F.coalesce(seconds, F.lit(0.0)).alias("last_run_duration_seconds")).drop("latest")


def run_history(runs: DataFrame, most: int = 10) -> DataFrame:
    """Newest runs first, their error as one short line."""
    return runs.withColumn("error_message", one_line("error_message")).orderBy(F.desc("started_at"), F.desc("run_id")).limit(most)


def latest_run(runs: DataFrame) -> DataFrame:
    w = W.orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1).withColumn("nth", F.row_number().over(w)).drop("nth")


def timing(samples: DataFrame, value: str, by: str) -> DataFrame:
    """Median and nearest-rank 95th percentile of samples."""
    return samples.groupBy(by).agg(F.median(value).alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.count("*").alias("samples"))


def prometheus(metrics: dict[str, float], prefix: str = "quayside_stream") -> str:
    """Text exposition of a metrics row."""
    lines = []
    for name, value in sorted(metrics.items()):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            kind = "counter" if name.endswith("_total") else "gauge"
            lines += [f"# TYPE {prefix}_{name} {kind}", f"{prefix}_{name} {value:g}"]
    return "\n".join(lines) + "\n"
