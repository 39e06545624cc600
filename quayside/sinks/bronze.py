"""Writing Bronze, Silver and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.verify import fingerprint
from ..schemas import REASON_CODES, TABLES


class BronzeConflict(RuntimeError):
    """A target exists with other rows."""


def bronze_rows(rows: DataFrame, table: str, run_id: str, extracted_at: Column, decimals: bool = True) -> DataFrame:
    """Declared columns and types, and lineage; ``extracted_at`` is made two seconds later.

    Without ``decimals`` numbers of the source stay doubles, as they came.
    """
    kinds = {c: T.DoubleType() if isinstance(t, T.DecimalType) and not decimals else t for c, t in TABLES[table].all_columns.items()}
    cast = [F.col(c).cast(t).alias(c) for c, t in kinds.items()]
    later = (extracted_at + F.expr("interval 2 seconds")).alias("extracted_at")
    return rows.select(*cast, F.lit(table).alias("source_table"), F.lit(run_id).alias("extraction_run_id"), F.col("updated_at").cast("timestamp").alias("source_updated_at"), later)


def write_once(rows: DataFrame, target: str, partition: str | None = None) -> bool:
    """Writes an immutable part; the same rows again are a no-op (False), others an error.

    Part files are not byte-stable, so identity is that of the rows.
    """
    spark = rows.sparkSession
    try:
        held = spark.read.parquet(target)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        held = None
    if held is not None:
        if fingerprint(held.select(*rows.columns)).first() != fingerprint(rows).first():
            raise BronzeConflict(f"{target} holds other rows")
        return False
    writer = rows.write.option("compression", "zstd").mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(target)
    return True


def write_batches(batches: DataFrame, table: str, bronze_dir: str, run_id: str) -> int:
    """Bronze parts of extracted rows (with ``batch``): one folder per run, laid out by date.

    ``extracted_at`` of a batch comes from its last row.  Returns the number of rows.
    """
    spec = TABLES[table]
    last = F.struct("updated_at", spec.key)
    stamp = F.col("ingestion_timestamp") if "ingestion_timestamp" in spec.columns else F.col("updated_at")
    ends = batches.groupBy("batch").agg(F.max_by(stamp, last).alias("_end"))
    rows = batches.join(ends, "batch")
    out = bronze_rows(rows, table, run_id, F.col("_end"))
    out = out.withColumn("date", F.to_date("updated_at"))
    out.write.mode("overwrite").option("compression", "zstd").partitionBy("date").parquet(f"{bronze_dir}/{table}/run={run_id}")
    return out.count()


def _write_counted(rows: DataFrame, target: str, *counts: Column) -> dict[str, int]:
    """Writes rows and returns counts that the writing tasks took; a task that runs again counts once."""
    seen = Observation()
    # observed behind the last shuffle: what a lost map task computes again is not counted
    rows.observe(seen, F.count("*").alias("rows"), *counts).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return {k: v or 0 for k, v in seen.get.items()}


def write_silver(accepted: DataFrame, table: str, silver_dir: str) -> int:
    """Accepted rows in key order; an empty relation keeps its schema.  Returns the rows written."""
    key = TABLES[table].key
    return _write_counted(accepted.repartitionByRange(key).sortWithinPartitions(key), f"{silver_dir}/{table}")["rows"]


def write_quarantine(rows: DataFrame, table: str, quarantine_dir: str) -> tuple[int, dict[str, int]]:
    """Rejected rows in key order; returns the rows written and how many carry each reason code."""
    # a row has a code once at most
    codes = [F.count_if(F.array_contains("reason_codes", code)).alias(code) for code in REASON_CODES]
    n = _write_counted(rows.repartitionByRange("primary_key").sortWithinPartitions("primary_key", "reason_codes"), f"{quarantine_dir}/{table}", *codes)
    return n["rows"], {code: n[code] for code in REASON_CODES if n[code]}


def partition_summary(bronze_dir_rows: DataFrame) -> DataFrame:
    """(rows, fingerprint) of a Bronze relation."""
    return fingerprint(bronze_dir_rows)
