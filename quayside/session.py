"""The session settings the engine's semantics rest on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC everywhere; runtime re-planning of joins, skew and partition counts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "quayside", **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` adds or overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or the warehouse where that is not set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{shared.rstrip('/')}/quayside-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """A table as it is read again from the shared folder, which cuts its lineage."""
    to, schema = scratch(df.sparkSession), df.schema
    df.write.parquet(to)
    return df.sparkSession.read.schema(schema).parquet(to)
