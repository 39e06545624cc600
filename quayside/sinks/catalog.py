"""Views, tables and message topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES
from ..streaming.config import StreamConfig


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Empty managed tables of the seven relations, where they are missing."""
    for name, spec in TABLES.items():
        spark.createDataFrame([], spec.struct).write.mode("ignore").saveAsTable(f"{database}.{name}")


def register(relations: dict[str, DataFrame], tables: tuple[str, ...] = (), database: str = "default") -> None:
    """Relations as temporary views; those named in ``tables`` as managed tables instead."""
    for name, df in relations.items():
        if name in tables:
            df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
        else:
            df.createOrReplaceTempView(name)


def publish_records(records: DataFrame, config: StreamConfig, topic: str | None = None) -> None:
    """Records to a topic, where the Kafka connector is on the class path."""
    headers = F.transform("headers", lambda h: F.struct(h["name"].alias("key"), h["value"].alias("value")))
    records.select("key", "value", headers.alias("headers")).write.format("kafka").options(**config.writer_options(topic)).option("includeHeaders", "true").save()
