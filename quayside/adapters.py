"""The driver's tables seen as canonical relations, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.scalars import event_key, padded

_STATE = {"click": "ACTIVE", "view": "IDLE", "purchase": "WARNING", "signup": "MAINTENANCE"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    machine = F.col("user_id") % 32
    state = F.lit("UNAVAILABLE")
    for kind, name in _STATE.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    return e.select(
        event_key("event_id").alias("event_id"),
        F.lit(1).cast("short").alias("schema_version"),
        padded("QC-", machine).alias("equipment_id"),
        padded("TM-", machine % 4 + 1).alias("terminal_id"),
        F.col("ts").alias("event_timestamp"),
        (F.col("ts") + F.expr("interval 2 seconds")).alias("ingestion_timestamp"),
        state.alias("state"),
        F.col("event_type").isin("click", "view", "purchase").alias("available"),
        F.col("value").alias("load_percent"),
        (20 + F.col("event_id") % 60).cast("double").alias("temperature_c"),
    )


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("GATE_IN", "LOAD", "DISCHARGE", "GATE_OUT")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("movement_id"),
        padded("TM-", F.col("l_suppkey") % 4 + 1).alias("terminal_id"),
        padded("QC-", F.col("l_partkey") % 32).alias("equipment_id"),
        kind.alias("movement_type"),
        F.concat(F.lit("CONT-"), F.col("l_orderkey").cast("string")).alias("container_ref"),
        F.col("l_shipdate").alias("event_timestamp"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    is_open, machine = F.col("event_id") % 4 == 0, F.col("user_id") % 32
    return e.select(
        padded("inc-", F.col("event_id"), 6).alias("incident_id"),
        padded("QC-", machine).alias("equipment_id"),
        padded("TM-", machine % 4 + 1).alias("terminal_id"),
        F.element_at(F.array(F.lit("MINOR"), F.lit("MAJOR"), F.lit("CRITICAL")), (F.col("event_id") % 3 + 1).cast("int")).alias("severity"),
        F.when(is_open, "OPEN").otherwise("RESOLVED").alias("status"),
        F.col("ts").alias("opened_at"),
        F.when(~is_open, F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 240).cast("int"))).alias("resolved_at"),
        F.concat(F.lit("cause-"), (F.col("user_id") % 7).cast("string")).alias("root_cause"),
    )


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return e.select(
        padded("alm-", F.col("event_id"), 6).alias("alarm_id"),
        padded("QC-", F.col("user_id") % 32).alias("equipment_id"),
        F.element_at(F.array(F.lit("INFO"), F.lit("WARNING"), F.lit("CRITICAL")), (F.col("event_id") % 3 + 1).cast("int")).alias("severity"),
        F.concat(F.lit("code-"), (F.col("event_id") % 5).cast("string")).alias("code"),
        F.col("ts").alias("opened_at"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("interval 10 minutes")).alias("cleared_at"),
    )


def equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("equipment_id", "terminal_id").distinct()


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with ``idx``, their place in the given total order; only for small relations."""
    return df.withColumn("idx", F.row_number().over(W.orderBy(*order)))


#: The same relations for the oracle; each is a CTE body.
CTES = {
    "telemetry": """select 'evt-' || lpad(cast(event_id // 1000000 as varchar), 6, '0') || '-' || lpad(cast(event_id % 1000000 as varchar), 6, '0') as event_id,
  'QC-' || lpad(cast(user_id % 32 as varchar), 3, '0') as equipment_id, 'TM-' || lpad(cast(user_id % 32 % 4 + 1 as varchar), 3, '0') as terminal_id,
  ts as event_timestamp, ts + interval 2 second as ingestion_timestamp,
  case event_type when 'click' then 'ACTIVE' when 'view' then 'IDLE' when 'purchase' then 'WARNING' when 'signup' then 'MAINTENANCE' else 'UNAVAILABLE' end as state,
  event_type in ('click', 'view', 'purchase') as available, value as load_percent, cast(20 + event_id % 60 as double) as temperature_c from events""",
    "movements": """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as movement_id, 'TM-' || lpad(cast(l_suppkey % 4 + 1 as varchar), 3, '0') as terminal_id,
  'QC-' || lpad(cast(l_partkey % 32 as varchar), 3, '0') as equipment_id,
  case l_linenumber % 4 when 0 then 'GATE_IN' when 1 then 'LOAD' when 2 then 'DISCHARGE' else 'GATE_OUT' end as movement_type,
  'CONT-' || cast(l_orderkey as varchar) as container_ref, l_shipdate as event_timestamp from lineitem""",
    "incidents": """select 'inc-' || lpad(cast(event_id as varchar), 6, '0') as incident_id, 'QC-' || lpad(cast(user_id % 32 as varchar), 3, '0') as equipment_id,
  'TM-' || lpad(cast(user_id % 32 % 4 + 1 as varchar), 3, '0') as terminal_id,
  case event_id % 3 when 0 then 'MINOR' when 1 then 'MAJOR' else 'CRITICAL' end as severity, case when event_id % 4 = 0 then 'OPEN' else 'RESOLVED' end as status,
  ts as opened_at, case when event_id % 4 <> 0 then ts + to_minutes(cast(event_id % 240 as integer)) end as resolved_at,
  'cause-' || cast(user_id % 7 as varchar) as root_cause from events where event_type in ('error', 'purchase')""",
    "alarms": """select 'alm-' || lpad(cast(event_id as varchar), 6, '0') as alarm_id, 'QC-' || lpad(cast(user_id % 32 as varchar), 3, '0') as equipment_id,
  case event_id % 3 when 0 then 'INFO' when 1 then 'WARNING' else 'CRITICAL' end as severity, 'code-' || cast(event_id % 5 as varchar) as code,
  ts as opened_at, case when event_id % 5 <> 0 then ts + interval 10 minute end as cleared_at from events where event_type = 'error'""",
}


def with_ctes(names: str, body: str, **more: str) -> str:
    """A query over the named relations (and extra CTEs, in order)."""
    parts = [f"{n} as ({CTES[n]})" for n in names.split()] + [f"{n} as ({sql})" for n, sql in more.items()]
    return f"with {', '.join(parts)} {body}" if parts else body
