"""Registered queries that go through the engine's own writers, readers, validators and streams.

They write to a folder of their own under ``spark.checkpoint.dir`` (the warehouse where
that is not set) and read it back.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import alarms, incidents, movements, read, telemetry
from ..functions import jsonschema
from ..functions import scalars as S
from ..operators import documents, kpi, presentation, replay, silver, verify
from ..schemas import DOCUMENT_SCHEMAS, KPI_COLUMNS, TABLES
from ..session import scratch, written
from ..sinks import bronze
from ..sinks.versions import Versions
from ..sources import keyset, log, records, tables
from ..streaming import consumer, decode, keyed
from . import catalogue as base
from . import pipeline
from .catalogue import _query, _sql_ts, _ts

EXTRACTED = datetime(2024, 3, 1)


# Bronze trees and staging

_ORDERS = """select 'mnt-' || lpad(cast(o_orderkey % 1000000 as varchar), 6, '0') as maintenance_order_id, 'QC-' || lpad(cast(o_custkey % 32 as varchar), 3, '0') as equipment_id,
 case o_orderstatus when 'F' then 'COMPLETED' when 'P' then 'IN_PROGRESS' else 'PLANNED' end as status, o_orderdate as started_at, case when o_orderstatus = 'F' then o_orderdate + interval 1 day end as completed_at from orders"""


def _orders(spark, d) -> DataFrame:
    o, done = read(spark, d, "orders"), F.col("o_orderstatus") == "F"
    return o.select(
        S.padded("mnt-", F.col("o_orderkey") % 1_000_000, 6).alias("maintenance_order_id"),
        S.padded("QC-", F.col("o_custkey") % 32).alias("equipment_id"),
        F.when(done, "COMPLETED").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("PLANNED").alias("status"),
        F.col("o_orderdate").alias("started_at"),
        F.when(done, F.col("o_orderdate") + F.expr("interval 1 day")).alias("completed_at"),
    )


def _through_bronze(spark, rows: DataFrame, table: str, time: str) -> DataFrame:
    """Rows written as a Bronze part, read back as a tree and put in staging types."""
    root = scratch(spark)
    rows = rows.withColumns({"created_at": F.col(time), "updated_at": F.col(time)})
    for c in TABLES[table].columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None))
    bronze.write_once(bronze.bronze_rows(rows, table, "run-1", F.lit(EXTRACTED)), f"{root}/{table}/run=1")
    return tables.staging(tables.read_bronze(spark, root, table), table)


@_query(
    "telemetry",
    f"select event_id, equipment_id, terminal_id, {_sql_ts('event_timestamp')} as event_timestamp, {_sql_ts('ingestion_timestamp')} as ingestion_timestamp, state, available, round(load_percent, 2) as load_percent, temperature_c, {_sql_ts('event_timestamp')} as updated_at from telemetry",
)
def staging_telemetry(spark, d):
    rows = telemetry(spark, d).withColumn("load_percent", F.round("load_percent", 2))
    out = _through_bronze(spark, rows, "telemetry_events", "event_timestamp")
    return out.select("event_id", "equipment_id", "terminal_id", _ts("event_timestamp").alias("event_timestamp"), _ts("ingestion_timestamp").alias("ingestion_timestamp"), "state", "available", F.round("load_percent", 2).alias("load_percent"), "temperature_c", _ts("updated_at").alias("updated_at"))


@_query("alarms", f"select alarm_id, equipment_id, severity, code, {_sql_ts('opened_at')} as opened_at, {_sql_ts('cleared_at')} as cleared_at from alarms")
def staging_alarms(spark, d):
    return _through_bronze(spark, alarms(spark, d), "alarms", "opened_at").select("alarm_id", "equipment_id", "severity", "code", _ts("opened_at").alias("opened_at"), _ts("cleared_at").alias("cleared_at"))


@_query("incidents", f"select incident_id, equipment_id, severity, status, {_sql_ts('opened_at')} as opened_at, {_sql_ts('resolved_at')} as resolved_at, root_cause from incidents")
def staging_incidents(spark, d):
    return _through_bronze(spark, incidents(spark, d), "incidents", "opened_at").select("incident_id", "equipment_id", "severity", "status", _ts("opened_at").alias("opened_at"), _ts("resolved_at").alias("resolved_at"), "root_cause")


@_query("", f"select maintenance_order_id, equipment_id, status, {_sql_ts('started_at')} as started_at, {_sql_ts('completed_at')} as completed_at from m", m=_ORDERS)
def staging_maintenance_orders(spark, d):
    return _through_bronze(spark, _orders(spark, d), "maintenance_orders", "started_at").select("maintenance_order_id", "equipment_id", "status", _ts("started_at").alias("started_at"), _ts("completed_at").alias("completed_at"))


@_query("movements", f"select movement_id, terminal_id, equipment_id, movement_type, container_ref, {_sql_ts('event_timestamp')} as event_timestamp from movements")
def staging_movements(spark, d):
    return _through_bronze(spark, movements(spark, d), "container_movements", "event_timestamp").select("movement_id", "terminal_id", "equipment_id", "movement_type", "container_ref", _ts("event_timestamp").alias("event_timestamp"))


@_query("alarms", "select alarm_id, source_table, extraction_run_id, source_updated_at, extracted_at from (select alarm_id, 'alarms' as source_table, 'run-' || cast(r as varchar) as extraction_run_id, " + _sql_ts("opened_at + to_minutes(r)") + " as source_updated_at, '2024-03-01 00:00:02.000000' as extracted_at from alarms cross join (values (1), (2)) as t(r))")
def bronze_lineage(spark, d):
    """Two runs of a table in one tree, a staging folder beside them that no reader sees."""
    root, rows = scratch(spark), alarms(spark, d)
    for run in (1, 2):
        stamped = rows.withColumns({c: F.col("opened_at") + F.make_dt_interval(mins=F.lit(run)) for c in ("created_at", "updated_at")})
        part = bronze.bronze_rows(stamped, "alarms", f"run-{run}", F.lit(EXTRACTED))
        bronze.write_once(part, f"{root}/alarms/run={run}")
        bronze.write_once(part, f"{root}/alarms/run={run}")  # the same rows again change nothing
        bronze.write_once(part, f"{root}/alarms/.staging/run={run}")
    return tables.read_bronze(spark, root, "alarms").select("alarm_id", "source_table", "extraction_run_id", _ts("source_updated_at").alias("source_updated_at"), _ts("extracted_at").alias("extracted_at"))


@_query(
    "telemetry",
    """select event_id, origin, case when origin = 'database' then round(load_percent, 2) else load_percent end as load_percent, case when origin = 'stream' then event_id end as note, origin <> 'old' as has_state from telemetry, (values ('database'), ('stream'), ('old')) as o(origin)""",
)
def bronze_both_origins(spark, d):
    """One tree of a database's decimals, a stream's doubles with a column more, and an old part with a column less."""
    root, t = scratch(spark), telemetry(spark, d)
    t = t.withColumns({c: F.col("event_timestamp") for c in ("created_at", "updated_at")}).withColumn("schema_version", F.lit(1))
    for origin, rounded in (("database", True), ("stream", False), ("old", False)):
        rows = t.withColumn("load_percent", F.round("load_percent", 2)) if rounded else t
        part = bronze.bronze_rows(rows, "telemetry_events", origin, F.lit(EXTRACTED), decimals=rounded)
        part = part.withColumn("note", F.col("event_id")) if origin == "stream" else part.drop("state") if origin == "old" else part
        bronze.write_once(part, f"{root}/telemetry_events/run={origin}")
    rows = tables.read_bronze(spark, root, "telemetry_events")
    return rows.select("event_id", F.col("extraction_run_id").alias("origin"), "load_percent", "note", F.col("state").isNotNull().alias("has_state"))


# All reasons of quarantine

_BAD = """select event_id, run, load_percent, state, available, n % 13 = 0 as no_run, n % 23 = 0 as bad_id, n % 17 = 0 as bad_state, n % 19 = 0 as bad_version, n % 11 = 0 as no_terminal, n % 31 = 0 as early,
 case when n % 29 = 0 then 151 else temperature_c end as temperature_c, event_timestamp, ingestion_timestamp, up, row_number() over (partition by event_id order by up desc, case when n % 13 = 0 then '  ' else cast(run as varchar) end desc) > 1 as superseded
 from (select *, cast(right(event_id, 6) as integer) as n from bronze)"""
_FOUND = """select event_id, superseded, case when no_run then 'extraction_run_id must be non-empty' when bad_id then 'equipment_id has an invalid identifier' when bad_state then 'state has an invalid value' when bad_version then 'schema_version must be 1' end as s,
 case when not load_percent between 0 and 100 then 'load_percent must be between 0 and 100' when not temperature_c between -20 and 150 then 'temperature_c must be between -20 and 150' end as r,
 case when bad_id then 'equipment_id ''qc1'' is not referenced' when no_terminal then 'terminal_id ''TM-999'' is not referenced' end as f,
 case when early then 'ingestion_timestamp must not precede event_timestamp' end as t from bad"""
_ISSUES = """select event_id as primary_key, case when superseded then 'DUPLICATE_KEY' else concat_ws(',', if(s is null, null, 'SCHEMA_INVALID'), if(r is null, null, 'RANGE_INVALID'), if(f is null, null, 'REFERENCE_INVALID'), if(t is null, null, 'TEMPORAL_INVALID')) end as reason_codes,
 case when superseded then 'duplicate event_id ''' || event_id || '''' else concat_ws('|', s, r, f, t) end as reason_details from found where superseded or s is not null or r is not null or f is not null or t is not null"""


def _spoilt(spark, d) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Bronze telemetry with defects of every kind, and the identifiers it may refer to."""
    n = F.substring("event_id", -6, 6).cast("int")
    rows = base._bronze_telemetry(spark, d).withColumn("schema_version", F.lit(1))
    known = {c: telemetry(spark, d).select(c).distinct() for c in ("equipment_id", "terminal_id")}
    put = lambda c, by, value: F.when(n % by == 0, value).otherwise(F.col(c))
    rows = rows.withColumns(
        {
            "terminal_id": put("terminal_id", 11, "TM-999"),
            "extraction_run_id": put("extraction_run_id", 13, "  "),
            "state": put("state", 17, "BROKEN"),
            "schema_version": put("schema_version", 19, 2),
            "equipment_id": put("equipment_id", 23, "qc1"),
            "temperature_c": put("temperature_c", 29, 151.0),
            "ingestion_timestamp": F.when(n % 31 == 0, F.col("event_timestamp") - F.expr("interval 1 second")).otherwise(F.col("ingestion_timestamp")),
        }
    )
    return rows, known


def _defective(spark, d) -> silver.Silver:
    rows, known = _spoilt(spark, d)
    return silver.split(rows, "telemetry_events", known)


_DEFECTS = {"bronze": base._BRONZE, "bad": _BAD, "found": _FOUND, "issues": _ISSUES}


@_query("telemetry", "select * from issues", **_DEFECTS)
def quarantine_all_reasons(spark, d):
    """Every reason code with the detail that wins, written sorted and read back."""
    root = scratch(spark)
    bronze.write_quarantine(_defective(spark, d).quarantine, "telemetry_events", root)
    held = spark.read.parquet(f"{root}/telemetry_events")
    return held.select("primary_key", F.array_join("reason_codes", ",").alias("reason_codes"), F.array_join("reason_details", "|").alias("reason_details"))


@_query("telemetry", "select (select count(*) from bronze) as bronze_rows, (select count(*) from bronze) - (select count(*) from issues) as silver_rows, (select count(*) from issues) as quarantine_rows, true as layers_valid", **_DEFECTS)
def layer_reconciliation(spark, d):
    """Bronze = Silver + quarantine, over written layers."""
    root, parts = scratch(spark), _defective(spark, d)
    bronze.write_silver(parts.accepted, "telemetry_events", f"{root}/silver")
    bronze.write_quarantine(parts.quarantine, "telemetry_events", f"{root}/quarantine")
    count = lambda kind: spark.read.parquet(f"{root}/{kind}/telemetry_events").agg(F.count("*").alias(f"{'silver' if kind == 'silver' else 'quarantine'}_rows"))
    rows = base._bronze_telemetry(spark, d).agg(F.count("*").alias("bronze_rows")).crossJoin(count("silver")).crossJoin(count("quarantine"))
    return rows.withColumn("layers_valid", F.col("bronze_rows") == F.col("silver_rows") + F.col("quarantine_rows"))


@_query(
    "telemetry",
    """select 'bronze' as layer, count(*) as n from bronze union all select 'silver', (select count(*) from bronze) - (select count(*) from issues) union all select 'quarantine', count(*) from issues
 union all select code, count(*) from (select unnest(string_split(reason_codes, ',')) as code from issues) group by 1""",
    **_DEFECTS,
)
def written_layer_counts(spark, d):
    """What the batch path counts while it writes the layers, and rows by reason code."""
    root, (rows, known) = scratch(spark), _spoilt(spark, d)
    n = pipeline.refined(spark, {"telemetry_events": rows}, f"{root}/silver", f"{root}/quarantine", known)
    counts = {"bronze": n.bronze_rows, "silver": n.silver_rows, "quarantine": n.quarantine_rows} | n.reason_counts
    return spark.createDataFrame(list(counts.items()), "layer string, n long")


@_query(
    "alarms",
    """select 'alarms' as source_table, alarm_id as primary_key, 'SCHEMA_INVALID' as reason_codes, 'missing columns: severity, code' as reason_details from alarms union all
 select 'weather', null, 'SCHEMA_INVALID', 'unsupported table ''weather''' from alarms""",
)
def quarantine_shapes(spark, d):
    """Rows of a table that lacks columns, and rows of a table that nobody knows."""
    rows = alarms(spark, d).withColumns({c: F.col("opened_at") for c in ("created_at", "updated_at")})
    rows = bronze.bronze_rows(rows, "alarms", "run-1", F.lit(EXTRACTED)).withColumns({"_path": F.lit(""), "_ordinal": F.lit(0).cast("long")})
    known = {"equipment_id": rows.select("equipment_id").distinct()}
    parts = [silver.split(rows.drop("severity", "code"), "alarms", known), silver.split(rows, "weather", known)]
    out = parts[0].quarantine.unionByName(parts[1].quarantine)
    return out.select("source_table", "primary_key", F.array_join("reason_codes", ",").alias("reason_codes"), F.array_join("reason_details", "|").alias("reason_details"))


@_query("telemetry movements incidents alarms", f"select terminal_id from ({base._KPI}) where terminal_id in ('TM-002', 'TM-003', 'TM-004')", **base._PARTS, inc=base._INC, al=base._ALARM)
def gold_assertions_broken(spark, d):
    """KPI rows spoilt in three ways: more available than scheduled intervals, a wrong ratio, a period that ends before it starts."""
    kpis, at = kpi.overview_kpis(*base._all(spark, d)), F.col("terminal_id")
    kpis = kpis.withColumns(
        {
            "available_intervals": F.when(at == "TM-002", F.col("scheduled_intervals") + 1).otherwise(F.col("available_intervals")),
            "availability": F.when(at == "TM-003", F.col("availability") + 1e-9).otherwise(F.col("availability")),
            "source_period_end": F.when(at == "TM-004", F.col("source_period_start") - F.expr("interval 1 second")).otherwise(F.col("source_period_end")),
        }
    )
    return documents.kpi_violations(kpis.select(*KPI_COLUMNS)).select("terminal_id")


# Import

_LINES = """select event_id as i, event_id // 1000000 as batch, 'alm-' || lpad(cast((case when event_id % 7 = 3 then event_id - 1 else event_id end) % 1000000 as varchar), 6, '0') as id, user_id % 32 as machine, ts, event_id % 5 = 1 as extra, event_id % 11 = 2 as no_code, event_id % 13 = 3 as bad_severity,
 event_id % 17 = 4 as no_zone, event_id % 19 = 5 as backwards, event_id % 23 = 6 as blank, event_id % 29 = 7 as no_object from events"""
_SHAPES = """select i as row_index, '' as field, 'not a JSON object' as problem from l where no_object union all select i, 'extra', 'unknown field' from l where extra and not no_object union all select i, 'code', 'missing field' from l where no_code and not no_object
 union all select i, 'severity', 'not a valid string' from l where bad_severity and not no_object union all select i, 'opened_at', 'not a valid timestamp' from l where no_zone and not no_object union all select i, 'code', 'not a valid string' from l where blank and not no_code and not no_object"""
_REPEATED = "select i, row_number() over (partition by batch, id order by i) as nth from l where not no_object"


@_query(
    "",
    f"""select * from shapes union all select i, '', 'cleared_at must not precede opened_at' from l where backwards and not no_object and i not in (select row_index from shapes)
 union all select i, 'alarm_id', 'repeated in this batch' from repeated where nth > 1""",
    l=_LINES, shapes=_SHAPES, repeated=_REPEATED,
)
def import_issues(spark, d):
    """JSON lines of alarms, in batches of a million keys: unknown, missing and wrong fields, times without a zone, times out of order, repeated keys."""
    e, i = read(spark, d, "events"), F.col("event_id")
    at = S.iso_micros("ts")
    key = S.padded("alm-", F.when(i % 7 == 3, i - 1).otherwise(i) % 1_000_000, 6)
    fields = [
        ("alarm_id", key), ("equipment_id", S.padded("QC-", F.col("user_id") % 32)), ("severity", F.when(i % 13 == 3, "LOUD").otherwise("INFO")), ("opened_at", F.when(i % 17 == 4, F.regexp_replace(at, "Z$", "")).otherwise(at)),
        ("cleared_at", F.when(i % 19 == 5, "2000-01-01T00:00:00Z").otherwise("2030-01-01T00:00:00Z")), ("created_at", at), ("updated_at", at), ("code", F.when(i % 23 == 6, "  ").otherwise("c")), ("extra", F.lit("x")),
    ]
    whole = F.create_map(*[x for n, v in fields for x in (F.lit(n), v)])
    kept = F.map_filter(whole, lambda k, v: ~((k == "code") & (i % 11 == 2)) & ~((k == "extra") & (i % 5 != 1)))
    lines = e.select(i.alias("row_index"), F.expr("event_id div 1000000").alias("batch"), F.when(i % 29 == 7, "not json").otherwise(F.to_json(kept)).alias("raw"))
    known = {"equipment_id": telemetry(spark, d).select("equipment_id")}
    return records.import_issues(lines, "alarms", known, batch="batch").select("row_index", "field", "problem")


@_query("", f"select i as row_index, id as alarm_id, {_sql_ts('ts')} as opened_at, case when no_code then null when blank then '  ' else 'c' end as code from l where not no_object and not no_zone", l=_LINES)
def import_normalised(spark, d):
    """The typed fields of lines that are objects with a time in UTC."""
    e, i = read(spark, d, "events"), F.col("event_id")
    at = S.iso_micros("ts")
    body = F.struct(S.padded("alm-", F.when(i % 7 == 3, i - 1).otherwise(i) % 1_000_000, 6).alias("alarm_id"), F.when(i % 17 == 4, F.regexp_replace(at, "Z$", "")).otherwise(at).alias("opened_at"), F.when(i % 11 == 2, None).when(i % 23 == 6, "  ").otherwise("c").alias("code"))
    lines = e.select(i.alias("row_index"), F.when(i % 29 == 7, "[1]").otherwise(F.to_json(body)).alias("raw"))
    out = records.normalise(lines, "alarms").where("opened_at is not null")
    return out.select("row_index", "alarm_id", _ts("opened_at").alias("opened_at"), "code")


# Streams over a log of several partitions, with state

_SENT = """select *, cast(right(event_id, 6) as integer) as n, case when event_timestamp < timestamp '2024-01-10' then 0 when event_timestamp < timestamp '2024-01-20' then 1 else 2 end as part,
 load_percent between 0 and 100 as valid from telemetry"""
_BATCHES = """select event_id, ingestion_timestamp, valid, case when n % 50 = 0 then 1 else part end as batch, 0 as form from sent where not (n % 50 = 0 and part <> 0)
 union all select event_id, ingestion_timestamp, valid, 1, 0 from sent where n % 6 = 0 and n % 50 <> 0 and part = 0
 union all select event_id, ingestion_timestamp, valid, 2, 1 from sent where n % 12 = 0 and n % 50 <> 0 and part = 0 union all select event_id, ingestion_timestamp, valid, 2, 0 from sent where n % 50 = 0 and part = 0"""
_MARKS = "select (select max(ingestion_timestamp) from batches where batch = 0 and valid) as m0, (select max(ingestion_timestamp) from batches where batch <= 1 and valid and event_id not in (select event_id from sent where n % 50 = 0)) as m1"
_OUTCOMES = """select event_id, batch, case when not valid then 'invalid' when nth > 1 then case when form = 0 then 'duplicate' else 'conflict' end
 when batch = 1 and ingestion_timestamp < (select m0 from marks) - interval 300 second then 'late' when batch = 2 and ingestion_timestamp < (select m1 from marks) - interval 300 second then 'late' else 'accepted' end as outcome
 from (select *, row_number() over (partition by event_id order by batch) as nth from batches)"""
_STREAMED = {"sent": _SENT, "batches": _BATCHES, "marks": _MARKS, "outcomes": _OUTCOMES}


def _sent(spark, d) -> str:
    """A log of four partitions and three commits: new events, repeats, changed repeats and events that come too late."""
    root = scratch(spark)
    t = telemetry(spark, d).withColumns({c: F.col(c).cast("timestamp") for c in ("event_timestamp", "ingestion_timestamp")})
    day = F.col("event_timestamp")
    part = F.when(day < F.lit("2024-01-10").cast("timestamp"), 0).when(day < F.lit("2024-01-20").cast("timestamp"), 1).otherwise(2)
    # keys are made once, not again by each of the commits' scans
    t = written(t.withColumns({"key": F.encode("event_id", "utf-8"), "n": F.substring("event_id", -6, 6).cast("int"), "part": part}))
    n, part = F.col("n"), F.col("part")
    held_back, first = (n % 50 == 0) & (part == 0), part == 0
    own = t.where(n % 50 != 0)
    changed = own.where(first & (n % 12 == 0)).withColumn("temperature_c", F.col("temperature_c") + 0.5)
    files = [own.where(first), own.where(part == 1).unionByName(own.where(first & (n % 6 == 0))).unionByName(t.where(held_back)), own.where(part == 2).unionByName(changed).unionByName(t.where(held_back))]
    for rows in files:
        log.append(rows, f"{root}/log", partitions=4, encode=_telemetry_records)
    return root


def _telemetry_records(rows: DataFrame) -> DataFrame:
    return decode.encode(rows, "telemetry", "partition")


def _consume(spark, root: str, run_id: str = "run-1", **how) -> consumer.Report:
    return consumer.consume_log(spark, f"{root}/log", commits=1, topic="telemetry", bronze_dir=f"{root}/bronze", state_dir=f"{root}/state", checkpoint_dir=f"{root}/offsets", run_id=run_id, dead_letter_dir=f"{root}/dead", **how)


def _consumed(spark, d) -> tuple[str, consumer.Report]:
    """The log consumed as a stream of three batches."""
    root = _sent(spark, d)
    return root, _consume(spark, root)


@_query(
    "telemetry",
    """select event_id, case outcome when 'accepted' then 'bronze' else 'dead_letter' end as outcome, case outcome when 'late' then 'late_event' end as reason_code, cast(batch as bigint) as batch from outcomes where outcome in ('accepted', 'late')""",
    **_STREAMED,
)
def stream_state(spark, d):
    """What the state holds after three batches; late events are remembered, so their repeats are duplicates."""
    root, _ = _consumed(spark, d)
    held = consumer.StreamState(spark, f"{root}/state", "telemetry").events()
    return held.select("event_id", "outcome", "reason_code", F.col("batch").cast("long").alias("batch"))


@_query(
    "telemetry",
    """select event_id, outcome, batch, n from (select event_id, outcome, cast(batch as bigint) as batch, count(*) as n from outcomes where outcome in ('accepted', 'late') group by 1, 2, 3
 union all select event_id, case outcome when 'late' then 'late_event' when 'conflict' then 'duplicate_conflict' else 'invalid_telemetry' end, null, count(*) from outcomes where outcome in ('late', 'conflict', 'invalid') group by 1, 2)""",
    **_STREAMED,
)
def stream_keyed_state(spark, d):
    """Events that the state store holds, each with its outcome and batch, and the dead letters of the same run with state by key."""
    root = _sent(spark, d)
    _consume(spark, root, keyed=True)
    events = consumer.StreamState(spark, f"{root}/state", "telemetry").events()
    kept = keyed.stored(spark, f"{root}/offsets/offsets").join(events.drop("ingestion_timestamp"), ["event_id", "digest"])
    kept = kept.select("event_id", F.when(F.col("outcome") == "bronze", "accepted").otherwise("late").alias("outcome"), F.col("batch").cast("long").alias("batch"))
    rows = kept.unionByName(_letters(spark, root).withColumn("batch", F.lit(None).cast("long")))
    return rows.groupBy("event_id", "outcome", "batch").agg(F.count("*").alias("n"))


@_query(
    "telemetry",
    """select count(*) as consumed, count(*) filter (where outcome = 'accepted') as bronze_rows, cast(3 as bigint) as committed_batches, count(*) filter (where outcome = 'duplicate') as duplicates, count(*) filter (where outcome = 'late') as late,
 count(*) filter (where outcome in ('late', 'conflict', 'invalid')) as dead_letters, 'succeeded' as status from outcomes""",
    **_STREAMED,
)
def stream_run(spark, d):
    """The run's row in the run table."""
    root, _ = _consumed(spark, d)
    runs = consumer.StreamState(spark, f"{root}/state", "telemetry").runs()
    return runs.select("consumed", "bronze_rows", "committed_batches", "duplicates", "late", "dead_letters", "status")


@_query("telemetry", "select event_id, case outcome when 'late' then 'late_event' when 'conflict' then 'duplicate_conflict' else 'invalid_telemetry' end as reason_code, count(*) as letters from outcomes where outcome in ('late', 'conflict', 'invalid') group by 1, 2", **_STREAMED)
def stream_dead_letters(spark, d):
    """Envelopes read back: whose record each one is, decoded from its source bytes."""
    root, _ = _consumed(spark, d)
    body = F.from_json(F.decode("value", "utf-8") if dict(spark.read.parquet(f"{root}/dead").dtypes)["value"] == "binary" else F.col("value"), "reason_code string, source_value_base64 string, source_key_base64 string")
    rows = spark.read.parquet(f"{root}/dead").select(body.alias("b"))
    event = F.get_json_object(F.decode(F.unbase64("b.source_value_base64"), "utf-8"), "$.event_id")
    return rows.select(event.alias("event_id"), F.col("b.reason_code").alias("reason_code")).groupBy("event_id", "reason_code").agg(F.count("*").alias("letters"))


@_query("telemetry", f"select event_id, {_sql_ts('ingestion_timestamp')} as updated_at, 'run-1' as extraction_run_id from sent join (select event_id from outcomes where outcome = 'accepted') using (event_id)", **_STREAMED)
def stream_bronze(spark, d):
    """Bronze parts that the stream wrote, keyed by batch."""
    root, _ = _consumed(spark, d)
    return tables.read_bronze(spark, f"{root}/bronze", "telemetry_events").select("event_id", _ts("updated_at").alias("updated_at"), "extraction_run_id")


def _letters(spark, root: str) -> DataFrame:
    body = F.from_json("value", "reason_code string, source_value_base64 string")
    rows = spark.read.parquet(f"{root}/dead").select(body.alias("b"))
    return rows.select(F.get_json_object(F.decode(F.unbase64("b.source_value_base64"), "utf-8"), "$.event_id").alias("event_id"), F.col("b.reason_code").alias("outcome"))


class _Crash(RuntimeError):
    """What ``stream_restart`` raises between two writes of a batch."""


@_query(
    "telemetry",
    """select point, kind, event_id, outcome, n from (values ('bronze'), ('state'), ('dead_letters')) as p(point), (select 'bronze' as kind, event_id, cast(null as varchar) as outcome, cast(1 as bigint) as n from outcomes where outcome = 'accepted'
 union all select 'state', event_id, outcome || ' ' || batch, 1 from outcomes where outcome in ('accepted', 'late')
 union all select 'dead letter', event_id, case outcome when 'late' then 'late_event' when 'conflict' then 'duplicate_conflict' else 'invalid_telemetry' end as o, count(*) from outcomes where outcome in ('late', 'conflict', 'invalid') group by 1, 2, 3) as t""",
    **_STREAMED,
)
def stream_restart(spark, d):
    """Runs that crash in the second batch after each of its writes, and run again: all tables are those of an undisturbed run."""
    found = []
    for point in consumer.WRITES:
        root = _sent(spark, d)

        def crash(write: str, batch: str, point: str = point) -> None:
            if write == point and int(batch) == 1:
                raise _Crash(point)

        try:
            _consume(spark, root, "run-1", after=crash)
        except Exception as error:
            if "_Crash" not in str(error):
                raise
        _consume(spark, root, "run-2")
        state = consumer.StreamState(spark, f"{root}/state", "telemetry").events()
        told = F.concat(F.when(F.col("outcome") == "bronze", "accepted").otherwise("late"), F.lit(" "), F.col("batch").cast("long").cast("string"))
        bronze_rows = tables.read_bronze(spark, f"{root}/bronze", "telemetry_events").select(F.lit("bronze").alias("kind"), "event_id", F.lit(None).cast("string").alias("outcome"))
        rows = bronze_rows.unionByName(state.select(F.lit("state").alias("kind"), "event_id", told.alias("outcome"))).unionByName(_letters(spark, root).withColumn("kind", F.lit("dead letter")))
        found.append(rows.groupBy("kind", "event_id", "outcome").agg(F.count("*").alias("n")).withColumn("point", F.lit(point)))
    return tables.union_by_name(*found)


@_query(
    "telemetry",
    """select event_id, part as partition, place as "offset", place // (select count(*) // 20 + 1 from telemetry) as batch from (select event_id, part, row_number() over (partition by part order by event_id) - 1 as place from (select event_id, cast(right(event_id, 6) as integer) % 5 as part from telemetry))""",
)
def stream_log_batches(spark, d):
    """Where a log of five partitions keeps each event, and the micro-batch, bounded by messages, that brings it."""
    root, t = scratch(spark), telemetry(spark, d)
    t = t.withColumns({c: F.col(c).cast("timestamp") for c in ("event_timestamp", "ingestion_timestamp")})
    rows = t.withColumns({"key": F.encode("event_id", "utf-8"), "partition": F.substring("event_id", -6, 6).cast("int") % 5})
    log.append(rows, f"{root}/log", encode=_telemetry_records)
    bound = 5 * (t.count() // 20 + 1)

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.decode("key", "utf-8").alias("event_id"), "partition", "offset").write.mode("overwrite").parquet(f"{root}/seen/batch={number}")

    query = log.stream(spark, f"{root}/log", f"{root}/planned", messages=bound).writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/offsets").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(f"{root}/seen").select("event_id", F.col("partition").cast("long").alias("partition"), "offset", F.col("batch").cast("long").alias("batch"))


# Ranks and comparison over whole relations


_TICKS = "select speed, i as tick, s + to_microseconds(cast(i * speed * 21600000000 as bigint)) as now from (select s, speed, unnest(range(cast(ceil((epoch_us(e) - epoch_us(s)) / (speed * 21600000000)) as bigint) + 1)) as i from (select min(event_timestamp) as s, max(event_timestamp) as e from telemetry), (values (0.5), (1.0), (2.0), (4.0)) as v(speed))"
_SHOWN = "select speed, tick, now, (select count(*) from telemetry where event_timestamp <= now) as applied, (select max(event_timestamp) from telemetry where event_timestamp <= now) as last from ticks"


@_query("telemetry", f"select cast(speed as double) as speed, tick, {_sql_ts('now')} as now, applied, {_sql_ts('last')} as last_applied, applied = (select count(*) from telemetry) as complete from shown", ticks=_TICKS, shown=_SHOWN)
def replay_ticks(spark, d):
    """A tick of six hours at each speed: events applied, the last of them, whether the replay is complete."""
    t = telemetry(spark, d)
    shown = replay.as_of(replay.ticks(t, 6 * 3600 * 1000), t, "speed", "tick")
    return shown.select("speed", "tick", _ts("now").alias("now"), "applied", _ts("last_applied").alias("last_applied"), "complete")


@_query("telemetry", "select event_id, cast((row_number() over (order by event_id) - 1) // 37 as bigint) as batch from telemetry")
def keyset_one_hour(spark, d):
    """Batches of rows that all have the same time."""
    rows = telemetry(spark, d).select("event_id").withColumn("updated_at", F.lit(EXTRACTED))
    return keyset.batches(rows, "event_id", size=37).select("event_id", "batch")


@_query(
    "telemetry",
    """select event_id, case when n % 97 = 0 then 'missing_right' else 'changed' end as problem from (select event_id, cast(right(event_id, 6) as integer) as n, load_percent from telemetry) where n % 97 = 0 or n % 89 = 0 or n % 79 = 0
 union all select 'new-' || event_id, 'missing_left' from telemetry where cast(right(event_id, 6) as integer) % 83 = 0""",
)
def relation_differences(spark, d):
    """Rows that were dropped, changed, repeated and added, named exactly."""
    t, n = telemetry(spark, d), F.substring("event_id", -6, 6).cast("int")
    other = t.where(n % 97 != 0).withColumn("temperature_c", F.when(n % 89 == 0, F.col("temperature_c") + 0.25).otherwise(F.col("temperature_c")))
    added = t.where(n % 83 == 0).withColumn("event_id", F.concat(F.lit("new-"), "event_id"))
    return verify.differences(t, other.unionByName(other.where(n % 79 == 0)).unionByName(added), "event_id")


# Upserts into a relation in versions

_PUT_IN = "select o_orderkey, o_orderstatus, o_totalprice * 2 as o_totalprice from orders where o_orderkey % 5003 = 0 union all select -1 - o_orderkey, 'N', o_totalprice from orders where o_orderkey % 1009 = 0"


def _upserted(spark, d) -> Versions:
    """Orders as version 1; some of them changed and some added as version 2."""
    o, k = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    changed = o.where(k % 5003 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    added = o.where(k % 1009 == 0).select((-1 - k).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    held = Versions(spark, f"{scratch(spark)}/orders")
    held.create(o, "o_orderkey", buckets=32)
    held.upsert(changed.unionByName(added))
    return held


@_query(
    "",
    """select cast(1 as bigint) as version, o_orderkey, o_orderstatus, round(o_totalprice, 4) as o_totalprice from orders union all select 2, coalesce(n.o_orderkey, o.o_orderkey), coalesce(n.o_orderstatus, o.o_orderstatus), round(coalesce(n.o_totalprice, o.o_totalprice), 4) from orders o full join neu n on n.o_orderkey = o.o_orderkey""",
    neu=_PUT_IN,
)
def upsert_versions(spark, d):
    """Both versions of an upserted relation, read after the upsert."""
    held = _upserted(spark, d)
    both = [held.read(n).withColumn("version", F.lit(n).cast("long")) for n in (1, 2)]
    return both[0].unionByName(both[1]).select("version", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"))


@_query(
    "",
    """select cast(1 as bigint) as version, (select count(*) from orders) as rows, (select count(*) from orders) as inserted, 0 as updated, 0 as rewritten_in_vain, 0 as left_unwritten union all
 select 2, (select count(*) from orders) + (select count(*) from neu where o_orderkey < 0), (select count(*) from neu where o_orderkey < 0), (select count(*) from neu where o_orderkey >= 0), 0, 0""",
    neu=_PUT_IN,
)
def upsert_rewrites(spark, d):
    """Rows of each version by its index and what its record counts; files that were rewritten but held no changed key, or that held one and stayed."""
    held = _upserted(spark, d)
    gone = held.files(1).join(held.files(2), "_file", "left_anti").select("_file")
    holders = held.read(1).select("o_orderkey", F.col("_metadata.file_path").alias("_file")).where(F.col("o_orderkey") % 5003 == 0).select("_file").distinct()
    differing = {"rewritten_in_vain": gone.join(holders, "_file", "left_anti").count(), "left_unwritten": holders.join(gone, "_file", "left_anti").count()}
    out = []
    for n in (1, 2):
        v, wrong = held.version(n), differing if n == 2 else dict.fromkeys(differing, 0)
        told = {"inserted": v.inserted, "updated": v.updated} | wrong
        out.append(held.files(n).agg(F.sum("rows").alias("rows")).select(F.lit(n).cast("long").alias("version"), "rows", *[F.lit(x).cast("long").alias(c) for c, x in told.items()]))
    return out[0].unionByName(out[1])


# Published documents against their schemas

_EVENT_DOCS = "select event_id as id, cast(right(event_id, 6) as integer) as n from telemetry"
_INCIDENT_DOCS = "select incident_id as id, cast(right(incident_id, 6) as integer) as n, resolved_at from (select * exclude (terminal_id) from incidents) join bridge using (equipment_id)"


@_query(
    "telemetry incidents",
    """select 'event' as document, id, '' as path, 'json' as rule from e where n % 29 = 0 union all select 'event', id, '/state', 'enum' from e where n % 7 = 0 and n % 29 <> 0
 union all select 'event', id, '/event_timestamp', 'required' from e where n % 11 = 0 and n % 29 <> 0 union all select 'event', id, '/note', 'additionalProperties' from e where n % 13 = 0 and n % 29 <> 0
 union all select 'event', id, '/available', 'type' from e where n % 17 = 0 and n % 29 <> 0 union all select 'event', id, '/terminal_id', 'pattern' from e where n % 19 = 0 and n % 29 <> 0
 union all select 'event', id, '/event_timestamp', 'pattern' from e where n % 23 = 0 and n % 11 <> 0 and n % 29 <> 0
 union all select 'incident', id, '/severity', 'enum' from i where n % 5 = 0 union all select 'incident', id, '/root_cause', 'minLength' from i where n % 7 = 0
 union all select 'incident', id, '/status', 'enum' from i where n % 11 = 0 union all select 'incident', id, '/resolved_at', 'pattern' from i where n % 13 = 0 and resolved_at is not null""",
    bridge=base._BRIDGE, e=_EVENT_DOCS, i=_INCIDENT_DOCS,
)
def document_issues(spark, d):
    """Event and incident documents, spoilt in every way their schemas speak of, and the path and keyword of each issue."""
    n, put = F.col("n"), lambda c, by, value: F.when(F.col("n") % by == 0, value).otherwise(F.col(c)).alias(c)
    unzoned = lambda c: F.regexp_replace(c, "Z$", "")
    e = documents.replay_events(telemetry(spark, d)).withColumns({"n": F.substring("event_id", -6, 6).cast("int"), "id": F.col("event_id")})
    at = F.when(n % 11 == 0, None).when(n % 23 == 0, unzoned("event_timestamp")).otherwise(F.col("event_timestamp")).alias("event_timestamp")
    body = F.to_json(F.struct("event_id", "equipment_id", put("terminal_id", 19, "TM-1"), at, put("state", 7, "BROKEN"), "available", F.when(n % 13 == 0, "x").alias("note")))
    body = F.when(n % 17 == 0, F.regexp_replace(body, '"available":(true|false)', '"available":"$1"')).otherwise(body)
    e = e.select("id", F.when(n % 29 == 0, F.substring(body, 1, 20)).otherwise(body).alias("body"))
    i = documents.incidents(documents.incidents_with_terminal(incidents(spark, d), telemetry(spark, d))).withColumns({"n": F.substring("incident_id", -6, 6).cast("int"), "id": F.col("incident_id")})
    spoilt = F.struct("incident_id", "equipment_id", "terminal_id", put("severity", 5, "INFO"), put("status", 11, "CLOSED"), "opened_at", put("resolved_at", 13, unzoned("resolved_at")), put("root_cause", 7, ""))
    i = i.select("id", F.to_json(spoilt, {"ignoreNullFields": "false"}).alias("body"))
    found = [jsonschema.violations(rows, "body", DOCUMENT_SCHEMAS[name], "id").withColumn("document", F.lit(kind)) for rows, name, kind in ((e, "event-replay", "event"), (i, "incidents", "incident"))]
    return found[0].unionByName(found[1]).select("document", "id", "path", "rule")


@_query(
    "telemetry",
    """select terminal_id, path, rule from (select distinct terminal_id from telemetry) join (values ('TM-001', '/availability/available_intervals', 'minimum'), ('TM-002', '/availability/value', 'type'), ('TM-003', '/mttr_minutes', 'type'), ('TM-003', '/schema_version', 'const'), ('TM-004', '/availability/value', 'maximum')) as v(terminal_id, path, rule) using (terminal_id)
 union all select terminal_id, '/' || place || '/downtime_minutes', 'minimum' from (select terminal_id, equipment_id, row_number() over (partition by terminal_id order by equipment_id) - 1 as place from (select distinct terminal_id, equipment_id from telemetry)) where cast(right(equipment_id, 3) as integer) % 5 = 0""",
)
def overview_document_issues(spark, d):
    """Overviews whose nested and conditional rules are broken, and a list of equipment per terminal with wrong items."""
    kpis, at = written(kpi.overview_kpis(*base._all(spark, d))), F.col("terminal_id")
    put = lambda terminal, value, c: F.when(at == terminal, value).otherwise(F.col(c))
    share = F.struct(
        put("TM-001", -1, "availability.available_intervals").alias("available_intervals"),
        put("TM-002", 0, "availability.scheduled_intervals").alias("scheduled_intervals"),
        put("TM-002", 0.5, "availability.value").alias("value"),
    )
    share = F.when(at == "TM-004", share.withField("value", F.lit(1.5))).otherwise(share)
    over = documents.overview(kpis).withColumns({"availability": share, "resolved_incident_count": put("TM-003", 0, "resolved_incident_count"), "mttr_minutes": put("TM-003", 5.0, "mttr_minutes"), "schema_version": put("TM-003", 2, "schema_version")})
    over = over.select("terminal_id", F.to_json(F.struct(*over.columns), {"ignoreNullFields": "false"}).alias("body"))
    machines = documents.equipment(telemetry(spark, d), alarms(spark, d), kpis)
    machines = machines.withColumn("downtime_minutes", F.when(F.substring("equipment_id", -3, 3).cast("int") % 5 == 0, -5).otherwise(F.col("downtime_minutes")))
    item = F.struct("equipment_id", *[c for c in machines.columns if c != "equipment_id"])
    lists = machines.groupBy("terminal_id").agg(F.to_json(F.array_sort(F.collect_list(item)), {"ignoreNullFields": "false"}).alias("body"))
    found = jsonschema.violations(over, "body", DOCUMENT_SCHEMAS["overview"], "terminal_id")
    return found.unionByName(jsonschema.violations(lists, "body", {"type": "array", "minItems": 1, "items": DOCUMENT_SCHEMAS["equipment"]}, "terminal_id"))


# Documents read back, texts, scalars


@_query("telemetry movements incidents alarms", f"select terminal_id, source_period_start, available_intervals, scheduled_intervals, availability, throughput, mttr_minutes, active_incidents from ({base._KPI})", **base._PARTS, inc=base._INC, al=base._ALARM)
def overview_document_fields(spark, d):
    """The overview document as JSON, parsed again."""
    over = documents.overview(kpi.overview_kpis(*base._all(spark, d)))
    text = F.to_json(F.struct(*sorted(over.columns)), {"ignoreNullFields": "false"})
    shape = "terminal_id string, source_period_start timestamp, availability struct<available_intervals: long, scheduled_intervals: long, value: double>, throughput long, mttr_minutes double, active_incidents long"
    b = over.select(F.from_json(text, shape).alias("b"))
    return b.select(
        "b.terminal_id", F.date_format("b.source_period_start", "yyyy-MM-dd HH:mm:ss.000000").alias("source_period_start"), "b.availability.available_intervals", "b.availability.scheduled_intervals",
        F.round("b.availability.value", 6).alias("availability"), "b.throughput", F.round("b.mttr_minutes", 6).alias("mttr_minutes"), "b.active_incidents",
    )


base.ORACLES["overview_document_fields"] = base.ORACLES["overview_document_fields"].replace("select terminal_id, source_period_start,", "select terminal_id, left(source_period_start, 19) || '.000000' as source_period_start,")


@_query(
    "telemetry movements incidents alarms",
    f"""select terminal_id, coalesce(printf('%.1f%%', 100 * a), 'Unavailable') as availability, cast(throughput as varchar) as throughput, coalesce(printf('%.1f min', mttr), 'Unavailable') as mttr from (select p.terminal_id, avail * 1.0 / nullif(scheduled, 0) as a, coalesce(m.throughput, 0) as throughput, repair / nullif(resolved, 0) as mttr
 from period p left join moves m using (terminal_id) left join inc i using (terminal_id))""",
    **base._PARTS, inc=base._INC,
)
def kpi_label_rows(spark, d):
    return presentation.kpi_labels(kpi.overview_kpis(*base._all(spark, d))).select("terminal_id", "availability", "throughput", "mttr")


@_query("telemetry", "select event_id, strftime(event_timestamp, '%H:%M') || ' ' || equipment_id || ' is ' || state || ' (' || if(available, 'available', 'not available') || ')' as label from telemetry")
def replay_label_rows(spark, d):
    return presentation.replay_labels(telemetry(spark, d)).select("event_id", "label")


@_query("telemetry", f"select count(distinct terminal_id) as terminals, {_sql_ts('min(event_timestamp)')} as period_start, {_sql_ts('max(event_timestamp)')} as period_end, {_sql_ts('max(ingestion_timestamp)')} as generated_at from telemetry")
def first_snapshot_facts(spark, d):
    t = telemetry(spark, d)
    return t.agg(F.count_distinct("terminal_id").alias("terminals"), _ts(F.min("event_timestamp")).alias("period_start"), _ts(F.max("event_timestamp")).alias("period_end"), _ts(F.max("ingestion_timestamp")).alias("generated_at"))


@_query(
    "telemetry",
    f"""select event_id, {_sql_ts('event_timestamp')} as parsed, true as no_zone_is_null, strftime(event_timestamp, '%Y%m%dT%H%M%S.%fZ-') || event_id as slug, base64(encode(event_id)) as b64, 'a' || chr(10) || 'b' as lines, true as near, load_percent is null as apart,
 '{{"available":' || cast(available as varchar) || ',"event_id":"' || event_id || '","nothing":null}}' as json, greatest(0, date_diff('second', event_timestamp, timestamp '{base.INSTANT}')) as age, cast(event_timestamp as date) = date '2024-01-15' as on_day from telemetry""",
)
def scalar_surface(spark, d):
    t, load = telemetry(spark, d), F.col("load_percent")
    text = S.iso_micros("event_timestamp")
    return t.withColumn("nothing", F.lit(None).cast("string")).select(
        "event_id", _ts(S.parse_utc(text)).alias("parsed"), S.parse_utc(F.regexp_replace(text, "Z$", "")).isNull().alias("no_zone_is_null"), S.cursor_slug("event_timestamp", "event_id").alias("slug"), S.base64_line(F.encode("event_id", "utf-8")).alias("b64"),
        S.unix_lines(F.lit("a\r\nb")).alias("lines"), S.same_number(load, load + 1e-13).alias("near"), S.same_number(load, load + 1).alias("apart"), S.canonical_json("event_id", "available", "nothing").alias("json"),
        F.greatest(F.lit(0), S.seconds_between("event_timestamp", F.lit(base.INSTANT))).cast("long").alias("age"), (F.to_date("event_timestamp") == F.lit("2024-01-15").try_cast("date")).alias("on_day"),
    )


@_query(
    "",
    """select o_orderkey, hour(o_orderdate) as h, minute(o_orderdate) as mi, second(o_orderdate) as s, cast(cast(o_orderdate as date) + 3 as varchar) as later, strftime(to_timestamp(o_orderkey), '%Y-%m-%d %H:%M:%S') as unix, coalesce(nullif(o_orderpriority, '1-URGENT'), '?') as filled,
 o_totalprice between 1000 and 100000 as mid, o_orderstatus in ('F', 'O') as known, contains(o_orderpriority, 'IGH') as has, ends_with(o_orderpriority, 'W') as ends, o_orderpriority is null as missing, cast(o_totalprice as bigint) - o_totalprice < 1 as whole from orders""",
)
def column_surface(spark, d):
    o = read(spark, d, "orders")
    o = o.withColumn("gone", F.lit(1)).drop("gone").withColumnRenamed("o_orderpriority", "priority").withColumn("filled", F.nullif("priority", F.lit("1-URGENT"))).fillna({"filled": "?"})
    c = F.col("priority")
    return o.select(
        "o_orderkey", F.hour("o_orderdate").cast("long").alias("h"), F.minute("o_orderdate").cast("long").alias("mi"), F.second("o_orderdate").cast("long").alias("s"), F.date_add(F.to_date("o_orderdate"), 3).cast("string").alias("later"), F.from_unixtime("o_orderkey").alias("unix"), "filled",
        F.col("o_totalprice").between(1000, 100000).alias("mid"), F.col("o_orderstatus").isin("F", "O").alias("known"), c.contains("IGH").alias("has"), c.endswith("W").alias("ends"), c.isNull().alias("missing"), (F.col("o_totalprice").cast("long") - F.col("o_totalprice") < 1).alias("whole"),
    )


@_query(
    "",
    """select r_name as name, n, first_nation, last_nation from (select n_regionkey, count(*) as n, min(n_name) as first_nation, max(n_name) as last_nation from (select * from nation union all select * from nation where n_nationkey < 5) where n_nationkey in (select distinct n_nationkey from nation) group by 1) join region on r_regionkey = n_regionkey
 union all select 'pairs', (select count(*) from region) * (select count(*) from region), null, null""",
)
def frame_surface(spark, d):
    """Unions by place and by name, distinct rows, a bounded cross join of a fixed table, joins, sorting."""
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    twice = n.union(n.where("n_nationkey < 5")).join(n.select("n_nationkey").dropDuplicates(), "n_nationkey", "left_semi")
    by = twice.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("n_name").alias("first_nation"), F.max("n_name").alias("last_nation"))
    named = by.join(r.withColumnsRenamed({"r_regionkey": "n_regionkey", "r_name": "name"}), "n_regionkey").sort("name").select("name", "n", "first_nation", "last_nation")
    pairs = r.select("r_name").distinct().crossJoin(r.select(F.col("r_name").alias("other"))).agg(F.count("*").alias("n")).select(F.lit("pairs").alias("name"), "n")
    return named.unionByName(pairs, allowMissingColumns=True)


@_query("telemetry", "select terminal_id, sha256(string_agg(part, ',' order by day)) as digest from (select terminal_id, cast(event_timestamp as date) as day, sha256(string_agg(event_id, ',' order by event_id)) as part from telemetry group by 1, 2) group by 1")
def result_hash_by_day(spark, d):
    """As ``result_hash``, in two levels: no array holds more than a terminal's day, and then a digest a day."""
    day = telemetry(spark, d).groupBy("terminal_id", F.to_date("event_timestamp").alias("day")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("event_id")), ","), 256).alias("part"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("day", "part"))), lambda x: x["part"])
    return day.groupBy("terminal_id").agg(F.sha2(F.array_join(parts, ","), 256).alias("digest"))


QUERIES, ORACLES = base.QUERIES, base.ORACLES
assert set(ORACLES) <= set(QUERIES)
