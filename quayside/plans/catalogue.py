"""The registered queries over the driver's tables, each with its oracle SQL.

Every query runs over whole tables; a limit stands only where top-k or a page is
the operator itself.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import alarms, incidents, movements, read, telemetry, with_ctes
from ..functions import scalars as S
from ..operators import documents, explore, kpi, observe, quality, replay, verify
from ..schemas import ENUMS, TABLES
from ..sinks import upsert
from ..sources import generators, keyset
from ..streaming import classify as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Half-open window of the headline summary, and instants used elsewhere.
START, END, INSTANT = datetime(2024, 1, 5), datetime(2024, 1, 20), datetime(2024, 1, 15, 12)


def _ts(c: str | Column) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def _query(ctes: str = "", body: str | None = None, **more: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if body is not None:
            ORACLES[f.__name__] = with_ctes(ctes, body, **more)
        return f

    return add


_PERIOD = """select terminal_id, min(event_timestamp) as s, max(event_timestamp) as e, count(*) as scheduled, count(*) filter (where available) as avail,
 count(*) filter (where state = 'ACTIVE') as active from telemetry group by terminal_id"""
_PAIRS = """select terminal_id, container_ref, min(event_timestamp) filter (where movement_type in ('GATE_IN', 'LOAD')) as a,
 max(event_timestamp) filter (where movement_type in ('GATE_OUT', 'DISCHARGE')) as b from movements group by terminal_id, container_ref"""
_MOVES = "select terminal_id, count(*) filter (where a is not null and b is not null) as throughput, avg(date_diff('second', a, b) / 60.0) filter (where a is not null and b is not null) as dwell from pairs group by terminal_id"
_INC_AGG = """count(*) filter (where status = 'RESOLVED') as resolved, coalesce(sum(date_diff('second', opened_at, resolved_at) / 60.0) filter (where status = 'RESOLVED'), 0) as repair,
 count(*) filter (where severity = 'CRITICAL') as failures, count(*) filter (where status = 'OPEN' and opened_at <= e and (resolved_at is null or resolved_at > e)) as active_inc"""
_BRIDGE = "select equipment_id, min(terminal_id) as t from telemetry group by equipment_id"
_INC = f"select p.terminal_id, {_INC_AGG} from incidents i join period p on p.terminal_id = 'TM-001' group by p.terminal_id"
_INC_EQ = f"select p.terminal_id, {_INC_AGG} from incidents i join bridge b on b.equipment_id = i.equipment_id join period p on p.terminal_id = b.t group by p.terminal_id"
_ALARM = "select p.terminal_id, count(*) filter (where severity = 'CRITICAL' and opened_at between s and e) as critical from alarms a cross join period p group by p.terminal_id"
_ALARM_EQ = """select p.terminal_id, count(a.alarm_id) filter (where a.severity = 'CRITICAL' and a.opened_at between s and e) as critical
 from period p left join bridge b on b.t = p.terminal_id left join alarms a on a.equipment_id = b.equipment_id group by p.terminal_id"""
_INC_OUT = "select terminal_id, resolved as resolved_incident_count, round(repair, 6) as repair_minutes, failures as qualifying_failure_count, active_inc as active_incidents from inc"
_KPI = f"""select p.terminal_id, {_sql_ts('s')} as source_period_start, {_sql_ts('e')} as source_period_end, avail as available_intervals, scheduled as scheduled_intervals, active as active_intervals,
 avail * 5 as available_time_minutes, coalesce(resolved, 0) as resolved_incident_count, round(coalesce(repair, 0), 6) as repair_minutes, coalesce(failures, 0) as qualifying_failure_count,
 round(scheduled * 5.0 / 60.0, 6) as operating_hours, coalesce(throughput, 0) as throughput, round(dwell, 6) as average_dwell_minutes, round(avail * 1.0 / nullif(scheduled, 0), 6) as availability,
 round(active * 1.0 / nullif(avail, 0), 6) as utilization, round(repair / nullif(resolved, 0), 6) as mttr_minutes, round(scheduled * 5.0 / 60.0 / nullif(failures, 0), 6) as mtbf_hours,
 coalesce(active_inc, 0) as active_incidents, coalesce(critical, 0) as critical_alarms from period p left join moves m using (terminal_id) left join inc i using (terminal_id) left join al a using (terminal_id)"""
_PARTS = {"period": _PERIOD, "pairs": _PAIRS, "moves": _MOVES}


def _rounded(df: DataFrame) -> DataFrame:
    out = []
    for c, kind in df.dtypes:
        x = F.round(c, 6) if kind == "double" else _ts(c) if kind.startswith("timestamp") else F.col(c)
        out.append(x.alias(c))
    return df.select(*out)


# KPIs


@_query(
    "telemetry",
    f"""select terminal_id, state, count(*) as event_count, cast(sum(case when available then 1 else 0 end) as bigint) as available_event_count, round(avg(load_percent), 6) as average_load_percent,
 round(avg(temperature_c), 6) as average_temperature_c from telemetry where event_timestamp >= timestamp '{START}' and event_timestamp < timestamp '{END}' group by terminal_id, state order by 1, 2""",
)
def telemetry_state_summary(spark, d):
    return kpi.state_summary(telemetry(spark, d), START, END)


@_query("telemetry", f"select terminal_id, {_sql_ts('s')} as source_period_start, {_sql_ts('e')} as source_period_end, scheduled as scheduled_intervals, avail as available_intervals, active as active_intervals, avail * 5 as available_time_minutes from period", period=_PERIOD)
def telemetry_period(spark, d):
    return _rounded(kpi.telemetry_period(telemetry(spark, d)))


@_query("movements", f"select terminal_id, container_ref, {_sql_ts('a')} as entry_timestamp, {_sql_ts('b')} as exit_timestamp from pairs", pairs=_PAIRS)
def movement_pairs_minmax(spark, d):
    return _rounded(kpi.movement_pairs(movements(spark, d)))


@_query(
    "movements",
    f"select terminal_id, container_ref, {_sql_ts('entry_at')} as entry_timestamp, {_sql_ts('event_timestamp')} as exit_timestamp from w where movement_type in ('GATE_OUT', 'DISCHARGE') and was in ('GATE_IN', 'LOAD')",
    w="select *, lag(movement_type) over k as was, lag(event_timestamp) over k as entry_at from movements window k as (partition by terminal_id, container_ref order by event_timestamp, movement_id)",
)
def movement_pairs_sequential(spark, d):
    return _rounded(kpi.movement_pairs(movements(spark, d), "sequential"))


@_query("movements", "select terminal_id, throughput, round(dwell, 6) as average_dwell_minutes from moves", pairs=_PAIRS, moves=_MOVES)
def movement_metrics(spark, d):
    return _rounded(kpi.movement_metrics(kpi.movement_pairs(movements(spark, d))))


@_query("telemetry incidents", _INC_OUT, period=_PERIOD, inc=_INC)
def incident_metrics_reference(spark, d):
    return _rounded(kpi.incident_metrics(incidents(spark, d), telemetry(spark, d)))


@_query("telemetry incidents", _INC_OUT, period=_PERIOD, bridge=_BRIDGE, inc=_INC_EQ)
def incident_metrics_by_equipment(spark, d):
    return _rounded(kpi.incident_metrics(incidents(spark, d), telemetry(spark, d), "equipment"))


@_query("telemetry alarms", "select terminal_id, critical as critical_alarms from al", period=_PERIOD, al=_ALARM)
def alarm_metrics_reference(spark, d):
    return kpi.alarm_metrics(alarms(spark, d), telemetry(spark, d))


@_query("telemetry alarms", "select terminal_id, critical as critical_alarms from al", period=_PERIOD, bridge=_BRIDGE, al=_ALARM_EQ)
def alarm_metrics_by_equipment(spark, d):
    return kpi.alarm_metrics(alarms(spark, d), telemetry(spark, d), "equipment")


def _all(spark, d):
    return telemetry(spark, d), movements(spark, d), incidents(spark, d), alarms(spark, d)


@_query("telemetry movements incidents alarms", _KPI, **_PARTS, inc=_INC, al=_ALARM)
def overview_kpis(spark, d):
    return _rounded(kpi.overview_kpis(*_all(spark, d)))


@_query("telemetry movements incidents alarms", _KPI, **_PARTS, bridge=_BRIDGE, inc=_INC_EQ, al=_ALARM_EQ)
def overview_kpis_by_equipment(spark, d):
    return _rounded(kpi.overview_kpis(*_all(spark, d), attribution="equipment"))


@_query("telemetry", "select count(*) filter (where available) as available_intervals, count(*) as scheduled_intervals, round(count(*) filter (where available) * 1.0 / count(*), 6) as value from telemetry")
def availability(spark, d):
    return _rounded(kpi.availability(telemetry(spark, d)))


@_query(
    "telemetry",
    f"select {_sql_ts('hour')} as hour, a as available_intervals, n as scheduled_intervals, round(a * 1.0 / n, 6) as availability from h",
    h="select date_trunc('hour', event_timestamp) as hour, count(*) filter (where available) as a, count(*) as n from telemetry group by 1",
)
def hourly_availability(spark, d):
    return _rounded(kpi.hourly_availability(telemetry(spark, d)))


@_query("telemetry", "select round(min(a), 6) as least, round(max(a), 6) as most from h", h="select count(*) filter (where available) * 1.0 / count(*) as a from telemetry group by date_trunc('hour', event_timestamp)")
def availability_range(spark, d):
    return _rounded(explore.value_range(kpi.hourly_availability(telemetry(spark, d)), "availability"))


# Validation and Silver.  Bronze is telemetry twice: a tenth of the rows comes again in a later run.

_BRONZE = """select *, 1 as run, event_timestamp as up from telemetry union all
 select event_id, equipment_id, terminal_id, event_timestamp, ingestion_timestamp, state, available, load_percent / 2, temperature_c, 2, event_timestamp + interval 1 minute from telemetry where cast(right(event_id, 6) as integer) % 10 = 0"""
_WINNER = "select *, row_number() over (partition by event_id order by up desc, run desc) > 1 as superseded from bronze"
_JUDGED = """select *, case when superseded then 'DUPLICATE_KEY' else concat_ws(',', case when not load_percent between 0 and 100 or not temperature_c between -20 and 150 then 'RANGE_INVALID' end,
 case when state in ('UNAVAILABLE', 'MAINTENANCE') and available or state not in ('UNAVAILABLE', 'MAINTENANCE') and not available or ingestion_timestamp < event_timestamp then 'TEMPORAL_INVALID' end) end as codes from winner"""


def _bronze_telemetry(spark, d):
    rows = telemetry(spark, d).withColumn("run", F.lit(1)).withColumn("up", F.col("event_timestamp"))
    again = rows.where(F.substring("event_id", -6, 6).cast("int") % 10 == 0)
    again = again.withColumns({"run": F.lit(2), "up": F.col("event_timestamp") + F.expr("interval 1 minute"), "load_percent": F.col("load_percent") / 2})
    out = rows.unionByName(again)
    stamp = F.col("up").cast("timestamp")
    out = out.withColumns(
        {
            "event_timestamp": F.col("event_timestamp").cast("timestamp"),
            "ingestion_timestamp": F.col("ingestion_timestamp").cast("timestamp"),
            "created_at": stamp,
            "updated_at": stamp,
            "source_table": F.lit("telemetry_events"),
            "extraction_run_id": F.col("run").cast("string"),
            "source_updated_at": stamp,
            "extracted_at": stamp,
            "_path": F.lit(""),
            "_ordinal": F.lit(0).cast("long"),
        }
    )
    return out.drop("run", "up")


def _silver_telemetry(spark, d):
    from ..operators import silver

    rows = _bronze_telemetry(spark, d)
    known = {c: rows.select(c).distinct() for c in ("equipment_id", "terminal_id")}
    return silver.split(rows, "telemetry_events", known)


@_query("telemetry", "select event_id, equipment_id, state, round(load_percent, 6) as load_percent, cast(run as varchar) as extraction_run_id from judged where codes = ''", bronze=_BRONZE, winner=_WINNER, judged=_JUDGED)
def silver_accepted(spark, d):
    return _silver_telemetry(spark, d).accepted.select("event_id", "equipment_id", "state", F.round("load_percent", 6).alias("load_percent"), "extraction_run_id")


@_query("telemetry", "select event_id as primary_key, 'telemetry_events' as source_table, codes as reason_codes from judged where codes <> ''", bronze=_BRONZE, winner=_WINNER, judged=_JUDGED)
def quarantine_rows(spark, d):
    return _silver_telemetry(spark, d).quarantine.select("primary_key", "source_table", F.concat_ws(",", "reason_codes").alias("reason_codes"))


@_query("telemetry", "select code as reason_code, count(*) as count from (select unnest(string_split(codes, ',')) as code from judged where codes <> '') group by 1", bronze=_BRONZE, winner=_WINNER, judged=_JUDGED)
def quarantine_reason_counts(spark, d):
    from ..operators import silver

    return silver.reason_counts(_silver_telemetry(spark, d).quarantine)


@_query("telemetry", "select event_id, cast(run as varchar) as extraction_run_id, superseded from winner", bronze=_BRONZE, winner=_WINNER)
def dedup_winner(spark, d):
    from ..operators import silver

    return silver.with_winner(_bronze_telemetry(spark, d), "event_id").select("event_id", "extraction_run_id", F.col("_superseded").alias("superseded"))


@_query("", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, nth from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_quantity) as nth from lineitem) where nth > 1")
def batch_duplicate_keys(spark, d):
    order = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = read(spark, d, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber")).withColumn("order", order)
    return quality.batch_duplicates(rows, "key", "order").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("nth").cast("long").alias("nth"))


@_query("movements telemetry", "select movement_id, equipment_id from movements where equipment_id not in (select equipment_id from telemetry where state = 'ACTIVE' and load_percent > 300)")
def reference_violations(spark, d):
    known = telemetry(spark, d).where((F.col("state") == "ACTIVE") & (F.col("load_percent") > 300))
    return quality.missing_references(movements(spark, d), known, "equipment_id").select("movement_id", "equipment_id")


@_query("", "select l_orderkey, l_linenumber, l_partkey from lineitem join orders on o_orderkey = l_orderkey where l_shipdate < o_orderdate")
def temporal_violations(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return rows.where(F.col("l_shipdate") < F.col("o_orderdate")).select("l_orderkey", "l_linenumber", "l_partkey")


@_query("telemetry", "select event_id, load_percent, temperature_c from telemetry where not load_percent between 0 and 100 or not temperature_c between -20 and 150")
def range_violations(spark, d):
    rules = quality.range_rules(TABLES["telemetry_events"])
    return telemetry(spark, d).where(F.size(quality.issues(rules)) > 0).select("event_id", "load_percent", "temperature_c")


@_query(
    "telemetry",
    """select 'accepted_values:state' as "check", count(*) filter (where state not in ('IDLE', 'ACTIVE', 'WARNING')) as violations from telemetry union all
 select 'not_null:event_id', count(*) filter (where event_id is null) from telemetry union all select 'not_null:load_percent', count(*) filter (where load_percent is null) from telemetry union all
 select 'unique:equipment_id', count(*) from (select equipment_id from telemetry group by 1 having count(*) > 1)""",
)
def dbt_accepted_values(spark, d):
    return quality.violations(telemetry(spark, d), ["event_id", "load_percent"], ["equipment_id"], {"state": ("IDLE", "ACTIVE", "WARNING")})


@_query("incidents alarms", "select incident_id, equipment_id from incidents i where not exists (select 1 from alarms a where a.equipment_id = i.equipment_id and a.severity = 'INFO' and a.code = 'code-0' and a.opened_at < timestamp '2024-01-04')")
def dbt_relationships_anti(spark, d):
    parents = alarms(spark, d).where("severity = 'INFO' and code = 'code-0' and opened_at < timestamp_ntz '2024-01-04 00:00:00'")
    return quality.missing_references(incidents(spark, d), parents, "equipment_id").select("incident_id", "equipment_id")


@_query("telemetry movements incidents alarms", f"select terminal_id from ({_KPI}) where available_intervals > scheduled_intervals or availability not between 0 and 1 or source_period_end < source_period_start", **_PARTS, inc=_INC, al=_ALARM)
def gold_assertions(spark, d):
    return documents.kpi_violations(kpi.overview_kpis(*_all(spark, d))).select("terminal_id")


# Extraction and import

_CURSOR = (datetime(2024, 1, 10), "evt-000000-000000")
_AFTER = f"(event_timestamp, event_id) > (timestamp '{_CURSOR[0]}', '{_CURSOR[1]}')"


@_query("telemetry", f"select event_id, {_sql_ts('event_timestamp')} as event_timestamp from telemetry where {_AFTER} order by telemetry.event_timestamp, event_id limit 1000")
def keyset_page(spark, d):
    rows = keyset.page(telemetry(spark, d), "event_id", _CURSOR, 1000, "event_timestamp")
    return rows.select("event_id", _ts("event_timestamp").alias("event_timestamp"))


@_query("telemetry", f"select event_id, cast((row_number() over (order by event_timestamp, event_id) - 1) // 37 as bigint) as batch from telemetry where {_AFTER}")
def keyset_batches(spark, d):
    return keyset.batches(telemetry(spark, d), "event_id", _CURSOR, 37, "event_timestamp").select("event_id", F.col("batch").cast("long").alias("batch"))


_NEW_ORDERS = "select o_orderkey + 200 as o_orderkey, o_orderstatus, o_totalprice * 2 as o_totalprice from orders"


@_query("", "select (select count(*) from neu where o_orderkey not in (select o_orderkey from orders)) as inserted, (select count(*) from neu where o_orderkey in (select o_orderkey from orders)) as updated", neu=_NEW_ORDERS)
def import_existing_keys(spark, d):
    held = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return upsert.counts(upsert.merge(held, _new_orders(held), "o_orderkey"))


def _new_orders(held: DataFrame) -> DataFrame:
    return held.select((F.col("o_orderkey") + 200).alias("o_orderkey"), "o_orderstatus", (F.col("o_totalprice") * 2).alias("o_totalprice"))


@_query("", "select coalesce(n.o_orderkey, o.o_orderkey) as o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) as o_orderstatus, round(coalesce(n.o_totalprice, o.o_totalprice), 4) as o_totalprice from orders o full join neu n on n.o_orderkey = o.o_orderkey", neu=_NEW_ORDERS)
def import_merged_rows(spark, d):
    held = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return upsert.merge(held, _new_orders(held), "o_orderkey").rows.withColumn("o_totalprice", F.round("o_totalprice", 4))


@_query("telemetry alarms movements", "select * from (select equipment_id, terminal_id, cast(null as varchar) as severity from telemetry union all select equipment_id, null, severity from alarms union all select equipment_id, terminal_id, null from movements) group by all")
def union_by_name(spark, d):
    from ..sources.tables import union_by_name as union

    return union(telemetry(spark, d).select("equipment_id", "terminal_id"), alarms(spark, d).select("equipment_id", "severity"), movements(spark, d).select("equipment_id", "terminal_id")).distinct()


@_query(
    "",
    """select 'evt-' || lpad(cast(i // 1000000 as varchar), 6, '0') || '-' || lpad(cast(i % 1000000 as varchar), 6, '0') as event_id, 'EQ-' || lpad(cast(i % 32 as varchar), 3, '0') as equipment_id,
 'TM-' || lpad(cast(i % 4 + 1 as varchar), 3, '0') as terminal_id, strftime(timestamp '2026-01-01' + to_minutes(cast(5 * i as integer)), '%Y-%m-%d %H:%M:%S.%f') as event_timestamp,
 (['IDLE', 'ACTIVE', 'WARNING', 'UNAVAILABLE', 'MAINTENANCE'])[(i + 42) % 5 + 1] as state, (i + 42) % 5 < 3 as available, round((i * 17 + 42) % 10001 / 100.0, 6) as load_percent,
 round(-20.0 + (i * 29 + 42) % 17001 / 100.0, 6) as temperature_c from (select o_orderkey - (select min(o_orderkey) from orders) as i from orders)""",
)
def benchmark_fixture(spark, d):
    n = read(spark, d, "orders").agg((F.max("o_orderkey") - F.min("o_orderkey") + 1).alias("n")).first()["n"]
    rows = generators.benchmark_fixture(spark, n)
    held = read(spark, d, "orders").select(S.event_key(F.col("o_orderkey") - F.lit(read(spark, d, "orders").agg(F.min("o_orderkey")).first()[0])).alias("event_id"))
    return _rounded(rows.join(held, "event_id"))


# Exploration


@_query("incidents", "select incident_id, equipment_id, root_cause from incidents where contains(lower(incident_id || ' ' || equipment_id || ' ' || root_cause), 'qc-01') and terminal_id = 'TM-002' and severity = 'CRITICAL'")
def incident_filter(spark, d):
    return explore.filter_incidents(incidents(spark, d), " QC-01 ", "TM-002", "CRITICAL").select("incident_id", "equipment_id", "root_cause")


_RANK = "case severity when 'MINOR' then 1 when 'MAJOR' then 2 else 3 end"
_MINUTES = "(epoch_us(resolved_at) - epoch_us(opened_at)) / 60000000.0"


@_query("incidents", f"select incident_id, severity, {_RANK} as severity_rank from incidents")
def incident_sort_severity(spark, d):
    return explore.sort_incidents(incidents(spark, d), "severity", True, "incident_id").select("incident_id", "severity", explore.severity_rank().alias("severity_rank"))


@_query("incidents", f"select incident_id, round({_MINUTES}, 6) as duration_minutes from incidents")
def incident_sort_duration(spark, d):
    rows = incidents(spark, d).withColumn("duration_minutes", F.round(explore.duration_minutes(), 6))
    return explore.sort_incidents(rows, "duration_minutes", tie="incident_id").select("incident_id", "duration_minutes")


@_query("incidents", f"select count(*) as total_count, count(*) filter (where status = 'OPEN') as open_count, round(avg({_MINUTES}), 6) as average_resolution_minutes from incidents")
def incident_metrics_ui(spark, d):
    return _rounded(explore.incident_summary(incidents(spark, d)))


@_query("incidents", "select cast(cast(opened_at as date) as varchar) as date, count(*) as count from incidents group by 1")
def incident_daily_trend(spark, d):
    return explore.incidents_per_day(incidents(spark, d)).withColumn("date", F.col("date").cast("string"))


@_query("incidents", "select root_cause, count(*) as count from incidents group by 1 having count(*) > 1")
def recurring_root_causes(spark, d):
    return explore.recurring_causes(incidents(spark, d))


@_query("incidents", "select severity, round(avg(date_diff('second', opened_at, resolved_at) / 60.0), 6) as mean_repair_minutes from incidents where status = 'RESOLVED' group by 1")
def mean_repair_by_severity(spark, d):
    return _rounded(explore.mean_repair(incidents(spark, d)))


@_query("incidents", f"select incident_id, severity, status from incidents order by (status = 'OPEN') desc, {_RANK} desc, opened_at desc, incident_id limit 3")
def incident_pulse_top3(spark, d):
    return explore.incident_pulse(incidents(spark, d)).select("incident_id", "severity", "status")


_LATEST = "select equipment_id, terminal_id, state as current_state, available from (select *, row_number() over (partition by equipment_id order by event_timestamp desc, event_id) as nth from telemetry) where nth = 1"
_EQUIP = """select l.*, d.downtime_minutes, d.availability, coalesce(r.alarm_count, 0) as alarm_count from latest l join (select equipment_id, 5 * count(*) filter (where state in ('UNAVAILABLE', 'MAINTENANCE')) as downtime_minutes,
 round(count(*) filter (where available) * 1.0 / count(*), 6) as availability from telemetry group by 1) d using (equipment_id) left join (select equipment_id, count(*) as alarm_count from alarms group by 1) r using (equipment_id)"""


def _equipment(spark, d) -> DataFrame:
    t = telemetry(spark, d)
    own = t.groupBy("equipment_id").agg(F.round(S.ratio(F.count_if("available"), F.count("*")), 6).alias("availability"))
    return documents.equipment(t, alarms(spark, d)).join(own, "equipment_id")


@_query("telemetry alarms", "select * from equip", latest=_LATEST, equip=_EQUIP)
def equipment_documents(spark, d):
    return _equipment(spark, d)


@_query("telemetry alarms", "select equipment_id, available, availability, downtime_minutes from equip order by available, availability nulls last, downtime_minutes desc nulls last, equipment_id limit 3", latest=_LATEST, equip=_EQUIP)
def equipment_pulse_top3(spark, d):
    return explore.equipment_pulse(_equipment(spark, d)).select("equipment_id", "available", "availability", "downtime_minutes")


@_query("telemetry alarms", "select equipment_id, terminal_id from equip where contains(lower(equipment_id), 'c-00') and terminal_id = 'TM-003'", latest=_LATEST, equip=_EQUIP)
def equipment_filter(spark, d):
    return explore.filter_equipment(_equipment(spark, d), "C-00 ", "TM-003").select("equipment_id", "terminal_id")


@_query(
    "telemetry alarms",
    "select equipment_id, a as alarm_share from (select equipment_id, case when alarm_count % 2 = 0 then round(alarm_count / 10.0, 6) end as a from equip)",
    latest=_LATEST,
    equip=_EQUIP,
)
def equipment_sort_nulls_last(spark, d):
    rows = _equipment(spark, d).withColumn("alarm_share", F.when(F.col("alarm_count") % 2 == 0, F.round(F.col("alarm_count") / F.lit(10.0), 6)))
    return explore.sorted_rows(rows, F.col("alarm_share"), True, "equipment_id").select("equipment_id", "alarm_share")


@_query(
    "telemetry",
    f"select event_id, equipment_id, state, {_sql_ts('event_timestamp')} as event_timestamp from w where s is null or s <> state or a <> available",
    w="select *, lag(state) over k as s, lag(available) over k as a from telemetry window k as (partition by equipment_id order by event_timestamp, event_id)",
)
def equipment_activity_runs(spark, d):
    return explore.activity_runs(telemetry(spark, d)).select("event_id", "equipment_id", "state", _ts("event_timestamp").alias("event_timestamp"))


@_query("telemetry alarms incidents", "select i.incident_id, i.equipment_id, e.current_state, e.alarm_count, e.downtime_minutes from incidents i left join equip e using (equipment_id)", latest=_LATEST, equip=_EQUIP)
def incident_context_join(spark, d):
    return explore.incident_context(incidents(spark, d), documents.equipment(telemetry(spark, d), alarms(spark, d))).select("incident_id", "equipment_id", "current_state", "alarm_count", "downtime_minutes")


@_query("telemetry incidents", "select i.incident_id, i.equipment_id, b.t as terminal_id from incidents i join bridge b using (equipment_id)", bridge=_BRIDGE)
def incident_terminal_join(spark, d):
    return documents.incidents_with_terminal(incidents(spark, d), telemetry(spark, d)).select("incident_id", "equipment_id", "terminal_id")


@_query("incidents", f"select incident_id, equipment_id, severity, status, {_sql_ts('opened_at')} as opened_at from incidents where equipment_id = 'QC-007'")
def incidents_of_equipment(spark, d):
    return explore.incidents_of(incidents(spark, d), "QC-007").select("incident_id", "equipment_id", "severity", "status", _ts("opened_at").alias("opened_at"))


@_query("incidents", "select incident_id, root_cause from incidents where incident_id = (select min(incident_id) from incidents)")
def incident_lookup(spark, d):
    least = incidents(spark, d).agg(F.min("incident_id")).first()[0]
    return explore.lookup(incidents(spark, d), "incident_id", least).select("incident_id", "root_cause")


# Documents, replay, health, runs


@_query(
    "telemetry alarms incidents movements",
    """select 'telemetry' as relation, count(*) as row_count from telemetry union all select 'alarms', count(*) from alarms union all select 'incidents', count(*) from incidents union all
 select 'movements', count(*) from movements union all select 'distinct_equipment_id', count(distinct equipment_id) from telemetry union all select 'distinct_terminal_id', count(distinct terminal_id) from telemetry""",
)
def quality_document_counts(spark, d):
    t, m, i, a = _all(spark, d)
    return documents.layer_counts({"telemetry": t, "alarms": a, "incidents": i, "movements": m}, t)


_RUNS = """select 'run-' || lpad(cast(user_id as varchar), 6, '0') as run_id, case user_id % 3 when 0 then 'succeeded' when 1 then 'failed' else 'running' end as status, min(ts) as started_at,
 case when user_id % 3 <> 2 then max(ts) end as finished_at, count(*) as consumed, case when user_id % 5 <> 0 then count(*) filter (where event_type <> 'error') end as bronze_rows, count(distinct event_type) as committed_batches,
 count(*) filter (where event_type = 'view') as duplicates, count(*) filter (where event_type = 'signup') as late, count(*) filter (where event_type = 'error') as dead_letters,
 case when user_id % 3 = 1 then '  lost   the broker ' || chr(10) || ' at ' || cast(user_id as varchar) end as error_message from events group by user_id"""


def _runs(spark, d) -> DataFrame:
    u = F.col("user_id")
    kind = lambda k: F.count_if(F.col("event_type") == k)
    rows = read(spark, d, "events").groupBy("user_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("_end"), F.count("*").alias("consumed"), F.count_if(F.col("event_type") != "error").alias("_rows"),
        F.count_distinct("event_type").alias("committed_batches"), kind("view").alias("duplicates"), kind("signup").alias("late"), kind("error").alias("dead_letters"),
    )
    return rows.select(
        S.padded("run-", "user_id", 6).alias("run_id"),
        F.when(u % 3 == 0, "succeeded").when(u % 3 == 1, "failed").otherwise("running").alias("status"),
        "started_at",
        F.when(u % 3 != 2, F.col("_end")).alias("finished_at"),
        "consumed",
        F.when(u % 5 != 0, F.col("_rows")).alias("bronze_rows"),
        "committed_batches",
        "duplicates",
        "late",
        "dead_letters",
        F.when(u % 3 == 1, F.concat(F.lit("  lost   the broker \n at "), u.cast("string"))).alias("error_message"),
    )


@_query("", f"select run_id, status, {_sql_ts('started_at')} as started_at, nullif(left(trim(regexp_replace(error_message, '\\s+', ' ', 'g')), 280), '') as error_message from runs order by runs.started_at desc, run_id desc limit 10", runs=_RUNS)
def run_history_top10(spark, d):
    return observe.run_history(_runs(spark, d)).select("run_id", "status", _ts("started_at").alias("started_at"), "error_message")


_SUMS = ", ".join(f"cast(coalesce(sum({c}), 0) as bigint) as {c}_total" for c in observe.COUNTERS)


@_query(
    "",
    f"""select count(*) filter (where status = 'running') as runs_running, count(*) filter (where status = 'succeeded') as runs_succeeded, count(*) filter (where status = 'failed') as runs_failed, {_SUMS},
 (select run_id from last) as last_run_id, (select status from last) as last_run_status,
 (select greatest(0.0, round((epoch_us(coalesce(finished_at, timestamp '2024-03-01')) - epoch_us(started_at)) / 1000000.0, 6)) from last) as last_run_duration_seconds from runs""",
    runs=_RUNS,
    last="select * from runs order by started_at desc, run_id desc limit 1",
)
def run_status_metrics(spark, d):
    return _rounded(observe.run_metrics(_runs(spark, d), F.lit(datetime(2024, 3, 1))))


@_query("", "select event_type, round(median(value), 6) as median, quantile_disc(value, 0.95) as p95, count(*) as samples from events group by 1")
def timing_percentiles(spark, d):
    return observe.timing(read(spark, d, "events"), "value", "event_type").withColumn("median", F.round("median", 6))


_HEALTH = """select l_returnflag as flag, count(*) as bronze_rows, count(*) filter (where l_linenumber <= 6) as silver_rows, count(*) filter (where l_linenumber > 6) as quarantine_rows,
 count(*) filter (where l_linenumber > 6 or l_returnflag = 'R' and l_linenumber = 1) as rejected, case when l_returnflag = 'A' then 'FAIL' else 'PASS' end as test_status from lineitem group by l_returnflag"""


@_query(
    "",
    """select flag, bronze_rows = silver_rows + quarantine_rows as layers_valid, rejected = quarantine_rows as reasons_valid, case when test_status <> 'PASS' or bronze_rows <> silver_rows + quarantine_rows or rejected <> quarantine_rows then 'invalid'
 else 'stale' end as health_status from h""",
    h=_HEALTH,
)
def health_status(spark, d):
    line, held = F.col("l_linenumber"), F.col("l_linenumber") > 6
    rows = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("*").alias("bronze_rows"), F.count_if(~held).alias("silver_rows"), F.count_if(held).alias("quarantine_rows"), F.count_if(held | ((F.col("l_returnflag") == "R") & (line == 1))).alias("rejected")
    )
    rows = rows.withColumn("test_status", F.when(F.col("flag") == "A", "FAIL").otherwise("PASS"))
    return documents.health(rows, age_hours=24.5).select("flag", "layers_valid", "reasons_valid", "health_status")


@_query(
    "telemetry",
    f"""select count(*) filter (where event_timestamp <= timestamp '{INSTANT}') as applied, count(*) as total, {_sql_ts(f"max(event_timestamp) filter (where event_timestamp <= timestamp '{INSTANT}')")} as last_applied,
 count(*) > 0 and count(*) = count(*) filter (where event_timestamp <= timestamp '{INSTANT}') as complete from telemetry""",
)
def replay_prefix(spark, d):
    return _rounded(replay.progress(telemetry(spark, d), INSTANT))


@_query("telemetry", f"select event_id, state from telemetry where event_timestamp <= timestamp '{INSTANT}'")
def replay_applied_events(spark, d):
    return replay.applied(telemetry(spark, d), INSTANT).select("event_id", "state")


@_query("telemetry", "select event_id, equipment_id, terminal_id, strftime(event_timestamp, '%Y-%m-%dT%H:%M:%SZ') as event_timestamp, state, available from telemetry")
def replay_event_documents(spark, d):
    return documents.replay_events(telemetry(spark, d))


@_query("telemetry incidents", "select incident_id, equipment_id, t as terminal_id, severity, status, strftime(opened_at, '%Y-%m-%dT%H:%M:%SZ') as opened_at, strftime(resolved_at, '%Y-%m-%dT%H:%M:%SZ') as resolved_at, root_cause from (select * exclude (terminal_id) from incidents) join bridge using (equipment_id)", bridge=_BRIDGE)
def incident_documents(spark, d):
    return documents.incidents(documents.incidents_with_terminal(incidents(spark, d), telemetry(spark, d)))


@_query()
def snapshot_documents(spark, d):
    kpis = kpi.overview_kpis(*_all(spark, d))
    over = documents.overview(kpis)
    return over.select("terminal_id", F.to_json(F.struct(*sorted(over.columns)), {"ignoreNullFields": "false"}).alias("document"))


# Streams, as a batch: every eighth event comes again, some changed, some late.

_STREAM = """select event_id, ingestion_timestamp, load_percent, cast(right(event_id, 6) as integer) as n from telemetry"""
_LOG = """select event_id, ingestion_timestamp, load_percent, n * 3 as pos from src union all select event_id, ingestion_timestamp, load_percent + case when n % 16 = 0 then 1 else 0 end, n * 3 + 1 from src where n % 8 = 0
 union all select event_id, ingestion_timestamp, load_percent, n * 3 + 2 from src where n % 16 = 0"""
_FIRSTS = "select *, row_number() over k as nth, first_value(load_percent) over k as held from log window k as (partition by event_id order by pos)"
_MARK = f"timestamp '{INSTANT}'"
_OUTCOME = f"case when nth > 1 then case when load_percent = held then 'duplicate' else 'conflict' end when ingestion_timestamp < {_MARK} - interval 300 second then 'late' else 'accepted' end"


def _stream_rows(spark, d) -> DataFrame:
    t = telemetry(spark, d).withColumn("n", F.substring("event_id", -6, 6).cast("int"))
    again = t.where("n % 8 = 0").withColumn("load_percent", F.col("load_percent") + F.when(F.col("n") % 16 == 0, 1).otherwise(0))
    log = t.withColumn("offset", F.col("n") * 3).unionByName(again.withColumn("offset", F.col("n") * 3 + 1)).unionByName(t.where("n % 16 = 0").withColumn("offset", F.col("n") * 3 + 2))
    event = F.struct("event_id", *[F.col(c).cast("timestamp").alias(c) for c in ("event_timestamp", "ingestion_timestamp")], "load_percent")
    return log.select(event.alias("event"), F.sha2(F.to_json(event), 256).alias("digest"), F.lit("telemetry").alias("topic"), F.lit(0).alias("partition"), F.col("offset").cast("long").alias("offset"))


def _classified(spark, d) -> DataFrame:
    empty = spark.createDataFrame([], "event_id string, digest string")
    return streams.classify(_stream_rows(spark, d), empty, F.lit(INSTANT).cast("timestamp"), 300)


@_query("telemetry", f"select event_id, cast(pos as bigint) as \"offset\", {_OUTCOME} as outcome from firsts", src=_STREAM, log=_LOG, firsts=_FIRSTS)
def stream_classification_replay(spark, d):
    return _classified(spark, d).select("event_id", "offset", "outcome")


@_query("telemetry", f"select outcome, count(*) as count from (select {_OUTCOME} as outcome from firsts) group by 1", src=_STREAM, log=_LOG, firsts=_FIRSTS)
def stream_outcome_counts(spark, d):
    return _classified(spark, d).groupBy("outcome").count()


@_query("telemetry", f"select event_id, cast(pos as bigint) as \"offset\" from firsts where {_OUTCOME} = 'late'", src=_STREAM, log=_LOG, firsts=_FIRSTS)
def late_events(spark, d):
    return _classified(spark, d).where("reason_code = 'late_event'").select("event_id", "offset")


@_query("telemetry", f"select max({_sql_ts('ingestion_timestamp')}) as watermark from firsts where {_OUTCOME} = 'accepted'", src=_STREAM, log=_LOG, firsts=_FIRSTS)
def stream_watermark(spark, d):
    return streams.watermark_of(_classified(spark, d)).select(_ts("watermark").alias("watermark"))


@_query()
def dead_letter_envelopes(spark, d):
    from ..streaming.decode import dead_letter, decode, encode

    t = telemetry(spark, d).withColumns({c: F.col(c).cast("timestamp") for c in ("event_timestamp", "ingestion_timestamp")})
    sent = encode(t, "telemetry").withColumn("partition", F.lit(0)).withColumn("offset", F.xxhash64("key"))
    empty = spark.createDataFrame([], "event_id string, digest string")
    rejected = streams.classify(decode(sent), empty, None).where("reason_code is not null")
    return dead_letter(rejected, "run-1")


# Fingerprints and the window surface


@_query("telemetry", "select terminal_id, sha256(string_agg(event_id, ',' order by event_id)) as digest from telemetry group by 1")
def result_hash(spark, d):
    return telemetry(spark, d).groupBy("terminal_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("event_id")), ","), 256).alias("digest"))


@_query()
def relation_fingerprint(spark, d):
    return verify.fingerprint(movements(spark, d))


@_query(
    "telemetry",
    """select event_id, lag(event_id) over k as before, lead(load_percent) over k as next_load, row_number() over k as n, rank() over r as rnk, dense_rank() over r as drnk, round(sum(load_percent) over (k rows between 2 preceding and current row), 6) as rolling,
 count(*) over (partition by equipment_id order by temperature_c range between 1 preceding and 1 following) as near from telemetry
 window k as (partition by equipment_id order by event_timestamp, event_id), r as (partition by equipment_id order by state)""",
)
def window_surface(spark, d):
    k, r = W.partitionBy("equipment_id").orderBy("event_timestamp", "event_id"), W.partitionBy("equipment_id").orderBy("state")
    near = W.partitionBy("equipment_id").orderBy("temperature_c").rangeBetween(-1, 1)
    return telemetry(spark, d).select(
        "event_id", F.lag("event_id").over(k).alias("before"), F.lead("load_percent").over(k).alias("next_load"), F.row_number().over(k).cast("long").alias("n"), F.rank().over(r).cast("long").alias("rnk"),
        F.dense_rank().over(r).cast("long").alias("drnk"), F.round(F.sum("load_percent").over(k.rowsBetween(-2, 0)), 6).alias("rolling"), F.count("*").over(near).alias("near"),
    )


@_query(
    "",
    """select o_orderkey, upper(o_orderstatus) as u, lower(o_orderpriority) as l, substring(o_orderpriority, 3, 4) as sub, greatest(o_totalprice, 1000.0) as g, least(o_totalprice, 1000.0) as le, round_even(o_totalprice, 1) as br,
 year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as dd, cast(cast(date_trunc('month', o_orderdate) as date) as varchar) as mon, date_diff('day', o_orderdate, timestamp '2000-01-01') as days,
 coalesce(nullif(o_orderstatus, 'O'), '-') as st, o_orderpriority like '1%' as starts, regexp_replace(o_orderpriority, '[0-9]-', '', 'g') as rr, concat_ws('/', o_orderstatus, o_orderpriority) as cw from orders""",
)
def function_surface(spark, d):
    o = read(spark, d, "orders")
    return o.select(
        "o_orderkey", F.upper("o_orderstatus").alias("u"), F.lower("o_orderpriority").alias("l"), F.substring("o_orderpriority", 3, 4).alias("sub"), F.greatest("o_totalprice", F.lit(1000.0)).alias("g"),
        F.least("o_totalprice", F.lit(1000.0)).alias("le"), F.bround("o_totalprice", 1).alias("br"), F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"),
        F.dayofmonth("o_orderdate").cast("long").alias("dd"), F.date_trunc("month", "o_orderdate").cast("date").cast("string").alias("mon"), F.datediff(F.lit("2000-01-01"), "o_orderdate").cast("long").alias("days"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("-")).alias("st"), F.col("o_orderpriority").startswith("1").alias("starts"), F.regexp_replace("o_orderpriority", "[0-9]-", "").alias("rr"),
        F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("cw"),
    )


@_query("incidents", "select incident_id, case when resolved_at is null then 'Unavailable' else printf('%.1f min', date_diff('second', opened_at, resolved_at) / 60.0) end as repair_label from incidents")
def label_surface(spark, d):
    return incidents(spark, d).select("incident_id", S.minutes_label(S.minutes_between("opened_at", "resolved_at")).alias("repair_label"))


assert set(ENUMS) and set(ORACLES) <= set(QUERIES)
