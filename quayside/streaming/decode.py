"""Records of a message log to telemetry events, and back."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import base64_line, parse_utc
from ..schemas import ENUMS, ID_PATTERNS, UP_STATES

#: Header names and values that a telemetry record must carry, no more and no less.
HEADERS = {"quayside-event-type": "telemetry", "quayside-schema-version": "1"}

RECORD = "key binary, value binary, headers array<struct<name: string, value: binary>>, topic string, partition int, offset long"
FIELDS = ("event_id", "schema_version", "equipment_id", "terminal_id", "event_timestamp", "ingestion_timestamp", "state", "available", "load_percent", "temperature_c")
_JSON = "event_id string, schema_version int, equipment_id string, terminal_id string, event_timestamp string, ingestion_timestamp string, state string, available boolean, load_percent double, temperature_c double"
EVENT = "event_id string, schema_version int, equipment_id string, terminal_id string, event_timestamp timestamp, ingestion_timestamp timestamp, state string, available boolean, load_percent double, temperature_c double"


def headers_valid() -> Column:
    # as many as are wanted and each of them there, in any order; no lambda, which would not be compiled
    held = [F.get("headers", F.lit(i)) for i in range(len(HEADERS))]
    whole = F.size("headers") == len(HEADERS)
    for k, v in HEADERS.items():
        whole &= reduce(or_, [(h["name"] == k) & (h["value"] == F.lit(v.encode("utf-8"))) for h in held])
    return F.coalesce(whole, F.lit(False))


def payload_digest(event: str = "event") -> Column:
    """SHA-256 of an event's canonical JSON: keys sorted, times in UTC to the microsecond."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"{event}.{c}").alias(c) for c in sorted(FIELDS)]), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}), 256)


def event_valid(e: str = "event") -> Column:
    """The event contract: all fields, identifiers, enumerations, ranges, times in order, state and availability in step."""
    c = {f: F.col(f"{e}.{f}") for f in FIELDS}
    whole = F.lit(True)
    for x in c.values():
        whole &= x.isNotNull()
    ids = c["event_id"].rlike(ID_PATTERNS["event_id"]) & c["equipment_id"].rlike(ID_PATTERNS["equipment_id"]) & c["terminal_id"].rlike(ID_PATTERNS["terminal_id"])
    values = (c["schema_version"] == 1) & c["state"].isin(*ENUMS["state"]) & c["load_percent"].between(0, 100) & c["temperature_c"].between(-20, 150)
    step = (c["ingestion_timestamp"] >= c["event_timestamp"]) & (c["available"] == c["state"].isin(*UP_STATES))
    return F.coalesce(whole & ids & values & step, F.lit(False))


def decode(records: DataFrame) -> DataFrame:
    """Records with ``event`` (null if the record breaks the contract) and ``digest``."""
    text = F.decode("value", "utf-8")
    rows = records.withColumn("_p", F.from_json(text, _JSON))
    fields = [parse_utc(F.col(f"_p.{f}")).alias(f) if f.endswith("_timestamp") else F.col(f"_p.{f}").alias(f) for f in FIELDS]
    rows = rows.withColumn("_e", F.struct(*fields)).drop("_p")
    # a JSON object of other fields is no telemetry event; one that has all fields and no more names has no other
    names = F.json_object_keys(text)
    known = F.coalesce((F.size(names) == len(FIELDS)) | (F.size(F.array_except(names, F.array(*[F.lit(f) for f in FIELDS]))) == 0), F.lit(False))
    # judged once, and the digest made from the fields, not from what the judgement gives
    rows = rows.withColumn("_valid", headers_valid() & event_valid("_e") & known)
    rows = rows.withColumns({"event": F.when(F.col("_valid"), F.col("_e")), "digest": F.when(F.col("_valid"), payload_digest("_e"))})
    return rows.drop("_e", "_valid")


def encode(events: DataFrame, topic: str, *kept: str) -> DataFrame:
    """Events as records (key, value, headers, topic, and columns that are kept), the producer's side."""
    fields = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c) if c.endswith("_timestamp") else F.col(c) for c in sorted(FIELDS)]
    headers = F.array(*[F.struct(F.lit(k).alias("name"), F.encode(F.lit(v), "utf-8").alias("value")) for k, v in HEADERS.items()])
    return events.select(F.encode("event_id", "utf-8").alias("key"), F.encode(F.to_json(F.struct(*fields)), "utf-8").alias("value"), headers.alias("headers"), F.lit(topic).alias("topic"), *kept)


def dead_letter(rejected: DataFrame, run_id: str) -> DataFrame:
    """Envelopes of rejected records: source bytes in base64, a fallback key where there is none."""
    header = F.transform("headers", lambda h: F.struct(h["name"].alias("name"), base64_line(h["value"]).alias("value_base64")))
    body = F.struct(
        F.col("reason"),
        F.col("reason_code"),
        F.lit(run_id).alias("run_id"),
        F.lit(1).alias("schema_version"),
        header.alias("source_headers"),
        base64_line("key").alias("source_key_base64"),
        F.col("offset").alias("source_offset"),
        F.col("partition").alias("source_partition"),
        F.col("topic").alias("source_topic"),
        base64_line("value").alias("source_value_base64"),
    )
    fallback = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return rejected.select(F.coalesce("key", F.encode(fallback, "utf-8")).alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"), "reason_code")
