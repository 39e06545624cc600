"""Classification of a batch of decoded records.

Order of outcomes: invalid, repeat or conflict inside the batch, repeat or
conflict with what is stored, late, accepted.  Later rows of a batch are
compared with the first valid row of the same event in that batch; the
watermark is that from before the batch, and equality with its bound is not late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATE = "event_id string, digest string, ingestion_timestamp timestamp, outcome string, reason_code string"
OUTCOMES = ("accepted", "duplicate", "conflict", "late", "invalid")
REASON = {"invalid": "invalid_telemetry", "late": "late_event", "conflict": "duplicate_conflict"}


def classify(decoded: DataFrame, stored: DataFrame | None, watermark: Column | None, allowed_lateness_seconds: int = 300) -> DataFrame:
    """Decoded records with ``outcome`` and, where rejected, ``reason_code`` and ``reason``.

    ``stored`` has (event_id, digest).  One shuffle by event serves the window
    and the join.  Without it the records tell in ``stored`` what is kept for their event.
    """
    rows = decoded.withColumn("event_id", F.col("event.event_id"))
    valid = F.col("event").isNotNull()
    # invalid rows have no event: dealt apart so that they don't meet in one task
    spread = F.when(valid, F.col("event_id")).otherwise(F.concat_ws(":", F.lit("invalid"), "topic", F.col("partition").cast("string"), F.col("offset").cast("string")))
    w = W.partitionBy("_key").orderBy("partition", "offset")
    rows = rows.withColumn("_key", spread).withColumn("_nth", F.row_number().over(w)).withColumn("_first", F.first("digest").over(w))
    if stored is None:
        rows = rows.withColumnRenamed("stored", "_stored")
    else:
        rows = rows.join(stored.select(F.col("event_id").alias("_key"), F.col("digest").alias("_stored")), "_key", "left")
    bound = None if watermark is None else watermark - F.make_dt_interval(secs=F.lit(float(allowed_lateness_seconds)))
    late = F.lit(False) if bound is None else F.coalesce(F.col("event.ingestion_timestamp") < bound, F.lit(False))
    outcome = (
        F.when(~valid, "invalid")
        .when((F.col("_nth") > 1) & (F.col("digest") == F.col("_first")), "duplicate")
        .when(F.col("_nth") > 1, "conflict")
        .when(F.col("_stored") == F.col("digest"), "duplicate")
        .when(F.col("_stored").isNotNull(), "conflict")
        .when(late, "late")
        .otherwise("accepted")
    )
    rows = rows.withColumn("outcome", outcome).drop("_key", "_nth", "_first", "_stored")
    code, told = F.lit(None).cast("string"), F.lit(None).cast("string")
    says = {"invalid": "the record breaks the telemetry contract", "late": "the event came later than allowed", "conflict": "another payload has this event id"}
    for name, c in REASON.items():
        code = F.when(F.col("outcome") == name, c).otherwise(code)
        told = F.when(F.col("outcome") == name, says[name]).otherwise(told)
    return rows.withColumn("reason_code", code).withColumn("reason", told)


def source_of_rejects(classified: DataFrame) -> DataFrame:
    """The same rows without the source bytes of those that are no rejects, which nobody asks for again."""
    rejected = F.col("reason_code").isNotNull()
    return classified.withColumns({c: F.when(rejected, F.col(c)) for c in ("key", "value", "headers")})


def state_rows(classified: DataFrame) -> DataFrame:
    """What a batch adds to the state: accepted and late events; invalid ones and conflicts are not kept."""
    kept = classified.where(F.col("outcome").isin("accepted", "late"))
    accepted = F.col("outcome") == "accepted"
    return kept.select(
        "event_id", "digest", F.col("event.ingestion_timestamp").alias("ingestion_timestamp"), F.when(accepted, "bronze").otherwise("dead_letter").alias("outcome"), F.when(~accepted, F.col("reason_code")).alias("reason_code")
    )


def counters(classified: DataFrame) -> DataFrame:
    """One row of counts by outcome."""
    return classified.agg(F.count("*").alias("consumed"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def watermark_of(classified: DataFrame) -> DataFrame:
    """The newest ingestion time of accepted events, one row."""
    return classified.where(F.col("outcome") == "accepted").agg(F.max("event.ingestion_timestamp").alias("watermark"))
