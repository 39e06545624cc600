"""Bounded consumption of a record stream with explicit state.

``withWatermark`` can't express the contract (equality with the bound is on
time, late events are kept as dead letters and remembered, only accepted events
move the watermark, one watermark per topic), so each micro-batch is classified
against state tables in ``foreachBatch``, or, with ``keyed``, against the state store, a
row per event.  Paths are keyed by batch, so a batch that runs again overwrites what it
wrote before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.bronze import bronze_rows
from ..sources import log
from . import keyed as by_key
from .classify import STATE, classify, counters, source_of_rejects, state_rows
from .decode import EVENT, FIELDS, RECORD, dead_letter, decode


class DeadLettersNotConfigured(RuntimeError):
    """A batch has rejects and no place for them; nothing of it was written."""


class FewerMessages(RuntimeError):
    """A log held fewer messages than a run was asked for."""


#: The writes of a batch, in order; ``after`` hooks are called with their names.
WRITES = ("bronze", "state", "dead_letters")


@dataclass
class Report:
    run_id: str
    consumed: int = 0
    bronze_rows: int = 0
    committed_batches: int = 0
    duplicates: int = 0
    late: int = 0
    conflicts: int = 0
    invalid: int = 0
    dead_letters: int = 0


@dataclass
class StreamState:
    """State of a topic under one folder: events by batch, watermarks by batch, runs."""

    spark: SparkSession
    root: str
    topic: str
    run: dict = field(default_factory=dict)

    def _read(self, kind: str, schema: str) -> DataFrame:
        path = f"{self.root}/{kind}/{self.topic}"
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as error:  # nothing stored yet
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], schema)
            raise

    def events(self, before: str | None = None) -> DataFrame:
        """Stored events, those of the batch ``before`` left out (it may be a rerun)."""
        rows = self._read("events", STATE + ", batch string")
        return rows if before is None else rows.where(F.col("batch") != before)

    def watermark(self, before: str | None = None) -> datetime | None:
        rows = self._read("watermarks", "watermark timestamp, batch string")
        rows = rows if before is None else rows.where(F.col("batch") != before)
        return rows.agg(F.max("watermark")).first()[0]

    def add(self, batch: str, events: DataFrame, watermark: DataFrame | None) -> None:
        events.write.mode("overwrite").parquet(f"{self.root}/events/{self.topic}/batch={batch}")
        if watermark is not None:
            watermark.write.mode("overwrite").parquet(f"{self.root}/watermarks/{self.topic}/batch={batch}")

    # the run table: a row per state of a run; a run's last row counts
    RUN = "run_id string, topic string, status string, started_at timestamp, finished_at timestamp, consumed long, bronze_rows long, committed_batches long, duplicates long, late long, dead_letters long, error_type string, error_message string"

    def runs(self) -> DataFrame:
        rows = self._read("runs", self.RUN)
        ended = rows.where("status != 'running'").select("run_id").distinct()
        return rows.where("status != 'running'").unionByName(rows.where("status = 'running'").join(ended, "run_id", "left_anti"))

    def begin(self, run_id: str) -> None:
        if not self._read("runs", self.RUN).where(F.col("run_id") == run_id).isEmpty():
            raise ValueError(f"run {run_id!r} exists")
        self.run = {"run_id": run_id, "topic": self.topic, "status": "running", "started_at": datetime.now(UTC)}
        self._put("running")

    def finish(self, report: Report, error: BaseException | None = None) -> None:
        if self.run.get("status") != "running":
            raise ValueError("only a running run can end")
        self.run |= {"status": "failed" if error else "succeeded", "finished_at": datetime.now(UTC), "error_type": type(error).__name__ if error else None, "error_message": str(error)[:2000] if error else None}
        self.run |= {k: v for k, v in asdict(report).items() if k in ("consumed", "bronze_rows", "committed_batches", "duplicates", "late", "dead_letters")}
        self._put("ended")

    def _put(self, part: str) -> None:
        row = self.spark.createDataFrame([{k: self.run.get(k) for k in (f.name for f in self._schema())}], self._schema())
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/runs/{self.topic}/part={self.run['run_id']}-{part}")

    def _schema(self):
        from pyspark.sql.types import StructType

        return StructType.fromDDL(self.RUN)


def process_batch(
    records: DataFrame,
    batch: str,
    state: StreamState,
    bronze_dir: str,
    run_id: str,
    dead_letter_dir: str | None,
    allowed_lateness_seconds: int = 300,
    writer: Callable[[DataFrame, str], None] | None = None,
    after: Callable[[str, str], None] | None = None,
    keyed: bool = False,
) -> dict[str, int]:
    """Classifies and writes one batch: Bronze, then state, then dead letters; returns its counts.

    ``after`` is called with each write's name and the batch when it is done.  ``keyed``
    records come from ``keyed.remember``; the table of events is then written, never read.
    """
    done = after or (lambda write, batch: None)
    mark = state.watermark(before=batch)
    decoded, held = (by_key.told(records), None) if keyed else (decode(records), state.events(before=batch).select("event_id", "digest"))
    classified = source_of_rejects(classify(decoded, held, None if mark is None else F.lit(mark), allowed_lateness_seconds)).persist()
    try:
        n = counters(classified).first().asDict()
        rejects = n["invalid"] + n["conflict"] + n["late"]
        if rejects and dead_letter_dir is None:
            raise DeadLettersNotConfigured(f"batch {batch} has {rejects} rejects")
        accepted = classified.where("outcome = 'accepted'").select("event.*")
        if n["accepted"]:
            (writer or _write_bronze(bronze_dir, run_id))(accepted, batch)
        done("bronze", batch)
        fresh = state_rows(classified)
        state.add(batch, fresh, accepted.agg(F.max("ingestion_timestamp").alias("watermark")) if n["accepted"] else None)
        done("state", batch)
        if rejects:
            letters = dead_letter(classified.where("reason_code is not null"), run_id)
            letters.write.mode("overwrite").parquet(f"{dead_letter_dir}/batch={batch}")
        done("dead_letters", batch)
        return n
    finally:
        classified.unpersist()


def _write_bronze(bronze_dir: str, run_id: str) -> Callable[[DataFrame, str], None]:
    def write(events: DataFrame, batch: str) -> None:
        rows = events.select(*FIELDS).withColumn("created_at", F.col("ingestion_timestamp")).withColumn("updated_at", F.col("ingestion_timestamp"))
        rows = bronze_rows(rows, "telemetry_events", run_id, F.col("ingestion_timestamp"), decimals=False)
        rows.write.mode("overwrite").parquet(f"{bronze_dir}/telemetry_events/batch-{batch}")

    return write


def consume(
    spark: SparkSession,
    source: DataFrame | str,
    *,
    topic: str,
    bronze_dir: str,
    state_dir: str,
    checkpoint_dir: str,
    run_id: str | None = None,
    dead_letter_dir: str | None = None,
    allowed_lateness_seconds: int = 300,
    files_per_batch: int = 1,
    writer: Callable[[DataFrame, str], None] | None = None,
    after: Callable[[str, str], None] | None = None,
    bounded: bool = False,
    max_messages: int | None = None,
    keyed: bool = False,
) -> Report:
    """Consumes what a stream holds now and ends.

    ``source`` is a streaming DataFrame of records, or a folder of JSON record
    files in the shape of a message log.  Offsets are committed when a batch is
    done; a failed run leaves its batch to be read again.  ``bounded`` says that the
    source bounds its batches itself, which a run of all that is available would not ask.
    With ``max_messages`` a run that found fewer fails, its batches kept.  ``keyed`` keeps
    the state by event in the checkpoint's state store; a topic is run either way, not both.
    """
    report = Report(run_id or f"run-{uuid.uuid4().hex[:12]}")
    state = StreamState(spark, state_dir, topic)
    state.begin(report.run_id)
    stream = source if isinstance(source, DataFrame) else record_stream(spark, source, files_per_batch)
    stream = stream.where(F.col("topic") == topic)
    stream = by_key.remember(stream) if keyed else stream

    def each(batch_df: DataFrame, batch_id: int) -> None:
        n = process_batch(batch_df, f"{batch_id:012d}", state, bronze_dir, report.run_id, dead_letter_dir, allowed_lateness_seconds, writer, after, keyed)
        report.consumed += n["consumed"]
        report.bronze_rows += n["accepted"]
        report.duplicates += n["duplicate"]
        report.late += n["late"]
        report.conflicts += n["conflict"]
        report.invalid += n["invalid"]
        report.dead_letters += n["invalid"] + n["conflict"] + n["late"]
        report.committed_batches += 1

    try:
        started = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir)
        with by_key.rocksdb(spark) if keyed else nullcontext():
            query = (started if bounded else started.trigger(availableNow=True)).start()
        if bounded:
            try:
                query.processAllAvailable()
            finally:
                query.stop()
        else:
            query.awaitTermination()
        if max_messages is not None and report.consumed < max_messages:
            raise FewerMessages(f"{report.consumed} of {max_messages} messages were there")
    except BaseException as error:
        state.finish(report, error)
        raise
    state.finish(report)
    return report


def consume_log(spark: SparkSession, folder: str, *, checkpoint_dir: str, messages: int | None = None, commits: int | None = None, max_messages: int | None = None, **how) -> Report:
    """Consumes a partitioned log in batches bounded by messages or by commit records; the rest as ``consume``."""
    rows = log.stream(spark, folder, f"{checkpoint_dir}/planned", messages, commits, max_messages)
    return consume(spark, rows, checkpoint_dir=f"{checkpoint_dir}/offsets", bounded=True, max_messages=max_messages, **how)


def record_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Record files (JSON lines; key, value and header values in base64) as a stream."""
    raw = "key string, value string, headers array<struct<name: string, value: string>>, topic string, partition int, offset long"
    rows = spark.readStream.schema(raw).option("maxFilesPerTrigger", files_per_batch).json(folder)
    headers = F.transform("headers", lambda h: F.struct(h["name"].alias("name"), F.unbase64(h["value"]).alias("value")))
    return rows.select(F.unbase64("key").alias("key"), F.unbase64("value").alias("value"), headers.alias("headers"), "topic", "partition", "offset")


def kafka_stream(spark: SparkSession, servers: str, topic: str, batch_size: int = 50, **options: str) -> DataFrame:
    """The same records from Kafka, where its connector is on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true").option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", batch_size)
    for k, v in options.items():
        reader = reader.option(k, v)
    headers = F.transform("headers", lambda h: F.struct(h["key"].alias("name"), h["value"].alias("value")))
    return reader.load().select("key", "value", headers.alias("headers"), "topic", "partition", "offset")


def write_records(records: DataFrame, folder: str) -> None:
    """Records (with topic, partition and offset) as a file that ``record_stream`` reads."""
    headers = F.transform("headers", lambda h: F.struct(h["name"].alias("name"), F.base64(h["value"]).alias("value")))
    out = records.select(F.base64("key").alias("key"), F.base64("value").alias("value"), headers.alias("headers"), "topic", "partition", "offset")
    out.coalesce(1).write.mode("append").json(folder)


__all__ = ["EVENT", "RECORD", "WRITES", "FewerMessages", "Report", "StreamState", "consume", "consume_log", "kafka_stream", "process_batch", "record_stream", "write_records"]
