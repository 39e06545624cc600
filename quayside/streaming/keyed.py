"""State by event: each event's first digest lives in the state store, with those of its neighbours.

``classify`` asks of the state only what was stored for an event before the batch; whether
an event is late depends on its own time and the topic's watermark, which is one value a
batch.  So ``remember`` keeps the digests by event id, tells each record what was stored,
and the batch decides the outcome with the watermark frozen before it.

Ids that differ in their last two digits only share a state row, which holds a hundred events at
most, as a valid id ends in digits: a call to the store from Python is made for each such
group and not for each event.  A batch touches the groups of its own events alone, however
many are stored; ids that run on, as those of a telemetry source do, fill their groups.

A record whose event is stored is no candidate for the state; of the others the first by
partition and offset is kept, accepted or late.  Records that break the contract pass
through without state.  A batch that runs again starts from the state before it.  The rows
of a group in a batch are taken a chunk at a time; nothing of them is held but
its events' first digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .decode import decode

#: Digits at the end of an id that the events of one state row differ in.
SHARED_DIGITS = 2
#: Groups of a log partition over which records without an event are dealt; their names begin with this.
INVALID = "invalid"
INVALID_GROUPS = 256
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_HEADERS = "array<struct<name: string, value: string>>"
_TOLD = "event_key string, event_id string, key binary, value binary, headers string, topic string, partition int, offset long, digest string, stored string"


class _Remember(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "digests map<string, string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = None if key[0].startswith(INVALID) else self.held.get()
        known = dict(held[0]) if held else {}
        first: dict[str, tuple] = {}
        for part in rows:
            for event, *place in zip(part["event_id"], part["partition"], part["offset"], part["digest"]):
                if event is not None and event not in known:
                    first[event] = min(first.get(event, place), place)
            yield part.assign(stored=[known.get(event) for event in part["event_id"]])
        if first:
            self.held.update((known | {event: digest for event, (_, _, digest) in first.items()},))

    def close(self) -> None:
        pass


def remember(records: DataFrame) -> DataFrame:
    """A stream of records with ``digest`` and ``stored``, the digest kept for the event before the batch."""
    place = F.concat_ws(":", F.lit(INVALID), F.col("partition").cast("string"), F.pmod("offset", F.lit(INVALID_GROUPS)).cast("string"))
    headers = F.to_json(F.transform("headers", lambda h: F.struct(h["name"].alias("name"), F.base64(h["value"]).alias("value"))))
    group = F.expr(f"substring(event.event_id, 1, length(event.event_id) - {SHARED_DIGITS})")
    rows = decode(records).select(F.coalesce(group, place).alias("event_key"), F.col("event.event_id").alias("event_id"), "key", "value", headers.alias("headers"), "topic", "partition", "offset", "digest")
    return rows.groupBy("event_key").transformWithStateInPandas(_Remember(), _TOLD, "Append", "None")


def told(batch: DataFrame) -> DataFrame:
    """A batch of ``remember`` decoded again, with ``stored``."""
    headers = F.transform(F.from_json("headers", _HEADERS), lambda h: F.struct(h["name"].alias("name"), F.unbase64(h["value"]).alias("value")))
    return decode(batch.select("key", "value", headers.alias("headers"), "topic", "partition", "offset", "stored"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which state by key asks for."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def stored(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """(event_id, digest) as the state store of a stopped run holds them."""
    with rocksdb(spark):
        rows = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint_dir)
    return rows.select(F.explode("value.digests").alias("event_id", "digest"))
