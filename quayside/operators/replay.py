"""Replay of ordered events: a plan for a prefix, and a reducer for the clock."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import ranked

SPEEDS = (0.5, 1.0, 2.0, 4.0)


def ordered(events: DataFrame, tie: str = "event_id") -> DataFrame:
    return events.orderBy("event_timestamp", tie)


def applied(events: DataFrame, until) -> DataFrame:
    """Events at or before a virtual time."""
    return events.where(F.col("event_timestamp") <= F.lit(until))


def progress(events: DataFrame, until) -> DataFrame:
    """One row: events applied, all events, the last applied time, and whether the replay is complete."""
    done = F.col("event_timestamp") <= F.lit(until)
    row = events.agg(F.count_if(done).alias("applied"), F.count("*").alias("total"), F.max(F.when(done, F.col("event_timestamp"))).alias("last_applied"))
    return row.withColumn("complete", (F.col("total") > 0) & (F.col("applied") == F.col("total")))


def ticks(events: DataFrame, milliseconds: int, speeds: tuple[float, ...] = SPEEDS) -> DataFrame:
    """(speed, tick, now) of a replay from the first event until the first tick at which all events are applied."""
    at = F.col("event_timestamp").cast("timestamp")
    whole = events.agg(F.min(at).alias("start"), F.max(at).alias("end")).where("start is not null")
    rows = whole.select("start", "end", F.explode(F.array(*[F.lit(float(s)) for s in speeds])).alias("speed"))
    step = (F.col("speed") * milliseconds * 1000).cast("long")
    last = F.ceil((F.unix_micros("end") - F.unix_micros("start")) / step)
    rows = rows.select("start", "speed", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("tick"))
    return rows.select("speed", "tick", F.timestamp_micros(F.unix_micros("start") + F.col("tick") * F.col("step")).alias("now"))


def as_of(times: DataFrame, events: DataFrame, *names: str) -> DataFrame:
    """``names`` and ``now`` of ``times`` with what a replay shows then: ``applied``, ``last_applied``, ``complete``.

    Both sides are ranked in one order, an event before a tick of the same time; a tick's
    place less the ticks before it is its count of events, and the event of that place is
    the last one applied.  No tick meets an event but in joins on places.
    """
    t = events.select(F.col("event_timestamp").cast("timestamp").alias("now"))
    ours = ranked(times.select(*names, "now"), "now", *names, at="_tick")
    both = ranked(t.select("now", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_tick")).unionByName(ours.select("now", F.lit(1).alias("_kind"), "_tick")), "now", "_kind", "_tick", at="_place")
    counts = both.where("_kind = 1").select("_tick", (F.col("_place") - F.col("_tick")).alias("applied"))
    placed = ranked(t, "now", at="_at").select((F.col("_at") + 1).alias("applied"), F.col("now").alias("last_applied"))
    total = t.agg(F.count("*").alias("_total"))  # one row
    found = ours.join(counts, "_tick").join(placed, "applied", "left").join(F.broadcast(total))
    return found.select(*names, "now", "applied", "last_applied", ((F.col("_total") > 0) & (F.col("applied") == F.col("_total"))).alias("complete"))


@dataclass(frozen=True)
class Clock:
    """State of a replay over sorted times."""

    times: tuple[datetime, ...]
    now: datetime | None = None
    applied: int = 0
    speed: float = 1.0
    status: str = "idle"  # idle, running, paused, complete

    def _upto(self, now: datetime) -> Clock:
        n = sum(t <= now for t in self.times)
        if n == len(self.times):
            return replace(self, now=self.times[-1], applied=n, status="complete")
        return replace(self, now=now, applied=n)

    def start(self) -> Clock:
        """Applies all events of the first time."""
        if not self.times or self.status == "running":
            return self
        if self.status == "paused":
            return replace(self, status="running")
        return replace(self, status="running", applied=0)._upto(self.times[0])

    def tick(self, milliseconds: float) -> Clock:
        """Moves the virtual time on by the speed; a complete replay stays at its last event."""
        if self.status != "running" or milliseconds <= 0 or self.now is None:
            return self
        return self._upto(self.now + timedelta(milliseconds=milliseconds * self.speed))

    def pause(self) -> Clock:
        return replace(self, status="paused") if self.status == "running" else self

    def at_speed(self, speed: float) -> Clock:
        return replace(self, speed=speed) if speed in SPEEDS else self

    def reset(self) -> Clock:
        return Clock(self.times, speed=self.speed)
