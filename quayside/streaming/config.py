"""Stream settings from the environment, checked once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class StreamConfig:
    """Where records come from and how a run takes them."""

    servers: str
    topic: str
    group: str = "quayside"
    batch_size: int = 50
    allowed_lateness_seconds: int = 300
    dead_letter_topic: str | None = None

    def __post_init__(self) -> None:
        if not self.servers.strip() or not self.topic.strip() or not self.group.strip():
            raise ValueError("servers, topic and group must not be blank")
        if self.batch_size < 1 or self.allowed_lateness_seconds < 0:
            raise ValueError("batch size must be positive and lateness not negative")
        if self.dead_letter_topic is not None and self.dead_letter_topic == self.topic:
            raise ValueError("dead letters need a topic of their own")

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "QUAYSIDE_") -> StreamConfig:
        get = lambda k, d=None: env.get(prefix + k, d)
        return cls(get("SERVERS", "localhost:9092"), get("TOPIC", "telemetry"), get("GROUP", "quayside"), int(get("BATCH_SIZE", "50")), int(get("LATENESS_SECONDS", "300")), get("DEAD_LETTER_TOPIC"))

    def reader_options(self) -> dict[str, str]:
        """Options of Spark's Kafka source; offsets live in the checkpoint."""
        return {"kafka.bootstrap.servers": self.servers, "subscribe": self.topic, "includeHeaders": "true", "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(self.batch_size)}

    def writer_options(self, topic: str | None = None) -> dict[str, str]:
        """Options of Spark's Kafka sink: all replicas acknowledge."""
        return {"kafka.bootstrap.servers": self.servers, "topic": topic or self.topic, "kafka.acks": "all", "kafka.enable.idempotence": "true"}
