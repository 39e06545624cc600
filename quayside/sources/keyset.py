"""Incremental extraction by keyset (updated_at, key)."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import ranked

FIRST = (datetime(1970, 1, 1, tzinfo=UTC), "")


def after(time: str, key: str, cursor: tuple) -> Column:
    """Rows beyond a cursor; written so that the time bound alone can reach the scan."""
    t = F.lit(cursor[0])
    return (F.col(time) >= t) & ((F.col(time) > t) | (F.col(key) > F.lit(cursor[1])))


def page(rows: DataFrame, key: str, cursor: tuple = FIRST, size: int = 1000, time: str = "updated_at") -> DataFrame:
    """The next ``size`` rows after a cursor, in order."""
    return rows.where(after(time, key, cursor)).orderBy(time, key).limit(size)


def batches(rows: DataFrame, key: str, cursor: tuple = FIRST, size: int = 1000, time: str = "updated_at") -> DataFrame:
    """All rows after a cursor with ``batch``, the page each would come in."""
    return ranked(rows.where(after(time, key, cursor)), time, key, at="_at").withColumn("batch", F.expr(f"_at div {size}")).drop("_at")


class CursorStore:
    """Cursors by table in one small JSON file, replaced atomically."""

    def __init__(self, path: str):
        self.path = Path(path)

    def _all(self) -> dict:
        if not self.path.exists():
            return {}
        held = json.loads(self.path.read_text(encoding="utf-8"))
        if not isinstance(held, dict):
            raise ValueError("a cursor file holds one object")
        return held

    def get(self, table: str) -> tuple:
        x = self._all().get(table)
        return FIRST if x is None else (datetime.fromisoformat(x["updated_at"].replace("Z", "+00:00")), x["key"])

    def put(self, table: str, cursor: tuple) -> None:
        """Moves a cursor forward; it never goes back."""
        if cursor < self.get(table):
            raise ValueError("a cursor can't go back")
        held = self._all() | {table: {"updated_at": cursor[0].astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "key": cursor[1]}}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        tmp = self.path.with_suffix(".tmp")
        with tmp.open("w", encoding="utf-8") as f:
            json.dump(held, f, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
        tmp.replace(self.path)
