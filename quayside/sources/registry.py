"""Schemas from a JSON registry, and result rows kept as JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.scalars import parse_utc
from ..schemas import KPI_COLUMNS, KPI_INTEGERS

# Type and mode names of the registry format.
KINDS = {"STRING": T.StringType(), "INT64": T.LongType(), "BOOL": T.BooleanType(), "FLOAT64": T.DoubleType(), "TIMESTAMP": T.TimestampType()}
MODES = {"REQUIRED": False, "NULLABLE": True}
_NAME = re.compile(r"[a-z][a-z0-9_]*\Z")


def load_registry(text: str, tables: tuple[str, ...]) -> dict[str, T.StructType]:
    """StructTypes of exactly the named tables; anything unknown or repeated is an error."""
    held = json.loads(text)
    if not isinstance(held, dict) or set(held) != set(tables):
        raise ValueError(f"a registry names exactly {', '.join(sorted(tables))}")
    out = {}
    for name, fields in held.items():
        made = T.StructType()
        for f in fields:
            if set(f) != {"name", "type", "mode"} or not _NAME.match(f["name"]) or f["type"] not in KINDS or f["mode"] not in MODES or f["name"] in made.names:
                raise ValueError(f"{name}: not a field: {f}")
            made.add(f["name"], KINDS[f["type"]], MODES[f["mode"]])
        if not made:
            raise ValueError(f"{name} has no fields")
        out[name] = made
    return out


def checked_name(text: str) -> str:
    """A table or schema name that may stand in a query as an identifier."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,127}", text):
        raise ValueError(f"not an identifier: {text!r}")
    return text


def render(spark: SparkSession, query: str, **names: str) -> DataFrame:
    """A query whose ``IDENTIFIER(:name)`` places take checked names."""
    return spark.sql(query, args={k: checked_name(v) for k, v in names.items()})


def has_columns(df: DataFrame, columns: tuple[str, ...] = tuple(KPI_COLUMNS)) -> bool:
    """Whether a result has exactly these columns in this order."""
    return tuple(df.columns) == tuple(columns)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """KPI rows from a JSON file with ``Z`` times; numbers are checked by the schema, times by their form."""
    times = [c for c in KPI_COLUMNS if c.startswith("source_period")]
    schema = T.StructType()
    for c in KPI_COLUMNS:
        schema.add(c, T.StringType() if c == "terminal_id" or c in times else T.LongType() if c in KPI_INTEGERS else T.DoubleType())
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumns({c: parse_utc(c) for c in times})
