"""Reason-coded row validation as column expressions.

Every rule is a ``(code, detail, broken)`` triple; a row's issues are the first
broken rule of each code, in the fixed order of codes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import filled
from ..schemas import DOWN_STATES, ENUMS, ID_PATTERNS, LINEAGE, REASON_CODES, TABLES, UP_STATES, Table


class Rule(NamedTuple):
    code: str
    detail: Column
    broken: Column


def _rule(code: str, detail: str | Column, broken: Column) -> Rule:
    return Rule(code, F.lit(detail) if isinstance(detail, str) else detail, F.coalesce(broken, F.lit(False)))


def lineage_rules(table: str) -> list[Rule]:
    """Checks of the lineage columns; they come first, so their detail wins."""
    out = [
        _rule("SCHEMA_INVALID", f"source_table must equal '{table}'", ~F.coalesce(F.col("source_table") == table, F.lit(False))),
        _rule("SCHEMA_INVALID", "extraction_run_id must be non-empty", ~filled("extraction_run_id")),
    ]
    return out + [_rule("SCHEMA_INVALID", f"{c} must be a UTC datetime", F.col(c).isNull()) for c, t in LINEAGE if isinstance(t, T.TimestampType)]


def schema_rules(table: Table, present: set[str]) -> list[Rule]:
    """Types, identifiers and enumerations; a missing column ends them."""
    missing = [c for c in table.all_columns if c not in present]
    if missing:
        return [_rule("SCHEMA_INVALID", f"missing columns: {', '.join(missing)}", F.lit(True))]
    out: list[Rule] = []
    for c, kind in table.all_columns.items():
        if c.endswith("_id") or c in ("name", "timezone_name", "code", "root_cause"):
            out.append(_rule("SCHEMA_INVALID", f"{c} must be a non-empty string", ~filled(c)))
        if isinstance(kind, T.TimestampType) and c not in table.nullable:
            out.append(_rule("SCHEMA_INVALID", f"{c} must be a UTC datetime", F.col(c).isNull()))
        if c in ID_PATTERNS:
            out.append(_rule("SCHEMA_INVALID", f"{c} has an invalid identifier", ~F.col(c).rlike(ID_PATTERNS[c])))
        if c in ENUMS:
            out.append(_rule("SCHEMA_INVALID", f"{c} has an invalid value", ~F.coalesce(F.col(c).isin(*ENUMS[c]), F.lit(False))))
    for c, told in (("commissioning_date", "a date"), ("available", "boolean"), ("load_percent", "numeric"), ("temperature_c", "numeric")):
        if c in table.columns:
            out.append(_rule("SCHEMA_INVALID", f"{c} must be {told}", F.col(c).isNull()))
    if "schema_version" in table.columns:
        out.append(_rule("SCHEMA_INVALID", "schema_version must be an integer", F.col("schema_version").isNull()))
        out.append(_rule("SCHEMA_INVALID", "schema_version must be 1", F.col("schema_version") != 1))
    return out


def range_rules(table: Table) -> list[Rule]:
    limits = {"load_percent": (0, 100), "temperature_c": (-20, 150)}
    return [_rule("RANGE_INVALID", f"{c} must be between {a} and {b}", ~F.col(c).cast("double").between(a, b)) for c, (a, b) in limits.items() if c in table.columns]


def reference_rules(table: Table) -> list[Rule]:
    """Needs the marker columns that ``with_references`` adds."""
    return [_rule("REFERENCE_INVALID", F.concat(F.lit(f"{c} '"), F.col(c), F.lit("' is not referenced")), F.col(c).isNotNull() & ~F.col(f"_known_{c}")) for c in table.references]


def temporal_rules(table: Table) -> list[Rule]:
    out = [_rule("TEMPORAL_INVALID", f"{b} must not precede {a}", F.col(b) < F.col(a)) for a, b in (("created_at", "updated_at"), *table.orders)]
    state, status = F.col("state"), F.col("status")
    if table.name == "telemetry_events":
        out.append(_rule("TEMPORAL_INVALID", "unavailable states must not be available", state.isin(*DOWN_STATES) & F.col("available")))
        out.append(_rule("TEMPORAL_INVALID", "available states must be available", state.isin(*UP_STATES) & ~F.col("available")))
    if table.name == "incidents":
        out.append(_rule("TEMPORAL_INVALID", "resolved incidents require resolved_at", (status == "RESOLVED") & F.col("resolved_at").isNull()))
        out.append(_rule("TEMPORAL_INVALID", "open incidents cannot have resolved_at", (status == "OPEN") & F.col("resolved_at").isNotNull()))
    if table.name == "maintenance_orders":
        out.append(_rule("TEMPORAL_INVALID", "completed orders require completed_at", (status == "COMPLETED") & F.col("completed_at").isNull()))
        out.append(_rule("TEMPORAL_INVALID", "unfinished orders cannot have completed_at", (status != "COMPLETED") & F.col("completed_at").isNotNull()))
    return out


def with_references(rows: DataFrame, table: Table, references: dict[str, DataFrame]) -> DataFrame:
    """Adds ``_known_<column>``: whether the value is among the distinct raw keys of the table it refers to."""
    for c in table.references:
        known = references[c].select(c).where(F.col(c).isNotNull()).distinct().withColumn(f"_known_{c}", F.lit(True))
        rows = rows.join(known, c, "left").withColumn(f"_known_{c}", F.coalesce(f"_known_{c}", F.lit(False)))
    return rows


def issues(rules: list[Rule]) -> Column:
    """array<struct<code, detail>>: the first broken rule of each code, codes in their order."""
    first = []
    for code in REASON_CODES:
        own = [r for r in rules if r.code == code]
        if own:
            detail = F.coalesce(*[F.when(r.broken, r.detail) for r in own])
            first.append(F.when(detail.isNotNull(), F.struct(F.lit(code).alias("code"), detail.alias("detail"))))
    none = F.lit(None).cast("struct<code: string, detail: string>")
    return F.filter(F.array(*(first or [none])), lambda x: x.isNotNull())


def row_rules(table: Table, present: set[str], lineage: bool = False) -> list[Rule]:
    """All rules of a table but duplicates; those on columns that are not there are left out."""
    schema = schema_rules(table, present)
    whole = set(table.all_columns) <= present
    out = (lineage_rules(table.name) if lineage else []) + schema
    return out + (range_rules(table) + reference_rules(table) + temporal_rules(table) if whole else [])


def validate(rows: DataFrame, table: str, references: dict[str, DataFrame]) -> DataFrame:
    """Rows with ``issues``."""
    spec = TABLES[table]
    rows = with_references(rows, spec, references) if set(spec.references) <= set(rows.columns) else rows
    return rows.withColumn("issues", issues(row_rules(spec, set(rows.columns)))).drop(*[f"_known_{c}" for c in spec.references])


def batch_duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Second and later rows of a key in a batch, by ``order``."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(order))).where("nth > 1")


def violations(rows: DataFrame, not_null: list[str] = (), unique: list[str] = (), accepted: dict[str, tuple] | None = None) -> DataFrame:
    """(check, violations) of column tests; every check is a row, zero included."""
    tests = [(f"not_null:{c}", F.count_if(F.col(c).isNull())) for c in not_null]
    tests += [(f"accepted_values:{c}", F.count_if(~F.col(c).isin(*v))) for c, v in (accepted or {}).items()]
    out = None
    if tests:
        pairs = F.array(*[F.struct(F.lit(n).alias("check"), x.cast("long").alias("violations")) for n, x in tests])
        out = rows.agg(F.explode(pairs).alias("t")).select("t.check", "t.violations")
    for c in unique:
        extra = rows.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit(f"unique:{c}").alias("check"), "violations")
        out = extra if out is None else out.unionByName(extra)
    return out


def missing_references(rows: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Rows whose value has no parent."""
    return rows.where(F.col(column).isNotNull()).join(parent.select(column).distinct(), column, "left_anti")
