"""Typed import of JSON records: normalisation, issues per row and field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import filled, parse_utc
from ..operators.quality import issues, reference_rules, temporal_rules, with_references
from ..operators.quality import range_rules as _ranges
from ..schemas import ENUMS, ID_PATTERNS, TABLES
from ..session import written


def records(spark: SparkSession, lines: DataFrame | list[str]) -> DataFrame:
    """(row_index, raw) of JSON objects, one per line."""
    if isinstance(lines, list):
        return spark.createDataFrame(list(enumerate(lines)), "row_index long, raw string")
    return lines


def _typed(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return parse_utc(value)
    return value if isinstance(kind, T.StringType) else value.try_cast(kind)


def normalise(rows: DataFrame, table: str, *carried: str) -> DataFrame:
    """(row_index, columns..., problems): typed fields and what was wrong with them.

    ``problems`` holds (field, problem): unknown and missing fields, wrong kinds,
    identifiers and enumerations.  A null is a value; only an absent field is missing.
    """
    spec = TABLES[table]
    fields = spec.all_columns
    parsed = rows.withColumn("_m", F.from_json("raw", "map<string, string>"))
    names = F.coalesce(F.map_keys("_m"), F.array().cast("array<string>"))
    problem = lambda f, p: F.struct(F.lit(f).alias("field") if isinstance(f, str) else f.alias("field"), F.lit(p).alias("problem"))
    unknown = F.transform(F.array_sort(F.array_except(names, F.array(*[F.lit(c) for c in fields]))), lambda c: problem(c, "unknown field"))
    checks = [F.when(F.col("_m").isNull(), problem("", "not a JSON object"))]
    columns = []
    for c, kind in fields.items():
        value, typed = F.col("_m")[c], _typed(F.col("_m")[c], kind)
        wrong = value.isNotNull() & typed.isNull()
        if c in ID_PATTERNS:
            wrong |= value.isNotNull() & ~value.rlike(ID_PATTERNS[c])
        elif c in ENUMS:
            wrong |= value.isNotNull() & ~value.isin(*ENUMS[c])
        elif isinstance(kind, T.StringType):
            wrong |= value.isNotNull() & ~filled(value)
        there = F.array_contains(names, c)
        checks.append(F.when(F.col("_m").isNotNull(), F.when(~there, problem(c, "missing field")).when(there & value.isNull() & F.lit(c not in spec.nullable), problem(c, "must not be null")).when(wrong, problem(c, f"not a valid {kind.simpleString()}"))))
        columns.append(typed.alias(c))
    found = F.filter(F.concat(F.array(*checks), F.coalesce(unknown, F.array().cast("array<struct<field: string, problem: string>>"))), lambda x: x.isNotNull())
    return parsed.select("row_index", *carried, *columns, found.alias("problems"))


def import_issues(rows: DataFrame, table: str, references: dict[str, DataFrame], batch: str | None = None) -> DataFrame:
    """(row_index, field, problem) of a batch: shape, then rules, then keys repeated inside it.

    Rows of several batches at once have a column ``batch``, inside which keys are compared.  A key's
    first row is found by partial aggregation, so a key of very many rows is no task's.  What was
    parsed is written first: a filter on it would otherwise move below the parser and parse a row
    again for each of the fields that it names.
    """
    spec = TABLES[table]
    own = [] if batch is None else [batch]
    typed = written(normalise(rows, table, *own))
    shape = typed.select("row_index", F.explode("problems").alias("p")).select("row_index", "p.field", "p.problem")
    checked = with_references(typed, spec, references) if spec.references else typed
    rules = issues(_ranges(spec) + reference_rules(spec) + temporal_rules(spec))
    broken = checked.where(F.size("problems") == 0).select("row_index", F.explode(rules).alias("i")).select("row_index", F.lit("").alias("field"), F.col("i.detail").alias("problem"))
    keyed = typed.where(F.col(spec.key).isNotNull()).select("row_index", *own, spec.key)
    first = keyed.groupBy(*own, spec.key).agg(F.min("row_index").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    repeats = keyed.join(first, [*own, spec.key]).where("row_index > _first").select("row_index", F.lit(spec.key).alias("field"), F.lit("repeated in this batch").alias("problem"))
    return shape.unionByName(broken).unionByName(repeats)
