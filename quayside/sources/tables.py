"""Reading relations: Bronze trees, typed staging relations, snapshots of a database."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLES


def read_bronze(spark: SparkSession, bronze_dir: str, table: str) -> DataFrame:
    """All Bronze rows of a table, schemas united by name, with origin; staging folders are skipped.

    A column missing from a part is null there.  Parts whose types can't be merged, such as
    decimals of a database and doubles of a stream, are read by groups of one schema and
    brought to the wider type, so that no value is rounded.
    """
    path = f"{bronze_dir}/{table}"
    try:
        rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)
    except Exception as error:
        if "CANNOT_MERGE_SCHEMAS" in str(error):
            return _by_schema(spark, path)
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            rows = spark.createDataFrame([], TABLES[table].bronze)
            return rows.withColumn("_path", F.lit("")).withColumn("_ordinal", F.lit(0).cast("long"))
        raise
    return _with_origin(rows)


def _with_origin(rows: DataFrame) -> DataFrame:
    rows = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_ordinal"))
    return rows.where(~F.col("_path").contains("/.staging/"))


def _by_schema(spark: SparkSession, path: str) -> DataFrame:
    """The parts of a tree (its first level of folders, one write each) in groups of one schema, united by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    place = F.regexp_extract("path", "/" + re.escape(path.rstrip("/").rpartition("/")[2]) + "/([^/]+)", 1)
    groups: dict[str, list[str]] = {}
    for part in sorted(r.part for r in files.select(place.alias("part")).where("part != '.staging'").distinct().collect()):
        kind = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/{part}").schema
        groups.setdefault(kind.json(), []).append(f"{path}/{part}")
    return union_by_name(*[_with_origin(spark.read.option("recursiveFileLookup", True).parquet(*parts)) for _, parts in sorted(groups.items())])


def staging(rows: DataFrame, table: str) -> DataFrame:
    """The typed projection that Gold reads: decimals become doubles, types are fixed."""
    spec = TABLES[table]
    out = []
    for c, t in spec.all_columns.items():
        kind = T.DoubleType() if isinstance(t, T.DecimalType) else t
        out.append((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c))
    return rows.select(*out)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Vertical union by column name; a missing column is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, after: tuple | None = None, **options: str) -> DataFrame:
    """A database table over JDBC, where its driver is on the class path; the cursor reaches the database."""
    key = TABLES[table].key
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    rows = reader.load()
    if after is not None:
        t, k = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col("updated_at") > t) | ((F.col("updated_at") == t) & (F.col(key) > k)))
    return rows


def parameterised(spark: SparkSession, template: str, source: DataFrame, **params) -> DataFrame:
    """A SQL template over ``{source}`` with named parameters."""
    return spark.sql(template, args=params, source=source)
