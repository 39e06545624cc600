"""Upsert of validated records into a Parquet relation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Merge(NamedTuple):
    rows: DataFrame
    inserted: DataFrame
    updated: DataFrame


def merge(held: DataFrame, new: DataFrame, key: str) -> Merge:
    """``held`` with the rows of ``new`` put in by key; ``new`` must not repeat a key."""
    fresh = new.join(held.select(key), key, "left_anti")
    known = new.join(held.select(key).distinct(), key, "left_semi")
    return Merge(held.join(new.select(key), key, "left_anti").unionByName(new), fresh, known)


def counts(m: Merge) -> DataFrame:
    return m.inserted.agg(F.count("*").alias("inserted")).crossJoin(m.updated.agg(F.count("*").alias("updated")))


def write_merged(m: Merge, root: str, version: int) -> str:
    """A new version of the relation in its own folder: readers of the old one are not disturbed, and it is all or nothing."""
    path = f"{root}/version={version:012d}"
    m.rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return path
