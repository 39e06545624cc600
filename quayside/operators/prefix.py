"""Ranks and running positions over whole relations by distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

_INSIDE = (1 << 33) - 1


def ranked(rows: DataFrame, *order: str, at: str = "rank") -> DataFrame:
    """Rows with ``at``, their place from 0 in the order of some columns (nulls first, equal rows in any order).

    Spark samples the order into ranges of about equal size, each sorted by one task;
    a row's place is that in its range and the sizes of the ranges before it.  The
    sorted rows are written, so that sizes and places come from the same ranges.  Only
    rows that are equal in all columns of the order must share a range.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("*", number.alias("_number")))
    placed = placed.withColumns({"_range": F.shiftright("_number", 33), "_inside": F.col("_number").bitwiseAND(F.lit(_INSIDE))}).drop("_number")
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a row for each range
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_start"))
    return placed.join(F.broadcast(starts), "_range").withColumn(at, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")
