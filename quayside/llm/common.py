"""What the operators share: reading tables, scratch tables, task sizes, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch.  The default of 10,000 whole texts can be large.
BATCH_ROWS = 1000
#: Bytes of input a task should hold when a shuffle is sized from its input.
TASK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made inside each open ``scratch_scope``.
_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the scratch tables made inside; for steps whose result has been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            discard(spark, folder)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where that setting is absent (tests, a single machine) is a folder
    under the warehouse used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        base = held or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    folder = f"{base.rstrip('/')}/quayside-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(folder)
    return folder


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name."""
    held = {c.lower() for c in df.columns}
    while base.lower() in held:
        base += "_"
    return base


def _written(df: DataFrame, to: str | None = None) -> tuple[DataFrame, str]:
    spark, to = df.sparkSession, to or scratch_dir(df.sparkSession)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(schema).parquet(to), to


def materialise(df: DataFrame, to: str | None = None) -> DataFrame:
    """Writes a table to the shared folder (or to ``to``) and reads it again, which cuts the lineage."""
    return _written(df, to)[0]


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a scratch table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def task_count(df: DataFrame, column: str, per_task: int = TASK_BYTES) -> int:
    """Shuffle partitions so that each holds about ``per_task`` bytes of ``column``, at least the session's number."""
    size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // per_task + 1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list as (node, component), component the least node.

    Each round gives every node the least label among its neighbours and then
    jumps along labels, so chains shrink by more than half in a round.  Rounds
    are written tables in the shared folder, of which the last one stays; only their
    change count reaches the driver.  A node without an edge has no row.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
    both, edge_table = _written(both.where("node != other").distinct())
    labels, label_table = _written(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("far"))
        after, table = _written(step.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("far", "now")).alias("component")))
        discard(spark, label_table)
        labels, label_table = after.select("node", "component"), table
        if after.where("was != component").isEmpty():
            discard(spark, edge_table)
            return labels
