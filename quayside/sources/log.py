"""A partitioned message log on shared storage, as a Spark data source.

A log is a folder of Parquet parts and numbered commit records.  A record names the
parts that a write added, with the log partition, first offset and length of each; a part
that no record names does not exist for readers, so a task that ran twice leaves no
message twice.  Offsets are dense and count from 0 in each partition.

Reading: a batch reader over all messages, and a stream reader with an offset for each
partition.  A micro-batch is bounded by a number of messages (dealt evenly over the
partitions) or by a number of commit records, and its tasks are ranges of offsets.  What
has been planned is noted in the folder ``progress``, since Spark does not tell a reader
where a restarted stream stands before it asks how far it may go; every planned batch is
noted before it runs.

Paths are whatever ``pyarrow.fs`` opens by its URI: local and mounted folders, HDFS, S3, GCS.
A log has one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..session import written

FORMAT = "message_log"
RECORD = "key binary, value binary, headers array<struct<name: string, value: binary>>, topic string, partition int, offset long"
#: Messages that one reading task takes, and that a writing task buffers.
TASK_MESSAGES = 100_000
BUFFER_MESSAGES = 50_000

_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.binary())]))
_STORED = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("headers", _HEADERS), ("topic", pa.string()), ("place", pa.int64())])
_TOLD = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("headers", _HEADERS), ("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64())])


@dataclass(frozen=True)
class Part:
    """A file of consecutive messages of one partition."""

    partition: int
    first: int
    count: int
    file: str

    @property
    def end(self) -> int:
        return self.first + self.count


class Folder:
    """The commit records of a log."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path)

    def text(self, name: str) -> str | None:
        path = f"{self.root}/{name}"
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with self.fs.open_input_stream(path) as f:
            return f.read().decode("utf-8")

    def put(self, name: str, text: str) -> None:
        """A small file, whole or not at all."""
        path = f"{self.root}/{name}"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(text.encode("utf-8"))
        self.fs.move(part, path)

    def commits(self) -> list[list[Part]]:
        """The parts of each commit record, in order."""
        held = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        names = sorted(x.base_name for x in held if x.base_name.endswith(".json"))
        return [[Part(**p) for p in json.loads(self.text(f"commits/{n}") or "[]")] for n in names]

    def ends(self, commits: int | None = None) -> dict[int, int]:
        """The offset after the last message of each partition, after so many commits."""
        out: dict[int, int] = {}
        for parts in self.commits()[:commits]:
            for p in parts:
                out[p.partition] = max(out.get(p.partition, 0), p.end)
        return out


class Range(InputPartition):
    """Messages of one part from ``start`` to before ``end``."""

    def __init__(self, part: Part, start: int, end: int):
        self.part, self.start, self.end = part, start, end


def _ranges(parts: list[Part], start: dict[int, int], end: dict[int, int]) -> list[Range]:
    out = []
    for p in parts:
        a, b = max(p.first, start.get(p.partition, 0)), min(p.end, end.get(p.partition, 0))
        out += [Range(p, at, min(at + TASK_MESSAGES, b)) for at in range(a, b, TASK_MESSAGES)]
    return out


def _read(path: str, wanted: Range) -> Iterator[pa.RecordBatch]:
    folder = Folder(path)
    with folder.fs.open_input_file(f"{folder.root}/{wanted.part.file}") as f:
        held, at = pq.ParquetFile(f), wanted.part.first
        for group in range(held.num_row_groups):
            n = held.metadata.row_group(group).num_rows
            a, b = max(wanted.start, at), min(wanted.end, at + n)
            if a < b:
                rows = held.read_row_group(group).slice(a - at, b - a)
                told = [*(rows.column(c) for c in ("key", "value", "headers", "topic")), pa.array(np.full(b - a, wanted.part.partition, np.int32)), pa.array(np.arange(a, b, dtype=np.int64))]
                yield from pa.table(told, schema=_TOLD).to_batches(max_chunksize=10_000)
            at += n


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        folder = Folder(self.path)
        return _ranges([p for c in folder.commits() for p in c], {}, folder.ends()) or [Range(Part(0, 0, 0, ""), 0, 0)]

    def read(self, wanted: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.path, wanted) if wanted.end > wanted.start else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are ``{"commits": n, "at": {partition: offset}}``."""

    def __init__(self, path: str, progress: str, messages: int | None, commits: int | None, run_limit: int | None):
        self.path, self.progress, self.messages, self.commit_bound, self.run_limit = path, progress, messages, commits, run_limit
        self.first: dict | None = None

    def initialOffset(self) -> dict:
        return {"commits": 0, "at": {}}

    def _planned(self) -> dict:
        held = Folder(self.progress).text("planned.json")
        return json.loads(held) if held else self.initialOffset()

    def latestOffset(self) -> dict:
        now, folder = self._planned(), Folder(self.path)
        self.first = self.first or now
        at = {int(p): n for p, n in now["at"].items()}
        known = len(folder.commits())
        upto = known if self.commit_bound is None else min(known, now["commits"] + self.commit_bound)
        ends = folder.ends(upto)
        taken = sum(at.values()) - sum(self.first["at"].values())
        left = None if self.run_limit is None else max(self.run_limit - taken, 0)
        bound = min((x for x in (self.messages, left) if x is not None), default=None)
        for i, p in enumerate(sorted(ends)):
            # an even share for each partition; what a bound leaves over goes to the first ones
            share = ends[p] if bound is None else bound // len(ends) + (i < bound % len(ends))
            at[p] = min(ends[p], at.get(p, 0) + share)
        whole = all(at.get(p, 0) == n for p, n in ends.items())
        return {"commits": upto if whole else now["commits"], "at": {str(p): n for p, n in sorted(at.items()) if n}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.first = self.first or start  # a batch that runs again counts for the run
        Folder(self.progress).put("planned.json", json.dumps(end))
        places = [{int(p): n for p, n in x["at"].items()} for x in (start, end)]
        return _ranges([p for c in Folder(self.path).commits() for p in c], *places) or [Range(Part(0, 0, 0, ""), 0, 0)]

    def read(self, wanted: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.path, wanted) if wanted.end > wanted.start else iter(())

    def commit(self, end: dict) -> None:
        """Nothing is removed: other readers have progress of their own."""


@dataclass
class _Written(WriterCommitMessage):
    parts: list[tuple[int, str, int]]


class _Writer(DataSourceArrowWriter):
    """Each task writes a part per partition that it meets; the driver names them, task by task, in one commit record, which is the commit."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        folder = Folder(self.path)
        folder.fs.create_dir(f"{folder.root}/parts", recursive=True)
        writers: dict[int, pq.ParquetWriter] = {}
        made: dict[int, list] = {}
        try:
            for batch in iterator:
                number = batch.column("partition")
                for p in pc.unique(number).to_pylist():
                    rows = pa.table({c: batch.column(c) for c in ("key", "value", "headers", "topic")}).filter(pc.equal(number, p))
                    if p not in writers:
                        made[p] = [f"parts/{p:05d}-{uuid.uuid4().hex}.parquet", 0]
                        writers[p] = pq.ParquetWriter(f"{folder.root}/{made[p][0]}", pa.schema(list(_STORED)[:4]), filesystem=folder.fs, compression="zstd")
                    writers[p].write_table(rows.cast(pa.schema(list(_STORED)[:4])), row_group_size=BUFFER_MESSAGES)
                    made[p][1] += rows.num_rows
        finally:
            for w in writers.values():
                w.close()
        return _Written([(p, file, n) for p, (file, n) in made.items()])

    def commit(self, messages: list[_Written | None]) -> None:
        folder = Folder(self.path)
        ends, parts = folder.ends(), []
        for message in messages:
            for p, file, n in sorted(message.parts) if message else ():
                parts.append({"partition": p, "first": ends.get(p, 0), "count": n, "file": file})
                ends[p] = ends.get(p, 0) + n
        folder.put(f"commits/{len(folder.commits()):012d}.json", json.dumps(parts))

    def abort(self, messages: list[_Written | None]) -> None:
        folder = Folder(self.path)
        for message in messages:
            for _, file, _ in message.parts if message else ():
                folder.fs.delete_file(f"{folder.root}/{file}")


class MessageLog(DataSource):
    """``format("message_log")``; options path, and for streams progress, messages, commits, run_limit."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _StreamReader:
        number = lambda k: int(self.options[k]) if k in self.options else None
        return _StreamReader(self.options["path"], self.options["progress"], number("messages"), number("commits"), number("run_limit"))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def append(records: DataFrame, folder: str, partitions: int = 1, by: str = "key", encode: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Adds records (key, value, headers, topic and whatever orders them) to a log as one commit.

    Messages go to partitions by a hash of their key, unless they have a ``partition``; within
    one they stand in the order of ``by`` columns.  A task sorts and writes a range of that order,
    as a part of its own, and the commit numbers the parts in the order of their ranges; so a
    partition is no task's, but messages that are equal in ``by`` are one task's.

    With ``encode`` the rows are none of a log yet, but have what deals and orders them (a key or
    a partition, ``by``); it makes the messages of rows, and keeps ``partition``, in the tasks that
    write them.  Such rows must be the same when they are read twice.
    """
    records.sparkSession.dataSource.register(MessageLog)
    if "partition" not in records.columns:
        records = records.withColumn("partition", F.pmod(F.crc32(F.coalesce(*[c for c in ("key", "value") if c in records.columns], F.lit(b""))), F.lit(partitions)).cast("int"))
    order = ["partition", *by.split()]
    # the ranges are sampled in a pass of their own: finished messages are written first, rows are read again
    rows = (records if encode else written(records)).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = encode(rows) if encode else rows
    rows.select("key", "value", "headers", "topic", "partition", F.lit(0).cast("long").alias("offset")).write.format(FORMAT).option("path", folder).mode("append").save()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All messages of a log."""
    spark.dataSource.register(MessageLog)
    return spark.read.format(FORMAT).option("path", folder).load()


def stream(spark: SparkSession, folder: str, progress: str, messages: int | None = None, commits: int | None = None, run_limit: int | None = None) -> DataFrame:
    """A log as a stream; ``progress`` belongs to one stream, like its checkpoint."""
    spark.dataSource.register(MessageLog)
    reader = spark.readStream.format(FORMAT).option("path", folder).option("progress", progress)
    for k, v in (("messages", messages), ("commits", commits), ("run_limit", run_limit)):
        reader = reader if v is None else reader.option(k, str(v))
    return reader.load()
