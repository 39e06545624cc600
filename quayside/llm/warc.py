"""WARC archives of pages, and their merged capture index.

Each record is a gzip member of its own (one of 16 MB or more is several), so an offset
of the index opens its record in the archive.  Writing is a Spark text write whose lines
are these members without their last byte, which is zero and stands as the line's end; part
files are whole archives and the committer makes retries safe.  Pages are dealt to
archives of about ``ARCHIVE_BYTES`` before compression, also those of one id and payload.
Payloads seen before become revisit records that refer to one response.

Reading unpacks the archives a member at a time and indexes them by external merge: each
archive yields a run of captures sorted by (URL key, time, id); Spark deals ranges of the
key space, about ``RANGE_ROWS`` captures each, and a loser tree merges the runs of a range,
so the ranges in order are the capture history of every URL in global order.

Rows: a null payload is empty; a null URL becomes ``urn:page:<id>``; a payload
under ``least`` bytes is always a response; a page without an id is always a response
and never referred to; repeated rows are records of their own; a very long payload is
one record, which a task holds a few times; columns that the operator doesn't name are
not read; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_dir, task_count

#: Bytes of payload in an archive, and captures of a key range: some 64 MB of index.
ARCHIVE_BYTES = 32 << 20
RANGE_ROWS = 200_000
#: Bytes of one gzip member at most: its last byte, the highest of its length, is zero.
MEMBER_BYTES = (1 << 24) - 1
#: Share of all pages from which on the pages of one id and payload are spread: fewer than 1000 such groups can be.
HOT = 1000

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "url_key string, ts string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_offset long, archive string"


def groups_of(pages: DataFrame) -> DataFrame:
    """(page_id, digest, size, n) of each distinct page and payload, written."""
    return materialise(pages.groupBy("page_id", F.sha1(F.encode("html", "utf-8")).alias("digest"), F.octet_length("html").alias("size")).agg(F.count("*").alias("n")))


def decide(found: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, digest, refers_to) of each page with an id and payload; ``refers_to`` is null for responses."""
    ids = found.where("page_id is not null").drop("n")
    # partial aggregation meets a payload that fills a third of all pages; only payloads found twice go on
    groups = ids.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    # both sides salted by the page's id, so that no payload is one task
    salt = F.array(*[F.lit(i) for i in range(16)])
    groups = groups.select("digest", "response", F.explode(salt).alias("salt"))
    out = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(16)).cast("int")).join(groups, ["digest", "salt"], "left")
    return out.select("page_id", "digest", F.when(F.col("response") != F.col("page_id"), F.col("response")).alias("refers_to"))


def _spread(found: DataFrame, archives: int) -> DataFrame:
    """(page_id, digest, copies): the groups of very many pages and the archives that each is spread over; under ``HOT`` rows."""
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where((F.col("n") > 1) & (F.col("n") * HOT > F.lit(total)))
    return hot.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.expr(f"n * {archives} div {max(total, 1)} + 1").alias("copies"))


def records(pages: DataFrame, found: DataFrame, decisions: DataFrame, time: Column, archives: int) -> DataFrame:
    """One WARC record per page as a string, without the two line ends that close it, dealt over ``archives`` partitions."""
    spread = F.broadcast(_spread(found, archives))
    same = (F.col("_id").eqNullSafe(F.col("page_id"))) & (F.col("_digest") == F.col("digest"))
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    decisions = decisions.join(spread, same, "left").select("page_id", "digest", "refers_to", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("salt"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), name(c), F.lit(">"))
    rows = pages.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).join(spread, same, "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), copies)).drop("_id", "_digest", "copies")
    rows = rows.repartition(archives, "page_id", "digest", "salt").join(decisions, ["page_id", "digest", "salt"], "left")
    safe = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), name(F.col("page_id")))), r"[\r\n\s]", "%20")
    payload = F.when(F.col("refers_to").isNull(), F.col("html")).otherwise("")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("\r\nWARC-Date: "), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Target-URI: "), safe,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("refers_to").isNull(), "").otherwise(F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT}\r\nWARC-Refers-To: "), urn(F.col("refers_to")))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(payload)).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, http, payload).alias("record"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as gzip members, the last one's last byte left out."""
    for batch in batches:
        out = []
        for record in batch.column("record"):
            whole = record.as_buffer().to_pybytes() + b"\r\n\r\n"
            pieces = []
            for at in range(0, len(whole), MEMBER_BYTES):
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                pieces += [packer.compress(whole[at : at + MEMBER_BYTES]), packer.flush()]
            out.append(b"".join(pieces)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write(pages: DataFrame, to: str, least: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes gzip WARC files of about ``archive_bytes`` of payload under ``to``; pages are (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    time = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000)))
    found = groups_of(pages)
    told = records(pages, found, decide(found, least), time, task_count(pages, "html", archive_bytes))
    members = told.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("member"))  # bytes as they are
    members.write.option("lineSep", "\0").option("compression", "none").text(to)


def url_key(url: str) -> str:
    """The sort-friendly form of a URL: host labels reversed, no www, path and query in lower case."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = re.sub(r"^www\d*\.", "", host).split(".")
    return (",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def parse(stream: BinaryIO) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, header, block) of each record of an unpacked archive, read as it goes."""
    at = 0
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record at {at}")
        head, size = {}, len(line)
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError(f"a header ends wrongly at {at}")
            size += len(line)
            key, value = line[:-2].decode("utf-8").split(": ", 1)
            head[key] = value
        block = stream.read(int(head["Content-Length"]))
        if len(block) < int(head["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"a record ends wrongly at {at}")
        yield at, head, block
        at += size + 2 + len(block) + 4


def unpack(content: pa.Buffer | bytes, at: int = 0) -> Iterator[tuple[int, dict, bytes]]:
    """(offset in the archive, header, block) of each record from one that begins at ``at``."""
    raw = memoryview(content)
    held, begin = b"", at
    while at < len(raw):
        packer = zlib.decompressobj(31)
        pieces = []
        while not packer.eof:
            if at >= len(raw):
                raise ValueError(f"a member ends wrongly at {begin}")
            given = raw[at : at + (1 << 16)]
            pieces.append(packer.decompress(given))
            at += len(given) - len(packer.unused_data)
        held = b"".join([held, *pieces])
        end = held.find(b"\r\n\r\n")  # of the header, which tells how long the record is
        size = re.search(rb"\r\nContent-Length: (\d+)\r\n", held[: end + 2]) if end >= 0 else None
        if at >= len(raw) or size and len(held) >= end + 4 + int(size[1]) + 4:
            for _, head, block in parse(io.BytesIO(held)):
                yield begin, head, block
            held, begin = b"", at


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted run of captures of each archive."""

    def number(x: str) -> int | None:
        name = x[len("<urn:page:") : -1]
        return None if name == "none" else int(name)

    names = [c.split()[0] for c in INDEX.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = []
            for at, head, block in unpack(content.as_buffer()):
                http, _, payload = block.partition(b"\r\n\r\n")
                revisit = head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"].partition(":")[2]
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"{path}: a payload does not match its digest at {at}")
                url = head["WARC-Target-URI"]
                rows.append((url_key(url), re.sub(r"\D", "", head["WARC-Date"]), number(head["WARC-Record-ID"]), url, head["WARC-Type"], size, digest, number(head["WARC-Refers-To"]) if revisit else None, at, path))
            rows.sort(key=_place)
            if rows:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _place(row: tuple) -> tuple:
    """Where a capture stands in the history: URL key, time, id (none first, as Spark sorts it), offset and archive."""
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9])


class LoserTree:
    """k-way merge of sorted runs with one comparison per level for each item."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, max(len(runs), 1)
        self.at = [0] * len(runs)
        self.tree = [-1] * self.k  # losers; place 0 holds the winner
        for i in range(len(runs)):
            self._play(i)

    def _key(self, i: int):
        """An ended run is larger than all; equal items go by the number of their run, so the merge is stable."""
        return (1,) if self.at[i] >= len(self.runs[i]) else (0, self.runs[i][self.at[i]], i)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._key(self.tree[node]) < self._key(i):
                i, self.tree[node] = self.tree[node], i
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.runs and self.at[self.tree[0]] < len(self.runs[self.tree[0]]):
            i = self.tree[0]
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self._play(i)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs (one per archive) of the key range in this partition."""
    runs: dict[str, list[tuple]] = {}
    names = [c.split()[0] for c in INDEX.split(", ")]
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            runs.setdefault(row[9], []).append((_place(row), row))
    for run in runs.values():
        if any(a[0] > b[0] for a, b in zip(run, run[1:], strict=False)):
            run.sort(key=lambda x: x[0])  # a shuffle may hand the pieces of a run over in another order
    merged, number, at = iter(LoserTree(list(runs.values()))), TaskContext.get().partitionId(), 0
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    while rows := [row for _, row in itertools.islice(merged, 10_000)]:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), number, np.int32)), pa.array(np.arange(at, at + len(rows)))], names=[*names, "key_range", "place"])
        at += len(rows)


def history(archives: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The merged index of (path, content) archives: captures with ``key_range`` and ``place`` in it, which order them globally."""
    runs = materialise(archives.mapInArrow(_captures, INDEX))
    rows = runs.count()
    # small indexes have a few ranges too, so that they are not one task's
    ranges = max(rows // range_rows + 1, min(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 1000 + 1))
    return runs.repartitionByRange(ranges, "url_key", "ts", "page_id").mapInArrow(_merge, INDEX + ", key_range int, place long")


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes all pages to archives in the shared folder, reads them back and returns their merged index."""
    spark, to = pages.sparkSession, f"{scratch_dir(pages.sparkSession)}/warc"
    write(pages, to, least)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(to).select("path", "content")
    return history(archives)
