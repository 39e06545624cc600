"""A keyed relation in versions; an upsert rewrites only the files that hold its keys.

Rows are dealt to a fixed number of buckets by a hash of their key and lie in immutable
Parquet files of a bounded number of rows.  Each version has a list of its files and an
index of those it added: key range and Bloom filter.  An upsert looks its keys up in the
index of their bucket, reads the keys of the files that may hold them, and rewrites those
that do; keys that are new go to new files.  A version exists once its record is
written, as the last step, so a reader of an earlier version is not disturbed and a
failed upsert changes nothing.

A relation has one writer at a time.  Keys are one column without nulls; rows to put in
must not repeat a key.  The driver holds a version's file names, as Spark does to scan them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from ..sources.log import Folder

#: Rows of a file at most; its Bloom filter takes BITS bits a row and errs for about one key in a hundred.
FILE_ROWS = 1_000_000
BITS, HASHES = 10, 7
#: Hashes whose bits are worked out at once, which bounds the arrays that takes.
PLACED = 65_536


class MergeError(ValueError):
    """Rows that can't be put in: keys are missing or repeated."""


@dataclass(frozen=True)
class Version:
    """What a version's record says; ``files`` and ``index`` are folders, the index one of each version so far."""

    version: int
    key: str
    buckets: int
    schema: str
    files: str
    index: tuple[str, ...]
    inserted: int
    updated: int
    rewritten: int
    kept: int


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, by double hashing of its halves."""
    h = hashes.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * high[:, None]) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    held = np.zeros(max(64, BITS * len(hashes)), dtype=np.uint8)
    for at in range(0, len(hashes), PLACED):
        held[_places(hashes[at : at + PLACED], len(held))] = 1
    return len(held).to_bytes(8, "little") + np.packbits(held).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """Of each hash, whether the filter may have seen it; True for all it has seen."""
    bits = int.from_bytes(filter_[:8], "little")
    at = _places(hashes, bits).astype(np.int64)
    packed = np.frombuffer(filter_, dtype=np.uint8, offset=8)
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


class Versions:
    """The versions of a relation below a folder of shared storage, given by its URI or path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(self.root)

    def versions(self) -> list[int]:
        at, out = 1, []
        while self.folder.text(f"versions/{at:012d}.json") is not None:
            out.append(at)
            at += 1
        return out

    def version(self, number: int | None = None) -> Version:
        """A version's record; by default the last one's."""
        number = number or max(self.versions(), default=1)
        text = self.folder.text(f"versions/{number:012d}.json")
        if text is None:
            raise FileNotFoundError(f"{self.root} has no version {number}")
        held = json.loads(text)
        return Version(**held | {"index": tuple(held["index"])})

    def files(self, number: int | None = None) -> DataFrame:
        """(_bucket, _file, rows) of a version."""
        return self.spark.read.schema("_bucket int, _file string, rows long").parquet(self.version(number).files)

    def read(self, number: int | None = None) -> DataFrame:
        v = self.version(number)
        return self._rows([r["_file"] for r in self.files(v.version).select("_file").collect()], v)

    def create(self, rows: DataFrame, key: str, buckets: int = 64) -> Version:
        """Version 1; ``buckets`` should let a bucket of the relation at its full size fit a task."""
        if self.versions():
            raise FileExistsError(f"{self.root} has versions")
        rows = self._checked(rows, key)
        return self._commit(Version(0, key, buckets, rows.schema.json(), "", (), 0, 0, 0, 0), rows, [], inserted=rows.count(), updated=0)

    def upsert(self, new: DataFrame) -> Version:
        """The next version: rows of known keys are replaced, the others added."""
        v = self.version()
        new = self._checked(new.select(*T.StructType.fromJson(json.loads(v.schema)).names), v.key)
        keys = new.select(v.key)
        found = self._rows(self._candidates(keys, v), v).select(v.key, F.col("_metadata.file_path").alias("_file")).join(keys, v.key, "left_semi")
        holders = {r["_file"]: r["n"] for r in found.groupBy("_file").agg(F.count("*").alias("n")).collect()}
        rest = self._rows(list(holders), v).join(keys, v.key, "left_anti")
        updated = sum(holders.values())
        return self._commit(v, rest.unionByName(new), list(holders), inserted=new.count() - updated, updated=updated)

    def compact(self, most: int = 4) -> Version:
        """A version of the same rows in which buckets of over ``most`` files are written anew."""
        v = self.version()
        many = self.files().groupBy("_bucket").agg(F.count("*").alias("n")).where(F.col("n") > most)
        names = [r["_file"] for r in self.files().join(many, "_bucket", "left_semi").collect()]
        return self._commit(v, self._rows(names, v), names, inserted=0, updated=0)

    def _checked(self, rows: DataFrame, key: str) -> DataFrame:
        rows = written(rows)
        if not rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).isEmpty():
            raise MergeError(f"{key} is missing or repeated")
        return rows

    def _rows(self, names: list[str], v: Version) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(v.schema))
        if not names:  # an empty folder, so that file metadata can be asked for all the same
            empty = f"{self.root}/empty"
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(empty)
            names = [empty]
        return self.spark.read.schema(schema).parquet(*names)

    def _bucket(self, v: Version) -> Column:
        return F.pmod(F.xxhash64(v.key), F.lit(v.buckets)).cast("int").alias("_bucket")

    def _candidates(self, keys: DataFrame, v: Version) -> list[str]:
        """Files whose key range and filter let them hold one of the keys."""
        key = v.key
        index = self.spark.read.parquet(*v.index).join(self.files(v.version).select("_file"), "_file", "left_semi").select("_bucket", "_file", "low", "high", "bloom")

        def hit(keys: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
            hashes, found = keys["_hash"].to_numpy(), []
            for f in files.itertuples(index=False) if len(keys) else ():
                inside = ((keys[key] >= f.low) & (keys[key] <= f.high)).to_numpy()
                if inside.any() and may_hold(f.bloom, hashes[inside]).any():
                    found.append(f[1])
            return pd.DataFrame({"file": found}, dtype=object)

        dealt = keys.select(key, F.xxhash64(key).alias("_hash"), self._bucket(v))
        hits = dealt.groupBy("_bucket").cogroup(index.groupBy("_bucket")).applyInPandas(hit, "file string")
        return [r["file"] for r in hits.collect()]

    def _commit(self, v: Version, rows: DataFrame, gone: list[str], inserted: int, updated: int) -> Version:
        """Writes rows that take the place of the files ``gone``, their index, the list of files and, last, the record."""
        name = f"{v.version + 1:012d}-{uuid.uuid4().hex}"
        data, index, files = (f"{self.root}/{kind}/{name}" for kind in ("data", "index", "files"))
        rows.withColumn("_bucket", self._bucket(v)).repartition("_bucket").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("_bucket").parquet(data)
        schema = T.StructType.fromJson(json.loads(v.schema)).add("_bucket", T.IntegerType())
        keyed = self.spark.read.schema(schema).parquet(data).select("_bucket", F.col("_metadata.file_path").alias("_file"), v.key, F.xxhash64(v.key).alias("_hash"))
        ranges = keyed.groupBy("_bucket", "_file").agg(F.min(v.key).alias("low"), F.max(v.key).alias("high"), F.count("*").alias("rows"))
        filters = keyed.select("_file", "_hash").groupBy("_file").applyInPandas(lambda x: pd.DataFrame({"_file": [x["_file"].iloc[0]], "bloom": [bloom(x["_hash"].to_numpy())]}), "_file string, bloom binary")
        ranges.join(filters, "_file").write.parquet(index)
        added = self.spark.read.schema("_bucket int, _file string, rows long").parquet(index)
        kept = self.files(v.version).where(~F.col("_file").isin(gone)) if v.version else added.limit(0)
        if len(gone) > 1000:  # a long list is joined, not written into the plan
            kept = self.files(v.version).join(self.spark.createDataFrame([(g,) for g in gone], "_file string"), "_file", "left_anti")
        kept.unionByName(added).write.parquet(files)
        n = self.files(v.version).count() - len(gone) if v.version else 0
        new = Version(v.version + 1, v.key, v.buckets, v.schema, files, (*v.index, index), inserted, updated, len(gone), n)
        self.folder.put(f"versions/{new.version:012d}.json", json.dumps(asdict(new)))
        return new
