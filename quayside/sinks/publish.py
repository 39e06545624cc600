"""Publishing snapshots: canonical JSON, manifest, atomic swap.

Aggregated relations are bounded lists of documents in one file.  Relations that
grow with the input are DataFrames: Spark writes them as sorted parts of JSON
lines into the snapshot, and the driver sees only the parts' names and digests.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonschema
from ..operators.verify import fingerprint

#: Documents of one file at most, as it is for reading in a browser.
MOST_DOCUMENTS = 100_000
#: Rows of one part at most.
PART_ROWS = 100_000


class PublishError(RuntimeError):
    """A snapshot can't be published; what was published before stays."""


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, a line end."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"


def documents(df: DataFrame) -> list[dict]:
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).take(MOST_DOCUMENTS + 1)
    if len(rows) > MOST_DOCUMENTS:
        raise PublishError(f"a dataset has over {MOST_DOCUMENTS} documents")
    return [json.loads(r["j"]) for r in rows]


def write_parts(df: DataFrame, target: Path) -> None:
    """One JSON object a row, in the order of ``df``, whose sort deals the parts."""
    lines = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.option("maxRecordsPerFile", PART_ROWS).text(target.absolute().as_uri())


def _lines(spark: SparkSession, target: Path) -> DataFrame:
    return spark.read.schema("value string").text(target.absolute().as_uri())


def describe_parts(spark: SparkSession, target: Path) -> list[dict]:
    """Name, rows, bytes and digest of each part, in the rows' order."""
    counts = _lines(spark, target).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target.absolute().as_uri())
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    found = files.join(counts, "name", "left").select("name", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes", "sha256").collect()
    return sorted((r.asDict() for r in found), key=lambda r: [int(x) for x in re.search(r"^part-(\d+)-.*-c(\d+)", r["name"]).groups()])


def rows(spark: SparkSession, out_dir: str, name: str, schema: str) -> DataFrame:
    """The rows of a dataset of the published snapshot that is written in parts; fails if a part is not as published."""
    entry = json.loads((Path(out_dir) / "manifest.json").read_text(encoding="utf-8"))["datasets"][name]
    target = Path(out_dir) / entry["path"]
    if describe_parts(spark, target) != entry["parts"]:
        raise PublishError(f"{name} is not as published")
    return _lines(spark, target).select(F.from_json("value", schema).alias("j")).select("j.*")


def _replace(path: Path, text: str) -> None:
    held = path.with_suffix(path.suffix + ".tmp")
    with held.open("w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    held.replace(path)


def check_overview(doc: dict) -> list[str]:
    """What is wrong with an overview document."""
    wrong = []
    for c in ("terminal_id", "source_period_start", "source_period_end"):
        if not isinstance(doc.get(c), str) or not doc[c]:
            wrong.append(f"{c} must be text")
    nested = doc.get("availability") or {}
    a, s, v = nested.get("available_intervals"), nested.get("scheduled_intervals"), nested.get("value")
    if not isinstance(a, int) or not isinstance(s, int) or not 0 <= a <= s:
        wrong.append("available_intervals must lie in 0..scheduled_intervals")
    elif (v is None) != (s == 0) or (s and abs(v - a / s) > 8 * 2**-52):
        wrong.append("availability must be the ratio of its counts")
    return wrong


def check_schema(lines: DataFrame, name: str, schema: dict) -> None:
    """Fails with an issue of a dataset's JSON lines (column ``value``), if there is one."""
    wrong = jsonschema.violations(lines, "value", schema).first()
    if wrong:
        raise PublishError(f"{name}: {wrong['rule']} fails at {wrong['path'] or '/'}")


def publish(
    out_dir: str, datasets: dict[str, object], *, snapshot_id: str, quality_status: str, period: tuple[str, str], generated_at: datetime | None = None, schemas: dict[str, dict] | None = None
) -> dict:
    """Writes a snapshot folder once and swaps the manifest to it; a failure leaves the old manifest.

    Each document of a dataset that has a schema must conform to it.
    """
    root, target = Path(out_dir), Path(out_dir) / "snapshots" / snapshot_id
    staging = root / f".staging-{snapshot_id}"
    shutil.rmtree(staging, ignore_errors=True)
    staging.mkdir(parents=True)
    try:
        for doc in datasets.get("overview", []) if isinstance(datasets.get("overview"), list) else [datasets.get("overview") or {}]:
            if wrong := check_overview(doc):
                raise PublishError("; ".join(wrong))
        entries, counts = {}, {}
        relations = {name: value for name, value in datasets.items() if isinstance(value, DataFrame)}
        schemas = schemas or {}
        for name, value in relations.items():
            write_parts(value, staging / name)
            if name in schemas:
                check_schema(_lines(value.sparkSession, staging / name), name, schemas[name])
        for name, value in sorted(datasets.items()):
            if name in relations:
                continue
            text = canonical_json(value)
            if name in schemas:
                docs = value if isinstance(value, list) else [value]
                check_schema(SparkSession.active().createDataFrame([(canonical_json(x),) for x in docs], "value string"), name, schemas[name])
            _replace(staging / f"{name}.json", text)
            entries[name] = {"path": f"snapshots/{snapshot_id}/{name}.json", "sha256": hashlib.sha256(text.encode()).hexdigest()}
            counts[name] = len(value) if isinstance(value, list) else 1
        if target.exists():
            for name, entry in entries.items():
                held = target / f"{name}.json"
                if not held.exists() or hashlib.sha256(held.read_bytes()).hexdigest() != entry["sha256"]:
                    raise PublishError(f"snapshot {snapshot_id} exists with other content")
            # part files are not byte-stable, so identity is that of the rows
            for name, value in relations.items():
                new = fingerprint(_lines(value.sparkSession, staging / name)).first()
                if not (target / name).is_dir() or fingerprint(_lines(value.sparkSession, target / name)).first() != new:
                    raise PublishError(f"snapshot {snapshot_id} exists with other content")
            shutil.rmtree(staging)
        else:
            target.parent.mkdir(parents=True, exist_ok=True)
            staging.rename(target)
        for name, value in relations.items():
            parts = describe_parts(value.sparkSession, target / name)
            entries[name] = {"path": f"snapshots/{snapshot_id}/{name}", "format": "json lines", "parts": parts}
            counts[name] = sum(x["rows"] for x in parts)
        manifest = {
            "schema_version": 1,
            "snapshot_id": snapshot_id,
            "generated_at": (generated_at or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ"),
            "quality_status": quality_status,
            "record_counts": counts,
            "source_period_start": period[0],
            "source_period_end": period[1],
            "datasets": entries,
        }
        _replace(root / "manifest.json", canonical_json(manifest))
        return manifest
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise


def load(out_dir: str) -> dict[str, dict]:
    """Datasets of the published snapshot with a status each: ready, empty, absent, unavailable or malformed.

    The manifest and the overview must be there; the others may fail alone.  Data of
    a dataset in parts are its parts, of which only the sizes are compared here;
    ``rows`` reads it.
    """
    root = Path(out_dir)
    manifest = json.loads((root / "manifest.json").read_text(encoding="utf-8"))
    out = {"manifest": {"status": "ready", "data": manifest}}
    for name in ("overview", "equipment", "incidents", "event-replay", "quality"):
        entry = manifest["datasets"].get(name)
        if entry is None:
            out[name] = {"status": "absent", "data": None}
            continue
        try:
            if "parts" in entry:
                sizes = [(root / entry["path"] / x["name"]).stat().st_size for x in entry["parts"]]
                if sizes != [x["bytes"] for x in entry["parts"]]:
                    raise ValueError("size")
                out[name] = {"status": "ready" if manifest["record_counts"][name] else "empty", "data": entry["parts"]}
                continue
            raw = (root / entry["path"]).read_bytes()
            if hashlib.sha256(raw).hexdigest() != entry["sha256"]:
                raise ValueError("digest")
            data = json.loads(raw)
            out[name] = {"status": "ready" if data else "empty", "data": data}
        except OSError:
            out[name] = {"status": "unavailable", "data": None}
        except ValueError:
            out[name] = {"status": "malformed", "data": None}
    if out["overview"]["status"] != "ready":
        raise PublishError(f"the overview is {out['overview']['status']}")
    return out
