"""Evidence bundles: a result, what it was made from, and their digests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators import kpi, verify
from ..sinks.publish import canonical_json, documents


class BundleError(RuntimeError):
    """A bundle does not hold what its manifest says."""


def inside(root: str, relative: str) -> Path:
    """A path under ``root``; one that leaves it, or a link out of it, is an error."""
    base = Path(root).resolve()
    path = (base / relative).resolve()
    if path == base or base not in path.parents:
        raise BundleError(f"{relative!r} leaves the bundle")
    return path


def _schema(df: DataFrame) -> list[list[str]]:
    return [[c, k] for c, k in df.dtypes]


def make(relations: dict[str, DataFrame], root: str, attribution: kpi.Attribution = "reference", pairing: kpi.Pairing = "minmax") -> dict:
    """Runs the KPIs over four relations and writes result and manifest."""
    out = verify.canonical(kpi.overview_kpis(relations["telemetry"], relations["movements"], relations["incidents"], relations["alarms"], attribution, pairing)).orderBy("terminal_id")
    Path(root).mkdir(parents=True, exist_ok=True)
    inside(root, "result.json").write_text(canonical_json(documents(out)), encoding="utf-8")
    inputs = {n: {"schema": _schema(df), **verify.fingerprint(df).first().asDict()} for n, df in sorted(relations.items())}
    manifest = {"schema_version": 1, "attribution": attribution, "pairing": pairing, "inputs": inputs, "result_schema": _schema(out), "result_hash": verify.result_hash(out)}
    inside(root, "manifest.json").write_text(canonical_json(manifest), encoding="utf-8")
    return manifest


def check(spark: SparkSession, relations: dict[str, DataFrame], root: str) -> dict:
    """Recomputes a bundle from its inputs and compares every digest."""
    manifest = json.loads(inside(root, "manifest.json").read_text(encoding="utf-8"))
    for n, df in relations.items():
        held = manifest["inputs"].get(n) or {}
        if held.get("schema") != _schema(df) or held.get("fingerprint") != verify.fingerprint(df).first()["fingerprint"]:
            raise BundleError(f"input {n} differs")
    rows = json.loads(inside(root, "result.json").read_text(encoding="utf-8"))
    again = verify.canonical(kpi.overview_kpis(relations["telemetry"], relations["movements"], relations["incidents"], relations["alarms"], manifest["attribution"], manifest["pairing"])).orderBy("terminal_id")
    if json.loads(canonical_json(documents(again))) != rows or verify.result_hash(again) != manifest["result_hash"]:
        raise BundleError("the result differs")
    return manifest


def compare(a: str, b: str) -> dict:
    """Whether two bundles hold the same result, as a report with a bounded reason."""
    x, y = (json.loads(inside(r, "manifest.json").read_text(encoding="utf-8")) for r in (a, b))
    reason = "schema_mismatch" if x["result_schema"] != y["result_schema"] else "match" if x["result_hash"] == y["result_hash"] else "result_hash_mismatch"
    return {"schema_version": 1, "reason": reason, "left": x["result_hash"], "right": y["result_hash"]}
