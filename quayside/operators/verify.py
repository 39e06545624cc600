"""Canonical rows, digests and comparison of results."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_micros
from ..session import written

REASONS = ("match", "schema_mismatch", "row_count_mismatch", "result_hash_mismatch")


def canonical(df: DataFrame, digits: int = 6) -> DataFrame:
    """Columns by name, floats and decimals rounded, times as text in UTC."""
    out = []
    for c, kind in sorted(df.dtypes):
        x = F.col(f"`{c}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            x = F.round(x.cast("double"), digits)
        elif kind.startswith("timestamp"):
            x = iso_micros(x.cast("timestamp"))
        elif kind == "date":
            x = x.cast("string")
        out.append(x.alias(c))
    return df.select(*out)


def row_digests(df: DataFrame) -> DataFrame:
    """(digest, n): SHA-256 of each canonical row's JSON and how often it occurs."""
    rows = canonical(df)
    return rows.select(F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, fingerprint), whatever the order of rows, by distributed sums of two row hashes.

    A cheap change detector for relations of any size.
    """
    rows = canonical(df)
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    h = rows.select(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    return h.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), total("a"), total("b")), 256).alias("fingerprint"))


#: Leaves of a digest tree, and children of one of its nodes, as bits.
LEAF_BITS, NODE_BITS = 16, 4


def digest_tree(df: DataFrame, *key: str, bits: int = LEAF_BITS) -> DataFrame:
    """(node, rows, a, b) of the leaves: rows by a hash of their key, each node with sums of two hashes of its rows.

    Sums don't depend on order and add up, so the nodes above come from ``above``.
    """
    rows = canonical(df)
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    leaf = F.shiftrightunsigned(F.xxhash64(*key), 64 - bits)
    hashed = rows.select(leaf.alias("node"), F.xxhash64(text).cast("decimal(38,0)").alias("a"), F.xxhash64(text, F.lit(1)).cast("decimal(38,0)").alias("b"))
    return hashed.groupBy("node").agg(F.count("*").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def above(nodes: DataFrame, bits: int = NODE_BITS) -> DataFrame:
    """The next level of a digest tree."""
    return nodes.groupBy(F.shiftrightunsigned("node", bits).alias("node")).agg(*[F.sum(c).alias(c) for c in ("rows", "a", "b")])


def differing_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes of one level that the trees have in different forms."""
    named = right.withColumnsRenamed({c: f"_{c}" for c in ("rows", "a", "b")})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("rows", "a", "b")])
    return left.join(named, "node", "full").where(~same).select("node")


def differences(left: DataFrame, right: DataFrame, *key: str, bits: int = LEAF_BITS) -> DataFrame:
    """(key..., problem) of rows that are not the same: ``missing_left``, ``missing_right`` or ``changed`` (rows of a key differ, also in number).

    Only rows of leaves that differ are compared.  A key's rows are summed before they meet.
    """
    leaves = written(differing_nodes(digest_tree(left, *key, bits=bits), digest_tree(right, *key, bits=bits)))
    leaf = F.shiftrightunsigned(F.xxhash64(*key), 64 - bits)

    def keyed(df: DataFrame, side: str) -> DataFrame:
        rows = canonical(df)
        text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        rows = rows.select(*key, leaf.alias("node"), *[F.xxhash64(text, F.lit(i)).cast("decimal(38,0)").alias(f"h{i}") for i in range(2)]).join(leaves, "node", "left_semi")
        return rows.groupBy(*key).agg(F.struct(F.count("*").alias("n"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).alias(side))

    a, b = keyed(left, "_left"), keyed(right, "_right").withColumnsRenamed({k: f"_r_{k}" for k in key})
    met = a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key]), "full")
    problem = F.when(F.col("_left").isNull(), "missing_left").when(F.col("_right").isNull(), "missing_right").when(F.col("_left") != F.col("_right"), "changed")
    return met.select(*[F.when(F.col("_left").isNull(), F.col(f"_r_{k}")).otherwise(F.col(k)).alias(k) for k in key], problem.alias("problem")).where("problem is not null")


def result_hash(df: DataFrame, most: int = 10_000) -> str:
    """SHA-256 of the sorted canonical rows of a small result, such as a KPI relation."""
    rows = canonical(df).toJSON().take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a result of over {most} rows has no result hash; use fingerprint")
    lines = sorted(json.dumps(json.loads(r), sort_keys=True, separators=(",", ":")) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(left: DataFrame, right: DataFrame) -> str:
    """A reason of ``REASONS`` for two relations."""
    if sorted(left.columns) != sorted(right.columns):
        return "schema_mismatch"
    a, b = fingerprint(left).first(), fingerprint(right).first()
    if a["rows"] != b["rows"]:
        return "row_count_mismatch"
    return "match" if a["fingerprint"] == b["fingerprint"] else "result_hash_mismatch"
