"""Approximate nearest neighbours by collision counting over single projections.

Every vector is projected on ``projections`` random lines.  An index block keeps,
for each line, its vectors in sorted order.  A query opens a window centred on
its own projection on every line and widens all windows together by a factor
(virtual rehashing: no bucket is built twice).  A vector that lies in at least
``threshold`` of the windows is verified by its exact distance.

1. Each query searches the block it lies in: windows widen until the ``k``-th
   verified distance lies within the radius that they stand for, so there is no cap
   on candidates.
2. That distance bounds the answer.  Every other block opens the windows of this
   radius at once, verifies what exceeds the threshold, and returns what is nearer
   than the bound.

All rows are indexed; the best ``k`` of all blocks remain.  Work is one comparison
per query, line and vector: without structure in the vectors it grows with queries
times vectors, in array operations, never as rows.

Rows: vectors that are null, empty, zero or hold a null or non-finite component, and
rows without an id, take no part; vectors of different lengths are not compared; equal
distances go to the smaller id; rows that repeat id and vector are one query, and
candidates one by one; columns that the operator doesn't name are not read; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Vectors of one index block, so that a place in it has 16 bits, and queries that meet a block in one task.
BLOCK = 8192
QUERY_BLOCK = 16384
#: Half the width of a window at radius 1, and the growth of the radius in a round.
HALF_WIDTH = 2.0
GROWTH = 1.2

_FOUND = "query_id long, query long, vec_id long, score double"


class Block:
    """The sorted arrays of one index block, and every vector's place in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: np.ndarray):
        self.ids, self.vectors, self.lines = ids, vectors, lines
        at = np.ascontiguousarray((vectors @ lines.T).T)
        order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, order, 1)
        self.place = np.empty(at.shape, np.uint16)
        np.put_along_axis(self.place, order, np.arange(at.shape[1], dtype=np.uint16)[None, :], 1)

    def colliding(self, centre: np.ndarray, radius: float, threshold: int) -> tuple[np.ndarray, bool]:
        """The vectors in at least ``threshold`` of the windows of this radius; whether all windows hold all."""
        half = HALF_WIDTH * radius
        low = np.array([s.searchsorted(c - half, "left") for s, c in zip(self.sorted, centre, strict=True)])
        size = np.array([s.searchsorted(c + half, "right") for s, c in zip(self.sorted, centre, strict=True)]) - low
        inside = (self.place - low.astype(np.uint16)[:, None]) < size.astype(np.uint16)[:, None]
        return np.flatnonzero(inside.sum(0, dtype=np.uint16) >= threshold), bool((size == len(self.ids)).all())

    def distances(self, which: np.ndarray, query: np.ndarray) -> np.ndarray:
        apart = self.vectors[which] - query
        return np.sqrt((apart * apart).sum(1))

    def search(self, query: np.ndarray, own: int | None, k: int, threshold: int, bound: float, start: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found within ``bound``, nearest first, without the vector at ``own``."""
        centre, radius, known = self.lines @ query, min(start, bound), np.zeros(len(self.ids), bool)
        if own is not None:
            known[own] = True
        if np.isfinite(bound):
            radius = bound
        found, dist = np.zeros(0, np.int64), np.zeros(0)
        while True:
            new, whole = self.colliding(centre, radius, threshold)
            new = new[~known[new]]
            known[new] = True
            found, dist = np.r_[found, new], np.r_[dist, self.distances(new, query)]
            near = np.flatnonzero(dist <= bound)
            best = near[np.lexsort((self.ids[found[near]], dist[near]))[:k]]
            found, dist = found[best], dist[best]
            if radius >= bound or whole or len(found) == k and dist[-1] <= radius:
                return self.ids[found], dist
            radius *= GROWTH


def _vectors(table: pa.Table) -> np.ndarray:
    column = table["v"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _block(table: pa.Table, projections: int, seed: int) -> tuple[Block, float]:
    """An index block, and a radius well below a typical nearest distance in it."""
    x = _vectors(table)
    lines = np.random.default_rng(seed).standard_normal((projections, x.shape[1]))
    return Block(table["id"].to_numpy(), x, lines), max(float(np.abs(x - x.mean(0)).mean()) * 0.3 * np.sqrt(x.shape[1]), 1e-9)


def _answers(found: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    rows = list(found)
    count = [len(r[2]) for r in rows]
    joined = lambda i, kind: np.concatenate([r[i] for r in rows]).astype(kind) if rows else np.zeros(0, kind)
    of = lambda i: np.repeat(np.array([r[i] for r in rows], np.int64), count)
    return pa.table({"query_id": of(0), "query": of(1), "vec_id": joined(2, np.int64), "score": joined(3, np.float64)})


def _search_home(k: int, projections: int, threshold: int, seed: int):
    def run(rows: pa.Table) -> pa.Table:
        block, start = _block(rows, projections, seed)
        names = rows["name"].to_numpy()
        asking = np.flatnonzero(rows["q"].to_numpy(zero_copy_only=False))
        asking = asking[np.unique(np.stack([block.ids[asking], names[asking]]), axis=1, return_index=True)[1]] if len(asking) else asking
        return _answers((block.ids[i], names[i], *block.search(block.vectors[i], i, k, threshold, np.inf, start)) for i in asking.tolist())

    return run


def _search_other(k: int, projections: int, threshold: int, seed: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _answers(iter(()))
        block, start = _block(rows, projections, seed)
        asked = zip(queries["id"].to_numpy(), queries["name"].to_numpy(), _vectors(queries), queries["bound"].to_numpy(), strict=True)
        return _answers((i, name, *block.search(v, None, k, threshold, bound, start)) for i, name, v, bound in asked)

    return run


def nearest(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 10, projections: int = 128, threshold: int = 118, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row among all other rows."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("v is not null and id is not null").where(fine)
    rows = rows.select("*", F.xxhash64("v").alias("name"), F.size("v").alias("size"))
    # blocks and query lots of each vector length
    sizes = rows.groupBy("size").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.count_if("q") / QUERY_BLOCK).alias("lots"))
    rows = rows.join(materialise(sizes), "size").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    ask = (k, projections, threshold, seed)
    home = materialise(rows.groupBy("size", "block").applyInArrow(_search_home(*ask), _FOUND))
    bounds = home.groupBy(F.col("query_id").alias("id"), F.col("query").alias("name")).agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("bound"))
    # every other block meets the queries in tasks of their own
    asking = rows.where("q and blocks > 1").dropDuplicates(["id", "name"]).join(bounds, ["id", "name"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    asking = asking.withColumn("lot", F.pmod(F.xxhash64("id", F.lit(1)), F.col("lots")))
    asking = asking.select("size", "lot", "id", "name", "v", "bound", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).alias("step"), "block", "blocks")
    asking = asking.withColumn("block", F.pmod(F.col("block") + F.col("step"), F.col("blocks"))).drop("step", "blocks")
    asking = asking.toDF(*asking.columns)  # columns of its own, apart from those of the blocks
    held = rows.where("blocks > 1 and lots > 0").select("size", "block", "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"))
    other = held.groupBy("size", "block", "lot").cogroup(asking.groupBy("size", "block", "lot")).applyInArrow(_search_other(*ask), _FOUND)
    w = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return home.unionByName(other).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
