"""Exact n-gram Jaccard join with set-relation skipping.

A document is the set of its distinct ``k``-word shingles (64-bit hashes of
words lower-cased in A-Z).  Equal sets are one record.  Two records link when
``100 * intersection >= percent * union``.

1. Every record posts the shingles of a fixed hash range to an inverted index
   (small records post all of them in a second space, so nothing is missed by a
   thin range).  The index is cut into blocks by shingle; a shingle held by one
   record alone leaves it there, which is nearly all of them.
2. Shingles are ordered by rarity.  Of a record's first ``missing + 1`` posted
   shingles a partner must hold one, so only shared shingles of that prefix stay
   in the lists; a record without one has no partner and is skipped altogether.
3. Lists are blocked by set size, and a position bounds what can still be
   shared: blocks and entries whose bound is too low are skipped.
4. Answers are derived from similar sets.  Each block first asks only its hub
   (the record with the largest shared part).  Records that reach one component
   need no pair among them, and with both distances to one hub known the
   symmetric difference of two records is at least their difference, which
   decides most other pairs unread.  Every pair left is verified on its texts.
5. A list that still has more than ``SHORT_LIST`` records of different components
   leaves this path: its records are compared block against block, sizes apart by more
   than a band skipped, as matrix products over the shingles that two of them share.
   This is exact, and quadratic in the records of such a list.

Rows: a null or empty text has no shingle and no link; fewer than ``k`` words
are one shingle; rows that repeat a doc_id are told apart by their text and a
component's id is the least doc_id in it; a very long text is one row of a task, about
60 times its bytes in memory; columns that the operator doesn't name are not read; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as K
from .common import components, free_name, materialise, task_count

#: Share of the hash range that the first space posts.  It must exceed the share
#: of a set that a partner may miss (a quarter at 75 percent).
RANGE = 0.4
#: Sets up to this size also post all shingles in the second space.
SMALL = 96
_SALT = np.uint64(0xA0761D6478BD642F)
_POST = np.dtype([("part", "<u4"), ("record", "<i8")])
_SHARED = np.dtype([("record", "<i8"), ("df", "<i4"), ("token", "<i8")])
#: A list of at most this many open records is compared pair by pair, a longer one in blocks.
SHORT_LIST = 48
#: Records of a block, and about how many shingles.
BLOCK = 384
BLOCK_SHINGLES = 1 << 20


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, off = K.text_bytes(column)
    w = K.words(K.LOWER[data], off)
    _, h = K.run_hashes(w, k)
    total = np.diff(w.first)
    edge = np.r_[0, np.cumsum(np.maximum(total - k + 1, 0))]
    out = []
    for i, n in enumerate(total):
        if n >= k:
            x = np.sort(h[edge[i] : edge[i + 1]])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        else:
            out.append(K.runs(w.hash[w.first[i] : w.first[i + 1]], int(n)) ^ _SALT if n else h[:0])
    return out


def _name(x: np.ndarray) -> int:
    """A 63-bit name of a set, whatever the order of its members; its last bit is free for the space."""
    return int(K.mix(x + np.uint64(len(x))).sum(dtype=np.uint64) >> np.uint64(2)) << 1


def _missing(s: int, percent: int) -> int:
    """How many members a set of size s may have that a partner has not."""
    return s - -(-percent * s // 100)


def _tokens(h: np.ndarray, buckets: int) -> np.ndarray:
    """The distinct tokens of shingle hashes: a bucket and 32 bits.

    Shingles of a set that share a token are one posted token, and are counted as one
    wherever tokens are counted: a set misses at most as many of a partner's tokens as
    of its shingles, so the bounds hold.
    """
    return np.unique((((h >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)).astype(np.int64))


def _spaces(x: np.ndarray, percent: int, buckets: int) -> list[np.ndarray]:
    """The tokens that a set posts: of the range and, if these may all be missing in a partner, all."""
    near = _tokens(K.mix(x[x < np.uint64(int(RANGE * 2**64))]), buckets)
    return [near] if len(x) > SMALL and len(near) > _missing(len(x), percent) else [near, _tokens(K.mix(x ^ _SALT), buckets)]


def _describe(k: int, percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            sets = shingle_sets(part.column("text"), k)
            spaces = [_spaces(x, percent, buckets) if len(x) else [] for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column("doc_id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_name(x) if len(x) else None for x in sets], pa.int64()),
                    pa.array([[len(y) for y in z] for z in spaces], pa.list_(pa.int32())),
                ],
                names=["row", "doc_id", "n_shingles", "record", "posted"],
            )

    return run


def _post(k: int, percent: int, buckets: int, remember: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of one task post once, as far as this bounded memory goes
        for part in K.slices(batches):
            tokens, records = [], []
            for x in shingle_sets(part.column("text"), k):
                if not len(x) or (name := _name(x)) in seen:
                    continue
                if len(seen) >= remember:
                    seen.clear()
                seen.add(name)
                for space, y in enumerate(_spaces(x, percent, buckets)):
                    tokens.append(y)
                    records.append(np.full(len(y), name | space, np.int64))
            if not tokens:
                continue
            token, record = np.concatenate(tokens), np.concatenate(records)
            bucket = (token >> 32).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, post = bucket[order], np.zeros(len(order), _POST)
            post["part"], post["record"] = token[order].astype(np.uint32), record[order]
            lot = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[lot[1:], len(post)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[lot]), K.pack([post[a:b] for a, b in zip(lot, ends, strict=True)])], names=["bucket", "payload"])

    return run


def _shared(lots: int):
    """Of each record, the tokens that another record posts too, with their number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], []
        for batch in batches:
            for b, x in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
                held.append(np.frombuffer(x.as_buffer(), _POST))
                of.append(np.full(len(held[-1]), b, np.int64))
        if not held:
            return
        post, bucket = np.concatenate(held), np.concatenate(of)
        held, of = [], []
        token = (bucket << 32) | post["part"].astype(np.int64)
        once = np.sort(token)
        twice = np.unique(once[1:][once[1:] == once[:-1]])
        if not len(twice):
            return
        live = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, token), len(twice) - 1)] == token)
        token, record = token[live], post["record"][live]
        order = np.lexsort((record, token))
        token, record = token[order], record[order]
        keep = np.r_[True, (token[1:] != token[:-1]) | (record[1:] != record[:-1])]
        token, record = token[keep], record[keep]
        df = np.diff(np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)])
        df = np.repeat(df, df)
        keep = df > 1
        lot = _lot(record[keep], lots)
        order = np.argsort(lot, kind="stable")
        out = np.zeros(len(order), _SHARED)
        out["token"], out["df"], out["record"], lot = token[keep][order], df[keep][order], record[keep][order], lot[order]
        if len(out):
            cut = np.flatnonzero(np.r_[True, lot[1:] != lot[:-1]])
            ends = np.r_[cut[1:], len(out)]
            yield pa.RecordBatch.from_arrays([pa.array(lot[cut]), K.pack([out[a:b] for a, b in zip(cut, ends, strict=True)])], names=["lot", "payload"])

    return run


def _lot(record: np.ndarray, lots: int) -> np.ndarray:
    return (K.mix(record.astype(np.uint64)) % np.uint64(lots)).astype(np.int32)


def _spaces_by_lot(lots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_lot(batch.column("record").to_numpy(), lots)), *(batch.column(c) for c in ("record", "size", "n"))], names=["lot", "record", "size", "n"])

    return run


def _prefixes(percent: int):
    """The shared tokens in the prefix of each record of a lot, rarest first, with their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known = [], []
        for batch in batches:
            parts += [np.frombuffer(x.as_buffer(), _SHARED) for x in batch.column("payload").drop_null()]
            rows = batch.filter(batch.column("record").is_valid())
            known.append(np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("record", "size", "n")]))
        if not parts:
            return
        x, (record, size, n) = np.concatenate(parts), np.concatenate(known, 1)
        x = x[np.lexsort((x["token"], x["df"], x["record"]))]
        order = np.argsort(record)
        record, size, n = record[order], size[order], n[order]
        first = np.flatnonzero(np.r_[True, x["record"][1:] != x["record"][:-1]])
        many = np.diff(np.r_[first, len(x)])
        at = np.searchsorted(record, x["record"][first])
        size, n = size[at], n[at]
        alone = n - many
        take = np.clip(np.minimum(n, size + (-percent * size // 100) + 1) - alone, 0, many)
        of = np.repeat(np.arange(len(first)), take)
        step = np.arange(len(of)) - np.repeat(np.cumsum(take) - take, take)
        x = x[first[of] + step]
        columns = (x["token"], x["record"], size[of], n[of], alone[of] + step, alone[of] / n[of])
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.float32)
        for i in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000].astype(t)) for c, t in zip(columns, kinds, strict=True)], names=["token", "record", "size", "n", "place", "alone"])

    return run


def _compare_blocks(k: int, percent: int):
    """Links between the components of two blocks of a long list, thinned to a forest."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["side", "node"])
        sets = [x for i in range(0, len(part), 64) for x in shingle_sets(pa.array(part["text"].iloc[i : i + 64], pa.string()), k)]
        sizes = np.array([len(x) for x in sets])
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
        use = count[token] > 1
        slot = np.cumsum(count > 1) - 1
        token, of = slot[token[use]], of[use]
        left = np.flatnonzero(part["side"].to_numpy() == 0)
        right = np.flatnonzero(part["side"].to_numpy() == 1) if (part["side"] == 1).any() else left
        both = np.zeros((len(left), len(right)), np.int64)
        for a in range(0, int(token.max(initial=-1)) + 1, 4096):
            own = (token >= a) & (token < a + 4096)
            dense = np.zeros((len(sets), 4096), np.float32)
            dense[of[own], token[own] - a] = 1
            both += (dense[left] @ dense[right].T).astype(np.int64)  # at most 4096 each, exact
        c, node = part["c"].to_numpy(), part["node"].to_numpy()
        total = sizes[left][:, None] + sizes[right][None, :] - both
        i, j = np.nonzero((100 * both >= percent * total) & (c[left][:, None] != c[right][None, :]))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x, y in zip(left[i], right[j], strict=True):
            a, b = find(c[x]), find(c[y])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for part in K.slices(batches, "text_b"):
            members = shingle_sets(part.column("text_b"), k)
            a, found = part.column("a").to_pylist(), []
            for i, x in enumerate(members):
                if hub != a[i]:
                    hub, held = a[i], shingle_sets(part.column("text_a").slice(i, 1), k)[0]
                at = np.minimum(np.searchsorted(held, x), len(held) - 1)
                found.append((int((held[at] == x).sum()), len(held), len(x)))
            both, s, t = (pa.array(c, pa.int32()) for c in zip(*found, strict=True))
            yes = pa.array([100 * i >= percent * (m + n - i) for i, m, n in found])
            apart = pa.array([m + n - 2 * i for i, m, n in found], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), apart, yes], names=["a", "b", "apart", "linked"])

    return run


def _long_lists(lists: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among the open records of long lists, (a, b).

    Records that long lists connect are dealt to blocks of bounded number and total
    size, by cluster and band of set sizes.  Two blocks of the same or of neighbouring
    bands meet in one task, unless both lie in one component, and give their shared
    counts as one matrix product: no pair becomes a row.
    """
    heads = lists.groupBy("token").agg(F.min("node").alias("head"))
    clusters = components(lists.join(heads, "token").select("head", "node").distinct(), "head", "node").withColumnRenamed("component", "cluster")
    nodes = lists.select("node", "c", "band", "size").distinct().join(clusters, "node")
    shares = nodes.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    placed = nodes.join(materialise(shares), ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    placed = materialise(placed.select("cluster", F.col("band"), "block", "node", "c"))
    blocks = placed.groupBy("cluster", "band", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    x = blocks.select("*", F.explode(F.array("band", F.col("band") + 1)).alias("near")).alias("x")
    meet = x.join(blocks.alias("y"), (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.near") == F.col("y.band")))
    meet = meet.where("(x.band < y.band or x.block <= y.block) and not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)")
    ends = [F.struct(F.col(f"{s}.band").alias("band"), F.col(f"{s}.block").alias("block")) for s in ("x", "y")]
    meet = meet.select(F.col("x.cluster").alias("cluster"), ends[0].alias("i"), ends[1].alias("j"))
    sides = F.array(F.struct("i.*", F.lit(0).alias("side")), F.struct("j.*", F.lit(1).alias("side")))
    sides = F.when(F.col("i") == F.col("j"), F.slice(sides, 1, 1)).otherwise(sides)
    dealt = meet.select("cluster", "i", "j", F.explode(sides).alias("s")).select("cluster", F.xxhash64("i", "j").alias("pair"), "s.band", "s.block", "s.side")
    rows = dealt.join(placed, ["cluster", "band", "block"]).join(texts.withColumnRenamed("record", "node"), "node")
    return materialise(rows.groupBy("cluster", "pair").applyInPandas(_compare_blocks(k, percent), "a long, b long"))


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, with_rows: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; see the module for the method.

    ``with_rows`` adds ``row``, the ``xxhash64`` of (doc_id, text), and ``group``,
    a name of the component that does not depend on ids (null: linked with nothing).
    """
    if not 100 * (1 - RANGE) < percent <= 100:
        raise ValueError(f"percent must be over {100 * (1 - RANGE):.0f} and at most 100")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("long"), text).alias("row"))
    buckets = task_count(rows, "text")
    sets = materialise(rows.mapInArrow(_describe(k, percent, buckets), "row long, doc_id long, n_shingles long, record long, posted array<int>"))

    records = sets.where("record is not null").groupBy("record").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.first("n_shingles").cast("int").alias("size"), F.first("posted").alias("posted"))
    records = materialise(records)
    spaces = records.select("size", F.posexplode("posted").alias("space", "n"), "record").select((F.col("record") + F.col("space")).alias("record"), "size", "n")

    posts = rows.select("text").mapInArrow(_post(k, percent, buckets), "bucket int, payload binary")
    shared = posts.repartitionById(buckets, "bucket").mapInArrow(_shared(buckets), "lot int, payload binary")
    known = spaces.mapInArrow(_spaces_by_lot(buckets), "lot int, record long, size int, n int")
    lots = shared.unionByName(known, allowMissingColumns=True).repartitionById(buckets, "lot")
    lists = lots.mapInArrow(_prefixes(percent), "token long, record long, size int, n int, place int, alone float")
    # the two spaces of a set are one node; sizes a factor of 100 / percent apart never share a block or its neighbour
    band = F.floor(F.log("size") / F.log(F.lit(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("size")
    lists = materialise(lists.select("token", (F.col("record") - F.pmod("record", F.lit(2))).alias("node"), "size", "n", "place", "alone", band.alias("band")))

    nodes = lists.select(F.col("node").alias("record")).distinct().join(records.select("record", "row"), "record")
    texts = materialise(rows.select("row", "text").join(nodes, "row").select("record", "text"))

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("record").alias("b"), F.col("text").alias("text_b"))
        right = texts.select(F.col("record").alias("a"), F.col("text").alias("text_a"))
        return materialise(pairs.join(left, "b").join(right, "a").mapInArrow(_verify(k, percent), "a long, b long, apart int, linked boolean"))

    def may_link(x: str, y: str):
        """Sizes and positions allow enough common shingles."""
        c = {f"{s}_{n}": F.col(f"{s}.{n}") for s in (x, y) for n in ("size", "n", "place")}
        need = F.ceil(percent * (c[f"{x}_size"] + c[f"{y}_size"]) / (100.0 + percent) - 1e-9)
        outside = F.least(c[f"{x}_size"] - c[f"{x}_n"], c[f"{y}_size"] - c[f"{y}_n"])
        within = F.least(c[f"{x}_n"] - c[f"{x}_place"], c[f"{y}_n"] - c[f"{y}_place"])
        return (100 * F.least(c[f"{x}_size"], c[f"{y}_size"]) >= percent * F.greatest(c[f"{x}_size"], c[f"{y}_size"])) & (within + outside >= need)

    # first the hub of each block, for its own block and the next larger one
    hubs = lists.groupBy("token", "band").agg(F.min(F.struct("alone", "node", "size", "n", "place")).alias("hub"), F.count("*").alias("many"))
    hubs = hubs.select("token", "band", "hub.*")
    near = lists.select("*", F.explode(F.array("band", F.col("band") - 1)).alias("at")).drop("band").withColumnRenamed("at", "band")
    stars = near.alias("y").join(hubs.alias("x"), ["token", "band"]).where("x.node != y.node").where(may_link("x", "y"))
    stars = stars.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    tested = verified(stars)
    labels = components(tested.where("linked"))

    # then the pairs that no common component has answered
    known = materialise(lists.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"))
    open_lists = known.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("many")).where("lo != hi").select("token", "many")
    still = materialise(known.join(open_lists, "token"))
    rest = still.where(F.col("many") <= SHORT_LIST).drop("many")
    wide = rest.select("*", F.explode(F.array("band", F.col("band") + 1)).alias("at")).drop("band").withColumnRenamed("at", "band")
    pairs = wide.alias("x").join(rest.alias("y"), ["token", "band"]).where("x.c != y.c and (x.size < y.size or x.size = y.size and x.node < y.node)").where(may_link("x", "y"))
    pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.first("x.size").alias("s"), F.first("y.size").alias("t"))
    both = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = pairs.join(both, ["a", "b"], "left_anti")
    # |x ^ y| >= ||x ^ hub| - |y ^ hub||, and a link needs |x ^ y| <= (100 - percent) / (100 + percent) * (|x| + |y|)
    to_hub = tested.groupBy(F.col("b").alias("m")).agg(F.min(F.struct("a", "apart")).alias("h")).select("m", F.col("h.a").alias("hub"), F.col("h.apart").alias("away"))
    pairs = pairs.join(to_hub.select(F.col("m").alias("a"), F.col("hub").alias("ha"), F.col("away").alias("da")), "a", "left")
    pairs = pairs.join(to_hub.select(F.col("m").alias("b"), F.col("hub").alias("hb"), F.col("away").alias("db")), "b", "left")
    derived = (F.col("ha") == F.col("hb")) & (F.abs(F.col("da") - F.col("db")) * (100 + percent) > (100 - percent) * (F.col("s") + F.col("t")))
    pairs = pairs.where(~F.coalesce(derived, F.lit(False))).select("a", "b")
    links = tested.where("linked").unionByName(verified(pairs).where("linked")).select("a", "b")
    links = links.unionByName(_long_lists(still.where(F.col("many") > SHORT_LIST), texts, k, percent))
    labels = components(links)

    least = records.select("record", "least").join(labels.withColumnRenamed("node", "record"), "record", "left").withColumn("component", F.coalesce("component", "record"))
    roots = least.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = least.join(roots, "component").select("record", "component_id", F.col("component").alias("group"))
    out = sets.join(ids, "record", "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", *(["row", "group"] if with_rows else []))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """The row of least doc_id of each component, all columns; repeated rows are one, a row without an id comes last."""
    groups = similar_components(docs, doc_id, text, k, percent, with_rows=True)
    name = free_name(docs, "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    firsts = groups.groupBy(F.coalesce("group", "row").alias("key")).agg(first).select(F.col("first.row").alias(name))
    return docs.withColumn(name, F.xxhash64(F.col(doc_id).cast("long"), text)).join(firsts, name, "left_semi").dropDuplicates([name]).drop(name)
