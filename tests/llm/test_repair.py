"""Conversation repair against a plain search over edit strings, with awkward rows."""

import re
import zlib
from functools import cache

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WANTED = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired) of sorted (role, text) rows."""
    seen, faults = set(), []
    for role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(at, state, idle):
        """The least (cost, edits) from here; at most two turns are put in at once."""
        found = [(0, "", ())] if at == len(rows) and state in ("", "a") else []
        put = lambda cost, edit, turn, rest: found.append((cost + rest[0], edit + rest[1], turn + rest[2])) if rest else None
        full = {"u": "user", "a": "assistant"}[WANTED[state]]
        if idle < 2:
            put(3, "I", ((full, ""),), best(at, WANTED[state], idle + 1))
        if at < len(rows):
            (role, text), fault = rows[at], faults[at]
            put(4, "D", (), best(at + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                put(3 + more, "R", ((full, text),), best(at + 1, WANTED[state], 0))
                if (state, role[:1]) in STEP:
                    put(more, "K", ((role, text),), best(at + 1, STEP[state, role[:1]], 0))
        return min(found) if found else None

    cost, audit, turns = best(0, "", 0)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, list(turns)


def key(row):
    return (row[1] is not None, row[1] or 0, row[2], row[3].encode())


def check(spark, rows):
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(((i, t, " " if a is None else a, " " if b is None else b) for i, t, a, b in rows if i == c), key=key)
        want = plain([(a, b) for _, _, a, b in own])
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [(t.role, t.text) for t in r.repaired]) == want
        turns = [t for _, t, _, _ in own if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


ROW = st.tuples(st.sampled_from([1, 2, 3, None]), st.sampled_from([0, 1, 2, 3, 5, 9, None]), st.sampled_from(["user", "assistant", "system", "tool", "", None]), st.sampled_from(["a.", "b", "", " \n", "c!", "é. ", None]))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=24))
def test_repair_is_the_cheapest_and_least(spark, rows):
    check(spark, rows)


def test_lengths_and_batches(spark, monkeypatch):
    """Conversations from one to 300 turns, and turns of one conversation over several Arrow batches."""
    roles, texts = ["user", "assistant", "system"], ["a.", "b", "", "c!", "d?"]
    rows = [(c, t, roles[(c * 7 + t * t) % 3], f"{t % 5}{texts[(c + t) % 5]}") for c in range(12) for t in range((c * c * 2 + 1) if c < 11 else 150)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_buckets_end_at_conversations():
    import pyarrow as pa

    n = repair.BUCKET_ROWS // 4
    ids = [None] * n + [i // 8 for i in range(6 * n)]
    at = range(len(ids))
    whole = pa.table({"conv_id": pa.array(ids, pa.int64()), "turn": pa.array(at, pa.int64()), "role": ["user", "assistant"] * (len(ids) // 2), "text": [f"{i}." for i in at], "live": [True] * len(ids)})
    whole = whole.append_column("kind", pa.array([2, 3] * (len(ids) // 2), pa.int32()))
    for name in ("blank", "broken"):
        whole = whole.append_column(name, pa.array([False] * len(ids)))
    parts = whole.to_batches(max_chunksize=1000)
    out = pa.Table.from_batches(list(repair._stream(iter(parts))))
    assert out.num_rows == len(set(ids)) and out.column("conv_id").null_count == 1
    assert set(out.column("cost").to_pylist()) == {0}


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", "a. b! c?") for c in [*range(40), None] for t in [*range(5), None]]
    got = sorted((r.conv_id is None, r.conv_id or 0, r.turn is not None, r.turn or 0, r.role, r.text, r.live) for r in repair.damage(spark.createDataFrame(rows, SCHEMA)).collect())
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        one = (c is None, c or 0, t is not None, t or 0, "user" if fate == 4 else role, {1: "", 2: "a b c"}.get(fate, text), fate != 0)
        want += [one] * (2 if fate == 3 else 1)
    assert got == sorted(want)


def test_nothing_live_and_nothing_at_all(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a."), (None, None, None, None)], SCHEMA)
    got = repair.repair(rows, F.lit(False)).collect()
    assert {(r.conv_id, r.gaps, r.blank, r.illegal, r.cost, r.audit, len(r.repaired)) for r in got} == {(1, 0, 0, 0, 0, "", 0), (None, 0, 0, 0, 0, "", 0)}
    assert repair.repair(rows.limit(0)).count() == 0
    wide = rows.withColumns({c: F.lit("x") for c in ("kind", "blank", "broken", "live", "audit")})
    assert repair.repair(wide).count() == 2


def test_far_apart_turns_have_no_gap_count(spark):
    rows = spark.createDataFrame([(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")], SCHEMA)
    assert repair.repair(rows).first().gaps is None
