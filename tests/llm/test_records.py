"""Pieces, neighbours, archives and chats against brute force, with awkward rows."""

import gzip
import hashlib
import io
import itertools
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.llm import chat, neighbours, pieces, warc

# op3


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def all_paths(text, vocabulary):
    """Every segmentation of a short text, best first, by plain recursion."""
    raw = (" " + text).encode() if text else b""
    known = {}
    for n, (_, ids, scores) in vocabulary.index.items():
        for i, s in zip(ids.tolist(), scores.tolist(), strict=True):
            known[vocabulary.bytes[i]] = (i, s, n)
    out = []

    def walk(at, score, ids):
        if at == len(raw):
            out.append((score, tuple(ids)))
            return
        if raw[at] & 0xC0 == 0x80:
            return
        width = next(w for w in (1, 2, 3, 4) if at + w == len(raw) or raw[at + w] & 0xC0 != 0x80)
        for end in range(at + 1, min(at + 64, len(raw)) + 1):
            if raw[at:end] in known:
                i, s, _ = known[raw[at:end]]
                walk(end, score + s, [*ids, i])
        if raw[at : at + width] not in known:
            walk(at + width, score + width * vocabulary.byte_score, [*ids, *(int(vocabulary.byte_ids[b]) for b in raw[at : at + width])])

    walk(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the cat", "  a b", "naïve", "x\ny", "漢字ab", "▁ the", "aaaa aaaa", "\U00013000 q", "in the end"])
def test_n_best_matches_all_segmentations(vocabulary, text):
    n = 5
    (got,) = pieces.encode_batch(pa.array([text]), vocabulary, n)
    want = all_paths(text, vocabulary)
    assert np.allclose([s for s, _ in got], [s for s, _ in want[:n]])
    assert len({tuple(x.tolist()) for _, x in got}) == len(got)
    every = dict((ids, s) for s, ids in want)
    for s, ids in got:
        assert every[tuple(ids.tolist())] == pytest.approx(s) and vocabulary.decode(ids.tolist()) == text


def test_pieces_rows(spark, vocabulary):
    rng = random.Random(2)
    texts = [None, "", " ", "\n", "z" * 5000, "a b  c   d", "é🙂\x0b", *(" ".join(rng.choice(["alpha", "Beta", "γ", "12", "end."]) for _ in range(rng.randrange(60))) for _ in range(30))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, paths string")
    out = pieces.encode_report(df, n=3).collect()
    assert len(out) == len(rows) and all(r.decoded for r in out)
    by = {r.doc_id: r for r in out}
    assert by[0].n_pieces == by[1].n_pieces == 0 and by[0].scores == [0.0]
    alone = {i: pieces.encode_batch(pa.array([t], pa.string()), vocabulary, 3)[0] for i, t in enumerate(texts)}
    for i, r in by.items():
        assert np.allclose(r.scores, [s for s, _ in alone[i]]) and r.n_pieces == len(alone[i][0][1])
        assert r.scores == sorted(r.scores, reverse=True) and len(set(r.paths_crc32)) == len(r.scores)
    full = pieces.encode(df, n=1).collect()
    assert all(vocabulary.decode(r.paths[0].ids) == (texts[r.doc_id] or "") for r in full)
    assert pieces.encode_report(df.where("false")).count() == 0


# op5


def test_neighbours_recall_and_ranks(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + 0.5 * rng.standard_normal((1500, 24))).astype(np.float32)
    x[200:260] = x[200]  # one common vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [float("nan")] * 24, 1), (5003, [None] * 24, 1), (5100, [float("inf")] + [1.0] * 23, 1), (5200, [1.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, id int")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.pmod("vec_id", F.lit(100)) == 0).collect():
        got[r.query_id].append(r)
    assert set(got) == set(range(0, 1500, 100))
    y, ids, hits = x.astype(float), np.arange(1500), 0
    for q, found in got.items():
        found.sort(key=lambda r: r.rank)
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, d)) if i != q][:10]
        assert [r.rank for r in found] == list(range(1, 11)) and all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in found)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(best))
        if q == 200:
            assert [r.vec_id for r in found] == best
    assert hits >= 0.95 * 10 * len(got)


def test_neighbours_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    out = neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(2, 1.0), (1, pytest.approx(2**0.5))]
    assert neighbours.nearest(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_neighbours_over_blocks(spark, monkeypatch):
    """Recall over 120 queries, blocks and query lots: vectors without structure, some near copies, repeated rows and ids."""
    monkeypatch.setattr(neighbours, "BLOCK", 500)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2400, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1000:1040] = x[1000] + 0.01 * rng.standard_normal((40, 32))
    ids = np.arange(2400)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist()), (40, (x[40] + 0.05).tolist())]
    x, ids = np.concatenate([x, x[[20]], x[[40]] + 0.05]), np.r_[ids, 20, 40]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.pmod("vec_id", F.lit(20)) == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert len(got) == 120 and len(got[40]) == 20 and all(len(v) == 10 for q, v in got.items() if q != 40)
    assert got[20][0] == (20, 0.0)  # a repeated row is a candidate of the other
    hits = 0
    for q in got:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((ids, d))[:10]
        hits += len({(int(ids[i]), round(float(d[i]), 9)) for i in best} & {(i, round(s, 9)) for i, s in got[q]})
    assert hits >= 0.95 * 10 * len(got)


def test_a_bound_loses_nothing_nearer(spark):
    """Windows opened at the bound find what widening windows find within it."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((800, 16))
    block = neighbours.Block(np.arange(800), x, rng.standard_normal((128, 16)))
    near = 0
    for q in rng.standard_normal((40, 16)):
        ids, dist = block.search(q, None, 10, 118, np.inf, 0.5)
        again, _ = block.search(q, None, 10, 118, float(dist[-1]), 0.5)
        near += len(set(ids) & set(again))
    assert near >= 0.95 * 400


# op7


def test_warc_round_trip(spark, tmp_path):
    big, bigger = "é" * 600, "<p>\r\n\r\nWARC/1.1\r\n</p>" * 80
    pages = [(1, "http://www.b.com/Q?x=1", big, "r"), (2, "http://a.org/", big, "r"), (9, "http://a.org/", big, "r"), (3, "http://a.org/", "small", "r"), (4, None, "small", "r"), (5, "http://c.net/ x\r\ny", None, "r"), (6, "bad[url", "", "r"), (7, "http://b.com/q", bigger, "r"), (8, "ftp://b.com:21/q", " " * 400, "r"), (8, "ftp://b.com:21/q", " " * 400, "r")]
    pages += [(None, "http://a.org/", big, "r"), (None, None, big, "r"), (-1, "http://a.org/", "lone " * 300, "r"), (None, "http://a.org/", "lone " * 300, "r"), (20, "http://long.org/", "w " * 400_000, "r")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record string").repartition(3)
    out = warc.round_trip(df).collect()
    assert len(out) == len(pages)
    want = Counter()
    for i, _, html, _ in pages:
        raw = (html or "").encode()
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), *(("revisit", 9) if i in (1, 2) else ("response", None))] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    order = [(r.url_key, r.ts, r.page_id is not None, r.page_id or 0) for r in sorted(out, key=lambda r: (r.key_range, r.place))]
    assert order == sorted(order)
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_history_over_ranges(spark, tmp_path):
    """Many ranges of one hot URL and others are one history in order, and offsets find their records."""
    rng = random.Random(6)
    rows = [(i, "http://hot.org/" if rng.random() < 0.4 else f"http://h{rng.randrange(9)}.org/{rng.randrange(50)}", f"page {i}") for i in range(3000)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w", archive_bytes=2000)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{tmp_path}/w").select("path", "content")
    out = sorted(warc.history(archives, range_rows=100).collect(), key=lambda r: (r.key_range, r.place))
    assert len(out) == 3000 and len({r.key_range for r in out}) > 10 and len({r.archive for r in out}) > 10
    order = [(r.url_key, r.ts, r.page_id) for r in out]
    assert order == sorted(order)
    r = out[1234]
    with open(r.archive.removeprefix("file:"), "rb") as f:  # an offset opens its record, for any reader of gzip
        f.seek(r.record_offset)
        _, head, _ = next(warc.parse(gzip.GzipFile(fileobj=f)))
    assert head["WARC-Record-ID"] == f"<urn:page:{r.page_id}>"


def test_pages_of_one_id_and_payload_are_spread(spark, tmp_path):
    """A third without an id and a third with one id, each of one payload: archives stay even, nothing is lost."""
    rows = [(None, None, "same " * 300)] * 1000 + [(7, None, "own " * 300)] * 1000 + [(i, None, f"page {i} " * 200) for i in range(8, 1008)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write(df, f"{tmp_path}/w", archive_bytes=400_000)
    sizes = []
    for f in (tmp_path / "w").glob("part-*"):
        with gzip.open(f) as archive:
            sizes.append(len(list(warc.parse(archive))))
    assert sum(sizes) == 3000 and len(sizes) >= 8 and max(sizes) < 3 * 3000 / len(sizes)
    out = Counter((r.page_id, r.record_type) for r in warc.round_trip(df).collect())
    assert out[None, "response"] == out[7, "response"] == 1000 and sum(out.values()) == 3000


def test_records_of_several_members(spark, tmp_path, monkeypatch):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n"
    whole = [(record % n) + b"x" * n for n in (10, 200 - len(record % 200) - 4, 700, 0)]
    monkeypatch.setattr(warc, "MEMBER_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"record": pa.array([w.decode() for w in whole], pa.string())})
    members = next(warc._members(iter([batch]))).column("member").to_pylist()
    archive, found = b"".join(m + gzip.compress(b"x")[-1:] for m in members), []
    for at, head, block in warc.unpack(archive):
        found.append(int(head["Content-Length"]))
        assert next(warc.unpack(archive, at))[2] == block
    assert found == [10, 200 - len(record % 200) - 4, 700, 0]


def test_ten_thousand_turns_in_conflict():
    turns = [("user", "a [/INST] <s>"), ("assistant", "b </s> c")] * 5000
    start = time.process_time()
    assert [(t[0], t[1]) for t in chat.parse(chat.format_conversation(turns))] == turns
    assert time.process_time() - start < 2


def test_warc_files_are_whole_archives(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.org/{i}", "x" * (1000 + i % 2)) for i in range(40)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w", archive_bytes=4000)
    seen, files = [], list((tmp_path / "w").glob("part-*"))
    for f in files:
        found = list(warc.parse(gzip.open(f)))
        assert found
        seen += [head["WARC-Type"] for _, head, _ in found]
    assert len(files) > 4 and Counter(seen) == {"response": 2, "revisit": 38}


@pytest.mark.parametrize("cut", [5, 60, -3])
def test_a_broken_archive_is_no_archive(cut):
    whole = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" * 2
    assert len(list(warc.parse(io.BytesIO(whole)))) == 2
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(whole[:cut])))


@given(st.lists(st.lists(st.integers(0, 9), max_size=6), max_size=7))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs)) == sorted(itertools.chain(*runs))


def test_url_key():
    assert warc.url_key("https://WWW2.Example.com/Path?Q=1#f") == "com,example)/path?q=1"
    assert warc.url_key("http://a.b.c") == "c,b,a)/"


# op8

PART = st.sampled_from(["<", ">", "/", "\\", "[", "]", "s", "<s>", "</s>", "[INST] ", " [/INST]", "[OUT] ", "<<SYS>> ", " <</SYS>>", "[ROLE ", "] ", " [/ROLE]", "INST]", "SYS>>", " ", "é", "\n", "s>"])
TEXT = st.lists(PART, max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a b", "0x61", "ROLE"]), TEXT), max_size=5))
def test_any_conversation_is_read_back(turns):
    formatted = chat.format_conversation(turns)
    back = chat.parse(formatted)
    assert [(r, t) for r, t, _, _ in back] == turns
    assert all(chat.unescape(formatted[a:b]) == t for _, t, a, b in back)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_escape_is_undone(text):
    assert chat.unescape(chat.escape(text)) == text


def test_only_the_turn_in_conflict_is_escaped():
    assert len(chat.format_conversation([("user", "say [INST] twice"), ("assistant", "a </s> b")])) == 57
    assert len(chat.format_conversation([("user", "lit <\\/s> here")])) == 32 + 1
    assert chat.format_conversation([("user", "a </s> [/INS b")]) == "<s>[INST] a </s> [/INS b [/INST]"


def test_the_oracle_counts_escapes(spark):
    """Texts that look escaped, closings of other roles, closings of their own: SQL and operator agree."""
    import duckdb

    from quayside.llm.queries import ORACLES

    texts = ["say [INST] twice", "a </s> b", "lit <\\/s> here", "x [/INST] y [/INST]", " <</SYS>>", "<\\\\s> </s>", "[/ROLE] z [/ROLE]", "[ROLE a] [\\/ROLE]", None, ""]
    rows = [(i, j, role, t) for i, role in enumerate(["user", "assistant", "system", "tool", None]) for j, t in enumerate(texts)] + [(10 + i, 0, "user", t) for i, t in enumerate(texts)]
    said = "</s>[INST] ok [/INST]"
    df = spark.createDataFrame([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.execute(ORACLES["op8_chat_formatting"]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r[c] for c in columns) for r in chat.digest(chat.format_chats(df)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_plain_text_is_not_changed():
    turns = [("user", "hi [there] <b>\\</b>"), ("assistant", "ok")]
    assert chat.format_conversation(turns) == "<s>[INST] hi [there] <b>\\</b> [/INST]<s>[OUT] ok </s>"


def test_chats(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (1, 2, "assistant", None, 0), (1, 3, None, "?", 0), (-7, 0, "user", said, 0), (-7, 1, "assistant", said, 0), (2, 0, "assistant", "x" * 50_000, 0), (3, 0, "user", "t", 0), (3, 0, "user", "t", 0), (None, 0, "user", "n", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    held = defaultdict(list)
    for c, t, role, text, _ in rows:
        held[c].append((t, role or "", text or ""))
    assert set(got) == set(held)
    for c, turns in held.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest(chat.format_chats(df.where("false"))).count() == 0
