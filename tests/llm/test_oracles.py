"""The registered queries with oracle SQL give the rows DuckDB gives; all give their contract's columns."""

import duckdb
import pytest

from quayside.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2": "doc_id held_out lang_pred score",
    "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5": "query_id rank vec_id score",
    "op6": "doc_id n_shingles component_id",
    "op7": "page_id payload_bytes payload_digest record_type refers_to",
    "op8": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op9": "doc_id n_words n_removed kept_sha256",
    "op11": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op12": "lang rank phrase a l r n score",
    "op13": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op10": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_contract_columns(spark, op):
    (name,) = (n for n in QUERIES if n.startswith(f"{op}_"))
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[op].split()) <= set(df.columns)
