"""Every query with oracle SQL gives the rows DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quayside.plans.catalogue_io import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    return round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
