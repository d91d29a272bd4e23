"""Every catalogue query against its SQL oracle (DuckDB) at sf0.001."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tools_check import TABLES, digest  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from tradetally.plans.registry import all_oracles, all_queries  # noqa: E402

QUERIES, ORACLES = all_queries(), all_oracles()
# the file-based oracles read sf0.01 by path (as the driver does)
PATH_BOUND = {"file_fingerprint", "file_merkle_roots", "source_profile"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    missing = set(QUERIES) - set(ORACLES)
    assert not missing, missing


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sf = "/root/testdata/sf0.01" if name in PATH_BOUND else SF_SMALL
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    sql = ORACLES[name]
    if name in PATH_BOUND:
        res = duckdb.sql(sql)
    else:
        res = con.sql(sql)
    ocols, orows = res.columns, res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    got = {r["break_type"]: r["n"] for r in df.collect()}
    assert got == {"CLEAN": 3587, "DUPLICATE": 2321, "MISSING": 292, "SIDE_BREAK": 200,
                   "QTY_BREAK": 185, "PRICE_BREAK": 170, "SETTLE_BREAK": 165}
