"""Every registered query with SQL, beside DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    verdict = compare(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df())
    assert verdict.startswith("ok"), verdict


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "roc_auc" in out.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
