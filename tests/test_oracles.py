"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver's correctness check, at the smallest scale)."""

import duckdb
import pytest

import __spark_entry__ as E
from check_tools import digest
from progcorpus.plans import registry
from progcorpus.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(E.queries()) and set(registry.oracle_sql()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    assert digest(df.columns, got) == digest(cols, want)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["sub_id", "func_name", "func_code"]
    assert df.count() == 585  # FIXTURES.md §5, sf0.001
