"""The registered queries with SQL against DuckDB, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from check_tools import digest  # noqa: E402

from progcorpus.llm import queries as Q  # noqa: E402

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(Q.ORACLES[name])
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, got) == digest(cols, want)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
