"""Steps whose cost must grow no faster than their input."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from progcorpus.operators import nodes as N
from progcorpus.operators import tokens as T

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_adjacency_needs_no_join(spark):
    """Children are grouped in the node table's layout: nothing can be broadcast."""
    assert "Join" not in _plan(E.queries()["adjacency_list"](spark, SF))
    dim = T.code_dim(spark.createDataFrame([("def f(a):\n    return a",), ("x = 1",), ("(",)], "func_code string"))
    rows = N.adjacency_list(N.node_table(dim)).collect()
    kids = {(r.code_id, r.node_id): r.children for r in rows}
    assert all(r.type for r in rows) and len(kids) == len(rows)
    assert sorted(len(v) for k, v in kids.items() if k[1] == 0) == [1, 1]
    assert all(v == sorted(v) for v in kids.values())


def test_token_jobs_keep_tokens_in_their_rows(spark):
    """Token rows come out of the text's row: no exchange, sort or join under them."""
    dim = T.code_dim(spark.createDataFrame([("def f(a):\n    if a:\n        return 1\n    return a\n",)], "func_code string"))
    job = T.token_table(dim)
    for frame in (job.tokens, job.status, T.tokenized(job)):
        plan = _plan(frame)
        assert not any(x in plan for x in ("Exchange", "Sort", "Join", "Window")), plan
    dedents = [r.pos for r in job.tokens.where(F.col("kind") == "DEDENT").orderBy("pos").collect()]
    assert len(dedents) == 2 and job.status.first().n_tokens == job.tokens.count()
    blocks = [(r.w, r.end_seg, r.close_seg) for r in job.blocks.orderBy("seg").collect()]
    assert blocks == [(0, None, None), (4, 3, None), (8, 3, 3), (4, None, None)]
