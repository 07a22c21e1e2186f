"""Syntax trees stay in their text's row: no node is shuffled, sorted or joined."""

import pytest

import __spark_entry__ as E
from progcorpus.operators import dedup as D
from progcorpus.operators import nodes as N
from progcorpus.operators import rename as R
from progcorpus.operators import tokens as T
from test_scopes import DIFFERENT, SAME, SLOTS, classes

SF = "/root/testdata/sf0.001"
MOVES = ("Exchange", "Join", "Window")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["node_table", "multi_function", "variable_list", "strip_docstrings"])
def test_nodes_do_not_move(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert not any(x in plan for x in MOVES), plan
    # nothing but the parser, on one task per bucket
    assert plan.count("MapInArrow") == 1 and "Bucketed: true" in plan, plan


def test_only_asked_columns_are_parsed(spark):
    nt = N.node_table(T.code_dim(spark.createDataFrame([("def f(a):\n    return a",), ("(",)], "func_code string")))
    assert nt.trees().columns == ["code_id", "compile_error"]
    got = sorted((r.compile_error or "", [n.ident for n in r.nodes if n.ident]) for r in nt.trees("ident").collect())
    assert got == [("", ["f", "a", "a"]), ("SyntaxError", [])]
    full, _ = N._flatten("@d\ndef f(a=1):\n    'doc'\n    return a")
    for c in N.FIELDS:
        rows, _ = N._flatten("@d\ndef f(a=1):\n    'doc'\n    return a", (c,))
        i = N.FIELDS.index(c)
        assert [r[i] for r in rows] == [r[i] for r in full], c


def test_long_programs_are_renamed_alike(spark, monkeypatch):
    codes = [c for pair in SAME + DIFFERENT for c in pair] + [s.format("a", "b", "c", "d", "e") for s in SLOTS]
    in_row = classes(spark, codes)
    monkeypatch.setattr(D, "SHORT", 0)
    assert classes(spark, codes) == in_row and all(in_row)


def test_arguments_and_templates_meet_without_token_rows(spark):
    rows = [(1, "f", "def f(x, /, y): return x", "def f(a, b, c):\n    return a + b(a=c)\n"),
            (2, "f", "def f(): return 1", "def f(a): return a"), (3, "f", "x = 1", "def f(a): return a")]
    job = R.PairJob(spark.createDataFrame(rows, "pair_id int, func_name string, source string, destination string"))
    assert sorted((r.arg_ix, r.src_arg, r.dst_arg) for r in job.arg_pairs.collect()) == [(0, "x", "a"), (1, "y", "b")]
    assert sorted(r.renamed for r in job.renamed().collect()) == ["def f(a): return a", "def f(x, y, c):\n    return x + y(x=c)\n"]
    args = job.args.where("func_name = 'f'")
    plan = _plan(R.templates(args, T.token_table(job.dim)))
    assert "Window" not in plan and plan.count("Generate") == 1, plan
