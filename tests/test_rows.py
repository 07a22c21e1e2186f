"""A text is parsed and lexed once, in its row; what a job doesn't ask for stays in the parser."""

import ast
import glob
import textwrap

import pytest

import __spark_entry__ as E
from progcorpus.functions.lines import dedent
from progcorpus.operators import functions as FN
from progcorpus.operators import nodes as N
from progcorpus.operators import rename as R
from progcorpus.operators import tokens as T

SF = "/root/testdata/sf0.001"
CODES = ["def f(a, /, b=lambda q: q, *c, d, **e):\n    def g(x): return x\n    return g\nasync def h(z): pass\ndef f(u, v): pass\n",
         "if x:\n    def f(a): pass\nelse:\n    class C:\n        def m(self): pass\nmatch x:\n    case 1:\n        def k(): pass\n",
         "try:\n    def t1(): pass\nexcept E as e:\n    def t2(): pass\nfinally:\n    def t1(): return 1\n",
         "def two(a)\n    return a\ndef one(b): pass\ndef two(): pass\n", "def broken(:\n    pass", "x = 'def '", ""]


def dim_of(spark, codes):
    return T.code_dim(spark.createDataFrame([(c,) for c in codes], "func_code string"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["function_map", "first_function_name"])
def test_functions_are_found_without_moving_a_text(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert not any(x in plan for x in ("Exchange", "Join", "Window", "Union")) and plan.count("MapInArrow") == 1, plan


def test_function_map_of_both_kinds(spark):
    dim = dim_of(spark, CODES)
    nt, ft = N.node_table(dim), FN.function_table(T.token_table(dim), dim)
    got = sorted(map(tuple, N.function_map(nt, dim).collect()))
    assert got == sorted(map(tuple, N.function_map(nt, dim, ft).collect()))
    assert {(n, i) for _, n, i, _ in got} >= {("two", 0), ("two", 1), ("one", 0), ("f", 0), ("f", 1), ("k", 0), ("m", 0), ("t1", 1)}
    first = sorted(map(tuple, N.first_function_name(nt, dim).collect()))
    assert first == sorted(map(tuple, N.first_function_name(nt, dim, FN.definitions(T.token_table(dim))).collect()))


def test_picked_nodes_are_those_of_the_whole_walk():
    lean = tuple(c for c in N.FIELDS if c not in N._RESOLVED)
    at = [N.FIELDS.index(c) for c in lean]
    for code in [c for c in CODES] + [open(f, encoding="utf8").read() for f in sorted(glob.glob(ast.__file__[:-3] + "*.py"))]:
        (full, error), (all_, _) = N._flatten(code), N._flatten(code, lean)
        assert [[r[i] for i in at] for r in full] == [[r[i] for i in at] for r in all_]
        for types in (N.FUNCTIONS, N._NAMED, (*N.FUNCTIONS, "arguments", "arg")):
            want = sorted((r for r in full if r[6] in types), key=lambda r: r[3])
            got, e = N._flatten(code, lean, types)
            assert e == error and [[r[i] for i in at] for r in want] == [[r[i] for i in at] for r in got]
            got, _ = N._flatten(code, ("type", "ident", "off"), types)
            assert [(r[6], r[7], r[16]) for r in want] == [(r[6], r[7], r[16]) for r in got]
            got, _ = N._flatten(code, ("type", "literal"), types)
            assert sorted(map(repr, got)) == sorted(repr(r) for r in N._flatten(code, ("type", "literal"))[0] if r[6] in types)


def test_arguments_of_every_function_in_one_pass(spark):
    many = "".join(f"def f{i}(a{i}, b): pass\n" for i in range(300))
    dim = dim_of(spark, CODES + [many])
    args = R.positional_arguments(N.node_table(dim))
    rows = args.join(dim, "code_id").collect()
    got = {r.func_name: r.args for r in rows if r.code == CODES[0]}
    assert got == {"f": ["u", "v"], "h": ["z"]}
    assert {r.func_name: r.args for r in rows if r.code == many} == {f"f{i}": [f"a{i}", "b"] for i in range(300)}
    assert len(rows) == 302
    assert "Exchange" not in _plan(R.positional_arguments(N.node_table(dim, dedented=True)))


def test_templates_lex_after_the_join(spark):
    dim = dim_of(spark, CODES)
    args = R.positional_arguments(N.node_table(dim)).localCheckpoint()
    plan = _plan(R.templates(args, T.token_table(dim))).split("Initial Plan")[0]
    # a plan's first lines are its last steps: no token is made below the join
    above, below = plan.split("Join", 1)
    assert "regexp_extract_all" in above and "regexp_extract_all" not in below, plan


def test_dedent_of_flush_texts(spark):
    texts = ["def f():\n    return 1", "  a\n  b", "a\n   \n b", "  a\nb\n \t", "\n  a\n\n    b\n", "x\n\t\ny", "", " ", "\n", "  a\n b\n"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", dedent("t").alias("d")).collect()
    assert [r.d for r in sorted(got)] == [textwrap.dedent(t) for t in texts]
    # a line break of Java's patterns ends a blank line too
    rows = spark.createDataFrame([("a\r\n  \r\n b",), ("\r\n  a",), (" \u2028\nb",)], "t string").select("t", dedent("t").alias("d")).collect()
    assert {r.t: r.d for r in rows} == {"a\r\n  \r\n b": "a\r\n\n b", "\r\n  a": "\r\n  a", " \u2028\nb": "\nb"}
