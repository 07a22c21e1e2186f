"""Spans cut out of texts (T3, T4, A7), block ends (W9), renaming by templates."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from progcorpus.functions import lines as L
from progcorpus.operators import functions as FN
from progcorpus.operators import nodes as N
from progcorpus.operators import tokens as T
from progcorpus.operators.rename import PairJob


def dim_of(spark, codes):
    return T.code_dim(spark.createDataFrame([(c,) for c in codes], "func_code string"))


def test_cut_spans_equal_slices(spark):
    rnd = random.Random(7)
    texts = ["", "ab", "é☃\U0001F600" * 700, "x" * 1024, "y\n" * 3000]
    rows = []
    for t in texts:
        spans = [(a, rnd.randrange(a, len(t) + 1)) for a in (rnd.randrange(len(t) + 1) for _ in range(30))]
        rows.append((t, spans + [(0, len(t))]))
    df = spark.createDataFrame(rows, "t string, s array<struct<a:long,b:long>>")
    got = df.select("t", "s", L.cut_spans(F.col("t"), F.col("s"), lambda s, cut: cut(s["a"], s["b"])).alias("x")).collect()
    for r in got:
        assert r.x == [r.t[s.a:s.b] for s in r.s]


DOCSTRINGS = [
    "def f(): 'doc'; return 1", "def f(): 'doc'", "def f():\n    'doc'; return 1\n", "def f():\n    'doc';\n    return 1\n",
    "def f():\n    \"\"\"a\n    b\"\"\"; return 1\n", "def f(): \"\"\"a\n  b\"\"\"\nx = 1\n", "class A:\n\t'doc'  # why\n\r\n\tx = 1",
    "class A:\n\t'doc'  # why\n", "def f():\r\n  'd'\r\n  return 2\r\n", "def f():\r  'd'\r  return 2",
    "class A:\n    'a'\n    def f(self):\n        'b'\n        def g(): 'c'\n        return g\n    async def h(self): 'd'; pass\n",
    "def f():\n    'é☃'; return 'é'\n", "def f():\n    ('doc')\n    return 1\n", "def f():\n    'a' 'b'\n    return 1\n", "x = 1\n", "",
    "def f():\n    'doc' ; # c\n    return 1", "def f():\n    'one'\n    'two'\n    return 1\n",
]


def without(tree):
    """The tree with its docstrings taken out by hand."""
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and ast.get_docstring(node, clean=False) is not None:
            node.body = node.body[1:] or [ast.Pass()]
    return ast.dump(tree)


def test_docstrings_go_and_all_else_stays(spark):
    many = "".join(f"def f{i}(a):\n    \"\"\"doc {i}\"\"\"\n    return a + {i}\n\n" for i in range(2000))
    codes = DOCSTRINGS + [many]
    dim = dim_of(spark, codes)
    got = {r.code: r.stripped for r in N.strip_docstrings(N.node_table(dim), dim).join(dim, "code_id").collect()}
    for c in codes:
        if c == DOCSTRINGS[12]:         # a docstring in brackets leaves them
            continue
        assert ast.dump(ast.parse(got[c])) == without(ast.parse(c)), (c, got[c])
        assert "\r" not in got[c]
    assert got["def f(): 'doc'; return 1"] == "def f(): return 1"
    assert got["class A:\n\t'doc'  # why\n"] == "class A:\n\tpass\n"
    assert got["def f():\n    'doc' ; # c\n    return 1"] == "def f():\n    return 1"


def test_functions_of_a_large_text(spark):
    code = "".join(f"def f{i}(a):\n    x = 'é{i}'\n    return x\n\n" for i in range(3000)) + "def last(): return 1"
    dim = dim_of(spark, [code, "def broken(:\n    pass\n", "def two(a)\n    return a\n"])
    nt = N.node_table(dim)
    fm = {r.name: r.definition for r in N.function_map(nt, dim, FN.function_table(T.token_table(dim), dim)).collect()}
    tree = ast.parse(code)
    assert {k: v for k, v in fm.items() if k != "two"} == {f.name: ast.get_source_segment(code, f) for f in tree.body}
    assert fm["two"] == "def two(a)\n    return a\n"
    small = N.unparsed(nt, dim)
    assert sorted(r.code for r in small.collect()) == ["def broken(:\n    pass\n", "def two(a)\n    return a\n"]
    first = N.first_function_name(nt, dim, FN.definitions(T.token_table(small)))
    assert sorted(r.first_function for r in first.collect()) == ["", "f0", "two"]


def nearest(w):
    out = []
    for i, x in enumerate(w):
        after, before = range(i + 1, len(w)), range(i - 1, -1, -1)
        out.append((i, next((j for j in after if w[j] < x), None), next((j for j in after if w[j] == x), None),
                    next((j for j in before if w[j] < x), None), next((j for j in before if w[j] == x), None)))
    return out


@pytest.mark.parametrize("widths", [1, 3, 16, 17, 40, 300, 5000])
def test_nearest_smaller_widths(spark, widths):
    rnd = random.Random(widths)
    w = [rnd.randrange(widths) for _ in range(400)] + list(range(min(widths, 600)))
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(w)] + [("b", 0, 4)], "code_id string, seg int, w int")
    got = sorted(tuple(r)[1:] for r in T.nearest_smaller(df).collect() if r.code_id == "a")
    assert got == nearest(w)


def test_a_staircase_costs_n_log_n_rows(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("a").alias("code_id"), F.col("id").cast("int").alias("seg"), F.col("id").cast("int").alias("w"))
    up = T.nearest_smaller(df)
    assert up.where((F.col("prev_lt") == F.col("seg") - 1) | (F.col("seg") == 0)).count() == n
    assert up.where("next_lt is not null or next_eq is not null").count() == 0
    assert T.nearest_rows(df).count() < 16 * 4 * n


def test_renaming_fills_one_template_per_destination(spark):
    dst = "def f(a, b, *c, k=1):\n    # a\n    return f'{a}' + a.a + b(a=a)\n"
    rows = [(1, "f", "def f(x, y): return x", dst), (2, "f", "def f(p): return p", dst), (3, "f", "def f(): return 0", dst),
            (4, "f", "def f(b, a, z): return z", dst), (5, "f", "def f(x): return x", "def f(): return 1\n"),
            (6, "f", "def g(x): return x", dst), (7, "f", "def f(x): return x", "def f(a):\n    return (a\n"),
            (8, "f", "    def f(x, y):\n        return x\n    z = f(1, 2)\n", dst)]
    job = PairJob(spark.createDataFrame(rows, "pair_id int, func_name string, source string, destination string"))
    got = {(r.src_id, r.dst_id): r.renamed for r in job.renamed().collect()}
    by = {r.pair_id: got.get((r.src_id, r.dst_id)) for r in job.pairs.collect()}

    def filled(a, b):
        return f"def f({a}, {b}, *c, k=1):\n    # a\n    return f'{{a}}' + {a}.{a} + {b}({a}={a})\n"

    assert by == {1: filled("x", "y"), 2: filled("p", "b"), 3: dst, 4: filled("b", "a"), 5: "def f(): return 1\n", 6: None, 7: None,
                  8: filled("x", "y")}
