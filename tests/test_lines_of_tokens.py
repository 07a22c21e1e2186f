"""The tokenizer's state goes from logical line to logical line (marks), token columns are made as asked for."""

import random

import pytest
from pyspark.sql import functions as F

from progcorpus.functions.lexer import END, WRONG, lex
from progcorpus.functions.tokenstate import read_lines
from progcorpus.operators import functions as FN
from progcorpus.operators import tokens as T
from pytokens import py_tokens

FRAGMENTS = ["def ", "f", "x", " ", "    ", "\t", "\n", "\r\n", "\\\n", "(", ")", "[", "]", "{", "}", ":", "0x1", "0b1", "2", "1_", ".5", "'a'",
             '"""b\n c"""', "'", "f'{d['k']}'", "# c\n", "é", "$", "**=", ".", "if x:\n    ", "pass\n", "'s'\n", "\n        ", "((((", "))))"]


def dim_of(spark, codes):
    return T.code_dim(spark.createDataFrame([(c,) for c in codes], "func_code string"))


def test_a_mark_for_every_token(spark):
    rnd = random.Random(4)
    codes = ["".join(rnd.choice(FRAGMENTS) for _ in range(rnd.randrange(30))) for _ in range(300)] + ["", "0xg", "0b12", "0o8", "0b'1'", "1_", "1.\n", "\x01\x02"]
    rows = lex(dim_of(spark, codes)).collect()
    for r in rows:
        assert len(r.marks) == len(r.raw) + 1 and r.marks.endswith(END) and "".join(r.raw) == r.code
        for token, mark in zip(r.raw, r.marks):
            if token[-1] in "'\"" and len(token) > 1:
                assert mark in "'\""
            elif mark != WRONG:
                assert mark == {"[": "(", "{": "(", "]": ")", "}": ")", "\r": "\n", "\t": " "}.get(token[0], token[0]) or mark.isdigit()
    wrong = {r.code: WRONG in r.marks for r in rows}
    assert [wrong[c] for c in ("0xg", "0b12", "0o8", "0b'1'", "1_", "1.\n")] == [True, True, True, False, True, False]


def test_the_state_steps_by_lines_not_tokens(spark):
    """A text costs a step a logical line, brackets of up to three levels included."""
    code = "def f(a, b=(1, [2, {3: 4}]),\n      c=0):\n    x = a + b * c - 1\n    return x\n"
    read = read_lines(F.col("raw"), F.col("marks"))
    r = lex(dim_of(spark, [code])).select(F.size("raw").alias("tokens"), read["lines"].alias("lines"), read["n_tokens"].alias("n")).first()
    assert r.tokens > 40 and len(r.lines) <= 8
    assert r.n == len(py_tokens(code))


@pytest.mark.parametrize("cols", [("pos", "kind", "src"), ("pos", "indent_depth"), ("off", "bracket_depth"), ("pos", "line", "seg")])
def test_asked_columns_are_those_of_the_whole_table(spark, cols):
    rnd = random.Random(9)
    codes = ["".join(rnd.choice(FRAGMENTS) for _ in range(rnd.randrange(40))) for _ in range(200)]
    codes += ["x = ((((1,\n2))))\nif x:\n    y\n", "def f():\n  def\n  def g(): pass\n", "def (\n", "(((((((\n)\n"]
    job = T.token_table(dim_of(spark, codes))
    for all_texts in (True, False):
        whole = job.tokens if all_texts else T.tokenized(job)
        some = T.stream(job, *cols, valid=not all_texts)
        assert sorted(map(repr, whole.select("code_id", *cols).collect())) == sorted(map(repr, some.collect()))


def test_functions_are_found_in_the_texts_row(spark):
    dim = dim_of(spark, ["def f(a):\n    def g():\n        return 1\n    return g\nx = f\n", "def def(h):\n  pass\n", "y = 1\n"])
    job = T.token_table(dim)
    for frame in (FN.definitions(job), FN.function_spans(job, dim), T.clean_programs(job, dim), T.indent_profile(job)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Sort", "Join", "Window", "Aggregate")), plan
    got = sorted((r.name, r.string) for r in FN.function_table(job, dim).collect())
    assert got == [("f", "def f(a):\n    def g():\n        return 1\n    return g\n"), ("g", "def g():\n        return 1\n    "),
                   ("h", "def def(h):\n  pass\n"), ("h", "def(h):\n  pass\n")]


def test_constructs_are_gathered_in_the_texts_row(spark):
    import ast

    from progcorpus.operators import inventory as C
    from progcorpus.operators import nodes as N

    codes = ["def f(a):\n    if a:\n        b = a + 1 - a\n    return 'a' + \"b\" + 'a'  # a\nb = 2 ** 2\n", "x = 1\nx = x + 1\n", "f(", "\n", "if 1\n  x + 1\n"]
    dim = dim_of(spark, codes)
    texts, ops = N.with_variables(N.node_table(dim), dim), C.operator_relation(spark)
    want, empty = set(), {}
    for c in codes:
        toks, names = py_tokens(c) or [], set()
        try:
            names = {n.id for n in ast.walk(ast.parse(c.lstrip())) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {
                n.arg for n in ast.walk(ast.parse(c.lstrip())) if isinstance(n, ast.arg)}
        except SyntaxError:
            pass
        at = {}
        for i, (k, s) in enumerate(toks):
            kind = ("operators" if s in C.OPERATORS else "numbers" if k == "NUMBER" else "variables" if s in names else
                    "strings" if k == "STRING" else None)
            if kind:
                at.setdefault((kind, s), []).append(i)
        want |= {(c, k, s, ",".join(map(str, p)), len(p)) for (k, s), p in at.items()}
        empty[c] = not at
    code = {r.code_id: r.code for r in dim.collect()}
    inventory = C.construct_inventory(texts, ops)
    plan = inventory._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "collect_list" not in plan, plan
    got = {(code[r.code_id], r.construct, r.src, r.positions, r.n) for r in inventory.collect()}
    assert got == want
    assert {code[r.code_id]: r.is_empty for r in C.has_no_constructs(texts, ops).collect()} == empty
    for frame, kind in ((C.variable_locations(texts), "variables"), (C.string_tokens(texts), "strings")):
        assert {(code[r.code_id], r.construct, r.src, r.positions, r.n) for r in frame.collect()} == {w for w in want if w[1] == kind}
    alone = {(code[r.code_id], r.construct, r.src, r.positions, r.n) for r in C.construct_inventory(dim, ops).collect()}
    assert alone == {w for w in want if w[1] in ("operators", "numbers")}


def test_listed_functions_are_those_of_the_joins(spark):
    """Main routines, subroutines and relevant parts found in the text's row equal those of the function table's joins."""
    codes = ["def g(x):\n    return x\ndef xf(a):\n    return 1\ndef f(a):\n    return g(a) + yxf(2) + h (3)\n\n\ndef f(b):\n    return xf(b)  \n",
             "def f(): return f()\n", "def h(): pass\n", "def f(a)\n    return (a\n", "", "x = 1\n", "def f(a):\n  def g(b): return 1\n  return g(a)\n"]
    dim = dim_of(spark, codes)
    job = T.token_table(dim)
    pairs = dim.select("code_id", F.explode(F.array(F.lit("f"), F.lit("g"), F.lit(""), F.lit(None).cast("string"))).alias("func_name"))
    lists, ft = FN.function_lists(job, pairs), FN.function_table(job, dim)
    plan = FN.listed_subroutines(lists)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2, plan       # the texts and their wanted names alone
    mains = FN.last_definition(ft, pairs)
    assert sorted(map(tuple, FN.listed_last_definitions(lists).collect())) == sorted(map(tuple, mains.collect()))
    want = sorted(map(tuple, FN.subroutines(ft, mains).collect()))
    assert sorted(map(tuple, FN.listed_subroutines(lists).collect())) == want and len(want) == 2
    code = {r.code_id: r.code for r in dim.collect()}
    parts = {(code[r.code_id], r.func_name): (r.relevant, r.extraction_ok) for r in FN.extraction_check(FN.relevant_part(lists)).collect()}
    assert len(parts) == 4 * len(codes)
    assert parts[codes[0], "f"] == ("def xf(a):\n    return 1\ndef f(b):\n    return xf(b)", True)
    assert parts[codes[6], "f"] == ("def g(b): return 1\ndef f(a):\n  def g(b): return 1\n  return g(a)", True)
    assert parts[codes[2], "f"] == ("", True) and parts[codes[3], None] == (codes[3], False) and parts[codes[3], "f"] == ("", True)
    assert parts[codes[0], ""] == (codes[0], True)
