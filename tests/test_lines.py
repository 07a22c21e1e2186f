"""Line functions against Python's own string methods."""

import textwrap

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from progcorpus.functions import lines as L

ALPHABET = st.sampled_from(list("ab #<\t ") + ["\n", "\r", "\r\n", "\v", "\f", "\x1c", "\x85", "\u2028", "  "])
TEXTS = st.lists(ALPHABET, max_size=30).map("".join)


def _eval(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_line_count_edges(spark):
    texts = ["", "a\n", "a\r\nb", "\n\n", "a\vb", "a\fb", "a\rb", "a\x1cb", "a\x85b", "a\u2028b", "x"]
    assert _eval(spark, texts, L.line_count) == [len(t.splitlines()) for t in texts]


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_line_count_property(spark, texts):
    assert _eval(spark, texts, L.line_count) == [len(t.splitlines()) for t in texts]


@settings(max_examples=15, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_splitlines_property(spark, texts):
    assert _eval(spark, texts, L.splitlines) == [t.splitlines() for t in texts]


def test_strip_generation_lines(spark):
    texts = ["  # x\nkeep", " <x\n<x\ny", "", "a\r\n#b\r\nc", "<|x|>\n# g\ndef f():\n  pass"]
    assert _eval(spark, texts, L.strip_generation_lines) == ["keep", " <x\ny", "", "a\nc", "def f():\n  pass"]


def test_implementation_start(spark):
    texts = ['def f():\n    """doc"""\n    return 1', "x = 1\ndef f():\n    pass", "no code here"]
    assert _eval(spark, texts, L.implementation_start) == [2, 2, None]


def test_dedent_matches_textwrap(spark):
    texts = ["    a\n      b\n    c", "\ta\n\tb", "  a\n\n  b", "a\n  b", "   \n  x\n  y", "  \t a\n  \t b"]
    assert _eval(spark, texts, L.dedent) == [textwrap.dedent(t) for t in texts]


def test_attach_docstring(spark):
    df = spark.createDataFrame([("def f(a):\n    return a", "Doc line.\n  more detail"),
                                ("def f(a): return a", "x")], "code string, doc string")
    out = [r[0] for r in df.select(L.attach_docstring("code", "doc")).collect()]
    assert out[0] == 'def f(a):\n    """Doc line.\n    more detail\n    """\n    return a'
    assert out[1] is None


def test_body_indentation(spark):
    assert _eval(spark, ["def f():\n\treturn 1", "x = 1"], L.body_indentation) == ["\t", None]


def test_with_docstring_equals_column_form(spark):
    df = spark.createDataFrame([(1, "def f(a):\n    return a", "Doc line.\n  more detail"),
                                (2, "def f(a): return a", "x"), (3, "def g():\n\tpass", "  one  "),
                                (4, "", "d"), (5, "def h():\n  x = 1", "")], "i int, code string, doc string")
    a = {r.i: r.v for r in df.select("i", L.attach_docstring("code", "doc").alias("v")).collect()}
    b = {r.i: r.with_doc for r in L.with_docstring(df, "code", "doc").collect()}
    assert a == b
