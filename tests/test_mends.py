"""Inputs that no program template contains: each test states one case."""

import ast
import inspect
import json
import os
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from progcorpus import session
from progcorpus.functions import lines as L
from progcorpus.functions.testspec import three_digits
from progcorpus.operators import dedup as D
from progcorpus.operators import functions as FN
from progcorpus.operators import nodes as N
from progcorpus.operators import sampling, testcases
from progcorpus.operators import tokens as T
from progcorpus.sources import json_io

SUB = "sub_id long, func_name string, func_code string"


# --- session -----------------------------------------------------------------------------

def test_live_session_is_left_alone(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert session.get_spark(shuffle_partitions=8).conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


class _Remote:
    """A session on a cluster without a checkpoint folder."""
    class _Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class _Conf:
        def get(self, key, default=None):
            return default

    sparkContext, conf = _Context(), _Conf()


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Remote())


def test_bucket_count_has_no_cap():
    assert session.buckets_for(0, 8) == 1
    assert session.buckets_for(40 << 20, 8) == 8
    assert session.buckets_for(100 << 40, 200) == (100 << 40) // (128 << 20)


def test_job_tables_are_dropped(spark):
    with session.job_tables(spark):
        t = session.materialize(spark.range(10), key="id", num_buckets=2)
        assert session.buckets_of(t) == 2 and t.count() == 10
        name, path = session._OWNED[-1][0]
        assert spark.catalog.tableExists(name)
    assert not spark.catalog.tableExists(name) and not os.path.exists(path.removeprefix("file:"))


def test_two_corpora_keep_their_own_layout(spark):
    a = T.code_dim(spark.createDataFrame([("x = 1",)], "func_code string"), num_partitions=3)
    b = T.code_dim(spark.createDataFrame([("y = 2",)], "func_code string"), num_partitions=2)
    assert (session.buckets_of(a), session.buckets_of(b)) == (3, 2)
    assert session.buckets_of(N.node_table(a)) == 3


# --- numbers, percentages, JSON layout ------------------------------------------------------

def test_numbers_past_32_bits(spark):
    df = spark.createDataFrame([(7,), (1234,), (3_000_000_000,)], "n long")
    assert [r[0] for r in df.select(three_digits("n")).collect()] == ["007", "1234", "3000000000"]


def test_keep_percentage_cases(spark):
    rows = [(1, "q", "b", False), (2, "q", "a", True), (3, "q", "b", False), (4, None, "z", True), (5, "r", "c", True)]
    df = spark.createDataFrame(rows, "sub_id long, func_name string, func_code string, ref boolean")
    ids = lambda p, **k: sorted(r.sub_id for r in sampling.keep_percentage(df, p, "func_name", **k).collect())
    assert ids(0) == ids("ref_sol") == [1, 5]
    assert ids(0, ref_sol_col="ref") == [2, 5]
    assert ids(50) == [1, 2, 5]
    assert ids("all") == ids(-3) == [1, 2, 3, 5]            # rows without a group drop out
    with pytest.raises(ValueError):
        sampling.head_percent(df, 0, "func_name")


def test_json_layout_is_not_guessed(spark):
    d = tempfile.mkdtemp(prefix="pc-json-")
    with open(os.path.join(d, "x.json"), "w") as fp:
        json.dump([{"a": [1, 2]}, {"a": [3]}], fp)
    assert [r.a for r in json_io.scan_json(spark, d, schema="a array<long>").collect()] == [[1, 2], [3]]
    with pytest.raises(ValueError):
        json_io.scan_json(spark, d, schema="a long", layout="columns")


# --- canonical form -------------------------------------------------------------------------

def _classes(spark, codes, name="f"):
    subs = T.with_code_id(spark.createDataFrame([(i, name, c) for i, c in enumerate(codes)], SUB))
    canon = D.canonical_form(N.node_table(T.code_dim(subs)), subs.select("code_id", "func_name").distinct())
    got = {r.code_id: r.normalized for r in canon.collect()}
    return [got.get(r.code_id) for r in subs.orderBy("sub_id").collect()]


PAIRS = [   # same class within a pair, different classes between pairs
    ("def f(*, a, b=1): return a", "def f(*, p, q=1): return p"),
    ("def f(*, a=1, b): return a", "def f(*, x=1, y): return x"),
    ("def f(a): return {**a, 'k': 1}", "def f(z): return {**z, 'k': 1}"),
    ("def f(a): return {'k': 1, **a}", "def f(q): return {'k': 1, **q}"),
    ("def f():\n import os.path\n return os", "def f():\n  import os.path\n  return os"),
    ("def f():\n import os.path as os\n return os", "def f():\n import os.path as o\n return o"),
    ("def f(): return 'a'", "def f():\n    return 'a'"),
    ("def f(): return u'a'", "def f():\n    return u'a'"),
    ("def f(): return b'a'", "def f():\n    return b'a'"),
]


def test_canonical_form_separates_and_repeats(spark):
    codes = [c for pair in PAIRS for c in pair]
    first, again = _classes(spark, codes), _classes(spark, list(reversed(codes)))[::-1]
    assert first == again                                # no memory address, no order
    assert all(x is not None for x in first)
    assert [first[i] == first[i + 1] for i in range(0, len(first), 2)] == [True] * len(PAIRS)
    assert len(set(first)) == len(PAIRS)


def test_offsets_of_non_ascii_lines():
    code = "def f(é):\n    s = 'ñ☃'; t = é + s; return (t, 'x')\n"
    rows, err = N._flatten(code)
    assert err is None
    for r in rows:
        if r[16] is not None and r[6] in ("Name", "Constant"):
            assert code[r[16]:r[17]] in ("é", "s", "t", "'ñ☃'", "'x'")


# --- docstrings -----------------------------------------------------------------------------

DOCS = st.text(alphabet=st.sampled_from("a b\tc\n \té."), max_size=40)


@settings(max_examples=25, deadline=None)
@given(st.lists(DOCS, min_size=1, max_size=30))
def test_clean_docstrings_property(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    got = {r.i: r.d for r in L.clean_docstrings(df, "d").collect()}
    assert got == {i: inspect.cleandoc(d) for i, d in enumerate(docs)}


def test_strip_docstrings_values(spark):
    codes = ['def f():\n    """Doc. """\n    return 1', 'class A:\n\t"""a\n\n\t\tb\n\t  \n\tc\n\t"""\n\tx = 1',
             "def f():\n    u'unicode kind'\n    return 2"]
    dim = T.code_dim(spark.createDataFrame([(c,) for c in codes], "func_code string"))
    got = {r.code: r.docstrings for r in N.strip_docstrings(N.node_table(dim), dim).join(dim, "code_id").collect()}
    for c in codes:
        assert got[c] == ast.get_docstring(ast.parse(c).body[0])


# --- subroutines ----------------------------------------------------------------------------

def test_subroutine_names_as_the_lexer_takes_them(spark):
    code = "def a·b():\n    return 1\n\ndef β():\n    return 2\n\ndef f():\n    return a·b() + xβ() + " + "z" * 20_000 + " + g(1)\n"
    dim = T.code_dim(spark.createDataFrame([(code,)], "func_code string"))
    ft = FN.function_table(T.token_table(dim), dim)
    wanted = ft.select("code_id", F.lit("f").alias("func_name")).distinct()
    mains = FN.last_definition(ft, wanted)
    assert sorted(r.name for r in FN.subroutines(ft, mains).collect()) == ["a·b", "β"]
    assert [r.name for r in FN.subroutines(ft, mains, word_boundary=True).collect()] == ["a·b"]


# --- typed docstring ------------------------------------------------------------------------

def test_typed_docstring_keeps_every_row(spark):
    cases = [
        ("def f(a):", "assert f(1,) == 2", ":type a: tuple\n:rtype: int"),
        ("def f(a):", "assert f(1) == (2,)", ":type a: int\n:rtype: tuple"),
        ("def f(a):", "assert f(1+2j) == -3j", ":type a: complex\n:rtype: complex"),
        ("def f(a, b):", "assert f(1, 'x') == None", ":type a: int\n:type b: str\n:rtype: NoneType"),
        ("def f():", "assert f() == True", ":rtype: bool"),
        ("def f(a, b):", "assert f(1,) == 2", ":type a: int\n:rtype: int"),
        ("def f(a, b):", "assert f(1) == 2", None),
        ("", "assert f(1) == 2", None),
        ("def f(a):", "assert f(1)", None),
        ("def f(a):", "f(1) == 2", None),
        ("def f(a):", None, None),
        (None, "assert f(1) == 2", None),
    ]
    df = spark.createDataFrame([(i, c, "D", t) for i, (c, t, _) in enumerate(cases)],
                               "sub_id long, func_code string, description string, test string")
    got = {r.sub_id: r.typed for r in testcases.typed_docstring(df).collect()}
    assert sorted(got) == list(range(len(cases)))
    for i, (_, _, middle) in enumerate(cases):
        assert (got[i] is None) if middle is None else got[i].split("\n\n")[1] == middle, cases[i]


def test_clean_programs_may_keep_docstrings(spark):
    code = 'def f():\n    """Doc\n\n      text  \n    """\n    # c\n    return 1  # d\n\n'
    dim = T.code_dim(spark.createDataFrame([(code,)], "func_code string"))
    job = T.token_table(dim)
    kept = T.clean_programs(job, dim, remove_docstring=False).first().cleaned
    assert kept == 'def f():\n    """Doc\n\n      text  \n    """\n    return 1'
    assert T.clean_programs(job, dim).first().cleaned == "def f():\n    return 1"
