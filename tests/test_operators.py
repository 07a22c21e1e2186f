
from pyspark.sql import functions as F

from progcorpus.functions.testspec import three_digits
from progcorpus.operators import dedup as D
from progcorpus.operators import export, grading, sampling, testcases
from progcorpus.operators import nodes as N
from progcorpus.operators import tokens as T

SUB = "sub_id long, func_name string, func_code string"


def _subs(rows, spark):
    return spark.createDataFrame(rows, SUB)


def test_mad_edges(spark):
    rows = [(1, "solo", "a\nb\nc"),                                  # group of one
            (2, "same", "x"), (3, "same", "y"), (4, "same", "z"),    # MAD 0: keep all
            (5, "even", "a"), (6, "even", "a\nb"), (7, "even", "a\nb\nc"), (8, "even", "\n" * 40)]
    out = sampling.mad_outliers(_subs(rows, spark), "func_name")
    kept = sorted(r.sub_id for r in out.collect())
    assert kept == [1, 2, 3, 4, 5, 6, 7]
    assert "n_lines" in out.columns


def test_mad_never_drops_at_or_below_median(spark):
    rows = [(i, "g", "\n" * (i % 7) + "x") for i in range(60)] + [(100, "g", "\n" * 500)]
    out = sampling.mad_outliers(_subs(rows, spark), "func_name")
    meds = sorted(r.n_lines for r in sampling.with_line_count(_subs(rows, spark)).collect())
    median = (meds[len(meds) // 2] + meds[(len(meds) - 1) // 2]) / 2
    kept = {r.sub_id for r in out.collect()}
    for r in sampling.with_line_count(_subs(rows, spark)).collect():
        if r.n_lines <= median:
            assert r.sub_id in kept
    assert 100 not in kept


def test_modal_tie_goes_to_first_seen(spark):
    rows = [(5, "q", "B"), (1, "q", "A"), (7, "q", "A"), (2, "q", "B"), (9, "q", "C")]
    out = sampling.modal_program(_subs(rows, spark), "func_name").collect()
    assert [(r.modal_code, r.modal_count) for r in out] == [("A", 2)]


def test_head_percent_identity_and_ceil(spark):
    rows = [(i, "q" if i < 7 else "r", "x") for i in range(10)]
    df = _subs(rows, spark)
    assert sampling.head_percent(df, 100, "func_name").count() == 10
    got = sorted(r.sub_id for r in sampling.head_percent(df, 33, "func_name").collect())
    assert got == [0, 1, 2, 7]            # ceil(7*.33)=3, ceil(3*.33)=1
    assert sampling.keep_percentage(df, "all", "func_name").count() == 10


def test_head_percent_hot_group_spread(spark):
    # one group with most rows: numbering stays exact across partitions
    rows = [(i, "hot" if i % 10 else f"c{i}", "x") for i in range(3000)]
    df = _subs(rows, spark).repartition(8)
    got = sampling.head_percent(df, 10, "func_name").where(F.col("func_name") == "hot")
    ids = sorted(r.sub_id for r in got.collect())
    hot = sorted(i for i in range(3000) if i % 10)
    assert ids == hot[:270]


def test_numbering_past_999(spark):
    rows = [(i, "q", "x", "d", None, True, False) for i in range(1, 1003)]
    df = spark.createDataFrame(rows, "sub_id long, func_name string, func_code string, description string, "
                                     "test string, correct boolean, ref_sol boolean")
    out = export.program_numbers(df).select(three_digits("program_no").alias("n")).collect()
    names = sorted(r.n for r in out)
    assert names[0] == "001" and "999" in names and "1002" in names


def test_test_strings(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x = 1"), (4, "assert f(1) == 2\nassert f(2) == 3"),
                                (5, "assert f(1) ==2 and f(2)== 3 and g(1)"), (6, "P = 1\nassert f(3) == 4")],
                               "sub_id long, test string")
    cases = {(r.sub_id, r.case_no): (r.input, r.expected) for r in testcases.assert_cases(df).collect()}
    assert (1, 0) not in cases and (2, 0) not in cases and (3, 0) not in cases
    # two assert lines: one case that splits in three on "==" -> null expected
    assert cases[(4, 0)] == ("f(1) == 2\n f(2) == 3", None)
    assert cases[(5, 0)] == ("f(1) ", "2") and cases[(5, 1)] == ("f(2)", "3") and cases[(5, 2)] == ("g(1)", None)
    assert cases[(6, 0)] == ("f(3) ", "4")


def test_call_split_and_prelude(spark):
    df = spark.createDataFrame([(1, "q", "OFFSET = 1\nassert f(1, 2) == 3 and f(2)==4")],
                               "sub_id long, func_name string, test string")
    t = testcases.test_case_table(df).orderBy("case_no").collect()
    assert [(r.input, r.expected) for r in t] == [("f(1, 2)", "3"), ("f(2)", "4")]
    p = testcases.test_preludes(df).collect()
    assert p[0].prelude == "OFFSET = 1"


def test_grade_without_outcomes_is_false(spark):
    subs = _subs([(1, "q", "x"), (2, "q", ""), (3, "q", "y")], spark)
    obs = spark.createDataFrame([(1, 0, True), (1, 1, True), (2, 0, True), (3, 0, False)],
                                "sub_id long, case_no int, passed boolean")
    out = {r.sub_id: r.correct for r in grading.grade_submissions(subs, obs).collect()}
    assert out == {1: True, 2: False, 3: False}


def _classes(spark, rows):
    subs = T.with_code_id(_subs(rows, spark))
    dim = T.code_dim(subs)
    nt = N.node_table(dim)
    canon = D.canonical_form(nt, subs.select("code_id", "func_name").distinct())
    return {r.sub_id: r.normalized for r in D.with_classes(subs, canon).collect()}, subs, canon


def test_canonical_form_is_rename_invariant(spark):
    a = "def f(p, q):\n    t = p * q\n    for i in range(t):\n        t += i\n    return t"
    b = "def f(x, y):\n    z = x * y\n    for k in range(z):\n        z += k\n    return z"
    c = "def f(x, y):\n    z = x * y\n    return z"
    d = "def f(x, y):\n    z = x * y\n    for k in range(z):\n        z += 2\n    return z"
    cls, _, _ = _classes(spark, [(1, "f", a), (2, "f", b), (3, "f", c), (4, "f", d), (5, "f", "def g(): pass")])
    assert cls[1] == cls[2]
    assert len({cls[1], cls[3], cls[4]}) == 3
    assert cls[5] is None


def test_unique_solutions_idempotent(spark):
    rows = [(1, "f", "def f(a):\n    return a"), (2, "f", "def f(b):\n    return b"),
            (3, "f", "def f(a):\n    return a"), (4, "f", "def f(a):\n    return -a"), (5, None, "x")]
    _, subs, canon = _classes(spark, rows)
    once = D.unique_solutions(subs, canon).select("sub_id", "func_name", "func_code", "code_id")
    assert sorted(r.sub_id for r in once.collect()) == [3, 4]
    subs2 = once.select("sub_id", "func_name", "func_code", "code_id")
    nt2 = N.node_table(T.code_dim(subs2))
    canon2 = D.canonical_form(nt2, subs2.select("code_id", "func_name").distinct())
    twice = D.unique_solutions(subs2, canon2)
    assert sorted(r.sub_id for r in twice.collect()) == [3, 4]


def test_docstrings_and_pass(spark):
    rows = [(1, "f", 'def f():\n    """Only doc."""\n'), (2, "f", 'class A:\n    """Doc\n\n    more"""\n    x = 1')]
    subs = T.with_code_id(_subs(rows, spark))
    dim = T.code_dim(subs)
    out = {r.code_id: (r.stripped, r.docstrings) for r in N.strip_docstrings(N.node_table(dim), dim).collect()}
    got = {s: out[c] for s, c in [(r.sub_id, r.code_id) for r in subs.collect()]}
    assert got[1] == ("def f():\n    pass\n", "Only doc.")
    assert got[2] == ("class A:\n    x = 1", "Doc\n\nmore")


def test_subroutines_substring_rule(spark):
    from progcorpus.operators import functions as FN

    code = "def h(x):\n    return x\ndef main(a):\n    return xh(a)\ndef xh(y):\n    return y\n"
    subs = T.with_code_id(_subs([(1, "main", code)], spark))
    dim = T.code_dim(subs)
    ft = FN.function_table(T.token_table(dim), dim)
    mains = FN.last_definition(ft, subs.select("code_id", "func_name"))
    raw = sorted(r.name for r in FN.subroutines(ft, mains).collect())
    strict = sorted(r.name for r in FN.subroutines(ft, mains, word_boundary=True).collect())
    assert raw == ["h", "xh"]        # "h(" is a substring of "xh(" (D21)
    assert strict == ["xh"]


def test_inline_docstring_goes_with_its_separator(spark):
    rows = [(1, "f", 'def f(): "doc"; return 1\n'), (2, "f", 'def f(a):\n    "doc"  # c\n    return a')]
    subs = T.with_code_id(_subs(rows, spark))
    dim = T.code_dim(subs)
    out = {r.code_id: (r.stripped, r.docstrings) for r in N.strip_docstrings(N.node_table(dim), dim).collect()}
    got = {s: out[c] for s, c in [(r.sub_id, r.code_id) for r in subs.collect()]}
    assert got[1] == ("def f(): return 1\n", "doc")
    assert got[2] == ("def f(a):\n    return a", "doc")


def test_clean_keeps_a_body(spark):
    rows = [(1, "f", 'def f():\n    """TODO"""\n\ndef g():\n    # c\n    "x"\n    return 1\n')]
    subs = T.with_code_id(_subs(rows, spark))
    dim = T.code_dim(subs)
    out = [r.cleaned for r in T.clean_programs(T.token_table(dim), dim).collect()]
    assert out == ["def f():\n    pass\ndef g():\n    return 1"]


def test_global_names_are_not_renamed(spark):
    a = "def f(p):\n    global total\n    total = p\n    return total"
    b = "def f(q):\n    global total\n    total = q\n    return total"
    c = "def f(q):\n    global other\n    other = q\n    return other"
    d = "def f(q):\n    total = q\n    return total"
    cls, _, _ = _classes(spark, [(1, "f", a), (2, "f", b), (3, "f", c), (4, "f", d)])
    assert cls[1] == cls[2]
    assert cls[1] != cls[3] and cls[1] != cls[4]


def test_literal_types_match_literal_eval(spark):
    import ast

    pieces = ["1", "-2", "3.5", "1e3", "2j", "'s'", '"t"', "b'x'", "True", "None", "[1, [2]]", "(1, 2)", "()",
              "{}", "{1: 2}", "{1, 2}", "(3)", "0x1F", "-1.5", "rb'q'"]
    groups = [pieces[i:i + 3] for i in range(0, len(pieces), 3)]
    df = spark.createDataFrame([(i, ", ".join(g)) for i, g in enumerate(groups)], "k int, t string")
    got = {r.k: list(r.types) for r in testcases.literal_types(df, "k", "t").collect()}
    for i, g in enumerate(groups):
        assert got[i] == [type(ast.literal_eval(p)).__name__ for p in g], g



def test_canonical_form_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    template = ("def f({a}, {b}):\n    {c} = {a} * 2\n    for {d} in range({b}):\n        {c} += {d}\n"
                "    return [{e} for {e} in ({c}, {a})]")
    ident = st.from_regex(r"[a-z][a-z0-9_]{0,6}", fullmatch=True).filter(
        lambda s: s not in {"f", "range", "for", "in", "if", "or", "and", "not", "is", "as", "def", "del",
                            "try", "with", "else", "elif", "pass", "from", "while", "return", "yield",
                            "import", "global", "lambda", "class", "raise", "break", "async", "await",
                            "assert", "except", "finally", "continue", "nonlocal"})

    @settings(max_examples=4, deadline=None)
    @given(st.lists(ident, min_size=5, max_size=5, unique=True))
    def check(names):
        a, b, c, d, e = names
        renamed = template.format(a=a, b=b, c=c, d=d, e=e)
        base = template.format(a="p", b="q", c="r", d="s", e="t")
        changed = base.replace("* 2", "* 3")
        cls, _, _ = _classes(spark, [(1, "f", base), (2, "f", renamed), (3, "f", changed)])
        assert cls[1] == cls[2]
        assert cls[1] != cls[3]

    check()


def test_group_median_matches_statistics(spark):
    import random
    import statistics
    from collections import Counter

    from progcorpus.operators.ordering import group_median

    random.seed(3)
    groups = [[random.randint(0, 9) for _ in range(random.randint(1, 40))] for _ in range(30)]
    rows = [(g, float(v), c) for g, vals in enumerate(groups) for v, c in Counter(vals).items()] + [(None, 1.0, 5)]
    df = spark.createDataFrame(rows, "g int, v double, c long")
    got = {r.g: r["median"] for r in group_median(df, ["g"], "v", "c").collect()}
    assert got == {g: float(statistics.median(vals)) for g, vals in enumerate(groups)}


def test_running_sums_over_many_partitions(spark, monkeypatch):
    from progcorpus.operators import ordering

    monkeypatch.setattr(ordering, "TASK_ROWS", 7)
    rows = [(g, v, v % 5 + 1) for g in ("hot", "cold") for v in range(60 if g == "hot" else 3)]
    df = spark.createDataFrame(rows, "g string, v int, c long")
    got = {(r.g, r.v): r.running for r in ordering.group_running_sum(df, ["g"], "v", "c").collect()}
    assert got == {(g, v): sum(c for h, u, c in rows if h == g and u <= v) for g, v, _ in rows}
    numbered = ordering.group_row_number(df, ["g"], [F.col("v").desc()])
    assert {(r.g, r.v): r.rn for r in numbered.collect()} == {
        (g, v): sum(h == g and u >= v for h, u, _ in rows) for g, v, _ in rows}
