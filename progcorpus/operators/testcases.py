"""Per-question test jobs (F4 as a table, F5, F6, W3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.functions.lines import _at
from progcorpus.functions.testspec import (ASSERT, CASE_SEPARATOR, EQUALS, fill, split_asserts,
                                           split_call_asserts, test_prelude)
from progcorpus.operators.grading import is_tested
from progcorpus.session import materialize


def assert_cases(df: DataFrame, key: str = "sub_id", test_col: str = "test") -> DataFrame:
    """F4 over a table: one row per (row, case) with ``case_no, input, expected``."""
    return (df.select(key, F.inline_outer(split_asserts(test_col)))
            .where(F.col("case_no").isNotNull()))


def first_tested(df: DataFrame, group: str = "func_name", order_col: str = "sub_id",
                 test_col: str = "test") -> DataFrame:
    """W7 + P5: the first tested row's test string of each question."""
    return df.where(is_tested(test_col)).groupBy(group).agg(
        F.min_by(test_col, F.col(order_col)).alias("first_test"))


def test_case_table(df: DataFrame, group: str = "func_name", order_col: str = "sub_id",
                    test_col: str = "test") -> DataFrame:
    """F5 + W3: ``func_name, case_no (0-based), input, expected`` from the
    first tested row of each question; a question without one has no rows."""
    first = first_tested(df, group, order_col, test_col)
    return first.select(group, F.inline(split_call_asserts("first_test")))


def test_preludes(df: DataFrame, group: str = "func_name", order_col: str = "sub_id",
                  test_col: str = "test") -> DataFrame:
    """F6 for every question: the first tested row's prelude, ``''`` when the
    question has no tested row."""
    questions = df.select(group).where(F.col(group).isNotNull()).distinct()
    first = first_tested(df, group, order_col, test_col)
    return (questions.join(first, on=group, how="left")
            .select(group, test_prelude("first_test").alias("prelude")))


# The fields of a typed docstring.
TYPE_LINE = ":type {arg}: {type}"
RTYPE_LINE = ":rtype: {type}"
EXAMPLE_HEADER = ":Example:"
EXAMPLE_PREFIX = "  >>> "


def _scalar_type(tok, nxt=None):
    """Python type name of a literal from its first token (and the next one
    after a sign)."""
    num = lambda t: (F.when(t.rlike("[jJ]$"), F.lit("complex"))
                     .when(~t.rlike("^0[xXoObB]") & t.rlike("[.eE]"), F.lit("float"))
                     .otherwise(F.lit("int")))
    out = (F.when(tok.rlike("^[rRuUfF]*['\"]"), F.lit("str"))
           .when(tok.rlike("^[rRbB]*[bB][rR]*['\"]"), F.lit("bytes"))
           .when(tok.rlike("^\\.?\\d"), num(tok))
           .when(tok.isin("True", "False"), F.lit("bool"))
           .when(tok == "None", F.lit("NoneType")))
    if nxt is not None:
        out = F.when(tok.isin("-", "+") & nxt.rlike("^\\.?\\d"), num(nxt)).otherwise(out)
    return out


def literal_types(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Type names of the comma-separated top-level literals of ``text_col``:
    ``key, types`` (array in order) and ``is_tuple`` (there is a top-level
    comma, be it a trailing one, so the whole is a tuple).  The text is cut by
    the library lexer; a running bracket depth (window per row key) finds the
    top-level commas."""
    from pyspark.sql import Window

    from progcorpus.functions.lexer import LEX

    t = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(LEX), 0)).alias("p", "tok"))
    t = t.where(~F.col("tok").rlike("^[ \\t\\f\\r\\n\\\\]"))
    w = Window.partitionBy(key).orderBy("p")
    step = F.when(F.col("tok").isin("(", "[", "{"), 1).when(F.col("tok").isin(")", "]", "}"), -1).otherwise(0)
    t = t.withColumn("_d", F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("_cut", (F.col("tok") == ",") & (F.col("_d") == 0))
    t = t.withColumn("piece", F.sum(F.col("_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("is_tuple", F.max("_cut").over(Window.partitionBy(key))).where(~F.col("_cut"))
    # a piece of more tokens that ends in an imaginary number is a complex one (1+2j)
    pieces = t.groupBy(key, "piece").agg(
        F.any_value("is_tuple").alias("is_tuple"),
        F.max_by("tok", "p").rlike("^\\.?\\d[\\w.]*[jJ]$").alias("_imag"),
        F.min_by("tok", "p").alias("_t0"),
        _at(F.array_sort(F.collect_list(F.struct("p", "tok"))), 2)["tok"].alias("_t1"),
        F.count(F.lit(1)).alias("_n"),
        F.max(((F.col("tok") == ":") & (F.col("_d") == 1)).cast("int")).alias("_colon"),
        F.max(((F.col("tok") == ",") & (F.col("_d") == 1)).cast("int")).alias("_comma"))
    paren = F.when((F.col("_n") == 2) | (F.col("_comma") == 1), F.lit("tuple")) \
        .otherwise(_scalar_type(F.coalesce(F.col("_t1"), F.lit(""))))
    brace = F.when((F.col("_n") == 2) | (F.col("_colon") == 1), F.lit("dict")).otherwise(F.lit("set"))
    ty = (F.when(F.col("_t0") == "[", F.lit("list"))
          .when(F.col("_t0") == "{", brace)
          .when(F.col("_t0") == "(", paren)
          .when(F.col("_imag") & F.col("_t0").rlike("^([-+]|\\.?\\d)"), F.lit("complex"))
          .otherwise(_scalar_type(F.col("_t0"), F.col("_t1"))))
    return pieces.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", ty.alias("ty")))),
                                               lambda s: s["ty"]).alias("types"), F.bool_or("is_tuple").alias("is_tuple"))


def typed_docstring(df: DataFrame, key: str = "sub_id", code_col: str = "func_code",
                    doc_col: str = "description", test_col: str = "test") -> DataFrame:
    """``key, typed`` = docstring, a ``:type arg: T``
    line per positional argument of line 0 (arguments with a default are
    skipped; names trimmed, none for a zero-argument header, D28), ``:rtype:``,
    and an ``:Example:`` block with every case.  Types come from the literals
    of the first case.  One row per input row; ``typed`` is null when a piece
    cannot be typed (the reference raises), the program is empty, or there is no
    ``assert`` (D15).

    Test strings repeat across submissions, so each distinct test string is
    split and typed once and joined back by its hash; line 0 of the program is
    taken per row with a single cached pattern."""
    from progcorpus.functions.lines import LINE_BREAK_CHARS, py_strip

    t = F.col(test_col)
    rows = df.select(key, F.col(doc_col).alias("_doc"), F.col(code_col).alias("_code"),
                     F.sha2(t, 256).alias("_tid"), t.alias("_test"))

    # --- per distinct test string: cases, first case, call arguments, types
    tests = (rows.where(F.instr("_test", ASSERT) > 0).groupBy("_tid")
             .agg(F.any_value("_test").alias("_test")))
    tt = F.col("_test")
    tests = (tests.withColumn("_body", py_strip(F.substr(tt, F.instr(tt, ASSERT) + len(ASSERT))))
             .withColumn("_cases", F.split("_body", CASE_SEPARATOR, -1))
             .withColumn("_first", F.split(_at(F.col("_cases"), 1), EQUALS, -1))
             .where(F.size("_first") == 2)
             .withColumn("_inp", py_strip(_at(F.col("_first"), 1)))
             .withColumn("_out", py_strip(_at(F.col("_first"), 2))))
    i = F.col("_inp")
    tests = tests.withColumn("_o", F.instr(i, "(")).withColumn(
        "_c", F.length(i) - F.instr(F.reverse(i), ")") + 1).withColumn("_has_c", F.instr(i, ")") > 0)
    # the call's argument text: inp[inp.find('(') + 1 : inp.rfind(')')]
    tests = tests.withColumn("_call", F.when((F.col("_o") > 0) & F.col("_has_c") & (F.col("_c") > F.col("_o")),
                                             F.substring(i, F.col("_o") + 1, F.col("_c") - F.col("_o") - 1)))
    tests = materialize(tests.select("_tid", "_cases", "_out", "_call"))      # one row per distinct test
    texts = (tests.select(F.col("_call").alias("_lit")).unionByName(tests.select(F.col("_out").alias("_lit")))
             .where(F.col("_lit").isNotNull()).groupBy(F.sha2("_lit", 256).alias("_lid"))
             .agg(F.any_value("_lit").alias("_lit")))
    types = literal_types(texts, "_lid", "_lit")
    typed_tests = materialize(
        tests.withColumn("_cid", F.sha2("_call", 256)).withColumn("_oid", F.sha2("_out", 256))
        .join(types.select(F.col("_lid").alias("_cid"), F.col("types").alias("_in"),
                           F.col("is_tuple").alias("_in_tuple")), on="_cid", how="left")
        .join(types.select(F.col("_lid").alias("_oid"), F.col("types").alias("_ot"),
                           F.col("is_tuple").alias("_ot_tuple")), on="_oid", how="left")
        .select("_tid", "_cases", "_in", "_in_tuple", "_ot", "_ot_tuple"))

    # --- per row: positional arguments of line 0
    code = F.col("_code")
    rows = rows.withColumn("_line0", F.when(code != "", F.regexp_extract(code, f"^[^{LINE_BREAK_CHARS}]*", 0)))
    line0 = F.col("_line0")
    rows = (rows.withColumn("_lo", F.instr(line0, "("))
            .withColumn("_hi", F.when(F.instr(line0, ")") > 0, F.length(line0) - F.instr(F.reverse(line0), ")"))
                        .otherwise(F.length(line0) - 1)))
    # Python slice line0[find('(') + 1 : rfind(')')] (rfind -1 means "up to the last character")
    arg_text = F.when(F.col("_hi") >= F.col("_lo") + 1,
                      F.substring(line0, F.col("_lo") + 1, F.col("_hi") - F.col("_lo"))).otherwise(F.lit(""))
    rows = rows.withColumn("_args", F.filter(F.transform(F.split(arg_text, ",", -1), lambda a: py_strip(a)),
                                             lambda a: (a != "") & ~a.contains("=")))
    j = rows.select(key, "_doc", "_args", "_line0", "_tid").join(typed_tests, on="_tid", how="left")

    n_args, n_in = F.size("_args"), F.coalesce(F.size("_in"), F.lit(0))
    in_tuple = F.coalesce("_in_tuple", F.lit(False)) | (n_in == 0)         # "()" is a tuple too
    # one parameter takes the whole literal; several parameters zip with the pieces
    param_types = F.when(n_args == 1, F.array(F.when(in_tuple, F.lit("tuple")).otherwise(_at(F.col("_in"), 1)))) \
        .otherwise(F.coalesce(F.col("_in"), F.array().cast("array<string>")))
    # zip stops at the shorter list: padded pairs give null lines, dropped below
    type_lines = F.zip_with(F.col("_args"), param_types,
                            lambda a, ty: fill(TYPE_LINE, arg=a, type=ty))
    rtype = F.when(F.col("_ot_tuple"), F.lit("tuple")).otherwise(_at(F.col("_ot"), 1))
    lines = F.concat(F.filter(type_lines, lambda l: l.isNotNull()),
                     F.array(fill(RTYPE_LINE, type=rtype)))
    example = F.concat(F.lit(EXAMPLE_HEADER + "\n"),
                       F.array_join(F.transform("_cases", lambda c: F.concat(F.lit(EXAMPLE_PREFIX), c)), "\n"))
    typed = F.concat(F.col("_doc"), F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\n"), example)
    typed_all = ~F.exists(F.slice(param_types, 1, F.least(n_args, F.size(param_types))), lambda x: x.isNull())
    # several parameters need a tuple of inputs (a lone literal does not unpack)
    ok = F.col("_line0").isNotNull() & typed_all & rtype.isNotNull() & ((n_args <= 1) | in_tuple)
    return j.select(key, F.when(ok, typed).alias("typed"))
