"""Test-string column functions.

A test string is an optional prelude followed by
``assert f(..) == v and f(..) == w``.  Cases are split with Catalyst string
functions; nothing is evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from progcorpus.functions.lines import _at, py_strip

CASE_TYPE = "array<struct<case_no:int,input:string,expected:string>>"

# How a test string is cut into cases.
ASSERT = "assert"            # the cases start at its first occurrence; every occurrence is deleted
CASE_SEPARATOR = " and "     # between cases
EQUALS = "=="                # between input and expected value
CALL_EQUALS_SPACED = ") =="  # rewritten to CALL_EQUALS before a call-aware split
CALL_EQUALS = ")=="


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _assert_body(test) -> Column:
    """Text from the first ``assert`` on, every ``assert`` deleted, stripped;
    null when there is no ``assert`` (D15: no cases)."""
    t = _c(test)
    pos = F.instr(t, ASSERT)
    return F.when(pos > 0, py_strip(F.replace(F.substr(t, pos), F.lit(ASSERT), F.lit(""))))


def split_asserts(test) -> Column:
    """cases split on ``" and "``, each on a bare
    ``==``; the input keeps its spacing, the expected value is stripped (D17);
    a case that does not split in exactly two gets a null expected (D16)."""
    body = _assert_body(test)
    cases = F.split(body, CASE_SEPARATOR, -1)

    def one(case, i):
        parts = F.split(case, EQUALS, -1)
        ok = F.size(parts) == 2
        return F.struct(i.cast("int").alias("case_no"),
                        F.when(ok, _at(parts, 1)).otherwise(case).alias("input"),
                        F.when(ok, py_strip(_at(parts, 2))).alias("expected"))

    return F.when(body.isNull(), F.array().cast(CASE_TYPE)).otherwise(F.transform(cases, one))


def split_call_asserts(test) -> Column:
    """like F4 but ``") =="`` becomes ``")=="``
    and cases split on ``")=="``, giving the ``)`` back to the input."""
    body = F.replace(_assert_body(test), F.lit(CALL_EQUALS_SPACED), F.lit(CALL_EQUALS))
    cases = F.split(body, CASE_SEPARATOR, -1)

    def one(case, i):
        parts = F.split(case, CALL_EQUALS.replace(")", "\\)"), -1)
        ok = F.size(parts) == 2
        return F.struct(i.cast("int").alias("case_no"),
                        F.when(ok, F.concat(_at(parts, 1), F.lit(")"))).otherwise(case).alias("input"),
                        F.when(ok, py_strip(_at(parts, 2))).alias("expected"))

    return F.when(body.isNull(), F.array().cast(CASE_TYPE)).otherwise(F.transform(cases, one))


def test_prelude(test) -> Column:
    """text before the first ``assert``, stripped; ``''``
    when there is no ``assert`` (D15) or no test."""
    t = _c(test)
    pos = F.instr(t, ASSERT)
    return F.coalesce(F.when(pos > 0, py_strip(F.substring(t, 1, pos - 1))), F.lit(""))


def fill(template: str, **parts) -> Column:
    """A text template as a column: each ``{name}`` becomes the column
    ``parts[name]``; null when any part is null (``concat`` semantics)."""
    import re

    pieces, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        pieces += [F.lit(template[pos:m.start()]), parts[m.group(1)]]
        pos = m.end()
    pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces)


def three_digits(n) -> Column:
    """F9 ``"{:03d}".format(i)``: zero-padded to three digits, wider past 999."""
    return F.format_string("%03d", _c(n).cast("long"))
