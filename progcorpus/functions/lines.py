"""Line-level column functions.

All of them are Catalyst expressions: they stay inside whole-stage codegen
and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(arr, i):
    """1-based array element, null when out of range (ANSI-safe)."""
    return F.try_element_at(arr, i if isinstance(i, Column) else F.lit(i))


# Line terminators of Python's ``str.splitlines``.
LINE_BREAK = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"
LINE_BREAK_CHARS = "\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029"
LINE_BREAK_AT_END = "[\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]\\z"
# Characters for which Python's ``str.isspace`` is true.
PY_SPACE = ("[\\t\\n\\u000B\\u000C\\r\\u001C-\\u001F \\u0085\\u00A0\\u1680\\u2000-\\u200A"
            "\\u2028\\u2029\\u202F\\u205F\\u3000]")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()`` with Python's whitespace set (Spark's ``trim`` only drops spaces)."""
    return F.regexp_replace(_c(col), f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def py_lstrip(col) -> Column:
    return F.regexp_replace(_c(col), f"^{PY_SPACE}+", "")


def py_rstrip(col) -> Column:
    return F.regexp_replace(_c(col), f"{PY_SPACE}+$", "")


# one line of ``splitlines``: a maximal run of non-break characters, or the
# empty line that starts at a break (after the start, a break other than the
# "\r" of "\r\n", or a lone "\r")
_LINE = (f"[^{LINE_BREAK_CHARS}]++"
         f"|(?:(?<=^|[\\n\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029])|(?<=\\r)(?!\\n))"
         f"(?=[{LINE_BREAK_CHARS}])")


def splitlines(col) -> Column:
    """``str.splitlines()``: no trailing empty piece, ``[]`` for ``''``.
    One cached pattern (``split`` would compile its pattern per row)."""
    return F.regexp_extract_all(_c(col), F.lit(_LINE), 0)


def line_count(col) -> Column:
    """number of lines under ``splitlines`` rules."""
    c = _c(col)
    ends_open = F.when((c != "") & ~c.rlike(LINE_BREAK_AT_END), 1).otherwise(0)
    return (F.regexp_count(c, F.lit(LINE_BREAK)) + ends_open).cast("long")


def strip_generation_lines(col) -> Column:
    """drop lines starting with ``<``
    or, once stripped, with ``#``; rejoin with ``\\n``."""
    kept = F.filter(splitlines(col),
                    lambda l: ~(l.startswith("<") | py_lstrip(l).startswith("#")))
    return F.array_join(kept, "\n")


def implementation_start(col) -> Column:
    """0-based line after the last line
    holding ``\"\"\"``, else after the last line starting with ``def``;
    null when neither exists (the reference raises)."""
    lines = F.split(_c(col), "\n", -1)
    last_doc = F.array_max(F.transform(lines, lambda l, i: F.when(l.contains('"""'), i)))
    last_def = F.array_max(F.transform(lines, lambda l, i: F.when(l.startswith("def"), i)))
    return (F.coalesce(last_doc, last_def) + 1).cast("int")


def leading_space(col) -> Column:
    """Leading whitespace of a line (what ``len(l) - len(l.lstrip())`` measures)."""
    return F.regexp_extract(_c(col), f"^{PY_SPACE}*", 0)


def body_indentation(cleaned) -> Column:
    """F10 applied to already-cleaned text: leading
    whitespace of line 1; null for a single-line program (the reference raises)."""
    lines = F.split(_c(cleaned), "\n", -1)
    return F.when(F.size(lines) > 1, leading_space(_at(lines, 2)))


def indent_docstring(docstring, indentation) -> Column:
    """Docstring layout: stripped lines, summary on the
    opening quotes, the rest indented, closing quotes on their own line."""
    lines = F.transform(splitlines(py_strip(docstring)), lambda l: py_strip(l))
    ind = _c(indentation)
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
                       lambda l: F.concat(ind, l))
    joined = F.array_join(F.concat(F.slice(lines, 1, 1), rest), "\n")
    return (F.when(F.size(lines) == 0, F.lit(None).cast("string"))
            .when(F.size(lines) == 1, F.concat(ind, F.lit('"""'), _at(lines, 1), F.lit('"""')))
            .otherwise(F.concat(ind, F.lit('"""'), joined, F.lit("\n"), ind, F.lit('"""'))))


def attach_docstring(code, docstring) -> Column:
    """F8: insert the indented docstring after line 0,
    indented like line 1; null for one-line code (the reference raises)."""
    lines = F.split(_c(code), "\n", -1)
    ind = leading_space(_at(lines, 2))
    doc = indent_docstring(docstring, ind)
    merged = F.concat(F.slice(lines, 1, 1), F.array(doc),
                      F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when((F.size(lines) > 1) & doc.isNotNull(), F.array_join(merged, "\n"))


def dedent(col) -> Column:
    """F11 ``textwrap.dedent``: blank out whitespace-only lines, then remove
    the longest common run of leading spaces/tabs of the other lines (what the
    least and the greatest of these runs have in common).  Most texts have neither
    and are told by two patterns, their lines are not taken apart."""
    margin = ~_c(col).rlike("(?:^|\\n)[^ \\t\\n]")
    blanks = _c(col).rlike("(?:^|\\n)[ \\t]++[\\r\\x{85}\\x{2028}\\x{2029}]?(?:\\n|\\z)")
    lines = F.transform(F.split(_c(col), "\n", -1),
                        lambda l: F.when(l.rlike("^[ \\t]+$"), F.lit("")).otherwise(l))

    def cut(lines):         # a lambda's variable, so the lines are made once
        margins = F.transform(F.filter(lines, lambda l: l != ""), lambda l: F.regexp_extract(l, "^[ \\t]*", 0))
        low, high = F.array_min(margins), F.array_max(margins)
        shared = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), F.lit(0),
            lambda k, i: F.when((k == i - 1) & (i <= F.length(low)) & (F.substring(low, i, F.lit(1)) == F.substring(high, i, F.lit(1))), i)
            .otherwise(k))
        size = F.coalesce(shared, F.lit(0))
        return F.get(F.transform(F.array(size), lambda n: F.array_join(
            F.transform(lines, lambda l: F.substr(l, n + 1)), "\n")), F.lit(0))

    return F.when(margin | blanks, F.get(F.transform(F.array(lines), cut), F.lit(0))).otherwise(_c(col))


def clean_docstring(col) -> Column:
    """A docstring as documentation tools show it: tabs
    expanded to multiples of eight, the first line without leading spaces, the
    least indentation of the other non-blank lines taken off all of them, and
    empty lines at both ends dropped (blanks at line ends stay)."""
    def expand(line):
        parts = F.split(line, "\t", -1)
        return F.aggregate(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _at(parts, 1),
            lambda acc, x: F.concat(acc, F.repeat(F.lit(" "), (8 - F.length(F.substring_index(acc, "\r", -1)) % 8).cast("int")), x))

    def indent(line):
        return F.length(line) - F.length(F.ltrim(line))

    def shown(lines):       # lambdas' variables, so lines and margin are made once
        rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
        margin = F.coalesce(F.array_min(F.transform(F.filter(rest, lambda l: F.ltrim(l) != ""), indent)), F.lit(0))
        return F.get(F.transform(F.array(margin), lambda m: F.array_join(F.transform(
            lines, lambda l, i: F.when(i == 0, F.ltrim(l)).otherwise(F.substr(l, m + 1))), "\n")), F.lit(0))

    lines = F.transform(F.split(_c(col), "\n", -1), expand)
    return F.regexp_replace(F.get(F.transform(F.array(lines), shown), F.lit(0)), "\\A\n+|\n+\\z", "")


def clean_docstrings(df, col: str):
    """``col`` replaced by the docstring as documentation tools show it."""
    return df.withColumn(col, clean_docstring(col))


def with_docstring(df, code_col: str, doc_col: str, out: str = "with_doc"):
    """F8 over a DataFrame: ``attach_docstring`` with every intermediate
    staged as a column, so each is computed once per row."""
    staged = (df.withColumn("_lines", F.split(F.col(code_col), "\n", -1))
              .withColumn("_dl", F.transform(splitlines(py_strip(doc_col)), lambda l: py_strip(l)))
              .withColumn("_ind", leading_space(_at(F.col("_lines"), 2))))
    lines, dl, ind = F.col("_lines"), F.col("_dl"), F.col("_ind")
    rest = F.transform(F.slice(dl, 2, F.greatest(F.size(dl) - 1, F.lit(0))), lambda l: F.concat(ind, l))
    doc = (F.when(F.size(dl) == 0, F.lit(None).cast("string"))
           .when(F.size(dl) == 1, F.concat(ind, F.lit('"""'), _at(dl, 1), F.lit('"""')))
           .otherwise(F.concat(ind, F.lit('"""'), F.array_join(F.concat(F.slice(dl, 1, 1), rest), "\n"),
                               F.lit("\n"), ind, F.lit('"""'))))
    staged = staged.withColumn("_doc", doc)
    merged = F.concat(F.slice(lines, 1, 1), F.array(F.col("_doc")),
                      F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    return (staged.withColumn(out, F.when((F.size(lines) > 1) & F.col("_doc").isNotNull(), F.array_join(merged, "\n")))
            .drop("_lines", "_dl", "_ind", "_doc"))


# --- cutting many spans out of one text ---------------------------------------------------

_CHUNK = 1024


def cut_spans(code: Column, spans: Column, make) -> Column:
    """The array of ``make(span, cut)`` for every element of ``spans``, where
    ``cut(off, end)`` is the text between two character offsets.

    The text is cut into chunks once and a span is taken from the chunks it
    touches, so a text is read once however many spans are cut from it (a plain
    ``substring`` counts characters from the beginning each time)."""
    def cut_from(chunks):
        def cut(off, end):
            off, end = off.cast("int"), end.cast("int")
            first = F.floor(off / _CHUNK).cast("int")
            n = F.floor((end - 1) / _CHUNK).cast("int") - first + 1
            return F.when(end <= off, F.lit("")).otherwise(
                F.substring(F.array_join(F.slice(chunks, first + 1, n), ""), off - first * _CHUNK + 1, end - off))
        return cut

    # the chunks are a lambda's variable, hence made once
    chunks = F.regexp_extract_all(code, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return F.get(F.transform(F.array(chunks), lambda c: F.transform(spans, lambda s: make(s, cut_from(c)))), F.lit(0))
