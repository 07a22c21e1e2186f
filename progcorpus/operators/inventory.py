"""Construct inventories (A5, A8; with the syntax tree also J2, J3, P8, T7).

Each construct is a filter of a text's tokens; positions are token
positions (whitespace tokens included, D4), sorted and collected per construct
value.  A text meets its variables in the row of its parse (``nodes.with_variables``), is lexed there and
its constructs are gathered there: one sort of the tokens that count, so no token row is
shuffled, joined or grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from progcorpus.functions.lexer import lex, token_kind
from progcorpus.functions.tokenstate import let, of_line, read_if_tokenizes
from progcorpus.session import splittable

# The operator set the inventories recognise (twenty entries,
# no "*", no augmented assignment, no word operators; "@" and ":=" included).
OPERATORS = ["+", "-", "**", "/", "//", "%", "@", "<<", ">>", "&", "|", "^", "~", ":=",
             "<", ">", "<=", ">=", "==", "!="]


def operator_relation(spark, operators: list[str] | None = None) -> DataFrame:
    """The operator set as a relation (20 rows);
    callers may pass their own list."""
    ops = OPERATORS if operators is None else operators
    # made from one row, so its size is known to the planner (rows from Python have none)
    return spark.range(1).select(F.explode(F.array(*[F.lit(o) for o in ops]).cast("array<string>")).alias("op"))


def _gathered(r, construct) -> Column:
    """The array of ``(construct, src, positions, n)`` of a text as read: its tokens for which ``construct(src)``
    is not null (asked once for each distinct token); ``positions`` are sorted and comma-joined."""
    raw = F.col("raw")
    wanted = F.filter(F.transform(F.array_distinct(raw), lambda t: F.struct(construct(t).alias("construct"), t.alias("src"))),
                      lambda w: w["construct"].isNotNull())

    def of_text(ws):
        def of_piece(x):    # blanks and comments before a line's DEDENT tokens are no constructs
            before = x["at"] + x["shift"] + x["n"]
            return F.filter(F.transform(of_line(raw, x), lambda t, i: let(F.array_position(ws["src"], t), lambda k: F.when(
                k > 0, F.struct(k.cast("int").alias("k"), (before + i).alias("pos"))))), lambda t: t.isNotNull())

        def groups(ts):
            starts = F.filter(F.transform(ts, lambda t, i: F.when(
                (i == 0) | (t["k"] != F.get(ts, i - 1)["k"]), i)), lambda i: i.isNotNull())

            def group(at, after):
                return let(F.get(ws, F.get(ts, at)["k"] - 1), lambda w: F.struct(
                    w["construct"].alias("construct"), w["src"].alias("src"), F.array_join(F.transform(
                        F.slice(ts, at + 1, after - at), lambda t: t["pos"]), ",").alias("positions"), (after - at).cast("long").alias("n")))

            return let(starts, lambda ix: F.transform(ix, lambda at, k: group(at, F.coalesce(F.get(ix, k + 1), F.size(ts)))))

        return let(F.sort_array(F.flatten(F.transform(r["lines"], of_piece))), groups)

    return let(wanted, lambda ws: F.when(F.size(ws) > 0, of_text(ws)))


def _read(texts: DataFrame, ops: DataFrame | None = None) -> DataFrame:
    """``texts`` lexed, with the operator relation as the list ``_ops`` in every row."""
    if ops is not None:
        texts = texts.crossJoin(ops.agg(F.collect_set("op").alias("_ops")))
    return lex(texts)


def _found(construct) -> Column:
    return read_if_tokenizes(F.col("raw"), F.col("marks"), lambda r: _gathered(r, construct))


def _any_construct(variables: bool = True):
    def construct(src):     # a token belongs to at most one
        kind = token_kind(src)
        found = F.when(F.array_contains("_ops", src), F.lit("operators")).when(kind == "NUMBER", F.lit("numbers"))
        if not variables:
            return found
        return found.when(F.array_contains("variables", src), F.lit("variables")).when(kind == "STRING", F.lit("strings"))

    return construct


def operator_tokens(tokens: DataFrame, ops: DataFrame) -> DataFrame:
    """Tokens whose text is in the operator relation (small relations are broadcast by their measured size)."""
    return tokens.join(ops, tokens["src"] == ops["op"], "left_semi")


def construct_inventory(texts: DataFrame, ops: DataFrame) -> DataFrame:
    """A5: ``code_id, construct, src, positions, n``: operators and numbers from tokens alone; where ``texts`` (``code_id, code``)
    have ``variables`` (a list) also variable locations (J2) and strings that are not variable names (J3)."""
    return _read(texts, ops).select("code_id", F.inline(_found(_any_construct("variables" in texts.columns))))


def variable_locations(texts: DataFrame) -> DataFrame:
    """Tokens whose text is one of the program's variables."""
    return _read(texts).select("code_id", F.inline(_found(
        lambda src: F.when(F.array_contains("variables", src), F.lit("variables")))))


def string_tokens(texts: DataFrame) -> DataFrame:
    """STRING tokens whose text is not a variable name."""
    return _read(texts).select("code_id", F.inline(_found(lambda src: F.when(
        (token_kind(src) == "STRING") & ~F.array_contains("variables", src), F.lit("strings")))))


def operator_histogram(tokens: DataFrame, ops: DataFrame, subs: DataFrame,
                       group: str = "func_name") -> DataFrame:
    """Corpus count per (question, operator).  Operators are counted once
    per distinct text, then weighted by how many submissions carry the text,
    so a popular program is tokenised once."""
    per_text = operator_tokens(tokens, ops).groupBy("code_id", "src").agg(F.count(F.lit(1)).alias("_k"))
    copies = subs.groupBy("code_id", group).agg(F.count(F.lit(1)).alias("_m"))
    return (per_text.join(copies, on="code_id", how="inner")
            .groupBy(group, F.col("src").alias("operator"))
            .agg(F.sum(F.col("_k") * F.col("_m")).cast("long").alias("n")))


def has_no_constructs(texts: DataFrame, ops: DataFrame) -> DataFrame:
    """``code_id, is_empty`` — no variable, string, operator or number."""
    counts = let(_found(_any_construct()), lambda found: F.coalesce(F.aggregate(
        found, F.lit(0).cast("long"), lambda n, c: n + c["n"]), F.lit(0).cast("long")))
    return _read(texts, ops).select("code_id", (counts == 0).alias("is_empty"))


def submission_profile(subs: DataFrame, texts: DataFrame, ops: DataFrame) -> DataFrame:
    """The per-program wrapper's state, one row per submission:
    ``sub_id, compile_error, n_tokens, variables, operators``.  ``texts`` are the distinct texts
    with their parse status (P7, ``compile_error``) and their ordered ``variables`` (A6); tokens are read
    in the same row, and the profile of a text is joined to the submissions by ``code_id``."""
    read = read_if_tokenizes(F.col("raw"), F.col("marks"), lambda r: F.struct(r["n_tokens"].alias("n"), F.array_join(
        F.filter("raw", lambda t: F.array_contains("_ops", t)), " ").alias("ops")), emit=False)
    per_text = _read(texts, ops).select("code_id", "compile_error", F.array_join("variables", " ").alias("variables"), read.alias("_t"))
    return subs.select("sub_id", "code_id").join(splittable(per_text), on="code_id", how="left").select(
        "sub_id", "compile_error", F.coalesce("_t.n", F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce("variables", F.lit("")).alias("variables"), F.coalesce("_t.ops", F.lit("")).alias("operators"))
