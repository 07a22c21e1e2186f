"""Token jobs (T1, P6, W9, J4, T4, J5, W8, U2, J6-A, A5, A8, T2).

Work happens on ``code_dim`` (one row per distinct program text, keyed by
``code_id`` = sha-256 of the text), bucketed by ``code_id`` once.  Every later
window and join is keyed by ``code_id`` (plus a sub-key), so the token
pipeline runs inside that one layout; the copies of a popular program are
collapsed by partial aggregation before the corpus is shuffled.

Token stream (same positions as a whitespace-preserving tokenizer):
raw tokens from the one-regex lexer, with line breaks split into NEWLINE/NL,
leading blanks of a deeper logical line marked INDENT, zero-width DEDENT
tokens before the first token of a shallower line, and NEWLINE ``''`` /
DEDENT / ENDMARKER at the end.

The tokenizer's state (``functions.tokenstate``) is carried over a text's logical lines
inside its row, and each job explodes what it needs from there: token rows are
never written, shuffled or sorted to be found, so the disk a job takes grows with the
texts and not with their tokens.  Their columns are made by compiled code, a row a token, as
far as a job asks for them.

``nearest_smaller`` answers "next line indented at most as deep" for a table of
lines that do not stand in one row: the distinct indent widths of a program are ranked and
a rank is read as digits (base ``RADIX``).  A line's question "who is nearest with a
smaller rank?" falls into one group per digit (same higher digits, smaller
digit), and a line stands in the groups of the digits above its own; inside each
group a running ``last(..)`` window gives the nearest.  Rows grow with lines x
``RADIX`` x digits of the number of widths: a staircase of n widths costs
O(n log n) rows, a usual program (fewer than ``RADIX`` widths) one digit.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from progcorpus.functions.lexer import END, lex, token_kind
from progcorpus.functions.tokenstate import (let, line_starts, of_line, read_blocks, read_if_tokenizes, read_lines, scan)
from progcorpus.session import buckets_for, buckets_of, materialize, splittable

TOKEN_COLS = ["code_id", "pos", "kind", "src", "line", "seg", "off", "bracket_depth", "indent_depth"]


class TokenJob:
    """Outputs of ``token_table``: ``tokens``, ``status`` (P6, with
    ``n_tokens`` per text) and
    ``blocks`` (one row per logical line: ``code_id, seg, w, is_indent,
    end_seg, close_seg, start_pos, start_off``; ``end_seg`` is the next
    logical line indented at most as deep, ``close_seg`` the next one indented
    less, ``start_pos`` the position where the line's DEDENT tokens begin).

    ``lexed`` (``code_id, code, raw, marks``) holds the texts with their raw tokens; ``rows``
    reads each text once for a job of its own, ``of`` each together with facts of it."""

    def __init__(self, lexed: DataFrame, dim: DataFrame):
        self.lexed, self._dim = lexed, dim

    def of(self, facts: DataFrame) -> DataFrame:
        """``lexed`` with the columns of ``facts`` (a row per text) for the texts that have some.  The
        facts meet the texts before these are lexed, so no raw token is shuffled or sorted for the
        join, and are spread over tasks by the texts' own count, however few bytes they have."""
        texts, n = self._dim.select("code_id", "code").join(facts, on="code_id", how="inner"), buckets_of(self._dim)
        return lex(texts.repartition(n, "code_id") if n else texts)

    @property
    def tokens(self) -> DataFrame:
        return stream(self, *TOKEN_COLS[1:], valid=False)

    @cached_property
    def status(self) -> DataFrame:
        return _status(self.lexed)

    @cached_property
    def blocks(self) -> DataFrame:
        made = let(read_lines(F.col("raw"), F.col("marks"), offsets=True), lambda r: read_blocks(line_starts(F.col("raw"), r["lines"])))
        return self.lexed.select("code_id", F.inline(made)).select(
            "code_id", "seg", "w", "is_indent", "end_seg", "close_seg", "start_pos", "start_off")

    def rows(self, make, outer: bool = False, **asked) -> DataFrame:
        """``code_id`` and the structs of the array ``make(read)`` for every text that
        tokenizes (``read``: ``tokenizes, n_tokens, lines, tail``, see ``read_lines``); with ``outer`` a row of
        nulls for each other text."""
        made = read_if_tokenizes(F.col("raw"), F.col("marks"), make, **asked)
        return self.lexed.select("code_id", F.inline_outer(made) if outer else F.inline(made))


def stream(job: TokenJob, *cols: str, valid: bool = True) -> DataFrame:
    """The token rows ``code_id`` and ``cols`` (of ``TOKEN_COLS``) of each text, with ``valid`` of those that
    tokenize.  The text's row gives its pieces (``tokenstate.LINE``), a piece its tokens, with null for
    a DEDENT; lines, offsets and bracket depths are counted where they are asked for."""
    raw, marks = F.col("raw"), F.col("marks")
    counted = {"off", "line", "bracket_depth"} & set(cols)

    def pieces(r):
        def piece(x, items, end):
            # where the NEWLINE and the INDENT of the logical line and the ENDMARKER are
            newline = F.when(x["ends"] & x["content"], F.size(items) - 1).otherwise(F.lit(-1)) if end is None else (
                x["first"] - 1)
            return F.struct((x["at"] + x["shift"]).alias("_at"), items.alias("_items"), newline.alias("_newline"),
                            F.when(x["is_indent"], 0).otherwise(F.lit(-1)).alias("_indent"),
                            (F.lit(-1) if end is None else end).alias("_end"), x["seg"].alias("seg"), x["first"].alias("_first"),
                            x["n"].alias("_n"), x["before"].alias("_before"), x["after"].alias("_after"),
                            x["off"].alias("_off"), x["line"].alias("_line"), x["bracket_depth"].alias("_depth"))

        def of_text(x):
            dedents = F.array_repeat(F.lit(None).cast("string"), x["n"])
            return let(of_line(raw, x), lambda t: piece(x, F.when(x["n"] > 0, F.concat(
                F.slice(t, 1, x["first"]), dedents, F.slice(t, x["first"] + 1, F.size(t)))).otherwise(t), None))

        behind = let(r["tail"], lambda x: let(x["first"] + x["n"], lambda n: F.array(piece(
            x, F.array_repeat(F.lit(None).cast("string"), n + 1), n))))
        return F.concat(F.transform(r["lines"], of_text), behind)

    asked = {"offsets": "off" in cols, "lines": "line" in cols}
    made = (read_if_tokenizes(raw, marks, pieces, **asked) if valid else let(read_lines(raw, marks, **asked), pieces))
    rows = job.lexed.select("code_id", F.inline(made))
    if counted:
        rows = rows.select("*", F.posexplode(_counted(F.col("_items"))).alias("_ix", "_t")).select("*", "_t.*")
    else:
        rows = rows.select("*", F.posexplode("_items").alias("_ix", "_src"))
    src, ix, first = F.col("_src"), F.col("_ix"), F.col("_first")
    kind = token_kind(src)
    rows = rows.withColumns({
        "pos": F.col("_at") + ix, "src": F.coalesce(src, F.lit("")),
        "kind": (F.when(ix == F.col("_newline"), F.lit("NEWLINE")).when(ix == F.col("_indent"), F.lit("INDENT"))
                 .when(ix == F.col("_end"), F.lit("ENDMARKER")).when(src.isNull(), F.lit("DEDENT"))
                 .when(kind == "LINEBREAK", F.lit("NL")).when(kind == "BLANK", F.lit("UNIMPORTANT_WS")).otherwise(kind)),
        "indent_depth": (F.when(ix == F.col("_indent"), F.col("_after")).when(ix < first, F.col("_before"))
                         .when(ix < first + F.col("_n"), F.col("_before") - (ix - first + 1)).otherwise(F.col("_after")))})
    return rows.select("code_id", *cols)


def _counted(items: Column) -> Column:
    """``_src, off, line, bracket_depth`` of a piece's tokens, carried on from where the piece begins."""
    state, out = "struct<off:bigint,line:int,depth:int>", "struct<_src:string,off:bigint,line:int,bracket_depth:int>"

    def step(s, t):
        src = F.coalesce(t, F.lit(""))
        after = F.struct((s["off"] + F.length(src)).alias("off"),
                         (s["line"] + F.when(src.rlike("[\r\n]"), F.regexp_count(src, F.lit("\r\n|\r|\n"))).otherwise(0)).alias("line"),
                         F.when(src.isin("(", "[", "{"), s["depth"] + 1).when(
                             src.isin(")", "]", "}"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]).alias("depth"))
        row = F.struct(t.alias("_src"), s["off"].alias("off"), s["line"].alias("line"), s["depth"].alias("bracket_depth"))
        return F.struct(after.cast(state).alias("s"), F.array(row.cast(out)).alias("o"))

    zero = F.struct(F.col("_off").alias("off"), F.col("_line").alias("line"), F.col("_depth").alias("depth")).cast(state)
    return scan(items, zero, state, out, step)["o"]


# bytes of token/node rows per character of program text (sizing only)
ROW_BYTES_PER_CHAR = 40


def code_dim(df: DataFrame, code_col: str = "func_code", num_partitions: int | None = None) -> DataFrame:
    """One row per distinct program text: ``code_id, code``.

    ``groupBy(code_id)`` with ``any_value`` is partially aggregated, so a text
    repeated in a third of the corpus is reduced map-side before the shuffle.
    The distinct texts (much smaller than the corpus) are then bucketed by
    ``code_id`` into a number of partitions sized for the token and node rows
    they expand into; every later window and join keyed by ``code_id`` reuses
    that layout (the count stays with the returned table, see ``buckets_of``)."""
    spark = df.sparkSession
    # reuse the row's code_id when it is there (one SHA-256 per row, not two)
    cid = F.col("code_id") if "code_id" in df.columns else F.sha2(F.col(code_col), 256)
    distinct = (df.where(F.col(code_col).isNotNull())
                .select(cid.alias("code_id"), F.col(code_col).alias("code"))
                .groupBy("code_id").agg(F.any_value("code").alias("code")))
    staged = materialize(distinct)
    n = num_partitions
    if n is None:
        chars = staged.agg(F.coalesce(F.sum(F.length("code")), F.lit(0)).alias("c")).first()["c"]
        n = buckets_for(chars * ROW_BYTES_PER_CHAR, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(staged.repartition(n, "code_id"), key="code_id", num_buckets=n)


def with_code_id(df: DataFrame, code_col: str = "func_code") -> DataFrame:
    return df.withColumn("code_id", F.sha2(F.col(code_col), 256))


RADIX = 16      # a power of two; widths of a program that need no second digit
_BITS = 4


def nearest_rows(lines: DataFrame) -> DataFrame:
    """``code_id, seg, d, g, asks, member``: the groups (digit, ranks) in which each logical
    line asks for the nearest member, and those it is a member of."""
    ranked = lines.select("code_id", "seg", (F.dense_rank().over(Window.partitionBy("code_id").orderBy("w")) - 1).alias("r"))
    ranked = ranked.withColumn("m", F.max("r").over(Window.partitionBy("code_id")))
    # digits that the largest rank has, at least one
    digits = F.greatest(F.lit(1), F.ceil(F.length(F.conv(F.col("m").cast("string"), 10, 2)) / _BITS).cast("int"))
    r, m = F.col("r"), F.col("m")

    def above(d):       # the groups of digit d that ask for ranks such as this one
        own = F.call_function("shiftright", r, d * _BITS)
        last = F.least(own.bitwiseOR(F.lit(RADIX - 1)), F.call_function("shiftright", m, d * _BITS))
        return F.when(last > own, F.transform(F.sequence(own + 1, last), lambda g: F.struct(
            d.alias("d"), g.alias("g"), F.lit(False).alias("asks"), F.lit(True).alias("member")))).otherwise(
            F.array().cast("array<struct<d:int,g:int,asks:boolean,member:boolean>>"))

    levels = F.sequence(F.lit(0), digits - 1)
    asks = F.transform(levels, lambda d: F.struct(d.alias("d"), F.call_function("shiftright", r, d * _BITS).alias("g"),
                                                  F.lit(True).alias("asks"), F.lit(False).alias("member")))
    # lines of the same width meet in a group of their own
    same = F.array(F.struct(F.lit(-1).alias("d"), r.alias("g"), F.lit(True).alias("asks"), F.lit(True).alias("member")))
    return ranked.select("code_id", "seg", F.inline(F.concat(same, asks, F.flatten(F.transform(levels, above)))))


def nearest_smaller(lines: DataFrame) -> DataFrame:
    """All nearest smaller values: for each logical line (``code_id, seg, w``) the nearest
    lines of its program with a smaller width or with the same:
    ``code_id, seg, next_lt, next_eq, prev_lt, prev_eq`` (null: none)."""
    rows = nearest_rows(lines)
    group = Window.partitionBy("code_id", "d", "g")
    after = group.orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = group.orderBy(F.col("seg").asc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("member"), F.col("seg"))
    found = rows.select("code_id", "seg", "d", "asks", F.last(seen, ignorenulls=True).over(after).alias("next"),
                        F.last(seen, ignorenulls=True).over(before).alias("prev")).where("asks")
    lt, eq = F.col("d") >= 0, F.col("d") < 0
    return found.groupBy("code_id", "seg").agg(
        F.min(F.when(lt, F.col("next"))).alias("next_lt"), F.min(F.when(eq, F.col("next"))).alias("next_eq"),
        F.max(F.when(lt, F.col("prev"))).alias("prev_lt"), F.max(F.when(eq, F.col("prev"))).alias("prev_eq"))


def _lexed(dim: DataFrame) -> DataFrame:
    return lex(dim.select("code_id", "code"))


def _status(lexed: DataFrame) -> DataFrame:
    """P6 per text: no error token or malformed number, brackets closed at
    the end, no line continuation before the end, every dedent on an open
    level (with consistent tabs)."""
    read = let(read_lines(F.col("raw"), F.col("marks"), emit=False), lambda r: F.array(F.struct(
        r["tokenizes"].alias("tokenizes"), r["n_tokens"].alias("n_tokens"))))
    return lexed.select("code_id", F.inline(read))


def token_status(dim: DataFrame) -> DataFrame:
    """P6 alone: ``code_id, tokenizes`` without building the full token
    stream (no DEDENT insertion or positions)."""
    return _status(_lexed(dim)).select("code_id", "tokenizes")


def raw_tokens(dim: DataFrame) -> DataFrame:
    """``code_id, rpos, kind, src`` of the texts that tokenize, without DEDENT tokens and
    the positions that count them (for jobs that ask only which tokens there are)."""
    raw = F.col("raw")
    valid = read_lines(raw, F.col("marks"), emit=False)["tokenizes"]
    return (_lexed(dim).select("code_id", F.posexplode(F.when(valid, raw)).alias("rpos", "src"))
            .select("code_id", "rpos", token_kind(F.col("src")).alias("kind"), "src"))


def token_table(dim: DataFrame) -> TokenJob:
    """Tokens, tokenizer status and logical-line blocks.

    ``tokens``: ``code_id, pos, kind, src, line, seg, off, bracket_depth,
    indent_depth`` — concatenating ``src`` in ``pos`` order rebuilds the text.
    ``status``: ``code_id, tokenizes`` (P6) per text; ``blocks``: see
    ``TokenJob``."""
    return TokenJob(_lexed(dim), dim)


def rebuild(tokens: DataFrame) -> DataFrame:
    """``code_id, n_tokens, text``: the tokens' number and their text concatenated in position
    order (collects one program's tokens; used to check the lexer)."""
    return tokens.groupBy("code_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "src"))), lambda s: s["src"]), "")
        .alias("text"))


# noncharacters that stand for the line breaks of string tokens while lines are cut
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_MASKS = "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4\ufdd5\ufdd6\ufdd7\ufdd8\ufdd9"


def tokenized(job: TokenJob, *cols: str) -> DataFrame:
    """Tokens of the texts that tokenize (D34: any tokenizer error means no tokens), with the columns a job asks for (all)."""
    return stream(job, *(cols or TOKEN_COLS[1:]))


def clean_programs(job: TokenJob, dim: DataFrame, remove_docstring: bool = True) -> DataFrame:
    """``code_id, cleaned`` — comments, statement-level
    literals (docstrings, bare strings/numbers; kept with
    ``remove_docstring=False``) and blank lines removed, line
    ends normalised, trailing blanks of lines dropped, text stripped.  Token
    based (D29: not re-printed through a syntax tree); null for a text that
    does not tokenize.  A text is put together in its row, line by line."""
    raw = F.col("raw")

    def text(x):
        """A piece's text without comments, the line breaks inside its strings masked."""
        def shown(t):
            quoted = F.transform(t, lambda s: F.when(token_kind(s) == "STRING", F.translate(s, _BREAKS, _MASKS)).otherwise(s))
            return F.array_join(F.when(x["marks"].rlike("[\"']"), quoted).otherwise(t), "")
        kept = F.when(x["marks"].contains("#"), F.filter(of_line(raw, x), lambda s: ~s.startswith("#"))).otherwise(of_line(raw, x))
        return let(kept, shown)

    def literal(x):
        return x["first"].isNotNull() & x["marks"].rlike(_LITERAL)

    def made(r):
        if not remove_docstring:
            return F.array_join(F.transform(r["lines"], text), "")

        def lines(soles):
            # a literal that was the only statement of its block leaves ``pass`` at the block's indentation
            return F.array_join(F.transform(r["lines"], lambda x: F.when(~literal(x), text(x)).when(
                F.array_contains(soles, x["seg"]), F.concat(F.get(raw, x["at"]), F.lit("pass\n")))), "")

        # the first line of a block whose next line at most as deep is already a shallower one
        soles = F.transform(F.filter(read_blocks(line_starts(raw, r["lines"])), lambda b: (
            b["is_indent"] & b["end_seg"].eqNullSafe(b["close_seg"]))), lambda b: b["seg"])
        return let(F.when(F.exists(r["lines"], lambda x: x["is_indent"] & literal(x)), soles).otherwise(
            F.array().cast("array<int>")), lines)

    joined = job.lexed.select("code_id", read_if_tokenizes(raw, F.col("marks"), made).alias("_t"))
    return joined.select("code_id", _cleaned(F.col("_t")).alias("cleaned"))


# marks of a logical line of literals alone
_LITERAL = "\\A[ #\\\\]*+[\"'0-9][ #\\\\\"'0-9]*+[\n" + END + "]\\z"


def _cleaned(text: Column) -> Column:
    """``text`` without blank lines and blanks at line ends; the lines inside a string token stay as they are (their
    breaks are masked by a character no program text holds while lines are cut)."""
    from progcorpus.functions.lines import py_rstrip, py_strip, splitlines

    lines = F.filter(F.transform(splitlines(text), lambda l: py_rstrip(l)), lambda l: l != "")
    return F.translate(py_strip(F.array_join(lines, "\n")), _MASKS, _BREAKS)


def indent_profile(job: TokenJob) -> DataFrame:
    """W9 over a table: per text the number of INDENT/DEDENT tokens and the
    deepest running indentation depth."""
    def profile(r):
        lines = r["lines"]
        return F.array(F.struct(
            F.array_max(F.transform(lines, lambda x: x["after"])).alias("max_indent_depth"),
            F.size(F.filter(lines, lambda x: x["is_indent"])).cast("long").alias("n_indent"),
            (r["tail"]["shift"] + r["tail"]["n"]).cast("long").alias("n_dedent")))

    return job.rows(profile)


def token_profile(df: DataFrame, code_col: str = "func_code") -> DataFrame:
    """P6 and W9 per row: ``df`` with ``tokenizes`` and, for a text that does, ``n_tokens``
    and ``max_indent_depth``; each distinct text is tokenized once."""
    rows = with_code_id(df, code_col)
    job = token_table(code_dim(rows, code_col))
    per_text = splittable(job.status.join(indent_profile(job), on="code_id", how="left").select(
        "code_id", "tokenizes", F.when(F.col("tokenizes"), F.col("n_tokens")).alias("n_tokens"), "max_indent_depth"))
    return rows.join(per_text, on="code_id", how="left").drop("code_id")
