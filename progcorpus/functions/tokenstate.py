"""The tokenizer's state carried over the logical lines of one text.

``scan`` folds an array from left to right with a state and gathers what each step
emits, in chunks, so that a long text costs its length and not its square.
``read_lines`` runs it over pieces of a text's marks (``lexer.lex``: a character per raw
token).  A regular expression cuts the marks so that a piece is a whole logical line
where its brackets are balanced, else ends at the bracket that is not; the state
(open indentation levels, bracket depth, DEDENT tokens so far) changes once a
piece and not once a token.  What a job asks of the tokens themselves is made from
a piece's slice of the raw tokens.  Everything happens inside the row of the
text, so no token is shuffled, sorted or written to find them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from progcorpus.functions.lexer import END, WRONG, indent_width

_CHUNK = 64
_STATE = ("struct<depth:int,at:int,off:bigint,line:int,seg:int,open:boolean,content:boolean,w:int,w1:int,levels:array<int>,"
          "bad:boolean,shift:int,ln:int>")
# a piece: its first raw token, their number and marks; the logical line (``seg``, ``ln`` among those with a
# token that counts), ``first``: where the line's first such token is (null: not here), ``n`` DEDENT tokens
# before it, ``shift`` such tokens before the piece; ``ends``: it closes the logical line, ``content``: which has a token that counts
LINE = ("struct<at:int,m:int,marks:string,seg:int,ln:int,first:int,n:int,shift:int,w:int,is_indent:boolean,before:int,after:int,"
        "ends:boolean,content:boolean,off:bigint,line:int,bracket_depth:int>")
BLOCK = ("struct<seg:int,w:int,is_indent:boolean,end_seg:int,close_seg:int,start_pos:int,start_off:bigint,end_pos:int,"
         "end_off:bigint>")
# up to three brackets inside each other are one piece
_BALANCED = rf"\((?:[^(){END}]++|\((?:[^(){END}]++|\([^(){END}]*+\))*+\))*+\)"
_PIECE = rf"(?:[^()\n{END}]++|{_BALANCED})*+[()\n{END}]"
_LAYOUT = " #\\\n" + END        # marks of tokens that make no line
_BREAK = "\r\n|\r|\n"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, zero: Column, zero_type: str, out_type: str, step) -> Column:
    """``struct(s, o)``: the last state, and the arrays that ``step(state, item)``
    (``struct(state, emitted array)``) emitted, put together."""
    none, nones = F.array().cast(f"array<{out_type}>"), F.array().cast(f"array<array<{out_type}>>")
    acc_type, all_type = f"struct<s:{zero_type},o:array<{out_type}>>", f"struct<s:{zero_type},o:array<array<{out_type}>>>"

    def one(acc, x):
        return let(step(acc["s"], x), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], r["o"]).alias("o")))

    def chunk(acc, c):
        part = F.aggregate(F.slice(items, c * _CHUNK + 1, _CHUNK),
                           F.struct(acc["s"].alias("s"), none.alias("o")).cast(acc_type), one)
        return let(part, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    chunks = F.sequence(F.lit(0), F.floor(F.size(items) / _CHUNK).cast("int"))
    return F.aggregate(chunks, F.struct(zero.alias("s"), nones.alias("o")).cast(all_type), chunk,
                       lambda acc: F.struct(acc["s"].alias("s"), F.flatten(acc["o"]).alias("o")))


def _width(ws: Column, tab: int) -> Column:
    return F.when(F.translate(ws, " ", "") == "", F.length(ws)).otherwise(indent_width(ws, tab))


def of_line(raw: Column, line: Column) -> Column:
    """The raw tokens of a piece."""
    return F.slice(raw, line["at"] + 1, line["m"])


def _step(raw: Column, emit: bool, offsets: bool, lines: bool):
    def step(s, p):
        def placed(a):      # a: rest (from the first token that counts), last, m
            has = a["rest"] != ""
            first = ~s["open"] & has
            f = F.length(p) - F.length(a["rest"])

            def indented(b):    # b: first, lw, lw1 (columns of the logical line's first token, tabs of 8 and of 1)
                lw, lw1 = b["lw"], b["lw1"]
                deeper, same = lw > s["w"], lw == s["w"]
                levels = F.when(~b["first"] | same, s["levels"]).when(deeper, F.concat(s["levels"], F.array(lw))).otherwise(
                    F.filter(s["levels"], lambda x: x <= lw))

                def done(levels):
                    # a dedent has to land on an open level; tabs: the comparison with the previous line must agree at sizes 8 and 1
                    ok = ((deeper | same | (lw == 0) | F.coalesce(F.try_element_at(levels, F.lit(-1)) == lw, F.lit(False)))
                          & (F.signum(lw - s["w"]) == F.signum(lw1 - s["w1"])))
                    ends = (a["last"] == "\n") & (s["depth"] == 0)
                    content = s["content"] | has
                    n = F.when(b["first"] & ~deeper, F.size(s["levels"]) - F.size(levels)).otherwise(0)
                    ln = F.when(b["first"], s["ln"] + 1).otherwise(s["ln"])
                    text = F.array_join(F.slice(raw, s["at"] + 1, a["m"]), "")

                    def state(text):
                        return F.struct(
                            F.when(a["last"] == "(", s["depth"] + 1).when(a["last"] == ")", F.greatest(s["depth"] - 1, F.lit(0)))
                            .otherwise(s["depth"]).alias("depth"), (s["at"] + a["m"]).alias("at"),
                            (s["off"] + F.length(text) if offsets else s["off"]).alias("off"),
                            (s["line"] + F.regexp_count(text, F.lit(_BREAK)) if lines else s["line"]).alias("line"),
                            F.when(ends, s["seg"] + 1).otherwise(s["seg"]).alias("seg"), (~ends & (a["m"] > 0)).alias("open"),
                            (content & ~ends).alias("content"), F.when(b["first"], lw).otherwise(s["w"]).alias("w"),
                            F.when(b["first"], lw1).otherwise(s["w1"]).alias("w1"), levels.alias("levels"),
                            (s["bad"] | (b["first"] & ~ok)).alias("bad"), (s["shift"] + n).alias("shift"), ln.alias("ln")).cast(_STATE)

                    none = F.lit(None).cast("int")
                    row = F.struct(
                        s["at"].alias("at"), a["m"].alias("m"), p.alias("marks"), s["seg"].alias("seg"), ln.alias("ln"),
                        F.when(b["first"], f).otherwise(none).alias("first"), n.alias("n"), s["shift"].alias("shift"),
                        F.when(b["first"], lw).alias("w"), (b["first"] & deeper).alias("is_indent"), F.size(s["levels"]).alias("before"),
                        F.size(levels).alias("after"), ends.alias("ends"), content.alias("content"), s["off"].alias("off"),
                        s["line"].alias("line"), s["depth"].alias("bracket_depth")).cast(LINE) if emit else None
                    out = F.array(row) if emit else F.array().cast(f"array<{LINE}>")
                    return let(text, lambda t: F.struct(state(t).alias("s"), out.alias("o"))) if offsets or lines else (
                        F.struct(state(None).alias("s"), out.alias("o")))

                return let(levels, done)

            # the blanks that start a logical line count where a token that counts follows them
            blanks = F.when(first & (f == 1) & p.startswith(" "), F.get(raw, s["at"]))
            return let(blanks, lambda ws: let(F.struct(
                first.alias("first"), F.when(ws.isNull(), 0).otherwise(_width(ws, 8)).alias("lw"),
                F.when(ws.isNull(), 0).otherwise(_width(ws, 1)).alias("lw1")), indented))

        last = F.right(p, F.lit(1))
        return let(F.struct(F.ltrim(p, F.lit(_LAYOUT)).alias("rest"), last.alias("last"),
                            F.when(last == END, F.length(p) - 1).otherwise(F.length(p)).alias("m")), placed)

    return step


def read_lines(raw: Column, marks: Column, offsets: bool = False, lines: bool = False, emit: bool = True) -> Column:
    """``struct(tokenizes, n_tokens, lines, tail)`` of one text's raw tokens and their marks: ``lines`` are its
    pieces (``LINE``; ``off`` and ``line`` are counted where they are asked for, none are given without ``emit``), ``tail`` the
    one of the tokens behind the text: NEWLINE '' when the last logical line is open
    (``first`` of them), ``n`` DEDENT tokens, ENDMARKER."""
    zero = F.struct(*[F.lit(x) for x in (0, 0, 0, 1, 0, False, False, 0, 0)], F.array().cast("array<int>"),
                    *[F.lit(x) for x in (False, 0, -1)]).cast(_STATE)

    def finish(r):
        s, n = r["s"], F.size(raw)
        newline = (s["content"] & ~marks.endswith("\n" + END)).cast("int")
        opened = F.size(s["levels"])
        # a line that ends in an escaped line break is never closed
        good = ~s["bad"] & (s["depth"] == 0) & ~marks.contains(WRONG) & ~marks.rlike(rf"\\[ #]*+{END}")
        null = F.lit(None)
        tail = F.struct(
            n.alias("at"), F.lit(0).alias("m"), F.lit("").alias("marks"), null.alias("seg"), null.alias("ln"), newline.alias("first"),
            opened.alias("n"), s["shift"].alias("shift"), null.alias("w"), F.lit(False).alias("is_indent"), opened.alias("before"),
            F.lit(0).alias("after"), F.lit(False).alias("ends"), F.lit(False).alias("content"), s["off"].alias("off"),
            s["line"].alias("line"), F.lit(0).alias("bracket_depth")).cast(LINE)
        return F.struct(good.alias("tokenizes"), (n + s["shift"] + newline + opened + 1).cast("long").alias("n_tokens"),
                        r["o"].alias("lines"), tail.alias("tail"))

    pieces = F.regexp_extract_all(marks, F.lit(_PIECE), 0)
    return let(pieces, lambda p: let(scan(p, zero, _STATE, LINE, _step(raw, emit, offsets, lines)), finish))


def read_if_tokenizes(raw: Column, marks: Column, make, **asked) -> Column:
    """``make(read_lines(raw, marks))`` for a text that tokenizes, else null."""
    return let(read_lines(raw, marks, **asked), lambda r: F.when(r["tokenizes"], make(r)))


def read_blocks(lines: Column) -> Column:
    """The logical lines of a text with a token that counts, in order, as ``BLOCK`` rows: the next line at
    most as deep (``end``) and less deep (``close``) are the nearest on a stack of
    the later lines, whose widths only grow towards its top.  Offsets are right where ``lines`` has them."""
    later = "array<struct<w:int,seg:int,pos:int,off:bigint>>"

    def step(s, t):
        w = t["w"]
        upto = F.filter(s, lambda x: x["w"] <= w)
        below = F.filter(s, lambda x: x["w"] < w)

        def done(c):
            end, close = F.try_element_at(c["upto"], F.lit(-1)), F.try_element_at(c["below"], F.lit(-1))
            me = F.struct(w.alias("w"), t["seg"].alias("seg"), t["pos"].alias("pos"), t["off"].alias("off"))
            out = F.struct(t["seg"].alias("seg"), w.alias("w"), t["is_indent"].alias("is_indent"), end["seg"].alias("end_seg"),
                           close["seg"].alias("close_seg"), t["pos"].alias("start_pos"), t["off"].alias("start_off"),
                           end["pos"].alias("end_pos"), end["off"].alias("end_off")).cast(BLOCK)
            return F.struct(F.concat(c["below"], F.array(me)).cast(later).alias("s"), F.array(out).alias("o"))

        return let(F.struct(upto.alias("upto"), below.alias("below")), done)

    return let(F.reverse(lines), lambda ls: F.reverse(scan(ls, F.array().cast(later), later, BLOCK, step)["o"]))


def line_starts(raw: Column, lines: Column) -> Column:
    """``seg, w, is_indent, pos, off`` of the logical lines with a token that counts: ``pos`` is the position
    where the line's DEDENT tokens begin, ``off`` where its first such token stands."""
    return F.transform(F.filter(lines, lambda x: x["first"].isNotNull()), lambda x: F.struct(
        x["seg"].alias("seg"), x["w"].alias("w"), x["is_indent"].alias("is_indent"),
        (x["at"] + x["first"] + x["shift"]).alias("pos"),
        (x["off"] + F.length(F.array_join(F.slice(raw, x["at"] + 1, x["first"]), ""))).alias("off")))


def with_offsets(tokens: Column, off: Column) -> Column:
    """``src, ix, off`` of ``tokens`` that stand side by side from ``off`` on."""
    out = "struct<src:string,ix:int,off:bigint>"
    zero = F.struct(F.lit(0).alias("ix"), off.alias("off")).cast("struct<ix:int,off:bigint>")
    return scan(tokens, zero, "struct<ix:int,off:bigint>", out, lambda s, t: F.struct(
        F.struct((s["ix"] + 1).alias("ix"), (s["off"] + F.length(t)).alias("off")).cast("struct<ix:int,off:bigint>").alias("s"),
        F.array(F.struct(t.alias("src"), s["ix"].alias("ix"), s["off"].alias("off")).cast(out)).alias("o")))["o"]
