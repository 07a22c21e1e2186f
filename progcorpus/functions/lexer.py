"""A Python lexer as one Java regular expression.

``regexp_extract_all(code, LEX, 0)`` cuts a program into raw tokens whose
concatenation is the program: strings (with prefixes, triple quotes,
escapes), comments, names, numbers, line breaks, escaped line breaks, runs of
blanks, operators longest first, and a one-character catch-all (an
unterminated quote, ``$``, ``?`` ...) that becomes ``ERRORTOKEN``.

String bodies use possessive, unrolled loops, so a long literal or a long run
of backslashes does not recurse in the regex engine.  Indentation tokens are
not lexed here; ``operators.tokens`` derives them from line starts.

A regular expression can't tell which quote ends an f-string whose replacement
fields hold strings, comments or line breaks (``f"{d["#k"]}"``).  ``lex`` finds the
texts that have such f-strings and reads them with a state machine: one
``aggregate`` over small pieces of the text carries the stack of open quotes,
fields, brackets and format specs.  Each such f-string, nested ones included, is
replaced by a short placeholder string, the text is cut by the regular expression,
and the placeholders become the f-strings again: one STRING token each (D33).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PREFIX = r"(?:[rRbBuUfF]|[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF])?"
_TRIPLE_SQ = r"'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''"
_TRIPLE_DQ = r'"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""'
_SQ = r"'[^'\\\r\n]*+(?:\\(?:\r\n|[\s\S])[^'\\\r\n]*+)*+'"
_DQ = r'"[^"\\\r\n]*+(?:\\(?:\r\n|[\s\S])[^"\\\r\n]*+)*+"'
STRING = _PREFIX + "(?:" + "|".join([_TRIPLE_SQ, _TRIPLE_DQ, _SQ, _DQ]) + ")"
COMMENT = r"#[^\r\n]*+"
# like the interpreter's tokenizer, any non-ASCII character may be part of a
# name (whether it is a valid identifier is the parser's question)
NAME = r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*+"
NUMBER = (r"(?:0[xX](?:_?[0-9a-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++"
          r"|(?:\d(?:_?\d)*+(?:\.(?:\d(?:_?\d)*+)?)?|\.\d(?:_?\d)*+)(?:[eE][+-]?\d(?:_?\d)*+)?[jJ]?)")
LINE_BREAK = r"\r\n|\r|\n"
ESCAPED_NL = r"\\(?:\r\n|\r|\n)"
BLANKS = r"[ \t\f]++"

# Python's operator and delimiter tokens.
OPERATORS_3 = ["**=", "//=", ">>=", "<<=", "...", "!="]
OPERATORS_2 = ["%=", "&=", "**", "*=", "+=", "-=", "->", "//", "/=", ":=", "<<", "<=", "==", ">=",
               ">>", "@=", "^=", "|="]
OPERATORS_1 = list("%&()*+,-./:;<=>@[]^{|}~")
# stray ASCII characters the tokenizer passes on as OP (the parser rejects them)
OPERATORS_STRAY = list("$?!`")
ALL_OPERATORS = OPERATORS_3 + OPERATORS_2 + OPERATORS_1 + OPERATORS_STRAY


def _quote(op: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\-" else c for c in op)


OPERATOR = "|".join(_quote(o) for o in sorted(ALL_OPERATORS, key=len, reverse=True))
CATCH_ALL = r"[\s\S]"

LEX = "|".join([STRING, COMMENT, NAME, NUMBER, ESCAPED_NL, LINE_BREAK, BLANKS, OPERATOR, CATCH_ALL])


# --- marks: one character per raw token -------------------------------------------------

# number literals the tokenizer rejects: a base prefix without digits ("0x", "0or"), a digit
# outside the base ("0b12", "0o8"), a trailing "_"
_BASED = r"0[xX]_?[0-9a-fA-F]|0[bB]_?[01]|0[oO]_?[0-7]"
_BAD_NUMBER = (rf"(?:(?!{_BASED})0(?=[xXoObB])(?!{STRING})"
               rf"|(?:0[bB](?:_?[01])++|0[oO](?:_?[0-7])++)(?=[0-9])|(?>{NUMBER})(?=_))")
# the same tokens as ``LEX``'s (numbers after blanks and line breaks, which begin otherwise); a group holds what is left of a token: the quote of a string, a digit of a
# number, the first character of any other, nothing of one that is wrong
_MARKED = "|".join([
    _PREFIX + "(?:" + "|".join(q.replace(c, f"({c})", 1) for q, c in ((_TRIPLE_SQ, "'"), (_TRIPLE_DQ, '"'), (_SQ, "'"), (_DQ, '"'))) + ")",
    "(#)" + COMMENT[1:], NAME.replace("]", "])", 1).replace("[", "([", 1),
    r"(\\)" + ESCAPED_NL[2:], r"(\r)\n|([\r\n])", "([ \\t\\f])" + BLANKS[:-2] + "*+",
    rf"(?=[0-9.])(?:(?!{_BAD_NUMBER})(?=\.?([0-9]))(?>{NUMBER})|{NUMBER})",
    "(?=([" + "".join("\\" + c for c in OPERATORS_1 + OPERATORS_STRAY) + f"]))(?:{OPERATOR})", CATCH_ALL])
_MARK_GROUPS = "".join(f"${i}" for i in range(1, 13))
# marks besides the characters themselves (no token leaves a control character)
_CUT, WRONG, END = "\x01", "\x02", "\x03"


def _marks(code: Column) -> Column:
    """One character per raw token of ``code``, and ``END``: a quote for a string, a digit for a
    number, ``(`` and ``)`` for brackets of all kinds, a line feed, a blank, ``#``, a backslash
    (escaped line break), ``WRONG`` for what the tokenizer rejects, the first character of others."""
    cut = F.regexp_replace(code, F.lit(_MARKED), F.lit(_MARK_GROUPS + _CUT))
    return F.concat(F.translate(F.regexp_replace(cut, F.lit(rf"(?<=^|{_CUT}){_CUT}"), F.lit(WRONG + _CUT)),
                                "[{]}\r\t\f" + _CUT, "(())\n  "), F.lit(END))


# --- f-strings -------------------------------------------------------------------------

_F_PREFIX = r"(?:[fF][rR]?|[rR][fF])"
_HAS_FSTRING = rf"(?:^|[^A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]){_F_PREFIX}['\"]"
# pieces of a text that the state machine reads: escapes, quote runs, names, and what
# opens, closes or ends something; everything else in runs
_PIECE = (r"\\N\{[A-Za-z0-9 \-]*+\}|\\(?:\r\n|[^{}])|'++|\"++|" + NAME + r"|\r\n|[\r\n#:{}()\[\]\\]"
          r"|[^\\'\"A-Za-z_\x{80}-\x{10FFFF}\r\n#:{}()\[\]]++")
# frames on the stack: plain strings s d (one quote) S D (three), f-strings a b A B, a
# replacement field e, a bracket inside one (, a format spec p, a comment c
_FRAMES = {"'": "sSaA", '"': "dDbB"}
_MARK = "\ufdd0"           # a noncharacter: no program text holds it


def _step(acc: Column, piece: Column) -> Column:
    """The state after one more piece: ``stack, pos, start, nested, prev, spans``."""
    stack, pos, prev = acc["stack"], acc["pos"], acc["prev"]
    top, n, c = F.right(stack, F.lit(1)), F.length(piece), F.substring(piece, 1, 1)
    popped = F.substring(stack, F.lit(1), F.length(stack) - 1)
    code, inside = top.isin("", "e", "("), stack != ""
    literal = top.isin(*"abABp")
    quote = c.isin("'", '"')

    # a run of quotes: those that close the string on top, the rest read as code
    mine = ((c == "'") & top.isin(*_FRAMES["'"])) | ((c == '"') & top.isin(*_FRAMES['"']))
    closing = F.when(top.isin(*"SDAB"), 3).otherwise(1)
    closes = quote & mine & (n >= closing)
    rest = F.when(closes, n - closing).when(quote & code, n).otherwise(0)
    left = F.when(closes, popped).otherwise(stack)
    f_prefix = code & prev.rlike(f"^{_F_PREFIX}$")

    def frame(i):
        return F.when(c == "'", _FRAMES["'"][i]).otherwise(_FRAMES['"'][i])

    opened = (F.when(rest % 6 == 1, F.when(f_prefix, frame(2)).otherwise(frame(0)))
              .when(rest % 6 >= 3, F.when(f_prefix, frame(3)).otherwise(frame(1))).otherwise(""))
    breaks = c.isin("\n", "\r")
    after = (F.when(quote, F.concat(left, opened))
             .when(top == "c", F.when(breaks, popped).otherwise(stack))
             # a line break ends a string of one quote without closing it
             .when(breaks, F.when(top.isin(*"sdab"), F.lit("")).otherwise(stack))
             .when(piece == "{", F.when((top == "e") & (prev == "{"), popped)               # "{{"
                   .when(literal, F.concat(stack, F.lit("e"))).when(code & inside, F.concat(stack, F.lit("(")))
                   .otherwise(stack))
             .when(piece == "}", F.when(top.isin("(", "e", "p"), popped).otherwise(stack))
             .when(piece.isin("(", "["), F.when(code & inside, F.concat(stack, F.lit("("))).otherwise(stack))
             .when(piece.isin(")", "]"), F.when(top == "(", popped).otherwise(stack))
             .when((piece == ":") & (top == "e"), F.concat(popped, F.lit("p")))
             .when((piece == "#") & code, F.concat(stack, F.lit("c")))
             .otherwise(stack))
    begins = quote & ~inside & opened.isin(*"abAB")
    ends = closes & (F.length(stack) == 1) & top.isin(*"abAB")
    special = code & inside & (quote | breaks | (piece == "#"))
    nested = ~begins & (acc["nested"] | special)
    span = F.struct(acc["start"].alias("a"), (pos + n - rest).alias("b"))
    return F.struct(after.alias("stack"), (pos + n).alias("pos"),
                    F.when(begins, pos - F.length(prev)).otherwise(acc["start"]).alias("start"),
                    nested.alias("nested"), piece.alias("prev"),
                    F.when(ends & acc["nested"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))


def _fstring_spans(code: Column) -> Column:
    """``array<struct<a int, b int>>``: where (characters, end exclusive) the outermost
    f-strings with strings, comments or line breaks in their fields stand."""
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("pos"), F.lit(0).alias("start"), F.lit(False).alias("nested"),
                     F.lit("").alias("prev"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))
    return F.aggregate(F.regexp_extract_all(code, F.lit(_PIECE), 0), start, _step, lambda acc: acc["spans"])


def _maybe_nested(raw: Column) -> Column:
    """Whether the raw tokens of a text hold an f-string that may have been cut short."""
    def odd(t):
        quotes = F.length(t) - F.length(F.translate(t, "'\"", ""))
        return ((F.length(F.translate(t, "{", "")) != F.length(F.translate(t, "}", "")))
                | ~(quotes.isin(2, 6)))

    return (F.exists(raw, lambda t: t.rlike(rf"^{_F_PREFIX}['\"]") & t.contains("{") & odd(t))
            | F.array_contains(raw, "'") | F.array_contains(raw, '"'))


def lex(texts: DataFrame, code_col: str = "code", out: str = "raw") -> DataFrame:
    """``texts`` with the array ``out`` of raw tokens; concatenated they are the text, and the string
    ``marks`` with a character for each (see ``_marks``)."""
    code = F.col(code_col)
    t = texts.withColumn(out, F.regexp_extract_all(code, F.lit(LEX), 0))
    t = t.withColumn("_spans", F.when(code.rlike(_HAS_FSTRING) & code.contains("{") & ~code.contains(_MARK)
                                      & _maybe_nested(F.col(out)), _fstring_spans(code)))
    spans = F.col("_spans")

    def cut(s, i):
        before = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["b"])
        return F.concat(F.substring(code, before + 1, s["a"] - before), F.lit(f'"{_MARK}'), i.cast("string"), F.lit('"'))

    def back(token):
        s = F.get(spans, F.regexp_replace(token, "[^0-9]", "").cast("int"))
        return F.when(token.startswith(f'"{_MARK}'), F.substring(code, s["a"] + 1, s["b"] - s["a"])).otherwise(token)

    masked = F.concat(F.array_join(F.transform(spans, cut), ""),
                      F.substring(code, F.element_at(spans, -1)["b"] + 1, F.length(code)))
    again = F.transform(F.regexp_extract_all(masked, F.lit(LEX), 0), back)
    nested = F.size(spans) > 0
    return (t.withColumn(out, F.when(nested, again).otherwise(F.col(out)))
            .withColumn("marks", _marks(F.when(nested, masked).otherwise(code))).drop("_spans"))


def token_kind(src: Column) -> Column:
    """Kind of a raw token: STRING, COMMENT, NAME, NUMBER, LINEBREAK,
    ESCAPED_NL, BLANK, OP or ERRORTOKEN (line breaks and blanks are refined
    into NEWLINE/NL and INDENT/UNIMPORTANT_WS by the token job).

    The lexer already cut the token, so its first character (and whether it
    holds a quote) decides the kind: no pattern is matched per token."""
    c = F.ascii(src)                      # code point of the first character
    n = F.length(src)
    quoted = (F.instr(src, "'") > 0) | (F.instr(src, '"') > 0)
    letter = ((c >= 97) & (c <= 122)) | ((c >= 65) & (c <= 90)) | (c == 95) | (c >= 128)
    digit = (c >= 48) & (c <= 57)
    return (F.when(c == 35, F.lit("COMMENT"))                                   # '#'
            .when(quoted & (n >= 2), F.lit("STRING"))                           # prefix + quotes
            .when(letter, F.lit("NAME"))
            .when(digit | ((c == 46) & (n >= 2) & (F.substring(src, 2, 1) != ".")), F.lit("NUMBER"))
            .when(src.isin("\n", "\r\n", "\r"), F.lit("LINEBREAK"))
            .when((c == 92) & (n >= 2), F.lit("ESCAPED_NL"))                    # backslash + line break
            .when((c == 32) | (c == 9) | (c == 12), F.lit("BLANK"))
            .when(src.isin(*ALL_OPERATORS), F.lit("OP"))
            .otherwise(F.lit("ERRORTOKEN")))


def indent_width(ws: Column, tab: int = 8) -> Column:
    """Column of a run of blanks as Python's tokenizer counts it: tabs to
    the next multiple of ``tab``, form feed resets to 0.  The tokenizer also
    measures with ``tab=1`` and rejects lines where the two disagree."""
    chars = F.split(ws, "")
    return F.aggregate(chars, F.lit(0),
                       lambda acc, c: F.when(c == "\t", ((F.floor(acc / tab) + 1) * tab).cast("int"))
                       .when(c == "\f", F.lit(0)).when(c == "", acc).otherwise(acc + 1)).cast("int")
