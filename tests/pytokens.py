"""Test-only reference token stream built on the standard library tokenizer.

Gaps between stdlib tokens become ``UNIMPORTANT_WS`` / ``ESCAPED_NL``
tokens, so concatenating ``src`` rebuilds the text; this is the stream whose
positions the Spark token table must reproduce.
"""

from __future__ import annotations

import io
import re
import tokenize

_ESC_NL = re.compile(r"\\(\n|\r\n|\r)")


def _merged(tokens, lines):
    """The tokens with each outermost f-string as one STRING token."""
    depth, start = 0, None
    for t in tokens:
        name = tokenize.tok_name[t.type]
        if name == "FSTRING_START":
            start = t.start if not depth else start
            depth += 1
        elif name == "FSTRING_END":
            depth -= 1
            if not depth:
                (sl, sc), (el, ec) = start, t.end
                text = lines[sl][sc:ec] if sl == el else lines[sl][sc:] + "".join(lines[sl + 1:el]) + lines[el][:ec]
                yield tokenize.STRING, text, start, t.end, "".join(lines[sl:el + 1])
            continue
        if not depth:
            yield t


def py_tokens(src: str) -> list[tuple[str, str]] | None:
    """``[(kind, src), ...]`` or None when the stdlib tokenizer fails."""
    target = io.StringIO(src)
    lines = ("",) + tuple(target)
    target.seek(0)
    out: list[tuple[str, str]] = []
    last_line, end = 1, 0
    try:
        for ttype, text, (sl, sc), (el, ec), line in _merged(tokenize.generate_tokens(target.readline), lines):
            if sl > last_line:
                gap = lines[last_line][end:]
                for n in range(last_line + 1, sl):
                    gap += lines[n]
                if sc > 0:
                    gap += lines[sl][:sc]
                while _ESC_NL.search(gap):
                    m = _ESC_NL.search(gap)
                    if m.start():
                        out.append(("UNIMPORTANT_WS", gap[:m.start()]))
                    out.append(("ESCAPED_NL", gap[m.start():m.end()]))
                    gap = gap[m.end():]
                if gap:
                    out.append(("UNIMPORTANT_WS", gap))
            elif sc > end:
                out.append(("UNIMPORTANT_WS", line[end:sc]))
            out.append((tokenize.tok_name[ttype], text))
            last_line, end = el, ec
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return None
    return out
