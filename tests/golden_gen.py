"""Compute per-template golden values with the Python standard library.

``python tests/golden_gen.py`` prints the literal stored in
``progcorpus/plans/golden.py``; ``tests/test_golden.py`` checks that the two
agree.  The oracles state these values per template id.
"""

from __future__ import annotations

import ast
import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pytokens import py_tokens  # noqa: E402

from progcorpus.operators.inventory import OPERATORS  # noqa: E402
from progcorpus.sources.fixtures import TEMPLATES  # noqa: E402

F = "task_0"


def _positions(toks, pred):
    m = {}
    for i, (k, s) in enumerate(toks):
        if pred(k, s):
            m.setdefault(s, []).append(i)
    return {s: ",".join(map(str, p)) for s, p in m.items()}


def _levels(tree):
    """The nodes of a tree, level by level from the root."""
    level = [tree] if tree else []
    while level:
        yield level
        level = [child for node in level for child in ast.iter_child_nodes(node)]


def _bound_names(tree) -> list[str]:
    """Arguments and assigned names, by first occurrence in level order."""
    seen: dict[str, None] = {}
    for level in _levels(tree):
        for node in level:
            match node:
                case ast.arg(arg=name) | ast.Name(id=name, ctx=ast.Store()):
                    seen.setdefault(name)
    return list(seen)


def _cut(text: str, node) -> str:
    """A node's text, by its UTF-8 positions."""
    rows = [row.encode() for row in re.split(r"(?<=\n)", text)]
    rows[node.end_lineno - 1] = rows[node.end_lineno - 1][:node.end_col_offset]
    rows[node.lineno - 1] = rows[node.lineno - 1][node.col_offset:]
    return b"".join(rows[node.lineno - 1:node.end_lineno]).decode()


def golden_for(text: str) -> dict:
    toks = py_tokens(text)
    g: dict = {"tokenizes": toks is not None}
    try:
        tree = ast.parse(text.lstrip())
        g["compile_error"] = None
    except SyntaxError as e:  # IndentationError / TabError are subclasses
        tree = None
        g["compile_error"] = type(e).__name__
    g["n_nodes"] = sum(1 for _ in ast.walk(tree)) if tree else 0
    variables = _bound_names(tree)
    g["variables"] = " ".join(variables)
    fdefs = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] if tree else []
    g["multi_function"] = len(fdefs) > 1 if tree else text.count("def ") > 1
    if toks is None:
        toks = []
    if tree:
        g["first_function"] = fdefs[0].name if fdefs else ""
    else:  # token fallback for programs that do not parse
        names = [s for k, s in toks if k == "NAME"]
        g["first_function"] = next((names[i + 1] for i, s in enumerate(names[:-1]) if s == "def"), "")
    g["n_tokens"] = len(toks)
    g["kinds"] = dict(sorted(Counter(k for k, _ in toks).items()))
    g["operators"] = _positions(toks, lambda k, s: s in OPERATORS)
    g["numbers"] = _positions(toks, lambda k, s: k == "NUMBER")
    g["strings"] = _positions(toks, lambda k, s: k == "STRING" and s not in variables)
    g["variable_locations"] = _positions(toks, lambda k, s: s in variables)
    g["defs"] = sum(1 for k, s in toks if k == "NAME" and s == "def")
    g["def_positions"] = ",".join(str(i) for i, (k, s) in enumerate(toks) if k == "NAME" and s == "def")
    depth, top = 0, 0
    for k, _ in toks:
        depth += (k == "INDENT") - (k == "DEDENT")
        top = max(top, depth)
    g["max_indent_depth"] = top
    g["operator_seq"] = " ".join(s for k, s in toks if s in OPERATORS)
    g["adjacency_md5"] = None
    g["tree_functions"] = []
    if tree:
        import hashlib
        full = ast.parse(text)  # positions in the original text
        order, kids = [], {}

        def pre(node):
            order.append(node)
            kids[len(order) - 1] = []
            me = len(order) - 1
            for c in ast.iter_child_nodes(node):
                kids[me].append(len(order))
                pre(c)
        pre(full)
        adj = ";".join(f"{type(n).__name__}:{','.join(map(str, kids[i]))}" for i, n in enumerate(order))
        g["adjacency_md5"] = hashlib.md5(adj.encode()).hexdigest()
        g["tree_functions"] = [(n.name, _cut(text, n)) for level in _levels(full) for n in level
                               if type(n) is ast.FunctionDef]
    g["positional_args"] = None
    if tree:
        tops = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == F]
        if tops:
            a = tops[-1].args
            g["positional_args"] = " ".join(x.arg for x in a.posonlyargs + a.args)
    g["tokens"] = toks
    g["n_indent"] = sum(1 for k, _ in toks if k == "INDENT")
    g["n_dedent"] = sum(1 for k, _ in toks if k == "DEDENT")
    return g


def all_golden() -> dict:
    return {v: golden_for(t.replace("{f}", F)) for v, t in enumerate(TEMPLATES)}


if __name__ == "__main__":
    import pprint
    pprint.pprint(all_golden(), width=110, sort_dicts=False)
