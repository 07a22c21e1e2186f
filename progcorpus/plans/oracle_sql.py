"""SQL building blocks for the per-template oracles (DuckDB)."""

from __future__ import annotations

from progcorpus.plans.golden import CLASS, CLEAN, FUNCS, GOLDEN, RELEVANT
from progcorpus.sources.fixtures import sql_str


def sql_val(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, int):
        return str(x)
    return sql_str(str(x))


def _values(name: str, cols: list[str], rows: list[tuple], types: list[str]) -> str:
    if not rows:
        rows = [tuple(None for _ in cols)]
    body = ",\n  ".join("(" + ", ".join(f"CAST({sql_val(x)} AS {t})" for x, t in zip(r, types)) + ")"
                        for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES\n  {body})"


SCALARS = ["tokenizes", "compile_error", "n_nodes", "variables", "multi_function", "first_function",
           "n_tokens", "defs", "def_positions", "max_indent_depth", "n_indent", "n_dedent"]
_TYPES = {"tokenizes": "BOOLEAN", "compile_error": "VARCHAR", "n_nodes": "BIGINT", "variables": "VARCHAR",
          "multi_function": "BOOLEAN", "first_function": "VARCHAR", "n_tokens": "BIGINT", "defs": "BIGINT",
          "def_positions": "VARCHAR", "max_indent_depth": "INTEGER", "n_indent": "BIGINT", "n_dedent": "BIGINT"}


def golden_scalars() -> str:
    rows = [(v, *[g[c] for c in SCALARS], RELEVANT[v], CLASS[v], CLEAN[v]) for v, g in GOLDEN.items()]
    cols = ["v", *SCALARS, "relevant", "cls", "clean"]
    types = ["INTEGER", *[_TYPES[c] for c in SCALARS], "VARCHAR", "VARCHAR", "VARCHAR"]
    return _values("gs", cols, rows, types)


def golden_constructs() -> str:
    rows = []
    for v, g in GOLDEN.items():
        for construct, key in (("operators", "operators"), ("numbers", "numbers"), ("strings", "strings"),
                               ("variables", "variable_locations")):
            for src, pos in g[key].items():
                rows.append((v, construct, src, pos, len(pos.split(","))))
    return _values("gc", ["v", "construct", "src", "positions", "n"], rows,
                   ["INTEGER", "VARCHAR", "VARCHAR", "VARCHAR", "BIGINT"])


def golden_funcs() -> str:
    rows = []
    for v, fs in FUNCS.items():
        for ix, (name, text) in enumerate(fs, start=1):
            rows.append((v, ix, name, text))
    return _values("gf", ["v", "ix", "name", "string"], rows, ["INTEGER", "INTEGER", "VARCHAR", "VARCHAR"])


# distinct texts with their template id (a text determines its template)
DIM = """d AS (SELECT sha256(func_code) AS code_id, v, any_value(func_name) AS func_name,
              any_value(func_code) AS func_code FROM submissions GROUP BY sha256(func_code), v)"""


def whole(expr: str, code: str = "func_code", f: str = "func_name") -> str:
    """Golden text column: ``WHOLE`` = the text from its first ``def``; ``{f}`` = question name."""
    return (f"CASE WHEN {expr} = 'WHOLE' THEN substr({code}, strpos({code}, 'def')) "
            f"ELSE replace({expr}, '{{f}}', {f}) END")


def ctes(*parts: str) -> str:
    return ",\n".join(parts)
