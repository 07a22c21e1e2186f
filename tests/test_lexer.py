"""The Spark token table reproduces the standard library token stream."""

import pytest
from pyspark.sql import functions as F

from progcorpus.operators.tokens import code_dim, rebuild, token_profile, token_table
from progcorpus.sources.fixtures import TEMPLATES
from pytokens import py_tokens

EDGES = [
    "x = 'a\\'b' + \"c\"  # comment\n",
    "s = '''a\n#b\"'''\n",
    "y = rb'x' + u\"z\" + Rb'''q'''\n",
    "if (a :=\n  3):\n    b **= 2\n",
    "x = 1 + \\\n  2\n",
    "def f():\n    if x:\n        return 1\n    return 2\n\n# end\n",
    "x = [1,\n# c\n 2]\n",
    "def g():\n    pass\n  # c\nz = 1",
    "a = 0x1F + 1_000 + 1.5e-3 + 3j + .5\n",
    "x = 'abc\n",
    "a = 1\n  b = 2\n",
    "def f(:\n",
    "x = (1,\n",
    "x = ']'\n",
    "class A:\n    def m(self):\n        pass\n\n    def n(self):\n\tpass\n",
    "x = '" + "a" * 100000 + "'\n",
    "x = '" + "\\\\" * 30000 + "'\n",
    # tokenizer leniency and its errors
    "a = $b ? !c `d`\n", "x = )\n", "x = (]\n", "x = ))(\n", "(\n]\n", "x = €\n", "x = \x01\n",
    "x = 1 + \\\n", "a \\\n   \n", "0or 1\n", "0b12\n", "0o8\n", "1_\n", "1.2.3\n", "0x1g\n", "09\n",
    "中文 = 1\n", "x = \U0001F600\n", "é = 2\n", "a\u00a0= 1\n",
]


# strings, comments, brackets, line breaks and f-strings inside replacement fields
FSTRINGS = [
    'x = f"{d["#k"]}"\n', "x = f'{d['k']}' + '#'  # c\n", 'x = f"{f"{f"{1}"}"}"\n', 'x = f"{"}"}" + f"{\'{\'}"\n',
    'x = f"{a["x"]}{b["y"]}" "z" f"{c}"\n', 'x = f"{x:{"w"}}" + f"{x!r:>{w["n"]}}"\n', 'x = f"{{{d["k"]}}}" + f"{{"\n',
    'x = f"""{d["k"]} " {e[\'""\']} {f"{y}"}\n"""\n', "x = rf'{d['\\n']}\\{a}' + fR\"{b}\"\n", 'x = f"{(lambda: "a")()}"\n',
    'x = f"{\n  d["k"]  # "c"\n}"\ny = 1\n', 'x = f"{ {"a": 1}["a"] }" + f"{[1, "b"][1]:>{3}}"\n', 'x = f"{""}" + f""\n',
    'x = f"\\N{BULLET} {d["k"]}" + f"\\\\{d["k"]}"\n', 'def f(d):\n    return f"{d["a"]}"  # f"{x["\n', "x = f\"it's {d}\" + 'y'\n",
    'if f"{d["a"]}" == "b":\n    x = f"{d["c"]}"\n', '# f"{x["\ny = "f\'{"\n', 'x = f"{é["ñ"]}" + g"\n', 'x = f"{d["é☃"]}" * 2\n',
    'x = f"""{d["""k"""]}"""\n', "x = f'{x['a']:%Y-%m:{'b'}}'\n", 'x = F"{d["k"]}" + Rf\'{d["k"]}{d[\'j\']}\'\n',
]


@pytest.fixture(scope="module")
def job(spark):
    texts = [t.replace("{f}", "task_1") for t in TEMPLATES] + EDGES + FSTRINGS
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, func_code string")
    dim = code_dim(df)
    return dim, token_table(dim)


def test_stream_matches_stdlib(job):
    dim, j = job
    codes = {r["code_id"]: r["code"] for r in dim.collect()}
    status = {r["code_id"]: r["tokenizes"] for r in j.status.collect()}
    counts = {r["code_id"]: r["n_tokens"] for r in j.status.collect()}
    by = {}
    for r in j.tokens.select("code_id", "pos", "kind", "src", "indent_depth", "line", "off",
                             "bracket_depth").collect():
        by.setdefault(r["code_id"], []).append(r)
    for cid, code in codes.items():
        ref = py_tokens(code)
        assert status[cid] == (ref is not None), repr(code[:60])
        rows = sorted(by[cid], key=lambda r: r["pos"])
        assert counts[cid] == len(rows)
        mine = [(r["kind"], r["src"]) for r in rows]
        assert sorted(r["pos"] for r in by[cid]) == list(range(len(mine)))
        assert "".join(s for _, s in mine) == code
        if ref is not None:
            assert mine == ref, repr(code[:60])
            depth, line, off, brackets = 0, 1, 0, 0
            for r, (k, src) in zip(rows, ref):
                depth += (k == "INDENT") - (k == "DEDENT")
                assert r["indent_depth"] == depth and r["line"] == line, (repr(code[:40]), k, src)
                assert r["off"] == off, (repr(code[:40]), k, src)
                if k not in ("DEDENT", "ENDMARKER", "NEWLINE") or src:
                    assert r["bracket_depth"] == brackets, (repr(code[:40]), k, src)
                if k == "OP" and src in "([{":
                    brackets += 1
                elif k == "OP" and src in ")]}":
                    brackets = max(0, brackets - 1)
                off += len(src)
                line += src.count("\r\n") + src.replace("\r\n", "").count("\n") + src.replace("\r\n", "").count("\r")


def test_rebuild(job):
    dim, j = job
    got = {r["code_id"]: r["text"] for r in rebuild(j.tokens).collect()}
    for r in dim.collect():
        assert got[r["code_id"]] == r["code"]


def test_fstring_is_one_token(spark):
    df = spark.createDataFrame([(1, "y = f'{z}'\n")], "i int, func_code string")
    j = token_table(code_dim(df))
    kinds = [r[0] for r in j.tokens.orderBy("pos").select("kind").collect()]
    assert kinds.count("STRING") == 1  # decision D33


def test_no_python_in_token_plan(job):
    dim, j = job
    plan = j.tokens.where(F.col("kind") == "NAME")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_documents_match_stdlib(spark):
    """Whole prose documents lexed as Python: verdict and stream per text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", F.col("text").alias("func_code"))
    dim = code_dim(docs)
    j = token_table(dim)
    status = {r["code_id"]: r["tokenizes"] for r in j.status.collect()}
    by = {}
    for r in j.tokens.select("code_id", "pos", "kind", "src").collect():
        by.setdefault(r["code_id"], []).append(r)
    for r in dim.collect():
        ref = py_tokens(r["code"])
        assert status[r["code_id"]] == (ref is not None)
        mine = [(x["kind"], x["src"]) for x in sorted(by[r["code_id"]], key=lambda x: x["pos"])]
        assert "".join(s for _, s in mine) == r["code"]
        if ref is not None:
            assert mine == ref


def test_document_verdicts_match_stdlib(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = token_profile(docs, "text").collect()
    assert len(got) == len(texts)
    for r in got:
        ref = py_tokens(texts[r.doc_id])
        assert r.tokenizes == (ref is not None)
        if ref is None:
            assert r.n_tokens is None and r.max_indent_depth is None
            continue
        depth = [0]
        for k, _ in ref:
            depth.append(depth[-1] + (k == "INDENT") - (k == "DEDENT"))
        assert (r.n_tokens, r.max_indent_depth) == (len(ref), max(depth))


SPAN_PROGRAMS = [
    "class A:\n    def m(self):\n        return 1\n\n    @staticmethod\n    def n():\n        pass\n# tail\nx = 1\n",
    "def f(a):\n    def g(b):\n        if b:\n            return 1\n        return 2\n    # note\n    return g(a)\n",
    "def one(): return 1\ndef two():\n    return 2\n",
    "def f():\n    x = [1,\n  2]\n    return x\n\n\ny = 3",
    "if True:\n    def h():\n        pass\n    z = 1\n",
]


def _expected_spans(text):
    """Spans by counting the stdlib INDENT/DEDENT tokens: a def whose body is
    indented ends just before the DEDENT that closes that body; a one-line
    body ends at the first token of the next logical line (D22)."""
    toks = py_tokens(text)
    spans = []
    for i, (k, s) in enumerate(toks):
        if k != "NAME" or s != "def":
            continue
        j = i
        while toks[j][0] not in ("NEWLINE", "ENDMARKER"):
            j += 1
        k2 = j + 1
        while k2 < len(toks) and toks[k2][0] in ("NL", "COMMENT", "UNIMPORTANT_WS"):
            k2 += 1
        if k2 < len(toks) and toks[k2][0] == "INDENT":
            depth, e = 0, k2
            while e < len(toks):
                depth += (toks[e][0] == "INDENT") - (toks[e][0] == "DEDENT")
                if depth == 0:
                    break
                e += 1
        else:   # one-line body: up to the next logical line's first token (or its DEDENTs)
            e = j + 1
            while e < len(toks) and toks[e][0] in ("NL", "COMMENT", "UNIMPORTANT_WS"):
                e += 1
        spans.append((i, "".join(s for _, s in toks[i:e])))
    return spans


def test_function_spans_match_indent_counting(spark):
    from progcorpus.operators.functions import function_table

    df = spark.createDataFrame([(i, t) for i, t in enumerate(SPAN_PROGRAMS)], "i int, func_code string")
    dim = code_dim(df)
    ft = function_table(token_table(dim), dim)
    got = {}
    for r in ft.collect():
        got.setdefault(r["code_id"], []).append((r["fn_pos"], r["string"]))
    for r in dim.collect():
        assert sorted(got[r["code_id"]]) == _expected_spans(r["code"]), repr(r["code"][:50])
