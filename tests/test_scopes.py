"""Renaming by binding (A10): which programs share a class."""

import random

import pytest

from progcorpus.operators import dedup as D
from progcorpus.operators import nodes as N
from progcorpus.operators import tokens as T

SUB = "sub_id long, func_name string, func_code string"


def classes(spark, codes, name="f"):
    subs = T.with_code_id(spark.createDataFrame([(i, name, c) for i, c in enumerate(codes)], SUB))
    canon = D.canonical_form(N.node_table(T.code_dim(subs)), subs.select("code_id", "func_name").distinct())
    got = {r.code_id: r.normalized for r in canon.collect()}
    return [got.get(r.code_id) for r in subs.orderBy("sub_id").collect()]


SAME = [
    # a helper's names and a helper's use of the same spelling stay as they are
    ("def g(x): return x\ndef f(a): return g(a)", "def g(x): return x\ndef f(x): return g(x)"),
    ("def h(): return max(1, 2)\ndef f(max): return h()", "def h(): return max(1, 2)\ndef f(a): return h()"),
    # captured names
    ("def f(a):\n def g(b): return a + b\n return g", "def f(c):\n def g(b): return c + b\n return g"),
    ("def f(a):\n n = 0\n def g():\n  nonlocal n\n  n += a\n return g", "def f(b):\n k = 0\n def g():\n  nonlocal k\n  k += b\n return g"),
    ("def f(a):\n class K:\n  a = 1\n  def m(self): return a\n return K", "def f(x):\n class K:\n  a = 1\n  def m(self): return x\n return K"),
    ("def f(a): return lambda a: a", "def f(b): return lambda a: a"),
    # comprehensions have scopes of their own
    ("def f(a): return [x for x in a]", "def f(a): return [y for y in a]"),
    ("def f(x): return [x for x in x]", "def f(y): return [x for x in y]"),
    ("def f(a): return {k: v for k, v in a if (n := k)} or n", "def f(b): return {p: q for p, q in b if (m := p)} or m"),
    # keywords keep their names, arguments do not
    ("def f(a): return g(a=a)", "def f(b): return g(a=b)"),
    ("def f(a):\n try: return a()\n except E as e: return e", "def f(b):\n try: return b()\n except E as x: return x"),
    ("def f(a):\n match a:\n  case {'k': v, **r}: return v, r", "def f(b):\n match b:\n  case {'k': w, **s}: return w, s"),
    ("def f(a):\n import m.n as p\n return p, a", "def f(b):\n import m.n as q\n return q, b"),
    ("def f(a, b=1, *c, d, **e): return a, b, c, d, e", "def f(p, q=1, *r, s, **t): return p, q, r, s, t"),
    ("def f(a):\n def g():\n  def h(): return a\n  return h\n return g", "def f(z):\n def g():\n  def h(): return z\n  return h\n return g"),
]
DIFFERENT = [
    ("def h(): return max(1, 2)\ndef f(max): return h()", "def h(): return min(1, 2)\ndef f(min): return h()"),
    ("def f(a): return [x for x in a] + [x]", "def f(a): return [y for y in a] + [y]"),
    ("def f(a, b=a): return a", "def f(c, b=c): return c"),
    ("@d\ndef f(d): return d", "@e\ndef f(e): return e"),
    ("def f(d: d): return d", "def f(e: e): return e"),
    ("def f():\n global a\n a = 1", "def f():\n global b\n b = 1"),
    ("def f(a):\n def g():\n  global a\n  return a\n return a", "def f(b):\n def g():\n  global b\n  return b\n return b"),
    ("def f(a): return g(a=a)", "def f(b): return g(b=b)"),
    ("def f(a):\n def g(b): return a\n return g", "def f(a):\n def g(b): return b\n return g"),
    ("def f(a): return a.a", "def f(b): return b.b"),
    ("def f(a):\n class K:\n  a = 1\n  b = a\n return K", "def f(c):\n class K:\n  a = 1\n  b = c\n return K"),
    ("def f(a): return [a for b in a]", "def f(a): return [b for b in a]"),
    ("def f(a): return [b for b in a for c in b]", "def f(a): return [c for b in a for c in b]"),
]


def test_same_and_different_classes(spark):
    got = classes(spark, [c for pair in SAME + DIFFERENT for c in pair])
    assert all(x is not None for x in got)
    pairs = list(zip(got[::2], got[1::2]))
    assert [a == b for a, b in pairs[:len(SAME)]] == [True] * len(SAME), [p for p, (a, b) in zip(SAME, pairs) if a != b]
    assert [a == b for a, b in pairs[len(SAME):]] == [False] * len(DIFFERENT), [
        p for p, (a, b) in zip(DIFFERENT, pairs[len(SAME):]) if a == b]


# programs with slots for the wanted function's local names; all other names are fixed
SLOTS = [
    "def g(x):\n    x = x + 1\n    return x\ndef f({0}, {1}=1):\n    {2} = [{3} * {1} for {3} in g({0})]\n    return {2}",
    "total = 0\ndef f({0}):\n    global total\n    total += {0}\n    def {1}(p, q={0}):\n        return total + p + q + {0}\n    return {1}(q={0})",
    "def f({0}, *{1}, **{2}):\n    {3} = 0\n    def {4}():\n        nonlocal {3}, {0}\n        {3} += {0}\n        return {3}\n"
    "    for {0} in {1}:\n        {4}()\n    return {3}, {2}",
    "class C:\n    def m(self, i):\n        return i\ndef f({0}):\n    class {1}(C):\n        w = {0}\n        def m(self, j):\n"
    "            return {{k: {0} for k in self.w if k not in {{z9 for z9 in {0}}}}}\n    del {0}\n    return {1}().m(j=1)",
    "def f({0}):\n    with {0} as ({1}, {2}), {1}() as {3}:\n        return (lambda r, s={2}: r + s + {3})({0})",
    "def f({0}):\n    try:\n        {1}: int = {0}\n        yield from ({2} async for {2} in {1})\n    except (A, B) as {3}:\n"
    "        raise {3} from {0}",
    "import os\ndef f({0}):\n    from os import path as {1}\n    {2} = {3} = {1}.join({0}, os.sep)\n    {2}, *{3} = {2}\n    return f'{{{3}}}-{{{2}!r:>{{{0}}}}}'",
]
POOL = ["x", "y", "i", "j2", "n", "val", "items", "x_0", "x_1", "acc", "self2", "data"]


@pytest.mark.parametrize("seed", [1, 2])
def test_class_is_kept_under_any_renaming_of_locals(spark, seed):
    rnd = random.Random(seed)
    codes, template = [], []
    for t, text in enumerate(SLOTS):
        # a name that the program uses for something of its own would be captured
        free = [p for p in POOL if p not in ("x",) or t == 0]
        for _ in range(6):
            codes.append(text.format(*rnd.sample(free, 5)))
            template.append(t)
    got = classes(spark, codes)
    by = {}
    for t, c, code in zip(template, got, codes):
        assert c is not None, code
        by.setdefault(t, set()).add(c)
    assert {t: len(s) for t, s in by.items()} == dict.fromkeys(range(len(SLOTS)), 1)
    assert len(set.union(*by.values())) == len(SLOTS)


def test_scopes_of_nodes():
    code = "@d(p)\ndef f(a: b, c=e) -> r:\n    return [(x, y) for x in a for y in x if (z := y)]\nclass K(B):\n    q = lambda s=t: s\n"
    rows, err = N._flatten(code)
    assert err is None
    kind = {r[0]: r[6] for r in rows}
    scope = {}
    for r in rows:
        if r[6] in ("Name", "arg"):
            scope.setdefault(r[7], set()).add(kind[r[11]])
    assert scope == {"d": {"Module"}, "p": {"Module"}, "a": {"FunctionDef"}, "b": {"Module"}, "c": {"FunctionDef"},
                     "e": {"Module"}, "r": {"Module"}, "x": {"ListComp"}, "y": {"ListComp"}, "z": {"FunctionDef"},
                     "B": {"Module"}, "q": {"ClassDef"}, "s": {"Lambda"}, "t": {"ClassDef"}}
