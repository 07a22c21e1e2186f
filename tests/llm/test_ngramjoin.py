import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from progcorpus.llm import graph
from progcorpus.llm import ngramjoin as J

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    sets = [shingle_set(t) for t in texts]
    n, up = [0] * len(texts), list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 5 * len(a & b) >= 4 * len(a | b):
            n[i] += 1
            n[j] += 1
            up[root(i)] = root(j)
    at = {t: i for i, t in enumerate(texts)}
    ids, same = {}, {}
    for d, t in rows:
        if d is not None:
            i = at[t or ""]
            ids[root(i)] = min(d, ids.get(root(i), d))
            same[i] = min(d, same.get(i, d))
    out = [(d, ids.get(root(at[t or ""])), n[at[t or ""]], same.get(at[t or ""])) for d, t in rows]
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def edit(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return " ".join(words)


def cases():
    rnd = random.Random(6)
    text = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    rows, base = [], text(200)
    rows += [(i, edit(rnd, base, rnd.randrange(6))) for i in range(0, 60)]          # one large group around the threshold
    for g in range(25):
        words = text(rnd.randrange(6, 120))
        rows += [(100 + 10 * g + k, edit(rnd, words, rnd.randrange(3))) for k in range(4)]
    passage = " ".join(text(60))
    rows += [(1000 + i, passage + " " + " ".join(text(150))) for i in range(30)]     # a shared passage links nothing
    rows += [(2000, None), (2001, ""), (2002, "?!"), (2003, "a b"), (2004, "A  b."), (2005, "b a"), (2006, "one two three four five")]
    rows += [(None, " ".join(base)), (None, "only null ids here at all"), (3, rows[3][1]), (2007, rows[5][1].upper()), (2008, "z " * 60_000)]
    return rows


@pytest.fixture(params=[(J.CHUNK, J.BUCKET_CHUNK), (7, 5)])
def chunks(request, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", request.param[0])
    monkeypatch.setattr(J, "BUCKET_CHUNK", request.param[1])


def test_every_pair_of_a_group_is_verified(docs_of, monkeypatch, chunks):
    """Signatures that call every pair unlike do not remove exact links inside a group."""
    monkeypatch.setattr(J, "candidate_groups", lambda sigs: sigs.where(F.size("bands") > 0).select(
        "id", F.lit(b"g").alias("grp")))
    monkeypatch.setattr(J, "similar", lambda a, b: np.zeros(len(a), dtype=bool))
    rnd = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, edit(rnd, base, rnd.randrange(5))) for i in range(30)] + [(50, "some other text with words")]
    want = brute(rows)
    assert sum(r[2] for r in want) > 100
    assert result(J.link_classes(docs_of(rows))) == want


def test_equals_brute_force(docs_of, chunks):
    rows = cases()
    docs = docs_of(rows).withColumnRenamed("lang", "id").withColumnRenamed("source", "sig")
    assert result(J.link_classes(docs)) == brute(rows)


def test_representatives(docs_of):
    rows = cases()
    docs = docs_of(rows).withColumnRenamed("lang", "id").withColumnRenamed("source", "label")
    kept = J.keep_representatives(docs)
    assert kept.columns == docs.columns
    want = sorted({c if c is not None else "none" for _, c, *_ in brute(rows)}, key=str)
    got = [r.doc_id if r.doc_id is not None else "none" for r in kept.collect()]
    assert sorted(got, key=str) == want


def test_empty_table(docs_of):
    assert J.link_classes(docs_of([])).collect() == []
    assert J.link_classes(docs_of([(1, None), (2, "?")])).count() == 2


def test_min_hash_estimates_and_bound():
    rnd = random.Random(8)
    err = []
    for _ in range(60):
        a = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        b = a[:rnd.randrange(100, 300)] + [f"w{rnd.randrange(10**6)}" for _ in range(40)]
        ta, tb = " ".join(a), " ".join(b)
        sa, sb = shingle_set(ta), shingle_set(tb)
        _, v = J.min_hashes(*J.shingles([ta.encode(), tb.encode()]), 2)
        err.append((v[0] == v[1]).mean() - len(sa & sb) / len(sa | sb))
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.06
    for n, m in J.KEEP.items():
        tail = lambda k: sum(math.comb(n + 1, i) * 0.8 ** i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= J.TOLERANCE > (tail(m - 1) if m else 0)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(100)] + [(200, rnd.randrange(201, 400)) for _ in range(80)] + [(500, 500), (601, 600)]
    got = {r.u: r.v for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{b: 200 for a, b in edges if a == 200}, 601: 600}


def test_documents(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert result(J.link_classes(sf_docs)) == brute(rows)
