import hashlib
import random
import re

import pytest

from progcorpus.llm import phraseindex as P

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        windows += [(i, w[k:k + n]) for k in range(len(w) - n + 1)] if n else []
    out = []
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        at = {}
        for k, x in enumerate(w):
            at.setdefault(x, []).append(k)
        for i, win in windows:
            for k in at.get(win[0], ()):
                if w[k:k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(i)
        ids = sorted(str(i) for i in ids - {None})
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("a b c dd ee éa Ça 12".split()) for _ in range(n))
    items = [(1, text(12)), (2, "dd ee. DD"), (3, "zebra"), (4, None), (5, "?!"), (6, text(10)), (None, "omega psi"), (7, "zebra"),
             (2, "dd ee. DD"), (8, "a " * 30)]
    docs = [(i, text(rnd.randrange(80))) for i in range(120)]
    docs += [(200, "x, " + items[0][1].upper().replace(" ", "...") + " y"), (201, None), (202, ""), (203, "ZEBRA omega psi"),
             (None, items[5][1]), (204, "zebra " * 20_000), (205, "ends a a a a a"), (206, "a a a a a starts"), (204, "zebra")]
    docs.append((207, items[5][1] + " " + " ".join(items[5][1].split()[1:])))
    return docs, items


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_equals_brute_force(spark, docs_of, block):
    docs, items = cases()
    table = docs_of(docs).withColumnRenamed("lang", "segment").withColumnRenamed("source", "item_id")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    index = P.build_index(table)
    got = P.per_document(index, P.search(index, bench, block_bytes=block)).drop("segment", "ordinal")
    assert result(got) == brute(docs, items)


def test_match_spans(spark, docs_of):
    index = P.build_index(docs_of([(1, "q w e r t y"), (2, "w e r w e r x")]))
    bench = spark.createDataFrame([(7, "W e r"), (8, "r")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.end) for r in P.search(index, bench).collect())
    assert got == [(1, 7, 1, 4), (1, 8, 3, 4), (2, 7, 0, 6), (2, 8, 2, 3), (2, 8, 5, 6)]


def test_proximity(spark, docs_of):
    docs = [(1, "alpha x x beta"), (2, "beta x alpha"), (3, "alpha"), (4, "beta " + "x " * 9 + "alpha"), (5, "beta"), (6, "alpha beta alpha")]
    index = P.build_index(docs_of(docs).coalesce(1))
    bench = spark.createDataFrame([(1, "alpha beta alpha")], "item_id long, text string")
    near = lambda n: sorted((r.doc_id, r.start, r.end) for r in P.proximity(index, bench, n).collect())
    assert {x[0] for x in near(2)} == {2, 6}
    assert {x[0] for x in near(3)} == {1, 2, 6}
    assert {x[0] for x in near(10)} == {1, 2, 4, 6}
    assert (1, 0, 4) in near(3) and (2, 0, 3) in near(2)


def brute_near(docs, items, distance):
    out = set()
    for i, t in items:
        wanted = set(split(t))
        for d, text in docs:
            w = split(text)
            spans = [(a, b) for a in range(len(w)) for b in range(a + 1, min(len(w), a + distance + 1) + 1)
                     if wanted and wanted <= set(w[a:b])]
            out |= {(d, i, a, b) for a, b in spans if not any(a <= x and y <= b and (x, y) != (a, b) for x, y in spans)}
    return sorted(out)


@pytest.mark.parametrize("segment", [20, 300, 1 << 20])
def test_proximity_does_not_depend_on_segments(spark, docs_of, monkeypatch, segment):
    rnd = random.Random(4)
    line = lambda k, n: " ".join(rnd.choice("alpha beta gamma delta x y".split()[:k]) for _ in range(n))
    docs = [(i, line(rnd.choice([3, 6]), rnd.randrange(1, 30))) for i in range(60)]
    # the second word is the rarest among these, and the first or third among those
    docs += [(100, "alpha x x x beta x x x gamma"), (101, "alpha gamma " * 9), (102, "beta " * 20 + "gamma")]
    items = [(1, "alpha beta gamma"), (2, "delta alpha gamma beta"), (3, "y"), (4, "absent alpha"), (5, "gamma beta x y"), (6, "")]
    monkeypatch.setattr(P, "SEGMENT_BYTES", segment)
    index = P.build_index(docs_of(docs).coalesce(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for distance in (2, 5, 8):
        got = sorted((r.doc_id, r.item_id, r.start, r.end) for r in P.proximity(index, bench, distance).collect())
        assert got == brute_near(docs, items, distance)
    assert (100, 1, 0, 9) in got


def test_proximity_of_a_document_beside_others(spark, docs_of):
    """At distance 5, the words at 0, 4 and 8 were found or lost by which of them its neighbours hold."""
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    one = (1, "alpha x x x beta x x x gamma")
    for other in ("alpha " * 9 + "gamma " * 9, "beta " * 9):
        index = P.build_index(docs_of([one, (2, other)]).coalesce(1))
        assert P.proximity(index, bench, 5).collect() == []
        assert [(r.doc_id, r.start, r.end) for r in P.proximity(index, bench, 8).collect()] == [(1, 0, 9)]


def test_documents_and_empty_tables(spark, docs_of, sf_docs):
    import os

    bench = spark.read.parquet(os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001") + "/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in sf_docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = brute(docs, items)
    assert any(x[-1] for x in want)
    assert result(P.decontaminate(sf_docs, bench)) == want
    assert P.decontaminate(sf_docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in P.decontaminate(sf_docs, bench.limit(0)).collect())
