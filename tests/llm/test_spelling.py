import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from progcorpus.llm import spelling as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, slips=199):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute_groups(words, ratio=5):
    """Near words by deleting, in every word, each code point in turn."""
    holes, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i], w[i + 1:]), set()).add(w)       # replaced at i
            short = w[:i] + w[i + 1:]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def variants(rnd, n=500, alphabet="abcdeé"):
    words = {}
    while len(words) < n:
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(6, 10)))
        words[w] = rnd.choice([5, 6, 30, 200, 900])
        for _ in range(rnd.randrange(4)):
            i, c = rnd.randrange(len(w)), rnd.choice(alphabet)
            v = rnd.choice([w[:i] + c + w[i + 1:], w[:i] + c + w[i:], w[:i] + w[i + 1:]])
            if len(v) >= 6:
                words.setdefault(v, rnd.choice([5, 5, 25, 150]))
    return words


@pytest.mark.parametrize("cell", [4096, 64, 7])
def test_groups_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(S, "CELL", cell)
    monkeypatch.setattr(S, "LEAF", min(S.LEAF, cell))
    words = variants(random.Random(cell))
    words |= {"listen": 9, "silent": 9, "tinsel": 60, "enlist": 9, "aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "àààààà": 7,
              "b" * 5000: 5, "b" * 5001: 25, "b" * 2500 + "c" + "b" * 2500: 125, "×÷×÷×÷": 5, "×÷×÷×÷×": 5}
    table = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    assert sorted(map(tuple, S.group_variants(table).collect())) == brute_groups(words)


def test_equal_vectors_are_split_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL", 10)
    rnd = random.Random(3)
    words = {"".join(rnd.sample("abcdefg", 7)): rnd.randrange(5, 500) for _ in range(600)}
    words |= {"".join(rnd.sample("abcdefgh", 7)): rnd.randrange(5, 500) for _ in range(100)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, S.group_variants(table).collect())) == brute_groups(words)


def test_reach_never_misses_a_near_vector():
    rnd = np.random.default_rng(4)
    points = rnd.integers(0, 3, (400, S.LETTERS)).astype(np.int32)
    tree = S.KdTree.build(points, 5)
    leaf_of = {int(i): n for n, rows in enumerate(tree.leaves) for i in rows}
    queries = points.copy()
    for q in queries:
        i, j = rnd.choice(S.LETTERS, 2, replace=False)
        q[i] += 1
        q[j] = max(0, q[j] - 1)
    hits = {(int(r), leaf) for leaf, rows in tree.reach(queries, 1, 1) for r in rows}
    assert all((i, leaf_of[i]) in hits for i in range(len(points)))
    assert len(hits) < len(points) * len(tree.leaves)
    exact = [(int(r), leaf) for leaf, rows in tree.reach(points, 0, 0) for r in rows]
    assert sorted(exact) == sorted(leaf_of.items())


def test_one_edit():
    def rows(*words):
        return np.array([list(w.encode("latin-1")) for w in words], dtype=np.uint8)

    a = rows("abcdef", "abcdef", "abcdef", "abcdef")
    assert S.one_edit(a, rows("abcdeg", "abcdef", "badcef", "xbcdef")).tolist() == [True, False, False, True]
    assert S.one_edit(a, rows("abcdeff", "xabcdef", "abxcdef", "abcfdeg")).tolist() == [True, True, True, False]


def test_documents_with_nulls_long_texts_and_repeated_rows(docs_of):
    rnd = random.Random(8)
    words = list(variants(rnd, 80))
    rows = [(i, " ".join(rnd.choice(words).upper() if rnd.random() < .2 else rnd.choice(words) for _ in range(60))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "1 2 3"), (None, "nullword " * 7), (903, "longerword, " * 500_000),
             (904, "x" * 300_000 + "." + "y" * 9), rows[2], rows[2], (905, "letterÿŸletter×letter Ābcdefgh " * 6)]
    table = docs_of(rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    got = S.group_variants(S.count_words(table, slips=199))
    assert sorted(map(tuple, got.collect())) == brute_groups(brute_words(rows))


def test_empty_table(spark, docs_of):
    assert S.group_variants(S.count_words(docs_of([]))).collect() == []


def test_documents(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    got = S.group_variants(S.count_words(sf_docs, slips=199))
    assert sorted(map(tuple, got.collect())) == brute_groups(brute_words(rows))
