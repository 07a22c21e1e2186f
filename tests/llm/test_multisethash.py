import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from progcorpus.llm import multisethash as M


def fp(text):
    return M.to_hex(*(v[0] for v in M.vectors([text.encode()])))


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        edited = t[:len(t) - k] + n[:k]
        a, e, f = M.from_hex(fp(t)), M.from_hex(fp(edited)), M.from_hex(fp(n))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp(t), fp(edited), M.likeness(a, e), M.likeness(a, f)))
    return sorted(out, key=str)


def text(rnd, n):
    return "\n".join(" ".join(f"w{rnd.randrange(500)}é" for _ in range(rnd.randrange(12))) for _ in range(n))


@pytest.mark.parametrize("size", [1 << 30, 2000])
def test_equals_brute_force(docs_of, size):
    rnd = random.Random(1)
    rows = [(rnd.randrange(10_000), text(rnd, rnd.randrange(12))) for _ in range(150)]
    rows += [(None, "null id"), (None, "other"), (5, None), (6, ""), (rows[0][0], "tie"), rows[1], (20_000, "x\n" * 30_000), (-4, "long " * 30_000)]
    docs = docs_of(rows).withColumnRenamed("lang", "bucket").withColumnRenamed("source", "guard")
    assert sorted(map(tuple, M.edit_likeness(docs, size).collect()), key=str) == brute(rows)


def test_single_row_and_empty_table(docs_of):
    assert [tuple(r) for r in M.edit_likeness(docs_of([(1, "a b c d\ne")])).collect()] == brute([(1, "a b c d\ne")])
    assert M.edit_likeness(docs_of([])).collect() == []
    assert M.fingerprints(docs_of([])).collect() == []


def test_order_insertion_and_deletion(docs_of):
    rnd = random.Random(2)
    parts = text(rnd, 40).split("\n")
    shuffled = rnd.sample(parts, len(parts))
    assert fp("\n".join(parts)) == fp("\n".join(shuffled)) != fp("\n".join(parts[1:]))
    assert M.insert(fp("\n".join(parts[3:])), parts[:3]) == fp("\n".join(parts))
    assert M.delete(fp("\n".join(parts)), parts[10:]) == fp("\n".join(parts[:10]))
    assert fp("a a") != fp("a a\na a")
    got = {r.doc_id: r.fingerprint for r in M.fingerprints(docs_of([(1, "b\na"), (2, "a\nb"), (3, None)])).collect()}
    assert got[1] == got[2] == fp("a\nb") and got[3] == fp("")


def exact(a, b):
    """The likeness from the counts of the runs of three words of one-line texts."""
    x, y = (Counter(zip(w, w[1:], w[2:])) for w in (a.split(), b.split()))
    off = sum((x[r] - y[r]) ** 2 for r in x | y)
    return 1 - off / sum(n * n for c in (x, y) for n in c.values())


@pytest.mark.parametrize("n", [20_000, 45_000, 70_000, 131_072])
def test_a_run_repeated_more_often_than_16_bits_count(docs_of, n):
    a, b = "z " * n, "z " * (n // 3)
    k = len(a) // 4
    got = {r.doc_id: r for r in M.edit_likeness(docs_of([(1, a), (2, b)])).collect()}
    assert got[1].near_edited == pytest.approx(exact(a, a[:len(a) - k] + b[:k]), abs=1e-9)
    assert got[1].near_next == got[2].near_next == pytest.approx(exact(a, b), abs=1e-9)
    copy = M.vectors([a[:len(a) - k].encode()])
    assert M.likeness([v[0] for v in M.vectors([a.encode()])], [v[0] for v in copy]) == pytest.approx(0.96, abs=1e-3)


def test_no_lane_of_the_longest_text_overflows():
    one = np.ones(M.LIKENESS, np.uint32)
    a, b = ((np.array([k], np.uint32), one * np.uint32(k << 28)) for k in (4, 3))
    assert M.likeness(a, b) == pytest.approx(1 - 1 / 25)
    assert M.likeness(a, (b[0], np.uint32(0) - a[1])) == 0


def test_likeness_follows_the_shared_share(sf_docs):
    rows = M.edit_likeness(sf_docs).collect()
    long = [r for r in rows if r.n_chars > 1500]
    assert 0.6 < np.median([r.near_edited for r in long]) < 0.85
    assert np.median([r.near_next for r in long]) < 0.2
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert all((r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1) for r in rows)


def test_an_id_that_a_third_of_the_rows_share_is_cut_apart(docs_of):
    rnd = random.Random(9)
    rows = [(5 if i % 3 == 0 else i - 100, f"{rnd.randrange(10 ** 6)} {text(rnd, 4)}") for i in range(300)]
    rows += [(None, "null id é"), (None, None), (5, None), (5, ""), (-(1 << 63), "least"), ((1 << 63) - 1, "é" * 40)]
    got = M.edit_likeness(docs_of(rows), range_bytes=1000)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < len(rows) / 6
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)
