import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash

from progcorpus.llm import simhash as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    if not w:
        return 0
    parts = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4):
    fp = [brute_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    values = np.array(fp, dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{fp[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rnd = random.Random(13)
    words = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    rows = []
    for g in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randrange(1, 200))]
        for _ in range(rnd.randrange(1, 6)):
            t = list(base)
            for _ in range(rnd.randrange(3)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows), rnd.choice([" ", "\n", " \t"]).join(t)))
    rows += [(900, None), (901, ""), (902, " \x0b\x0c"), (None, "one two three four five"), (None, None), rows[3], rows[3],
             (903, "a b c"), (904, "A  b\nc"), (905, "x\x1cy z\x85q"), (906, "again " * 70_000)]
    return rows


@pytest.mark.parametrize("bucket,chunk", [(512, 4096), (1, 4096), (0.0001, 4), (512, 3)])
def test_equals_brute_force(spark, docs_of, bucket, chunk):
    rows = corpus()
    docs = docs_of(rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id")
    got = sorted((tuple(r) for r in S.link_fingerprints(docs, bucket=bucket, chunk=chunk).collect()), key=str)
    assert got == brute(rows)


def test_chains_of_links_are_followed(spark):
    # neighbours differ in 4 bits, the ends in 48
    value, chain = 0, [0]
    for k in range(12):
        value |= 0xF << 4 * k
        chain.append(value)
    rnd = random.Random(1)
    chain += [rnd.getrandbits(63) for _ in range(500)]
    fps = spark.createDataFrame([(x,) for x in sorted(set(chain))], "fp long")
    ties = S.near_links(fps, chunk=5).collect()
    up = {x: x for x in chain}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in ties:
        assert a == b or root(a) == root(b) or up.update({max(root(a), root(b)): min(root(a), root(b))}) is None
    assert {root(x) for x in chain[:13]} == {0}


def test_every_near_pair_meets_in_a_bucket_and_survives_the_pivots():
    rnd = random.Random(2)
    for k in (5, 6, 8):
        masks = S.keys_of(k, 4)
        for _ in range(200):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), 4):
                b ^= 1 << bit
            assert ((np.uint64(a) & masks) == (np.uint64(b) & masks)).any()
            d = S.pivot_distances(np.array([a, b], dtype=np.uint64)).astype(int)
            assert abs(d[0] - d[1]).max() <= 4
    assert S.segment_count(1000) == 5 and S.segment_count(10 ** 8) > 5


def test_close_pairs_equal_all_pairs():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rnd.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)]))
    table = S.pivot_distances(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    got = {(int(a), int(b)) for i, j in S.close_pairs(fps, table, 4) for a, b in zip(i, j)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j}


def test_long_text_in_bounded_memory():
    text = b"some words that go on " * 200_000
    tracemalloc.start()
    S.fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(text)


def test_empty_table(docs_of):
    assert S.link_fingerprints(docs_of([])).collect() == []


def test_documents(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert sorted((tuple(r) for r in S.link_fingerprints(sf_docs).collect()), key=str) == brute(rows)
