import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from progcorpus.llm import prefixtrie as P

COLUMNS = [c.split()[0] for c in P.NODES.split(", ")]


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, digest, (role, text)))
    convs = {c: [x[-1] for x in sorted(t)] for c, t in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def brute(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                children[tuple(seq[:d - 1])].add(tuple(seq[:d]))
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        n, below = members[node], children[node]
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + (len(n) - 1) * words
        ends = ",".join(str(c) for c in sorted(n) if len(convs[c]) == len(node))
        out.append((min(n), len(node), min(members[node[:-1]]) if node else None, len(n), len(below), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def corpus(n=300, seed=1):
    rnd = random.Random(seed)
    rows, lines = [], [("user", "hi there"), ("user", "hi"), ("assistant", "hello you  all"), ("user", ""), ("", "userhi"), ("us", "erhi")]
    for c in range(n):
        k = rnd.choice([0, 1, 2, 3, 5, 9])
        for t in range(k):
            role, text = rnd.choice(lines[:2 + t % 5])
            rows.append((c, t, role, text))
    return rows


def table(spark, rows):
    random.Random(2).shuffle(rows)
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, node string, n_convs long")


@pytest.mark.parametrize("block,partitions", [(1 << 18, None), (1 << 18, 7), (1, 3), (5, 2), (60, 4)])
def test_equals_brute_force(spark, monkeypatch, block, partitions):
    monkeypatch.setattr(P, "BLOCK", block)
    rows = corpus()
    rows += [(5000 + i, t, "user", "all the same words") for i in range(60) for t in range(6)]
    rows += [(20, None, None, None), (20, None, "user", None), (20, 1, "user", "tie a"), (20, 1, "user", "tie b"),
             (21, 3, "user", "x"), (21, 3, "user", "x"), (None, 0, "user", "no conversation"), (-7, 0, "user", "hi"),
             (9_000_000_000, 0, "user", "long " * 100_000)]
    rows += [(7777, t, "user", f"only here {t % 3}") for t in range(700)]
    rows += [(7778, t, "user", f"only here {t % 3}") for t in range(699)]
    turns = P.splice(P.turns_of(table(spark, rows)))
    assert got(P.trie(turns, partitions)) == brute(rebuilt(rows))


def test_without_splicing(spark):
    rows = corpus(80, 5)
    convs = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        convs[c].append((role, text))
    assert got(P.conversation_trie(table(spark, rows))) == brute(convs)


def test_turnless_conversations_only(spark):
    ids = [c for c in range(1000) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:5]
    rows = [(c, 0, "user", "a b") for c in ids]
    assert got(P.conversation_trie(table(spark, rows), True)) == brute(rebuilt(rows)) and len(brute(rebuilt(rows))) == 1


def test_empty_table(spark):
    assert got(P.conversation_trie(table(spark, []), True)) == []


def test_range_minimum_and_extents():
    rnd = np.random.default_rng(6)
    for n in (1, 2, 3, 17, 64, 100):
        v = rnd.integers(0, 5, n)
        t = P.RangeMinimum(v)
        for a in range(n):
            for d in range(6):
                r = a
                while r + 1 < n and v[r + 1] >= d:
                    r += 1
                left = a
                while left > 0 and v[left] >= d:
                    left -= 1
                one = np.array([a]), np.array([d])
                assert (t.right(*one)[0], t.left(*one)[0]) == (r, left)
            for b in range(a, n):
                assert t.least(np.array([a]), np.array([b]))[0] == v[a:b + 1].min()


def test_conversations(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert got(P.conversation_trie(df, True)) == brute(rebuilt(rows))
