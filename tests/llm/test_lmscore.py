import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from progcorpus.llm import lmscore as L

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, order=L.ORDER, mu=L.MU):
    tokens = [[*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    train = [t for t, h in zip(tokens, held) if not h]
    c = Counter(w for t in train for w in t)
    grams = Counter()
    for t in train:
        line = ["<s>", *t]
        grams.update(tuple(line[j - k + 1:j + 1]) for j in range(1, len(line)) for k in range(2, order + 1) if j - k + 1 >= 0)
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    d = (n1 + 1) / (n1 + 2 * n2 + 2)

    def p(h, w):
        if not h:
            return 1.0 if not n else (c[w] - d) / n if c[w] else d * v / n
        seen = len(train) if h == ("<s>",) else grams[h] if len(h) > 1 else c[h[0]]
        return (grams[(*h, w)] + mu * p(h[1:], w)) / (seen + mu)

    out = []
    for (i, _), t, h in zip(rows, tokens, held):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        line = ["<s>", *t]
        total = sum(math.log10(p(tuple(line[max(0, j - order + 1):j]), line[j])) for j in range(1, len(line)))
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, base, total))
    return sorted(out, key=str)


def check(got, want):
    got = sorted(map(tuple, got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("order,block,shard", [(3, None, None), (3, 700, 300), (1, 700, 3000), (2, 900, 300), (4, 2000, 500)])
def test_equals_brute_force(docs_of, monkeypatch, order, block, shard):
    monkeypatch.setattr(L, "STRETCH", 7 if block else L.STRETCH)
    rnd = random.Random(5)
    word = lambda: rnd.choice(["The", "the", "Öl", "a", "b.", f"r{rnd.randrange(300)}"])
    rows = [(i, rnd.choice([" ", "\n", "\t "]).join(word() for _ in range(rnd.randrange(40)))) for i in range(80)]
    rows += [(500, None), (501, ""), (None, "the null id"), (502, "the a " * 5000), rows[4], rows[4], (503, "x\x0b\x0cy\x1c z")]
    docs = docs_of(rows).withColumnRenamed("lang", "block").withColumnRenamed("source", "held")
    check(L.score(docs, order, block, shard).collect(), brute(rows, order))


def one_block(texts, order):
    import pyarrow as pa

    raw = b"".join(texts)
    block = L.Block([len(t) for t in texts], pa.compress(raw, "zstd", asbytes=True), len(raw), order)
    totals = block.counts([False] * len(texts))
    c = totals[0]
    return block, totals, [int(x) for x in (c.sum(), len(c), (c == 1).sum(), (c == 2).sum())]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_weights_of_every_state_sum_to_one(order):
    rnd = random.Random(order)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(30))).encode() for _ in range(12)]
    block, totals, stats = one_block(texts, order)
    model = L.BackoffAutomaton(block, totals, stats)
    at = {int(g): int(np.flatnonzero(block.number[0] == i)[0]) for i, g in enumerate(block.grams[0])}
    states = {0} | ({1} if order > 1 else set())
    for target, seen, k in zip(model.target, model.seen, range(1, order)):
        states |= set(target[seen].tolist())
    arcs = {}
    for k in range(1, order + 1):       # every arc: (state it leaves, word) -> weight
        for g in np.flatnonzero(model.seen[k - 1]):
            last = block.last[k - 1][g]
            context = block.number[k - 2][last - 1] if k > 1 else None
            state = 0 if k == 1 else 1 if context < 0 else 2 + sum(len(t) for t in totals[:k - 2]) + context
            arcs[int(state), int(block.number[0][last])] = 10 ** model.weight[k - 1][g]

    def weight(state, word):
        if (state, word) in arcs:
            return arcs[state, word]
        return 10 ** model.fail_weight[state] * weight(int(model.fail[state]), word)

    n, v, n1, n2 = stats
    unknown = (n1 + 1) / (n1 + 2 * n2 + 2) * v / n
    for state in states:
        fails, x = 1.0, state
        while x:
            fails, x = fails * 10 ** model.fail_weight[x], int(model.fail[x])
        assert math.isclose(sum(weight(state, w) for w in range(len(at))) + fails * unknown, 1, rel_tol=1e-9)


def test_sizes_grow_with_the_root_of_the_corpus():
    assert L.plan_sizes(10 ** 9) == (L.BLOCK_BYTES, L.SHARD_BYTES)
    for total in (10 ** 9, 10 ** 12, 10 ** 14):
        block, shard = L.plan_sizes(total)
        assert block * shard / (total * L.TOKEN_BYTES) >= L.ROW_KEYS * 0.99
    assert L.plan_sizes(10 ** 14)[0] < 1 << 29


def test_no_training_rows_and_empty_table(docs_of):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    check(L.score(docs_of([(held, "a b")])).collect(), brute([(held, "a b")]))
    assert L.score(docs_of([])).collect() == []


def test_documents(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    got = L.score(sf_docs).collect()
    check(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
