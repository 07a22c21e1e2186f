import math
import pathlib
import re
import zlib

import numpy as np

from progcorpus.llm import common
from progcorpus.llm import toxicity as X

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

INSULTS = ["grumblor", "snarkfiend", "vexilcreep"]


def corpus(n=300):
    import random

    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        sents = [" ".join(f"word{rnd.randrange(300)}" for _ in range(rnd.randrange(3, 9))) for _ in range(rnd.randrange(2, 30))]
        toxic = i % 4 == 0
        if toxic:
            sents.insert(rnd.randrange(len(sents)), f"you are a {rnd.choice(INSULTS)}{rnd.choice('abcdef')} indeed")
        rows.append((i, ". ".join(sents) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


def test_fold_score_and_offending_sentence(spark, docs_of):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (1002, "?!"), (None, "fine words"), (1003, "calm. " * 20_000 + "you are a grumblora indeed"), rows[0]]
    table = docs_of(rows).withColumnRenamed("lang", "toxic").withColumnRenamed("source", "score")
    lab = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = X.classify(table, lab).collect()
    assert len(got) == len(rows)
    truth, by = dict(labels), {}
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(key.encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        by[r.doc_id] = r
    held = [(by[i].score, y) for i, y in labels if by[i].held_out]
    assert auc(held) > 0.98 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert by[1000].score == by[1001].score == by[1002].score == 0 and by[None].predicted == 0
    assert by[1003].predicted == 1 and by[1003].offending == f"{6 * 20_000}:{6 * 20_000 + len('you are a grumblora indeed')}"
    text = dict(rows)
    for i, y in labels:
        if y and by[i].predicted:
            assert any(any(w in text[i][a:b] for w in INSULTS) for a, b in (map(int, x.split(":")) for x in by[i].offending.split(",")))


def test_score_is_the_noisy_or_of_sentences(spark, docs_of):
    word = lambda w: X.sentences([w.encode()])[0][0][0]
    features = np.sort(np.array([word("bad"), word("worse")], dtype=np.uint64))
    weight = {"bad": 2.0, "worse": 5.0}
    w = np.array([weight["bad"] if f == word("bad") else weight["worse"] for f in features])
    text = "Bad bad day. Nothing here! worse, bad\nplain"
    got = X.score(docs_of([(1, text)]), X.Model(features, w, -3.0)).first()
    p = [1 / (1 + math.exp(-z)) for z in (-1.0, -3.0, 4.0, -3.0)]
    assert math.isclose(got.score, 1 - math.prod(1 - x for x in p), rel_tol=1e-12)
    assert got.offending == "27:37"


def test_labels_of_one_class_and_empty_tables(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, "c"), (3, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in X.classify(docs, none).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in X.classify(docs, ones).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}
    assert X.classify(docs.limit(0), ones).collect() == []


def test_held_out_accuracy_on_documents(spark):
    base = "/root/testdata/sf0.01"
    docs, lab = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in lab.collect()}
    held = [(r.score, truth[r.doc_id]) for r in X.classify(docs, lab).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and auc(held) > 0.95


def brute_features(text):
    """Per sentence, its features as strings: words, and their first 4, 5 and 6 bytes."""
    out = []
    for part in re.split("[.!?\n]", text):
        words = [w.translate(LOW).encode() for w in re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", part)]
        if words:
            out.append({("word", w) for w in words} | {(k, w[:k]) for w in words for k in X.PREFIXES})
    return out


def hashed(feature):
    kind, value = feature
    row = 0 if kind == "word" else 1 + X.PREFIXES.index(kind)
    return int(X.sentences([value])[0][row][0])


def test_fit_equals_brute_force(spark, docs_of):
    rows, labels = corpus(200)
    train = [(brute_features(t), y) for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5]
    model = X.fit(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), features=60)
    # the features that tell the classes apart best
    n_pos = sum(y for _, y in train)
    n_neg = len(train) - n_pos
    seen = {}
    for bag, y in train:
        for f in set().union(*bag):
            seen.setdefault(f, [0, 0])[1 - y] += 1
    z = {}
    for f, (pos, neg) in seen.items():
        rate = (pos + neg) / (n_pos + n_neg)
        if pos >= X.MIN_DOCS:
            z[hashed(f)] = (pos / n_pos - neg / n_neg) / math.sqrt(rate * (1.0001 - rate) * (1 / n_pos + 1 / n_neg))
    best = sorted((h for h in z if z[h] > 1), key=lambda h: (-round(z[h], 9), np.uint64(h).view(np.int64)))[:60]
    assert sorted(best) == model.features.tolist()
    # the weights are where the likelihood is flat
    weight = dict(zip(model.features.tolist(), model.weights))
    bags = [([[h for h in map(hashed, s) if h in weight] for s in bag], y) for bag, y in train]

    def value(weight, bias):
        total = -X.DECAY / 2 * sum(w * w for w in weight.values())
        for bag, y in bags:
            clean = math.prod(1 / (1 + math.exp(bias + sum(weight[h] for h in s))) for s in bag)
            n = n_pos + n_neg
            total += math.sqrt(n / 2 / (n_pos if y else n_neg)) * math.log(1 - clean if y else clean) / n
        return total

    top = value(weight, model.bias)
    assert top > value(dict.fromkeys(weight, 0.0), -6.0) + 0.1
    for h in list(weight)[::6]:
        up, down = ({**weight, h: weight[h] + e} for e in (1e-4, -1e-4))
        assert abs(value(up, model.bias) - value(down, model.bias)) / 2e-4 < 1e-4
    assert abs(value(weight, model.bias + 1e-4) - value(weight, model.bias - 1e-4)) / 2e-4 < 1e-4


def test_one_id_that_many_rows_share_is_one_document_of_the_sample(spark, docs_of):
    rows, labels = corpus(120)
    hot = next(i for i, _ in labels if zlib.crc32(str(i).encode()) % 5)
    many = docs_of(rows + [(hot, f"zzz other text {j}") for j in range(400)] + [(hot, None)])
    X.fit(many, spark.createDataFrame(labels, "doc_id long, toxic int"))
    written = max((p for p in pathlib.Path(common.scratch(spark, "x").removeprefix("file:")).parent.glob("toxicity-sample-*")),
                  key=lambda p: p.stat().st_mtime)
    ids = [r.doc_id for r in spark.read.parquet(str(written)).select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and hot in ids
