import hashlib
import time
from collections import Counter

import pytest

from progcorpus.llm import common
from progcorpus.llm import linededup as L

TRIM = "\x20\t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    key = lambda line: line.strip(TRIM).translate(LOW)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= least)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(docs_of):
    rows = [(i, f"Shared LINE\t\nown {i}\n\n  shared line\r\nÉcole {i % 2}") for i in range(12)]
    rows += [(100, None), (101, ""), (None, "shared line"), (102, "\n\n"), (103, " \x0b\n shared line"), (5, rows[5][1])]
    rows += [(200 + i, "nine\n" + "x" * 50_000) for i in range(9)]
    docs = docs_of(rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "dropped")
    assert result(L.dedup_lines(docs)) == brute(rows)
    cut = L.rewrite(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_clashing_names(spark):
    names = ["_kept", "_n_lines", "_n_dropped", "row", "lost", "kept", "text_id", "_text", "key", "n_docs", "batch"]
    rows = [(i, f"same\nown {i}", *[f"v{j}" for j in range(len(names))]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = L.rewrite(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted((r[0], r[1].split("\n")[1], *r[2:]) for r in rows)
    assert result(L.dedup_lines(docs)) == brute([r[:2] for r in rows])


def test_time_is_linear_in_a_texts_lines(docs_of):
    text = "\n".join(f"line {i}" for i in range(40_000))
    rows = [(i, text) for i in range(10)] + [(10, text + "\nlast")]
    docs = docs_of(rows)
    began = time.time()
    assert result(L.dedup_lines(docs)) == brute(rows)
    assert time.time() - began < 30


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (9, 3)])
def test_runs_at_any_batching(spark, docs_of, batches, fanout):
    rows = [(i, "\n".join(f"line {j}" for j in range(40) if (i * 7 + j) % (j + 2) == 0)) for i in range(60)]
    frequent = L.frequent_lines(docs_of(rows), 10, batches, fanout)
    seen = Counter(k for _, t in rows for k in set(t.split("\n")) if k)
    assert {bytes(r.key).hex() for r in frequent.collect()} == {
        hashlib.md5(k.encode()).hexdigest() for k, n in seen.items() if n >= 10}


def batch(spark, **counts):
    return spark.createDataFrame([(bytearray(k.encode()), n) for k, n in counts.items()], "key binary, n_docs long")


def held(runs, name):
    return {bytes(r.key).decode(): r.n_docs for r in runs.run(name).collect()}


def test_levels_are_compacted(spark):
    runs = L.LineRuns(spark, min_docs=3, fanout=2, buckets=2)
    for i in range(4):
        runs.add(batch(spark, a=1, b=1, **{f"own{i}": 1}))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert held(runs, runs.levels[2][0]) == {f"own{i}": 1 for i in range(4)}
    assert [held(runs, x) for x in runs.settled] == [{"a": 4, "b": 4}]        # settled runs were merged into one
    runs.add(batch(spark, a=5, c=3))
    assert [held(runs, x) for x in runs.levels[0]] == [{"c": 3}]              # settled keys are not counted again
    assert sorted(bytes(r.key) for r in runs.frequent().collect()) == [b"a", b"b", b"c"]


def test_runs_are_read_without_exchange_or_sort(spark):
    runs = L.LineRuns(spark, min_docs=2, fanout=2, buckets=3)
    for _ in range(3):
        runs.add(batch(spark, **{f"k{i}": 1 for i in range(50)}))
    runs.add(batch(spark, k1=1, z=1))
    with L._sorted_buckets(spark):
        plan = runs.fresh(batch(spark, k1=1, z=1))._jdf.queryExecution().executedPlan().toString()
        merged = runs._merge(runs.levels[1] + runs.settled)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == len(runs.settled) == 1
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1         # of the batch itself
    assert "Exchange" not in merged


def test_a_later_session_adds_its_batch(spark):
    folder = common.scratch(spark, "line-runs-test")
    runs = L.LineRuns(spark, folder, min_docs=3, fanout=2, buckets=2)
    for _ in range(3):
        runs.add(batch(spark, a=1, b=1))
    later = L.LineRuns(spark.newSession(), folder)
    assert (later.min_docs, later.fanout, later.buckets) == (3, 2, 2)
    later.add(batch(later.spark, b=1, c=3))
    again = L.LineRuns(spark.newSession(), folder, min_docs=99)
    assert sorted(bytes(r.key) for r in again.frequent().collect()) == [b"a", b"b", b"c"]


def test_documents_and_empty_table(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert result(L.dedup_lines(sf_docs)) == brute(rows)
    assert result(L.dedup_lines(sf_docs.limit(0))) == []
