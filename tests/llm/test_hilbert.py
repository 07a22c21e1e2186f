import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from progcorpus.llm import common
from progcorpus.llm import hilbert as H


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (3, 5), (4, 2)])
def test_curve_visits_neighbours(n, bits):
    """Every cell once, and each step of the curve moves by one in one dimension."""
    cells = np.array(list(itertools.product(range(1 << bits), repeat=n))).T
    at = H.hilbert_index(cells, bits)
    assert sorted(at) == list(range(1 << (n * bits)))
    walk = cells[:, np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def brute(rows, shards, bits=H.BITS):
    """Rows ``(doc_id, text, lang, source)`` in curve order with shard and slot."""
    raw = [(t or "").encode() for _, t, *_ in rows]
    code = lambda s: -1 if s is None else int.from_bytes(s.encode()[:7].ljust(7, b"\0"), "big")
    dims = [[code(r[2]) for r in rows], [code(r[3]) for r in rows], [len(x) + 16 for x in raw]]
    axes = []
    for values in dims:
        ranked = sorted(values)
        first = {v: i for i, v in reversed(list(enumerate(ranked)))}
        level = {v: (i << bits) // len(values) for v, i in first.items()}
        dense = {lv: k for k, lv in enumerate(sorted(set(level.values())))}
        axes.append([dense[level[v]] for v in values])
    place = H.hilbert_index(np.array(axes), bits)
    key = lambda i: (place[i], zlib.crc32(raw[i]), len(raw[i]), rows[i][0] is not None, rows[i][0] or 0)
    order = sorted(range(len(rows)), key=key)
    out, n = [], len(rows)
    for rank, i in enumerate(order):
        s = rank * shards // n
        out.append((rows[i][0], len(raw[i]) + 16, zlib.crc32(raw[i]), "rows", s, rank - -(-s * n // shards), None))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows],
                                 "doc_id long, text string, lang string, source string, shard int, _size int")


def test_equals_brute_force(spark):
    rows = [(i * 7 % 101, "é" * (i % 13) + "x" * (i * i % 50), "abc"[i % 3] * 2, f"src{i % 11}") for i in range(90)]
    rows += [(500, None, None, "s"), (None, "", "aa", None), (501, "t" * 40_000, "aa", "s\0ö"), rows[3]]
    docs = table(spark, rows).drop("_size")
    got = [tuple(r) for r in H.assign(docs, 7).collect()]
    assert H.assign(docs, 7).columns == list(H.RESULT)
    assert sorted(got, key=str) == brute(rows, 7)
    sizes = Counter(r[4] for r in got).values()
    assert max(sizes) - min(sizes) <= 1


def test_values_with_a_common_beginning_and_fractions(spark):
    """Levels follow whole values: longer names and fractions in the same order give the same shards."""
    rows = [(i * 7 % 331, "x" * (i * i % 50), "abc"[i % 3], f"s{i * 5 % 37:02}") for i in range(300)] + [(900, "t", "a", None)]
    want = brute(rows, 7)
    long = [(d, t, v, s and "common_crawl_" + s) for d, t, v, s in rows]
    assert sorted(map(tuple, H.assign(table(spark, long).drop("_size"), 7).collect()), key=str) == want
    frac = spark.createDataFrame([(d, t, v, s and int(s[1:]) / 100) for d, t, v, s in rows],
                                 "doc_id long, text string, lang string, weight double")
    assert sorted(map(tuple, H.assign(frac, 7, dims=("lang", "weight", "size")).collect()), key=str) == want


def test_few_rows_and_empty_table(spark):
    rows = [(1, "a", "x", "y"), (2, "a", "x", "y")]
    assert sorted(map(tuple, H.assign(table(spark, rows), 40).collect())) == brute(rows, 40)
    assert H.assign(table(spark, rows).limit(0)).collect() == []


def test_documents(sf_docs):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in sf_docs.collect()]
    assert sorted(map(tuple, H.assign(sf_docs).collect()), key=str) == brute(rows, H.SHARDS)


def test_written_shards_prune_in_every_dimension(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.hash("id") % 500 + 500).cast("int")).alias("text"),
        F.concat(F.lit("l"), (F.hash("id", F.lit(1)) % 16 + 16).cast("string")).alias("lang"),
        F.concat(F.lit("s"), (F.hash("id", F.lit(2)) % 50 + 50).cast("string")).alias("source"))
    folder = common.scratch(spark, "t")
    H.write_shards(docs, folder, 64)
    back = spark.read.parquet(folder)
    assert back.count() == 4000
    m = H.manifest(back)
    for spec, test in (({"lang": ("l16", "l16")}, F.col("lang") == "l16"), ({"source": ("s60", "s62")}, F.col("source").between("s60", "s62")),
                       ({"size": (700, 720)}, F.col("_bytes").between(700, 720))):
        touched = H.prune(m, **spec)
        assert back.where(test & ~F.col("_shard").isin(touched)).count() == 0
        assert len(touched) < 40


def test_names_with_a_common_beginning_prune(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.hash("id") % 500 + 500).cast("int")).alias("text"), F.lit("l").alias("lang"),
        F.concat(F.lit("common_crawl_"), (F.hash("id", F.lit(2)) % 20 + 2020).cast("string")).alias("source"))
    folder = common.scratch(spark, "t")
    H.write_shards(docs, folder, 64)
    back = spark.read.parquet(folder)
    touched = H.prune(H.manifest(back), source=("common_crawl_2023", "common_crawl_2023"))
    assert back.where((F.col("source") == "common_crawl_2023") & ~F.col("_shard").isin(touched)).count() == 0
    assert 0 < len(touched) < 32


def test_clashing_names(spark):
    names = ["_size", "_crc", "_place", "_shard", "_slot", "_bytes", "__shard", "_part", "_row", "_c0", "size"]
    rows = [(i, f"text {i}" * (i % 7), "en" if i % 3 else "de", f"s{i % 5}", *[f"v{i}"] * len(names)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    plain = docs.select("doc_id", "text", "lang", "source")
    assert sorted(map(tuple, H.assign(docs, 8).collect())) == sorted(map(tuple, H.assign(plain, 8).collect()))
    folder = common.scratch(spark, "hilbert-test")
    H.write_shards(docs, folder, 8)
    back = spark.read.parquet(folder)
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(rows)
    m = H.manifest(back)
    assert sum(r.rows for r in m.collect()) == 200
    touched = H.prune(m, source=("s1", "s1"))
    assert back.where((F.col("source") == "s1") & ~F.col("___shard").isin(touched)).count() == 0
