import os
import sys

import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import test_linededup  # noqa: E402
import test_ngramjoin  # noqa: E402
import test_phraseindex  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from progcorpus.llm import common, toxicity  # noqa: E402

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


def clean_lines(rows):
    key = lambda x: x.strip(test_linededup.TRIM).translate(test_linededup.LOW)
    seen = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    keep = lambda t: "\n".join(x for x in (t or "").split("\n") if not key(x) or seen[key(x)] < 10)
    return [(i, keep(t)) for i, t in rows]


def expected(docs, predicted, items):
    """Every stage by brute force, given the classifier's verdicts."""
    rows = [(i, t) for i, t in docs if not predicted[i]]
    out = [rows]
    rows = clean_lines(rows)
    out.append(rows)
    stay = {c for _, c, *_ in test_ngramjoin.brute(rows)}
    rows = list(dict.fromkeys(r for r in rows if r[0] in stay))
    out.append(rows)
    hit = {r[0] for r in test_phraseindex.brute(rows, items) if r[-1]}
    out.append([r for r in rows if r[0] not in hit])
    return out


def check(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    predicted = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels).collect()}
    want = expected([(r.doc_id, r.text) for r in docs.collect()], predicted, items)
    columns = docs.columns
    for (name, stage), rows in zip(P.STAGES[:4], want):
        docs = common.store(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        got = docs.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str), name
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in got)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: r for r in P.STAGES[4][1](spark, docs, sf_dir).collect()}
    assert len(tokens) == len(want[3]) and all(r.round_trip for r in tokens.values())
    for i, t in want[3]:
        assert tokens[i].ids == library.encode(t or "", add_special_tokens=False).ids
    return [len(x) for x in want]


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = check(spark, docs.withColumnRenamed("source", "id").withColumnRenamed("lang", "key"), SF)
    assert docs.count() > kept[0] and kept[1] > kept[2] > kept[3] > 50
    assert P.run(spark, SF).count() == kept[3]


def test_nulls_repeats_and_empty_table(spark, docs_of):
    base = "\n".join(f"some words of line {i} here" for i in range(9))
    rows = [(1, base), (2, base + " x"), (3, None), (4, ""), (5, base), (5, base), (6, "z " * 30_000)]
    check(spark, docs_of(rows), SF)
    empty = docs_of([])
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).collect() == []
