"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from progcorpus.llm import (bpe, hilbert, linededup, lmscore, multisethash, ngramjoin, phraseindex, prefixtrie, secrets,
                            simhash, spelling, toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op8_secret_scan(spark, sf_dir):
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


@_query
def op5_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encode_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op7_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


ORACLES["op7_line_dedup"] = linededup.ORACLE


@_query
def op1_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


ORACLES["op1_warc"] = warc.ORACLE


@_query
def op4_benchmark_decontamination(spark, sf_dir):
    return phraseindex.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op4_benchmark_decontamination"] = phraseindex.ORACLE


@_query
def op3_fingerprints(spark, sf_dir):
    return multisethash.edit_likeness(_table(spark, sf_dir, "documents"))


@_query
def op6_hilbert_shards(spark, sf_dir):
    return hilbert.assign(_table(spark, sf_dir, "documents"))


@_query
def op2_toxicity(spark, sf_dir):
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_lm_scoring(spark, sf_dir):
    return lmscore.score(_table(spark, sf_dir, "documents"))


@_query
def op10_ngram_jaccard_join(spark, sf_dir):
    return ngramjoin.link_classes(_table(spark, sf_dir, "documents"))


ORACLES["op6_hilbert_shards"] = hilbert.ORACLE


ORACLES["op10_ngram_jaccard_join"] = ngramjoin.ORACLE


@_query
def op13_simhash(spark, sf_dir):
    return simhash.link_fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op12_spelling_variants(spark, sf_dir):
    return spelling.group_variants(spelling.count_words(_table(spark, sf_dir, "documents"), slips=199))


@_query
def op11_conversation_trie(spark, sf_dir):
    return prefixtrie.conversation_trie(_table(spark, sf_dir, "conversations"), spliced=True)
