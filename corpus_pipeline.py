"""A training corpus from the documents table, in five stages.

1. ``toxicity``: documents that the classifier rejects go;
2. ``line_dedup``: lines found in at least ten documents go from every document;
3. ``near_duplicates``: of documents linked by five-word shingles (similarity 0.8 or
   more), one stays;
4. ``decontamination``: documents with a window of a benchmark item go;
5. ``bpe``: the rest as token ids, with a check that they decode to the text.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; every result is written as Parquet in the session's shared folder and read
again.  All but the last return the columns of their input.  Nulls, repeated rows and
empty tables are treated as in the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from progcorpus.llm import bpe, linededup, ngramjoin, phraseindex, toxicity
from progcorpus.llm.common import drop, job_scratch, scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.rewrite(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.keep_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phraseindex.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicates_stage),
          ("decontamination", decontamination_stage), ("bpe", bpe_stage)]

ORACLE_SQL = None   # the classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py checks every stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  A stage's scratch goes when its result is
    written, and that result when the next one has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        with job_scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        if last:
            drop(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return docs
