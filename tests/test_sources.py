"""Sources and sinks: JSON layouts, text sink modes, the manifest writer,
column application with a pandas UDF."""

import json
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from progcorpus.operators import columns, export
from progcorpus.sources import fixtures as fx
from progcorpus.sources import json_io, sinks

SF = "/root/testdata/sf0.001"


def test_json_records_and_column_layout(spark):
    d = tempfile.mkdtemp(prefix="pc-json-")
    with open(os.path.join(d, "records.json"), "w") as fp:
        json.dump([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], fp, indent=3)
    with open(os.path.join(d, "columns.json"), "w") as fp:
        json.dump({"a": [1, 2, 3], "b": ["x", "y", "z"]}, fp)
    recs = json_io.scan_json(spark, os.path.join(d, "records.json"), multi_line=True)
    cols = json_io.scan_json(spark, os.path.join(d, "columns.json"), multi_line=True, layout="columns")
    assert sorted(tuple(r) for r in recs.select("a", "b").collect()) == [(1, "x"), (2, "y")]
    assert sorted(tuple(r) for r in cols.select("a", "b").collect()) == [(1, "x"), (2, "y"), (3, "z")]


def test_sink_text_clear_modes(spark):
    d = tempfile.mkdtemp(prefix="pc-text-") + "/out"
    df = spark.createDataFrame([("q1", "hello"), ("q2", None)], "q string, t string")
    sinks.sink_text(df, d, "t", clear=True, partition_by=["q"])
    assert [r.value for r in spark.read.text(d).collect()] == ["hello"]      # null text: no file row
    sinks.sink_text(df, d, "t", clear=True, partition_by=["q"])              # replaced, not appended
    assert spark.read.text(d).count() == 1
    with pytest.raises(AnalysisException):
        sinks.sink_text(df, d, "t", clear=False)                              # mkdir(exist_ok=False)


def test_write_manifest_partitions_by_question(spark):
    d = tempfile.mkdtemp(prefix="pc-manifest-") + "/m"
    m = export.repair_manifest(fx.submissions(spark, SF))
    export.write_manifest(m, d)
    qs = sorted(p for p in os.listdir(d) if p.startswith("question_id="))
    assert len(qs) == 159
    back = spark.read.parquet(d)
    assert back.count() == m.count() == 2752      # FIXTURES.md §5, sf0.001


def test_apply_column_with_pandas_udf(spark):
    @F.pandas_udf("long")
    def n_words(s: pd.Series) -> pd.Series:
        return s.str.split().str.len()

    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "id int, text string")
    out = columns.apply_column(df, n_words, "text", "n")
    assert sorted(tuple(r) for r in out.select("id", "n").collect()) == [(1, 3), (2, 1)]
    same = columns.apply_column(df, lambda c: F.upper(c), ["text"])          # default name: first column
    assert sorted(r.text for r in same.collect()) == ["A B C", "D"]


def test_key_subset_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert columns.key_subset_columns(df, ["a", "c"]).columns == ["a", "c"]
    assert columns.key_subset_columns(df, ["a", "c"], reject=True).columns == ["b"]
