import os

import pytest

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table (with all its columns) from ``(doc_id, text)`` pairs."""
    def make(pairs):
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs],
            "doc_id long, text string, lang string, source string, n_chars long")
    return make


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
