"""Helpers shared by the operators: scratch tables, shipping of task code, block iteration."""

from __future__ import annotations

import sys
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from progcorpus.session import checkpoint_dir, job_tables


# folders named by ``scratch`` while a ``job_scratch`` block is open
_OWNED: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def job_scratch(spark: SparkSession):
    """Owns the scratch folders made inside the block, and the tables of
    ``session.materialize``: at its end they are deleted, so results must have been
    written elsewhere before."""
    _OWNED.append([])
    try:
        with job_tables(spark):
            yield
    finally:
        for path in _OWNED.pop():
            drop(spark, path)


def store(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts the
    lineage; a lost executor costs no recomputation).  Empty tables work."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(*modules: str) -> None:
    """Send the task code of these modules by value: executors need not have
    this package on their path, only numpy and pyarrow."""
    for m in modules:
        cloudpickle.register_pickle_by_value(sys.modules[m])


class Shared:
    """A broadcast value whose class travels with it (a plain broadcast names the class, so
    executors would need this package on their path)."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self):
        import pickle

        if not hasattr(self, "_value"):
            self._value = pickle.loads(self.broadcast.value)
        return self._value

    def __getstate__(self):
        return {"broadcast": self.broadcast}


def share(spark: SparkSession, value) -> Shared:
    """Broadcast ``value``; modules of its classes must have been shipped."""
    return Shared(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


def local_path(uri: str):
    """``(filesystem, path)`` of a shared folder for use inside a task."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def text_blocks(batches, max_bytes: int = 4 << 20):
    """Split Arrow batches into slices whose ``text`` column holds at most
    ``max_bytes`` (one longer text is a slice of its own)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index("text"))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 (null: empty)."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
