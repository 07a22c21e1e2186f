"""S1 ``scan_submissions``: columnar tables in, pruned and pushed down by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None,
                 where=None) -> DataFrame:
    """Load a Parquet dataset; a projection and a predicate given here reach
    the scan as ``ReadSchema`` / ``PushedFilters``."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    return df
