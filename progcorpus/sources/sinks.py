"""S4 ``sink_table`` and S5 ``sink_text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_table(df: DataFrame, path: str, mode: str = "overwrite",
               partition_by: list[str] | None = None) -> None:
    """Persist a result as Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def sink_text(df: DataFrame, path: str, text_col: str, clear: bool = True,
              partition_by: list[str] | None = None) -> None:
    """Text files under ``path``.

    ``clear=True`` replaces the folder (it is cleared first);
    ``clear=False`` refuses to write into an existing one, as
    ``mkdir(exist_ok=False)`` does.  Null text writes nothing (D32).
    """
    cols = [F.col(text_col).alias("value")] + [F.col(c) for c in (partition_by or [])]
    out = df.where(F.col(text_col).isNotNull()).select(*cols)
    w = out.write.mode("overwrite" if clear else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


# a text record ends with this; a NUL inside a text is written as NUL SOH
_END = "\x00\x02\n"


def sink_texts(df: DataFrame, path: str, text_col: str, clear: bool = True,
               partition_by: list[str] | None = None) -> None:
    """S5 for texts of any content: many texts share a file, each ended by a mark that no
    text holds, so line breaks, empty texts and NULs come back as they were
    (``scan_texts``) and small texts make no small files."""
    text = F.replace(F.col(text_col), F.lit("\x00"), F.lit("\x00\x01"))
    cols = [text.alias("value")] + [F.col(c) for c in (partition_by or [])]
    w = df.where(F.col(text_col).isNotNull()).select(*cols).write.mode("overwrite" if clear else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.option("lineSep", _END).text(path)


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """The texts of ``sink_texts`` as ``value``, with the partition columns."""
    df = spark.read.option("lineSep", _END).text(path)
    return df.withColumn("value", F.replace("value", F.lit("\x00\x01"), F.lit("\x00")))
