"""Incremental line profiles of arriving program files.

The reference has no stream processing.  The row-local column jobs of the
library (F1 line count, F2 generation-line stripping, F3 implementation
start) need no state, so they apply unchanged to a ``readStream`` of
submission files; the query's progress lives under the shared checkpoint
folder, so a restarted driver resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from progcorpus.functions.lines import implementation_start, line_count, strip_generation_lines
from progcorpus.session import checkpoint_dir


def line_profile(df: DataFrame, key: str = "sub_id", code_col: str = "func_code") -> DataFrame:
    """Stateless per-row profile: works on batch and streaming DataFrames."""
    return df.select(key, line_count(code_col).alias("n_lines"),
                     strip_generation_lines(code_col).alias("stripped"),
                     implementation_start(code_col).alias("impl_start"))


def start_line_profiles(spark: SparkSession, source_dir: str, schema: StructType | str, sink_dir: str,
                        name: str = "line_profiles", key: str = "sub_id", code_col: str = "func_code",
                        max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Profile every Parquet file arriving in ``source_dir`` into ``sink_dir``
    (Parquet, append; exactly once through the checkpoint)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    return (line_profile(stream, key, code_col).writeStream.format("parquet")
            .option("path", sink_dir).option("checkpointLocation", ckpt).outputMode("append")
            .queryName(name).start())


__all__ = ["line_profile", "start_line_profiles"]
