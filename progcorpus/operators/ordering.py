"""Row numbering inside groups without putting a group into one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of ``g`` to
one task; with one hot group holding a third of the corpus that task is the
job.  Here rows are range-partitioned on ``(g, o)`` instead, so a hot group is
spread over many partitions.  Each partition is sorted locally, rows get a
local index, and a small table of per-(partition, group) counts gives each
partition's offset inside its group.

The tagged rows are checkpointed to the shared checkpoint folder, so the
partition ids seen by the count branch and the row branch are the same data,
also after an executor is lost.  The order must be total (end it with a
unique column).  ``group_running_sum`` adds up a column in the same way, and
``group_median`` selects by rank from such sums.  The number of partitions
follows from the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from progcorpus.session import checkpoint_dir


TASK_ROWS = 4 << 20         # rows of a range partition
LEAST_ROWS = 1 << 14        # rows that are worth a partition


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    """As many range partitions as the rows need; small tables take as many as the
    session's parallelism as long as each has ``LEAST_ROWS``."""
    if num_partitions:
        return num_partitions
    rows = df.count()
    parallel = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return max(1, -(-rows // TASK_ROWS), min(parallel, -(-rows // LEAST_ROWS)))


def _ranged(df: DataFrame, sort_cols: list[Column], n: int) -> DataFrame:
    """``df`` range-partitioned and sorted, with its partition and place in it (``_pid``,
    ``_local``), materialised once: branches that read it would each partition on
    their own sample and disagree."""
    checkpoint_dir(df.sparkSession)
    return (df.repartitionByRange(n, *sort_cols)
            .sortWithinPartitions(*sort_cols)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_local", F.monotonically_increasing_id()
                        - F.shiftleft(F.spark_partition_id().cast("long"), 33))
            .checkpoint(eager=True))


def group_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                     name: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its ``keys`` group
    under ``order`` (Column expressions with asc/desc)."""
    keys = list(keys)
    n = _partitions(df, num_partitions)
    sort_cols = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    tagged = _ranged(df, sort_cols, n)
    # one row per (partition, group): tiny compared with the data
    seg = tagged.groupBy("_pid", *keys).agg(F.min("_local").alias("_first"),
                                            F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) \
        if keys else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_offset", F.coalesce(F.sum("_cnt").over(before), F.lit(0))).drop("_cnt")
    # null-safe: a null group key is a group of its own
    seg = seg.select(*[F.col(c).alias(f"_s_{c}") for c in ["_pid"] + keys], "_first", "_offset")
    cond = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in ["_pid"] + keys]
    out = tagged.join(seg, on=cond, how="inner")
    return (out.withColumn(name, (F.col("_offset") + F.col("_local") - F.col("_first") + 1).cast("long"))
            .drop("_pid", "_local", "_first", "_offset", *[f"_s_{c}" for c in ["_pid"] + keys]))


def group_running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "running") -> DataFrame:
    """Add ``name`` = sum of ``value`` over the rows of the ``keys`` group up to this one in
    ``order`` (unique in its group); null keys drop out."""
    keys = list(keys)
    known = df.dropna(subset=keys)
    tagged = _ranged(known, [F.col(k).asc() for k in keys] + [F.col(order).asc()], _partitions(known, None))
    upto = Window.partitionBy("_pid", *keys).orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = tagged.groupBy("_pid", *keys).agg(F.sum(value).alias("_part")).withColumn(
        "_offset", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    return (tagged.withColumn("_upto", F.sum(value).over(upto)).join(seg, on=["_pid", *keys], how="inner")
            .withColumn(name, F.col("_offset") + F.col("_upto")).drop("_pid", "_local", "_upto", "_offset"))


def group_median(hist: DataFrame, keys: Sequence[str], value: str, count: str, name: str = "median") -> DataFrame:
    """``keys..., name``: the exact median of each group of a histogram (``value`` occurs
    ``count`` times, a row per value): the mean of the values at the two middle ranks.
    The values of a group are ranked over many tasks and none is gathered."""
    keys = list(keys)
    total = hist.groupBy(*keys).agg(F.sum(count).alias("_n"))
    ranked = group_running_sum(hist, keys, value, count, "_rank").join(total, on=keys, how="inner")
    at = lambda k: F.min(F.when(F.col("_rank") >= k, F.col(value)))
    return ranked.groupBy(*keys).agg(at(F.floor((F.col("_n") + 1) / 2)).alias("_a"), at(F.floor(F.col("_n") / 2) + 1).alias("_b")) \
        .select(*keys, ((F.col("_a") + F.col("_b")) / F.lit(2.0)).alias(name))
