"""Session construction, the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library likes; a value that the submitter, the cluster or a live
# session has set already is left alone (see ``get_spark``).
_WANTED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # joins and windows keyed on (code_id, x) reuse the code_id partitioning
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def get_spark(cores: int | str | None = None, shuffle_partitions: int | None = None,
              app: str = "progcorpus", **settings: str) -> SparkSession:
    """The live session as it is, else a new one.

    A new session takes its master and all settings from the submitter; only
    where no master is given (a plain ``python`` process) it is ``local[*]``.
    ``cores`` and ``shuffle_partitions`` are for tests and benchmarks."""
    live = SparkSession.getActiveSession()
    if live is not None:
        return live
    from pyspark import SparkConf

    given = SparkConf()
    builder = SparkSession.builder.appName(app)
    if cores is not None or not given.contains("spark.master"):
        builder = builder.master(f"local[{cores or '*'}]")
    wanted = dict(_WANTED)
    if shuffle_partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (wanted | settings).items():
        if not given.contains(k):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder used to cut lineage.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that value is
    always used.  A scratch folder of this machine is made only where it is
    unset and all tasks run on this machine (a local master); on any other
    master a missing setting is an error, as executors would not see each
    other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="progcorpus-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def buckets_for(size_bytes: float, parallel: int, target_bytes: int = 128 << 20,
                least_bytes: int = 4 << 20) -> int:
    """Partitions for ``size_bytes`` of data: as many as keep each at
    ``target_bytes`` or less, however many that is; small data takes up to
    ``parallel`` partitions as long as each has ``least_bytes``."""
    return max(1, -(-int(size_bytes) // target_bytes), min(parallel, -(-int(size_bytes) // least_bytes)))


def buckets_of(table: DataFrame) -> int | None:
    """The bucket count of a table made by ``materialize``; None for other frames."""
    return getattr(table, "_buckets", None)


def splittable(facts: DataFrame) -> DataFrame:
    """Per-text facts stored without buckets, for a join with rows by text.  Both
    sides of that join are then plain shuffles, so adaptive execution splits the
    rows of a text that many of them hold (a bucketed side can't be split)."""
    return materialize(facts)


# tables made by ``materialize`` while a ``job_tables`` block is open
_OWNED: list[list[tuple[str, str]]] = []


def materialize(df: DataFrame, key: str | None = None, num_buckets: int | None = None) -> DataFrame:
    """Compute ``df`` once and cut its lineage, in the shared checkpoint folder
    (survives executor loss; the plan downstream starts from a scan).

    With ``key`` the result is written as a Parquet table bucketed by
    ``key``: later windows, aggregations and joins keyed by ``key`` (or by
    ``key`` plus more columns) reuse that layout without another shuffle.  The
    bucket count is ``num_buckets`` (``buckets_of`` a table it is joined with),
    else ``spark.sql.shuffle.partitions``.  A plain ``checkpoint()`` is used
    otherwise (it does not keep partitioning).
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if key is None:
        return df.checkpoint(eager=True)
    n = num_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"progcorpus_{uuid.uuid4().hex}"
    path = f"{folder.rstrip('/')}/tables/{name}"
    (df.write.bucketBy(n, key).format("parquet").mode("overwrite")
     .option("path", path).saveAsTable(name))
    if _OWNED:
        _OWNED[-1].append((name, path))
    out = spark.table(name)
    out._buckets = n
    return out


@contextmanager
def job_tables(spark: SparkSession):
    """Owns the tables that ``materialize`` makes inside the block: at its end
    they are dropped from the catalog and their folders deleted, so results must
    have been written before."""
    _OWNED.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name, path in _OWNED.pop():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
