"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` keeps how many documents hold each line as runs of ``(key, n_docs)`` in
levels.  A run is a table cut into ``buckets`` files by key, each sorted by key; a
manifest beside the runs lists them, so a later job, in another session, opens the
folder again and adds its batch.  Adding a batch of documents counts its line keys,
merge-anti-joins the *settled* runs (keys that have reached the threshold already,
which need no more counting) and writes the rest as a new run of level 0.  When a
level has ``fanout`` runs they are merged into one run of the next level; keys that
reach the threshold on a merge move to a settled run, so the runs above never carry
them again.  Settled runs are merged in the same way, so there are fewer than
``fanout`` of them.  All runs are cut alike: joins and merges read a bucket of each run
and move no row between tasks, and the sorted files need no sort.  ``frequent()`` merges what
is left and returns every key found in at least ``min_docs`` documents.

``cut_lines(docs, frequent)`` removes all lines with such a key from every
document.  ``dedup_lines(docs)`` does both over one table, in batches.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and
A-Z lower-cased; it is carried as its 128-bit MD5.  Lines with an empty key are
never counted nor dropped.  A document is a row: a key counts once per row,
however often it is repeated inside, and repeated rows count as documents.

Nulls: a null or empty text is one empty line (kept, ``n_lines`` 1,
``n_dropped`` 0, kept text empty); a null ``doc_id`` is passed through.  Ties do
not arise (a key is dropped everywhere or nowhere).  An empty table gives no
rows.  Other columns may have any name: a row is carried as one struct.

Scale: the runs hold 24 bytes a distinct key and are counted with partial
aggregation, so a line that a third of all documents share is one row per map
task.  What each text loses is found by joining its line hashes to the
frequent keys and stored (it is a plain scan on both sides of the joins, so
adaptive execution can split a hot line or a hot text); the texts themselves
move once, in the join that cuts the lines out, in time linear in their lines.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from progcorpus.llm.common import scratch, store

# fixed values
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_DOCS = 10       # a key in so many documents loses its lines
FANOUT = 4          # runs of a level that are merged into the next
BATCHES = 8         # batches that one table is fed in
BUCKETS = 8         # files of a run, cut by key
BUCKET_KEYS = 4 << 20       # keys of a bucket, where a table is fed in as a whole
LEAST_KEYS = 1 << 16        # keys that are worth a bucket


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """While open, a bucket read from a single sorted file counts as sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class LineRuns:
    """Levelled sorted runs of ``key binary, n_docs long`` in a shared folder.

    ``LineRuns(spark, folder)`` opens the runs that the folder's manifest lists, with
    the settings they were made with; a folder without one is new."""

    def __init__(self, spark: SparkSession, folder: str | None = None, min_docs: int = MIN_DOCS, fanout: int = FANOUT,
                 buckets: int = BUCKETS):
        self.spark, self.folder = spark, (folder or scratch(spark, "line-runs")).rstrip("/")
        self.min_docs, self.fanout, self.buckets = min_docs, fanout, buckets
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self._tables: dict[str, str] = {}
        said = self._read_manifest()
        if said:
            self.min_docs, self.fanout, self.buckets = said["min_docs"], said["fanout"], said["buckets"]
            self.levels, self.settled = said["levels"], said["settled"]

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read_manifest(self) -> dict | None:
        fs, path = self._path("manifest.json")
        if not fs.exists(path):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(path.toString(), wholetext=True).collect()))

    def _write_manifest(self) -> None:
        """A new manifest beside the old one, then put in its place."""
        said = {"min_docs": self.min_docs, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels,
                "settled": self.settled}
        fs, new = self._path(f"manifest-{uuid.uuid4().hex}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        _, path = self._path("manifest.json")
        if fs.exists(path):
            fs.delete(path, False)
        fs.rename(new, path)

    def run(self, name: str) -> DataFrame:
        """A run as a table that knows its buckets and their order."""
        if name not in self._tables:
            table = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} (key BINARY, n_docs BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
            self._tables[name] = table
        return self.spark.table(self._tables[name])

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys of a batch that are in no settled run, in the runs' buckets."""
        keys = keys.select("key", "n_docs").repartition(self.buckets, "key")
        for run in self.settled:
            keys = keys.join(self.run(run).hint("merge"), "key", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add a batch: ``key, n_docs`` with a row per key and its documents
        in the batch."""
        with _sorted_buckets(self.spark):
            self.levels[0].append(self._write(self.fresh(keys)))
            level = 0
            while len(self.levels[level]) >= self.fanout:
                self.compact(level)
                level += 1
        self._write_manifest()

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one run of the next; keys that have
        reached the threshold become a settled run."""
        merged = self.run(self._write(self._merge(self.levels[level])))
        self.levels[level] = []
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._write(merged.where(F.col("n_docs") < self.min_docs)))
        self.settled.append(self._write(merged.where(F.col("n_docs") >= self.min_docs)))
        if len(self.settled) >= self.fanout:
            self.settled = [self._write(self._merge(self.settled))]

    def frequent(self) -> DataFrame:
        """``key``: every key in at least ``min_docs`` documents, sorted.  A
        settled key that met the threshold again from runs written before it
        was settled is listed once."""
        with _sorted_buckets(self.spark):
            rest = self._merge([r for runs in self.levels for r in runs]).where(F.col("n_docs") >= self.min_docs)
            keys = rest.select("key")
            for run in self.settled:
                keys = keys.union(self.run(run).where(F.col("key").isNotNull()).select("key"))
            return store(keys.distinct().sortWithinPartitions("key"), "line-frequent")

    def _merge(self, runs: list[str]) -> DataFrame:
        """The runs' counts added up, bucket by bucket."""
        if not runs:
            return self.spark.createDataFrame([], "key binary, n_docs long")
        # the filter makes Spark unite rows, bucket with bucket; a union of columnar scans
        # (Spark 4.1.2) claims the same layout but lists their buckets one after another
        parts = [self.run(r).where(F.col("key").isNotNull()) for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.groupBy("key").agg(F.sum("n_docs").alias("n_docs"))

    def _write(self, rows: DataFrame) -> str:
        """A new run of the folder; ``rows`` lie in the runs' buckets already."""
        name = f"run-{uuid.uuid4().hex}"
        table = f"line_run_{uuid.uuid4().hex}"
        (rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").format("parquet")
         .saveAsTable(table))
        self._tables[name] = table
        return name


def batch_counts(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``batch, key, n_docs``: the documents of each batch that hold each key.
    A row's batch is drawn from the hash of its id and text."""
    t = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch"),
                    F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), line_key),
                                              lambda k: k != "")).alias("_keys"))
    keys = t.select("batch", F.explode("_keys").alias("_key")).select("batch", _hash(F.col("_key")).alias("key"))
    return keys.groupBy("batch", "key").agg(F.count("*").alias("n_docs"))


def _text_id(text: Column) -> Column:
    return _hash(F.coalesce(text, F.lit("")))


def losses(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``text_id, dropped array<int>``: the places (from 0) of the lines that
    each text loses; texts that lose nothing have no row."""
    # the hash before the explode: else it is computed again for every line
    lines = (docs.select(_text_id(F.col("text")).alias("text_id"), "text")
             .select("text_id", F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("place", "_key"))
             .where(F.col("_key") != "").select("text_id", "place", _hash(F.col("_key")).alias("key")))
    hit = lines.join(frequent, "key", "left_semi")
    return store(hit.groupBy("text_id").agg(F.collect_set("place").alias("dropped")), "line-losses")


def cut_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``row, n_lines, n_dropped, kept``: each row of ``docs`` (as a struct) with
    the number of its lines, of those that go, and the kept ones joined by newlines."""
    lost = losses(docs, frequent).toDF("_text", "lost")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _text_id(F.col("text")).alias("text_id"))
    cut = whole.join(lost, F.col("text_id") == F.col("_text"), "left").select("row", "lost")

    # the lines as a lambda's variable: they are split once, whatever refers to them
    def cut_one(lines):
        n = F.size(lines)
        places = F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost"))     # one pass over a set
        kept = F.when(F.col("lost").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(
            F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
        return F.struct(n.cast("long").alias("n_lines"), kept.alias("kept"))

    found = F.get(F.transform(F.array(lines_of(F.col("row.text"))), cut_one), F.lit(0))
    return cut.select("row", found.alias("found"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped")).select(
        "row", "found.n_lines", "n_dropped", "found.kept")


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                   fanout: int = FANOUT) -> DataFrame:
    """``key`` of every line found in at least ``min_docs`` rows of ``docs``,
    fed to the runs batch by batch."""
    spark = docs.sparkSession
    counts = store(batch_counts(docs, batches), "line-counts")
    n = counts.count()
    runs = LineRuns(spark, None, min_docs, fanout, max(1, min(100_000, max(
        -(-n // BUCKET_KEYS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_KEYS))))))
    for b in range(batches):
        runs.add(counts.where(F.col("batch") == b))
    return runs.frequent()


def rewrite(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` (all columns) with the kept lines as their ``text``, and
    ``n_chars``, where there is one, counted anew."""
    out = cut_lines(docs, frequent_lines(docs, min_docs))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256``: one row per document."""
    docs = docs.select("doc_id", "text")
    return cut_lines(docs, frequent_lines(docs, min_docs)).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce("text", '') AS t FROM documents
), line AS (
  SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line,
         unnest(range(len(string_split(t, chr(10))))) AS place FROM doc
), keyed AS (
  SELECT rid, doc_id, place, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), often AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE o.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o USING (k) GROUP BY rid
"""
