"""Sharding along a Hilbert curve over several metadata columns.

Every column in ``DIMENSIONS`` is quantised to ``2**BITS`` levels of about equal
row counts (exact quantiles of its values), the levels of a row are the
coordinates of a cell, and the rows are sorted by the cell's place on the
Hilbert curve.  Neighbours on the curve are neighbours in every dimension, so
cutting the order into runs gives shards that cover small boxes: a filter on any
of the columns can skip most shards by their least and largest values.

``assign(docs, shards)`` cuts runs of equal row counts (the law ``rows``: at most
one row apart) and returns

``doc_id, size, text_crc32, law, shard, slot, grown_shard``

with ``size`` the UTF-8 bytes of the text plus 16, ``text_crc32`` the unsigned
CRC-32 of its UTF-8, ``slot`` the row's place in its shard without gaps and a null
``grown_shard`` (that belongs to the law ``key``).  Equal cells are ordered by
CRC, size and id, so copies of a text are neighbours.

``write_shards(docs, folder, shards)`` writes whole rows into
``_shard=<n>`` folders, sorted along the curve; ``manifest`` gives each shard's
row count and the least and largest value of each dimension, and ``prune`` the
shards that ranges of values can touch.

Nulls: a null text is empty for the sums (size 16, CRC 0); null values of a
dimension form its lowest level; null ids sort first.  Rows equal in every sort
column get their slots in any order.  Repeated rows are rows of their own;
with fewer rows than shards some shards stay empty; an empty table gives no
rows.  Dimensions are ordered by whole values, strings by their UTF-8 bytes and
numbers with their fractions (the SQL oracle reads seven bytes of a string, enough
for the given tables).  Columns other than id, text and the dimensions are
ignored (and kept by ``write_shards``).

Scale: texts are not moved for the assignment.  The sort is a range
partitioning on columns that end with the id, so equal cells spread over tasks;
ranks are row numbers inside the stored partitions plus the partitions' offsets
(one number per partition).  Quantile cuts (``2**BITS`` per dimension) are the
only values collected from the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from progcorpus.llm.common import ship, store

DIMENSIONS = ("lang", "source", "size")
BITS = 5
SHARDS = 40
HEADER_BYTES = 16       # counted for every row besides its text
RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of integer points (one row per dimension),
    by Skilling's transposition: undo excess turns from the high bit down, Gray
    encode, then interleave the bits."""
    x = [a.astype(np.int64).copy() for a in axes]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where(x[-1] & bit, turn ^ (bit - 1), turn)
        bit >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            out = out << 1 | (((a ^ turn) >> b) & 1)
    return out


def _value(column: str, kind: T.DataType) -> Column:
    """The values in the order of their levels; nulls sort first."""
    c = F.col(f"`{column}`")
    return F.encode(c, "UTF-8") if isinstance(kind, T.StringType) else c


def _quantile_cuts(values: DataFrame, bits: int) -> list:
    """The least value of every level but the lowest, of the one column: a value with
    ``b`` of ``n`` rows before it is of level ``floor(b * 2**bits / n)``."""
    counts = values.toDF("value").groupBy("value").count()
    parts = store(counts.repartitionByRange("value").sortWithinPartitions("value")
                  .select("value", "count", F.spark_partition_id().alias("part")), "hilbert-counts")
    before, total = [], 0
    for part, n in sorted(map(tuple, parts.groupBy("part").agg(F.sum("count")).collect())):
        before.append((part, total))
        total += n
    if not total:
        return []
    offsets = parts.sparkSession.createDataFrame(before, "part int, before long")
    inside = F.sum("count").over(Window.partitionBy("part").orderBy("value")) - F.col("count")
    level = F.floor((F.col("before") + F.col("inside")) * F.lit(1 << bits) / F.lit(total))
    cuts = (parts.withColumn("inside", inside).join(F.broadcast(offsets), "part")
            .groupBy(level.alias("level")).agg(F.min("value").alias("value")).collect())
    return [c.value for c in sorted(cuts, key=lambda c: c.level) if c.level]


def _level(value: Column, cuts: list, kind: T.DataType) -> Column:
    """The number of cuts up to the value; null lowest."""
    out = F
    for n, cut in reversed(list(enumerate(cuts, 1))):
        least = F.lit(bytes(cut)) if isinstance(kind, T.StringType) else F.lit(cut).cast(kind)
        out = out.when(value >= least, n)
    return out.otherwise(0) if cuts else F.lit(0)


def _ranked(docs: DataFrame, keep: list[str], dims, bits: int, shards: int) -> DataFrame:
    """``keep`` columns and ``_size, _crc, _shard, _slot``, stored in curve order."""
    ship(__name__)
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = docs.withColumns({"_size": F.octet_length(text).cast("long") + HEADER_BYTES, "_crc": F.crc32(text)})
    kinds = {f.name: f.dataType for f in base.schema.fields}
    names = ["_size" if d == "size" else d for d in dims]
    values = [_value(n, kinds[n]) for n in names]
    levels = [_level(v, _quantile_cuts(base.select(v), bits), kinds[n]) for v, n in zip(values, names)]
    base = base.select(*keep, "_size", "_crc", *(x.alias(f"_c{i}") for i, x in enumerate(levels)))

    @F.pandas_udf("long")
    def place(cells):
        import pandas as pd

        return pd.Series(hilbert_index(np.stack([cells.iloc[:, i].to_numpy() for i in range(cells.shape[1])]), bits))

    order = ["_place", "_crc", "_size", "doc_id"]
    if "doc_id" not in keep:
        raise ValueError("doc_id must be kept")
    row = F.monotonically_increasing_id()
    ordered = store(
        base.withColumn("_place", place(F.struct(*(f"_c{i}" for i in range(len(dims))))))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select(*keep, "_size", "_crc", "_place", F.shiftright(row, 33).cast("int").alias("_part"),
                row.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")), "hilbert-order")
    counts = sorted(map(tuple, ordered.groupBy("_part").count().collect()))
    total, offsets = 0, []
    for part, n in counts:
        offsets.append((part, total))
        total += n
    offsets = spark.createDataFrame(offsets, "_part int, _offset long")
    rank = F.col("_offset") + F.col("_row")
    shard = F.expr(f"(_rank * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(_shard * {total}L + {shards - 1}L) div {shards}L")
    return (ordered.join(F.broadcast(offsets), "_part").withColumn("_rank", rank).withColumn("_shard", shard)
            .withColumn("_slot", F.col("_rank") - first).select(*keep, "_size", "_crc", "_place", "_shard", "_slot"))


def assign(docs: DataFrame, shards: int = SHARDS, dims=DIMENSIONS, bits: int = BITS) -> DataFrame:
    """One row per document (see the module docstring)."""
    docs = docs.select("doc_id", "text", *(d for d in dims if d != "size"))
    out = _ranked(docs, ["doc_id"], dims, bits, shards)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                      F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
                      F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_columns(columns: list[str], own: bool = False) -> tuple[str, str, str]:
    """The names of a written table's bytes, shard and slot columns: ``_bytes``, ``_shard``
    and ``_slot``, with more underscores in front where the rows have such names
    themselves.  ``own``: ``columns`` are those of a written table."""
    def name(n):
        while n in columns:
            n = "_" + n
        return n[1:] if own else n

    return name("_bytes"), name("_shard"), name("_slot")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, dims=DIMENSIONS, bits: int = BITS) -> None:
    """Whole rows as Parquet, one folder per shard, in curve order inside."""
    size, shard, slot = shard_columns(docs.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_hs_row")
    keyed = docs.select(row, "doc_id", "text", *(F.col(f"`{d}`") for d in dims if d != "size"))
    out = _ranked(keyed, ["doc_id", "_hs_row"], dims, bits, shards)
    (out.select(*(F.col(f"_hs_row.`{c}`").alias(c) for c in docs.columns), F.col("_size").alias(size), F.col("_shard").alias(shard),
                F.col("_slot").alias(slot))
     .repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(folder))


def manifest(written: DataFrame, dims=DIMENSIONS) -> DataFrame:
    """``_shard, rows`` and ``min_<dim>, max_<dim>`` of a table read from ``write_shards``."""
    size, shard, _ = shard_columns(written.columns, own=True)
    names = {d: size if d == "size" else d for d in dims}
    return written.groupBy(F.col(shard).alias("_shard")).agg(
        F.count("*").alias("rows"),
        *(f(f"`{c}`").alias(f"{n}_{d}") for d, c in names.items() for f, n in ((F.min, "min"), (F.max, "max"))))


def prune(table: DataFrame, **ranges) -> list[int]:
    """The shards of a manifest that rows within ``dim=(low, high)`` can lie in."""
    hit = F.lit(True)
    for d, (low, high) in ranges.items():
        hit = hit & (F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high))
    return sorted(r._shard for r in table.where(hit).select("_shard").collect())


def _curve_sql(source: str) -> str:
    """SQL for the columns of ``source`` plus ``place``, from cells ``x0, x1, x2``."""
    q, n = source, len(DIMENSIONS)

    def step(query, new):
        keep = ", ".join(new.get(f"x{i}", f"x{i}") + f" AS x{i}" for i in range(n))
        return f"(SELECT * EXCLUDE ({', '.join(f'x{i}' for i in range(n))}), {keep} FROM {query})"

    for b in range(BITS - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(n):
            swap = f"CASE WHEN x{i} & {bit} <> 0 THEN 0 ELSE xor(x0, x{i}) & {low} END"
            turned = f"xor(x0, CASE WHEN x{i} & {bit} <> 0 THEN {low} ELSE xor(x0, x{i}) & {low} END)"
            q = step(q, {"x0": turned} | ({f"x{i}": f"xor(x{i}, {swap})"} if i else {}))
    for i in range(1, n):
        q = step(q, {f"x{i}": f"xor(x{i}, x{i - 1})"})
    turn = "0"
    for b in range(BITS - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN x{n - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    place = " + ".join(f"(((xor(x{i}, turn) >> {b}) & 1) << {b * n + n - 1 - i})" for b in range(BITS) for i in range(n))
    return f"(SELECT *, {place} AS place FROM (SELECT *, {turn} AS turn FROM {q}))"


_CELLS = ", ".join(f"""
l{i} AS (SELECT code, dense_rank() OVER (ORDER BY level) - 1 AS x{i} FROM (
  SELECT c{i} AS code, (sum(count(*)) OVER (ORDER BY c{i}) - count(*)) * {1 << BITS} // (SELECT count(*) FROM d) AS level
  FROM d GROUP BY c{i}))""" for i in range(len(DIMENSIONS)))

ORACLE = f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), d AS (
  SELECT doc_id, octet_length(encode(coalesce("text", ''))) + {HEADER_BYTES} AS size,
         xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(
               regexp_extract_all(hex(encode(coalesce("text", ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc,
         coalesce(rpad(hex(encode(lang)[1:7]), 14, '0'), '') AS c0,
         coalesce(rpad(hex(encode(source)[1:7]), 14, '0'), '') AS c1,
         octet_length(encode(coalesce("text", ''))) AS c2
  FROM documents, crc
), {_CELLS.strip()}, cells AS (
  SELECT doc_id, size, crc, x0, x1, x2 FROM d JOIN l0 ON c0 = l0.code JOIN l1 ON c1 = l1.code JOIN l2 ON c2 = l2.code
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY place, crc, size, doc_id NULLS FIRST) - 1 AS rank, count(*) OVER () AS n
  FROM {_curve_sql('cells')}
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(rank * {SHARDS} // n AS INTEGER) AS shard,
       CAST(rank - ((rank * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM ranked
"""
