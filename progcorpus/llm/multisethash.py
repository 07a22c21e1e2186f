"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (its lines, empty ones too).  Every
paragraph is hashed to a wide vector and a fingerprint is the sum of the
vectors, lane by lane:

* 32 identity lanes, 32 bits each, from SHAKE-128 of the paragraph, added modulo
  2**32: equal multisets have equal lanes, and different ones do not in
  practice;
* 128 likeness lanes, 32 bits each, added modulo 2**32 and read as signed numbers:
  each run of three words of the paragraph adds a hashed +1 or -1 to every lane.  A
  text has at most 2**30 runs (a word and its gap take two bytes of Spark's 2 GB), so
  no lane of a text wraps, however often a run is repeated.  The sum of squares of
  such a vector estimates the size of the multiset of runs and that of a
  difference the size of the symmetric difference, so
  ``1 - |a - b|^2 / (|a|^2 + |b|^2)`` is a likeness from 0 to 1.

Paragraph order does not matter, and paragraphs are inserted or deleted by adding
or subtracting their vectors (``insert``, ``delete``) without the rest of the text.

``fingerprints(docs)`` returns ``doc_id, fingerprint`` (lower-case hex of the
lanes).  ``edit_likeness(docs)`` compares every document with an edited copy (the
last quarter of its code points replaced by the first ones of the next document
by ``doc_id``, after the last the first) and with that next document:

``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``

The edited fingerprint is made incrementally: the paragraphs from the cut on are
deleted, the new ones inserted.

Nulls: a null text is an empty one (one empty paragraph); null ids sort first.
Rows of one id follow each other by text.  Repeated rows are rows of their own; a
single row is its own next one; an empty table gives no rows.  Other columns are
ignored.  Equal identity lanes have likeness 1; texts without words are alike only
if equal.

Scale: texts move once, into ranges of ``(id, beginning of the text)``, a partition each,
so an id that many rows share is cut apart too.  The ranges' bounds come from these
keys alone (one of at most 72 bytes per range is collected; there are at most
``RANGES``, which grow with the data), and the first row of the next range is
added to every range, so no row waits for another task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.llm.common import ship, text_blocks, utf8
from progcorpus.llm.textblocks import NONSPACE, chain, mix, words

IDENTITY, LIKENESS = 32, 128        # lanes
RUN = 3                             # words of a run
RANGE_BYTES = 16 << 20              # text of one range, at least
RANGES = 1 << 16                    # ranges, at most
BEGIN = 16                          # code points of a text that rows of one id are ranged by
STEP = 1 << 15                      # runs whose signs are expanded at a time

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _identity(texts: list[bytes]) -> np.ndarray:
    """The identity lanes of every text."""
    digests, first = [], []
    for t in texts:
        first.append(len(digests))
        digests += [hashlib.shake_128(p).digest(4 * IDENTITY) for p in t.split(b"\n")]
    lanes = np.frombuffer(b"".join(digests), dtype="<u4").reshape(-1, IDENTITY)
    return np.add.reduceat(lanes, first, axis=0, dtype=np.uint32) if texts else lanes


def _runs(texts: list[bytes]):
    """Hashes of the word runs inside paragraphs, and the text of each."""
    hashes, doc, starts, _ = words(texts, NONSPACE, lower=False)
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    paragraph = np.cumsum(buf == 10)[starts] + doc
    out, owner = [], []
    edge = np.flatnonzero(np.r_[True, paragraph[1:] != paragraph[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(hashes)))
    for n in range(1, RUN + 1):
        runs = chain(hashes, n)
        if n < RUN:                 # a paragraph of fewer words is one run
            at = edge[size == n]
        else:
            at = np.flatnonzero(paragraph[n - 1:] == paragraph[:len(runs)]) if len(runs) else edge[:0]
        out.append(mix(runs[at] + np.uint64(n)))
        owner.append(doc[at])
    return np.concatenate(out), np.concatenate(owner)


def _likeness(texts: list[bytes]) -> np.ndarray:
    """The likeness lanes of every text."""
    lanes = np.zeros((len(texts), LIKENESS), dtype=np.int64)
    runs, owner = _runs(texts)
    order = np.argsort(owner, kind="stable")
    runs, owner = runs[order], owner[order]
    for i in range(0, len(runs), STEP):
        h, o = runs[i:i + STEP], owner[i:i + STEP]
        bits = np.unpackbits(np.stack([h, mix(h ^ np.uint64(0xA5A5A5A5))], axis=1).view(np.uint8), axis=1)
        edge = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        ones = np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
        lanes[o[edge]] += 2 * ones - np.diff(np.append(edge, len(o)))[:, None]
    return lanes.astype(np.uint32)          # modulo 2**32


def vectors(texts: list[bytes]):
    """``(identity, likeness)`` lanes of every text."""
    return _identity(texts), _likeness(texts)


def to_hex(identity: np.ndarray, likeness: np.ndarray) -> str:
    return identity.astype("<u4").tobytes().hex() + likeness.astype("<u4").tobytes().hex()


def from_hex(fingerprint: str):
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[:4 * IDENTITY], "<u4"), np.frombuffer(raw[4 * IDENTITY:], "<u4")


def _shift(fingerprint: str, paragraphs: list[str], sign: int) -> str:
    identity, likeness = from_hex(fingerprint)
    for more_identity, more_likeness in zip(*vectors([p.encode() for p in paragraphs])):
        if sign > 0:
            identity, likeness = identity + more_identity, likeness + more_likeness
        else:
            identity, likeness = identity - more_identity, likeness - more_likeness
    return to_hex(identity, likeness)


def insert(fingerprint: str, paragraphs: list[str]) -> str:
    """The fingerprint with these paragraphs added."""
    return _shift(fingerprint, paragraphs, 1)


def delete(fingerprint: str, paragraphs: list[str]) -> str:
    """The fingerprint with these paragraphs taken out."""
    return _shift(fingerprint, paragraphs, -1)


def likeness(a, b) -> float:
    """Likeness of two fingerprints given as lanes."""
    if np.array_equal(a[0], b[0]):
        return 1.0
    x, y = (v[1].astype(np.int32).astype(np.float64) for v in (a, b))      # squares can pass 2**63
    d = x - y
    total = float(x @ x + y @ y)
    return max(0.0, 1.0 - float(d @ d) / total) if total else 0.0


def _fingerprint_batches(batches):
    import pyarrow as pa

    for part in text_blocks(batches, 1 << 20):
        got = zip(*vectors(utf8(part.column(1))))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([to_hex(*v) for v in got], pa.string())],
                                         names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text."""
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches,
                                                                        "doc_id long, fingerprint string")


def _pairs_of(texts: list[str], ahead: list[str]):
    """The result columns (after the id) of texts and the ones that follow them."""
    whole = vectors([t.encode() for t in texts])
    follow = vectors([t.encode() for t in ahead])
    old, new, sha = [], [], []
    for t, n in zip(texts, ahead):
        k = len(t) // 4
        keep = len(t) - k
        cut = t.rfind("\n", 0, keep) + 1
        old.append(t[cut:].encode())
        new.append((t[cut:keep] + n[:k]).encode())
        sha.append(hashlib.sha256((t[:keep] + n[:k]).encode()).hexdigest())
    old, new = vectors(old), vectors(new)
    edited = [w - o + n for w, o, n in zip(whole, old, new)]
    rows = []
    for i, t in enumerate(texts):
        a, e, f = ((v[0][i], v[1][i]) for v in (whole, edited, follow))
        rows.append((len(t), sha[i], to_hex(*a), to_hex(*e), likeness(a, e), likeness(a, f)))
    return rows


def _edit_batches(batches):
    """Rows ``doc_id, text, bucket, guard`` sorted so that the guard row, the
    first one of the next range, ends its bucket."""
    import pyarrow as pa

    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    held = None                         # the last row, whose next one has not come yet
    for part in text_blocks(batches, 1 << 20):
        ids, buckets, texts, ahead = [], [], [], []
        rows = zip(*(part.column(i).to_pylist() for i in range(4)))
        for doc_id, text, bucket, guard in rows:
            if held is not None:
                ids.append(held[0])
                texts.append(held[1])
                ahead.append(text or "")
            held = None if guard else (doc_id, text or "", bucket)
        if ids:
            cols = [ids, *zip(*_pairs_of(texts, ahead))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _keys(ids, begins):
    """``(id, beginning)`` as byte strings in the same order; null ids first."""
    # a null id shares its code with the least one: such rows only share a range
    return [(0 if i is None else int(i) + (1 << 63)).to_bytes(8, "big") + (b or "").encode() for i, b in zip(ids, begins)]


def _range_starts(docs: DataFrame, range_bytes: int) -> list[bytes]:
    """The first key of every range, in order (ranges are cut from the keys alone)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(RANGES, -(-total // range_bytes)))
    keys = docs.select("doc_id", F.substring("text", 1, BEGIN).alias("begin"))
    first = (keys.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("begin").asc_nulls_first())
             .groupBy(F.spark_partition_id().alias("p"))
             .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.coalesce("begin", F.lit("")).alias("begin")))
                  .alias("k")).select("k.doc_id", "k.begin").collect())
    return sorted(set(_keys([r.doc_id for r in first], [r.begin for r in first])))


def edit_likeness(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document (see the module docstring)."""
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    starts = _range_starts(docs, range_bytes)
    if not starts:
        return spark.createDataFrame([], SCHEMA)
    bounds = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("struct<bucket int, head boolean>")
    def range_of(ids, begins):
        from bisect import bisect_right

        import pandas as pd

        at = bounds.value
        keys = _keys(ids.tolist(), begins.tolist())
        bucket = [max(0, bisect_right(at, k) - 1) for k in keys]
        return pd.DataFrame({"bucket": np.array(bucket, np.int32), "head": [at[b] == k for b, k in zip(bucket, keys)]})

    # ids as strings: pandas would turn a column with nulls into floats
    placed = docs.withColumn("r", range_of(F.col("doc_id").cast("string"), F.substring("text", 1, BEGIN)))
    n = len(starts)
    heads = (placed.where("r.head").groupBy("r.bucket").agg(F.min(F.struct(
        F.col("doc_id").isNotNull().alias("known"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("t")))
    guards = heads.select(F.lit(None).cast("long").alias("doc_id"), F.col("t.text").alias("text"),
                          F.pmod(F.col("bucket") - 1, F.lit(n)).cast("int").alias("bucket"), F.lit(True).alias("guard"))
    rows = placed.select("doc_id", "text", F.col("r.bucket").alias("bucket"), F.lit(False).alias("guard")).union(guards)
    return (rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "guard", "doc_id", "text")
            .mapInArrow(_edit_batches, SCHEMA))
