"""SimHash near-duplicates by pivot distance tables.

A fingerprint has 64 bits: each is 1 if more than half of the text's shingle hashes
have it.  Two fingerprints are linked if they differ in at most ``RADIUS`` bits.
``link_fingerprints(docs)`` returns one row per document,

``doc_id, fingerprint, component_id``

``fingerprint`` as 16 lower-case hex digits, ``component_id`` the least ``doc_id``
of all documents whose fingerprints a chain of links connects.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a shingle is four words joined by
a space (all words of a shorter text), repeats included; its hash is XXH64 of the
UTF-8 bytes with seed 42.  A text without words has the fingerprint zero, which is
linked like any other.

1. Texts become fingerprints in one map step; all further work is on distinct ones.
2. A pivot table row is made per fingerprint: its Hamming distances to ``PIVOTS``
   fixed reference fingerprints, a byte each.  By the triangle inequality two
   fingerprints within the radius differ by at most the radius in *every* distance.
3. The 64 bits are cut into ``k > RADIUS`` segments.  Linked fingerprints agree in at
   least ``k - RADIUS`` of them, so they meet in a bucket for some choice of that many
   segments; ``k`` is the least for which a bucket is expected to hold no more than
   ``BUCKET`` fingerprints (``expected_bucket``).  Buckets over ``CHUNK`` are cut into
   chunks by hash, and every pair of chunks is a unit of its own.
4. In a unit the rows are sorted by the first distance, so a window holds all
   partners of a row; the other distances discard pairs by their maximum coordinate
   difference, and the survivors are verified on the bits.  A unit returns one row per
   fingerprint that was linked there: the least one it connects to.
5. Connected components of those rows give the classes.

Nulls: a null text is an empty one; null ids are ignored in the minima (a component of
null ids only has a null ``component_id``).  Repeated rows and equal texts share a
fingerprint and so a component.  An empty table gives no rows.  Other columns are ignored.

Scale: no text is shuffled.  Copies are aggregated before any shuffle of fingerprints;
a bucket row has 8 + ``PIVOTS`` bytes, and there are ``C(k, RADIUS)`` of them per distinct fingerprint.
A group of copies that a third of all documents belong to is one fingerprint; a
large group of near copies is cut into chunk pairs, whose survivors stay in the task.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.llm.common import ship, store, text_blocks, utf8
from progcorpus.llm.graph import components
from progcorpus.llm.textblocks import LOWER, mix

WORDS, SEED = 4, 42
RADIUS = 4
PIVOTS = 24         # reference fingerprints
DENSE = 4           # of them, compared for all pairs of a window (the rest for what is left)
BUCKET = 512        # fingerprints expected in a bucket, at most
CHUNK = 4096        # fingerprints of a bucket on either side of a unit
TILE = 1 << 20      # pairs compared at a time
PIECE = 1 << 16     # shingles whose bits are counted at a time

REFERENCES = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def fingerprint(text: bytes) -> int:
    """The SimHash of a text."""
    from xxhash import xxh64_intdigest

    parts = text.translate(LOWER.tobytes()).split()
    if not parts:
        return 0
    line, n = b" ".join(parts), len(parts)
    ends = list(itertools.accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[:-1]]
    if n <= WORDS:
        return xxh64_intdigest(line, SEED)
    total, view = np.zeros(64, dtype=np.int64), memoryview(line)
    for at in range(0, n - WORDS + 1, PIECE):
        last = min(at + PIECE, n - WORDS + 1)
        hashes = np.fromiter((xxh64_intdigest(view[a:b - 1], SEED) for a, b in zip(
            starts[at:last], ends[at + WORDS - 1:last + WORDS - 1])), dtype="<u8", count=last - at)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = total * 2 > n - WORDS + 1
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    import pyarrow as pa

    for part in text_blocks(batches):
        values = np.array([fingerprint(t) for t in utf8(part.column(1))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint (as a signed long) of every row's text."""
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """Hamming distances to the references, a column for each."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.uint8)


def segments(k: int) -> list[int]:
    """``k`` masks of neighbouring bits, of sizes at most one apart."""
    edges = [64 * i // k for i in range(k + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def keys_of(k: int, radius: int) -> np.ndarray:
    """The masks of all choices of ``k - radius`` segments."""
    return np.array([sum(c) for c in itertools.combinations(segments(k), k - radius)], dtype=np.uint64)


def expected_bucket(n: int, k: int, radius: int) -> float:
    """Fingerprints that share a key with one of ``n``, were their bits independent."""
    return n / 2 ** (64 * (k - radius) / k)


def segment_count(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> int:
    k = radius + 1
    while expected_bucket(n, k, radius) > bucket and k < 64:
        k += 1
    return k


def _bucket_batches(k: int, radius: int):
    """``choice, key, fp, pivots`` of every fingerprint for every choice of segments."""
    masks = keys_of(k, radius)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                fps = batch.column(0).slice(at, 1 << 16).to_numpy().view(np.uint64)
                table = pa.array([row.tobytes() for row in pivot_distances(fps)], pa.binary())
                for c, mask in enumerate(masks):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(fps), c, dtype=np.int32)), pa.array((fps & mask).view(np.int64)),
                        pa.array(fps.view(np.int64)), table], names=["choice", "key", "fp", "pivots"])
    return run


def close_pairs(fps: np.ndarray, table: np.ndarray, radius: int):
    """Arrays ``(i, j)`` of the pairs within ``radius``, tile by tile; the rows are in
    order of the first distance.  Pairs are discarded by their largest coordinate
    difference, a distance at a time, and what is left is compared bit by bit."""
    n = len(fps)
    end = np.searchsorted(table[:, 0], table[:, 0].astype(np.int64) + radius, side="right")
    row = 0
    while row < n:
        rows = max(1, min(n - row, TILE // max(1, int(end[row]) - row)))
        while rows > 1 and rows * (int(end[row + rows - 1]) - row) > 2 * TILE:
            rows //= 2
        stop = int(end[row + rows - 1])
        a, b = table[row:row + rows], table[row:stop]
        alive = np.ones((rows, stop - row), dtype=bool)
        for c in range(min(DENSE, table.shape[1])):
            x, y = a[:, c][:, None], b[:, c][None, :]
            alive &= np.maximum(x, y) - np.minimum(x, y) <= radius
        i, j = np.nonzero(alive)
        i, j = i[j > i] + row, j[j > i] + row                  # each pair once
        for c in range(DENSE, table.shape[1]):
            if not len(i):
                break
            gap = np.abs(table[i, c].astype(np.int16) - table[j, c]) <= radius
            i, j = i[gap], j[gap]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        yield i[near], j[near]
        row += rows


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs whose ends are tied already cost one array step."""
        roots = np.array(self.up)
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots = up
        apart = roots[i] != roots[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist()):
            self.join(x, y)


def _units(batches, n_keys: int):
    """Sorted rows as one Arrow table per run of equal first ``n_keys`` columns."""
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(n_keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        for a, b in zip(at, [*at[1:], batch.num_rows]):
            this = tuple(c[a] for c in cols)
            if key is not None and this != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = this
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _unit_batches(radius: int):
    """``a, b`` per fingerprint linked in a unit: itself and the least it connects to;
    from sorted ``choice, key, low, high, chunk, fp, pivots``."""
    def run(batches):
        import pyarrow as pa

        for (_, _, low, high), t in _units(batches, 4):
            if t.num_rows < 2:
                continue
            fps = t.column(5).to_numpy().view(np.uint64)
            table = np.frombuffer(b"".join(t.column(6).to_pylist()), dtype=np.uint8).reshape(len(fps), -1)
            chunk = t.column(4).to_numpy()
            order = np.argsort(table[:, 0], kind="stable")
            fps, table, chunk = fps[order], table[order], chunk[order]
            ties, linked = _Union(len(fps)), np.zeros(len(fps), dtype=bool)
            for i, j in close_pairs(fps, table, radius):
                if low != high:                                 # pairs of one chunk have their own unit
                    across = chunk[i] != chunk[j]
                    i, j = i[across], j[across]
                linked[i] = linked[j] = True
                ties.add(i, j)
            at = np.flatnonzero(linked)
            if len(at):
                root = np.array([ties.root(int(x)) for x in at])
                yield pa.RecordBatch.from_arrays([pa.array(fps[at].view(np.int64)), pa.array(fps[root].view(np.int64))],
                                                 names=["a", "b"])
    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: ties between the fingerprints of ``distinct`` (a column ``fp``, no repeats)
    whose components are those of all links within ``radius``."""
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    k = segment_count(distinct.count(), radius, bucket)
    rows = store(distinct.select("fp").mapInArrow(_bucket_batches(k, radius), "choice int, key long, fp long, pivots binary"),
                 "simhash-buckets")
    size = (rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
            .select(F.col("choice").alias("_c"), F.col("key").alias("_k"), F.ceil(F.col("n") / chunk).cast("int").alias("n")))
    size = store(size, "simhash-sizes")
    member = rows.join(size, (F.col("choice") == F.col("_c")) & (F.col("key") == F.col("_k"))).withColumn(
        "chunk", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(
        F.least(F.col("chunk"), j).alias("low"), F.greatest(F.col("chunk"), j).alias("high")))
    units = (member.select("choice", "key", F.explode(pairs).alias("_p"), "chunk", "fp", "pivots")
             .select("choice", "key", "_p.low", "_p.high", "chunk", "fp", "pivots"))
    return (units.repartition("choice", "key", "low", "high").sortWithinPartitions("choice", "key", "low", "high")
            .mapInArrow(_unit_batches(radius), "a long, b long"))


def link_fingerprints(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """One row per document (see the module docstring)."""
    fps = store(fingerprints(docs.select("doc_id", "text")), "simhash-fingerprints")
    least = store(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    ties = store(near_links(least, radius, bucket, chunk), "simhash-ties")
    star = components(ties, "a", "b").select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    label = store(least.join(star, F.col("fp") == F.col("_u"), "left").select(
        "fp", "least", F.coalesce("_v", "fp").alias("label")), "simhash-labels")
    top = label.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = store(label.join(top, "label").select("fp", "component_id"), "simhash-components")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

