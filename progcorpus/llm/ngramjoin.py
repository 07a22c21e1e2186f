"""N-gram Jaccard self-join with Bayesian candidate pruning.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles
is at least 0.8.  ``link_classes(docs)`` returns one row per document,

``doc_id, class_id, n_links, text_class``

``class_id`` is the least ``doc_id`` of all documents that links (or equal texts)
connect, ``n_links`` the number of *other distinct texts* linked with the document's
text, ``text_class`` the least ``doc_id`` of the documents with the same text.

Words are runs of ASCII letters, digits and bytes above 0x7F with A-Z lower-cased;
a text of one to four words is one shingle.  Work is done on distinct texts.

1. Each text gets 128 MinHash values and 32 band keys of four values (a pair at the
   threshold shares a key with probability ``1 - (1 - 0.8**4)**32``, all but 5e-8).
2. Every text is compared with the least text of each of its buckets.  The
   comparison is incremental: 16 values at a time, and as soon as the posterior
   probability (uniform prior) that the similarity reaches the threshold falls below
   ``TOLERANCE``, the pair is dropped.  What survives ties texts into groups.
3. Buckets whose members lie in more than one group are compared member by member,
   in chunks, by the same test; a survivor ties their groups.  So a bucket of near
   copies costs one comparison per text, and no pairs are listed.
4. Inside the final groups every pair is verified exactly on the shingle sets,
   without the test of the signatures, in chunk pairs of at most ``CHUNK`` texts a
   side.  A chunk pair returns a row per text: its links there and the least text
   they connect it to.
5. Connected components of the exact links are the classes.

Nulls: a null text is an empty one; texts without words are linked with nothing
(equal ones share their class).  Null ids are ignored in the minima (a class of null
ids only has a null ``class_id``).  Repeated rows are rows of the same class.  An
empty table gives no rows.  Other columns are ignored.

Scale: signatures are 0.5 KB a text; shingle sets are made again only for texts that
have a group.  Buckets, groups and copies are aggregated before they are joined
back, and joins read stored tables, so adaptive execution can split a hot bucket or
a text that a third of all documents have.  Large buckets and groups are cut into
chunk pairs, which are spread over tasks.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from progcorpus.llm.common import ship, store, text_blocks, utf8
from progcorpus.llm.graph import components
from progcorpus.llm.textblocks import ALNUM, chain, mix, words

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
HASHES, BANDS = 128, 32
STEP = 16                   # MinHash values compared at a time
TOLERANCE = 1e-6            # least posterior probability that keeps a pair
BUCKET_CHUNK = 512          # members of a mixed bucket compared in one task, per side
CHUNK = 512                 # members of a group verified in one task, per side
COLUMNS = 4096              # shingles of a group multiplied at a time

_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_MULT = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_XOR = (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32)


def shingles(texts: list[bytes], n: int = SHINGLE):
    """Distinct shingle hashes of every text, sorted: ``(hashes, text of each)``."""
    hashes, doc, _, _ = words(texts, ALNUM)
    runs = chain(hashes, n)
    inside = np.flatnonzero(doc[n - 1:] == doc[:len(runs)]) if len(runs) else np.zeros(0, np.int64)
    out, owner = [runs[inside]], [doc[inside]]
    counts = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(counts) - counts
    for k in range(1, n):                           # texts of fewer words
        short = np.flatnonzero(counts == k)
        if len(short):
            out.append(mix(chain(hashes, k)[first[short]] + np.uint64(k)))
            owner.append(short)
    out, owner = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    once = np.r_[True, (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])][:len(out)]
    return out[once], owner[once]


def min_hashes(hashes: np.ndarray, owner: np.ndarray, n_texts: int):
    """``(rows, values)``: texts with shingles, and their MinHash values."""
    rows = np.flatnonzero(np.bincount(owner, minlength=n_texts))
    values = np.empty((len(rows), HASHES), dtype=np.uint32)
    if len(rows):
        x, edge = (hashes >> np.uint64(16)).astype(np.uint32), np.searchsorted(owner, rows)
        for k in range(HASHES):
            values[:, k] = np.minimum.reduceat(x * _MULT[k] ^ _XOR[k], edge)
    return rows, values


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the fewest matches that keep a pair.

    With a uniform prior the posterior after m matches of n is Beta(m+1, n-m+1),
    so P(similarity >= t) is the chance of at most m successes in n+1 trials."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


KEEP = least_matches(float(THRESHOLD), TOLERANCE)


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (rows of ``a`` and ``b``) survive all tests."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    for n, least in KEEP.items():
        if not len(alive):
            break
        matches[alive] += (a[alive, n - STEP:n] == b[alive, n - STEP:n]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def _signature_batches(batches):
    """``id, bands, sig`` of texts with shingles (16 bits of each MinHash value)."""
    import pyarrow as pa

    for part in text_blocks(batches, 2 << 20):
        rows, values = min_hashes(*shingles(utf8(part.column(1))), part.num_rows)
        width = HASHES // BANDS
        keys = np.stack([mix(chain(np.ascontiguousarray(values[:, b * width:(b + 1) * width]).reshape(-1).astype(np.uint64),
                                   width)[::width] + np.uint64(b)) for b in range(BANDS)], axis=1) if len(rows) else values
        sig = (mix(values) >> np.uint64(48)).astype("<u2")
        yield pa.RecordBatch.from_arrays([
            part.column(0).take(pa.array(rows)), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())),
            pa.array([s.tobytes() for s in sig], pa.binary())], names=["id", "bands", "sig"])


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, HASHES)


def _star_batches(batches):
    """Pairs ``id, pivot`` that survive, from ``id, pivot, sig, pivot_sig``."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            alive = pa.array(similar(_sigs(batch.column(2)), _sigs(batch.column(3))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], names=["a", "b"])


def _units(batches, n_keys: int):
    """Sorted rows as one Arrow table per run of equal first ``n_keys`` columns."""
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if key is not None and keys[start] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield key, pa.Table.from_batches(held)


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


def _bucket_batches(batches):
    """Ties ``a, b`` between the groups of a mixed bucket's members, from sorted
    ``key, low, high, chunk, group, id, sig``."""
    import pyarrow as pa

    for (_, low, high), t in _units(batches, 3):
        chunk, group = t.column(3).to_numpy(), t.column(4).to_pylist()
        ids, sig = t.column(5).to_pylist(), _sigs(t.column(6))
        number = {g: i for i, g in enumerate(dict.fromkeys(group))}
        group = np.array([number[g] for g in group])
        ties, made = _Union(len(number)), []
        left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        for i in left:
            root = np.array([ties.root(g) for g in range(len(number))])
            other = right[(root[group[right]] != root[group[i]]) & ((right > i) | (low != high))]
            alive = other[similar(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other])]
            for j in alive:
                if ties.root(group[i]) != ties.root(group[j]):
                    ties.join(group[i], group[j])
                    made.append((ids[i], ids[j]))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*made)], names=["a", "b"])


def _set_batches(batches):
    """``grp, chunk, n, id, set`` from ``grp, chunk, n, id, text``."""
    import pyarrow as pa

    for part in text_blocks(batches, 2 << 20):
        hashes, owner = shingles(utf8(part.column(4)))
        at = np.searchsorted(owner, np.arange(part.num_rows + 1))
        sets = [hashes[a:b].tobytes() for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(sets, pa.binary())],
                                         names=["grp", "chunk", "n", "id", "set"])


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left and right set."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1                               # the others meet in no pair
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    width = int(shared.sum())
    edges = np.searchsorted(column, np.arange(0, width + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        block = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        block[owner[a:b], column[a:b] - k * COLUMNS] = 1
        out += block[left] @ block[right].T
    return out.astype(np.int64)


def _verify_batches(batches):
    """Per chunk pair and text ``id, n_links, least``, from sorted
    ``grp, low, high, chunk, id, set``."""
    import pyarrow as pa

    num, den = THRESHOLD.numerator, THRESHOLD.denominator
    for (_, low, high), t in _units(batches, 3):
        order = np.argsort(np.array(t.column(4).to_pylist(), dtype=object), kind="stable")
        t = t.take(pa.array(order))
        chunk, ids = t.column(3).to_numpy(), t.column(4).to_pylist()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in t.column(5).to_pylist()]
        left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        links, ties = np.zeros(len(ids), dtype=np.int64), _Union(len(ids))
        if len(left) and len(right):
            size = np.array([len(s) for s in sets])
            both = _overlaps(sets, left, right)
            close = both * den >= num * (size[left][:, None] + size[right][None, :] - both)
            for row, i in enumerate(left):
                to = right[close[row]]
                to = to[to > i] if low == high else to
                links[i] += len(to)
                links[to] += 1
                for j in to:
                    ties.join(i, j)
        least = [ids[ties.root(i)] for i in range(len(ids))]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(links), pa.array(least, pa.binary())],
                                         names=["id", "n_links", "least"])


def _chunk_pairs(n: str, chunk: str):
    """One ``low, high`` for every chunk that a member of ``chunk`` meets."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda j: F.struct(
        F.least(F.col(chunk), j).alias("low"), F.greatest(F.col(chunk), j).alias("high"))))


def candidate_groups(sigs: DataFrame) -> DataFrame:
    """``id, grp``: groups of at least two texts outside which no pair survives."""
    bands = sigs.select("id", F.explode("bands").alias("key"))
    pivots = store(bands.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("size"))
                   .where(F.col("size") > 1), "buckets")
    pairs = store(bands.join(pivots, "key").where(F.col("id") != F.col("pivot")).select("id", "pivot").distinct(), "pairs")
    sig_of = sigs.select("id", "sig")
    stars = store(pairs.join(sig_of, "id")
                  .join(sig_of.select(F.col("id").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
                  .select("id", "pivot", "sig", "pivot_sig").mapInArrow(_star_batches, "a binary, b binary"), "stars")
    labels = store(stars.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("grp")), "labels")
    member = bands.join(pivots, "key").join(labels, "id", "left").select(
        "key", "id", "size", F.coalesce("grp", "id").alias("grp"))
    member = store(member, "members")
    mixed = store(member.groupBy("key").agg(F.min("grp").alias("_a"), F.max("grp").alias("_b"), F.max("size").alias("_n"))
                  .where(F.col("_a") != F.col("_b")).select("key", F.ceil(F.col("_n") / BUCKET_CHUNK).cast("int").alias("n")),
                  "mixed")
    units = (member.join(mixed, "key").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
             .select("key", _chunk_pairs("n", "chunk").alias("_p"), "chunk", "grp", "id").join(sig_of, "id")
             .select("key", "_p.low", "_p.high", "chunk", "grp", "id", "sig"))
    ties = (units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
            .mapInArrow(_bucket_batches, "a binary, b binary"))
    star = components(stars.union(labels.select(F.col("id").alias("a"), F.col("grp").alias("b"))).union(store(ties, "ties")), "a", "b")
    return store(star.select(F.col("u").alias("id"), F.col("v").alias("grp"))
                 .union(star.select(F.col("v").alias("id"), F.col("v").alias("grp")).distinct()), "groups")


def verified_links(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """``id, n_links, least`` per chunk pair, exact; ``texts``: ``id, text`` with a row per id."""
    size = store(groups.groupBy("grp").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n")), "group-sizes")
    member = groups.join(size, "grp").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    sets = member.join(texts, "id").select("grp", "chunk", "n", "id", "text").mapInArrow(
        _set_batches, "grp binary, chunk int, n int, id binary, set binary")
    units = sets.select("grp", _chunk_pairs("n", "chunk").alias("_p"), "chunk", "id", "set").select(
        "grp", "_p.low", "_p.high", "chunk", "id", "set")
    return (units.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high")
            .mapInArrow(_verify_batches, "id binary, n_links long, least binary"))


def text_classes(docs: DataFrame) -> DataFrame:
    """``id, text_class, class_id, n_links``: one row per distinct text, stored
    (``id`` is the MD5 of the text)."""
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    keyed = docs.select(F.col("doc_id").cast("long"), _text_id().alias("id"), "text")
    signed = keyed.select("id", "text").mapInArrow(_signature_batches, "id binary, bands array<long>, sig binary")
    sigs = store(signed.dropDuplicates(["id"]), "signatures")
    least = store(keyed.groupBy("id").agg(F.min("doc_id").alias("text_class")), "text-classes")
    groups = candidate_groups(sigs)
    # one row of every grouped text: the one with the least id (several if it is repeated)
    chosen = groups.select("id").join(least, "id").toDF("_id", "_doc")
    texts = (keyed.join(chosen, (F.col("id") == F.col("_id")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
             .select("id", "text").dropDuplicates(["id"]))
    links = store(verified_links(texts, groups), "links")
    star = components(links.select("id", "least"), "id", "least")
    label = star.select(F.col("u").alias("id"), F.col("v").alias("label"))
    count = links.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    table = store(least.join(label, "id", "left").join(count, "id", "left").select(
        "id", "text_class", F.coalesce("label", "id").alias("label"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")),
        "text-labels")
    top = store(table.groupBy("label").agg(F.min("text_class").alias("class_id")), "class-ids")
    return store(table.join(top, "label").select("id", "text_class", "class_id", "n_links", "label"), "classes")


def _text_id():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def link_classes(docs: DataFrame) -> DataFrame:
    """One row per document (see the module docstring)."""
    docs = docs.select("doc_id", "text")
    return docs.select("doc_id", _text_id().alias("id")).join(text_classes(docs), "id").select(
        "doc_id", "class_id", "n_links", "text_class")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that represent their class: the row with
    the class's least ``doc_id``; of rows equal in id and text, and of the texts
    of a class without ids, one stays."""
    names = docs.columns
    classes = text_classes(docs)
    row = Window.partitionBy("label").orderBy("id")
    chosen = (classes.where(F.col("text_class").eqNullSafe(F.col("class_id")))
              .withColumn("_n", F.row_number().over(row)).where("_n = 1")
              .select(F.col("id").alias("_nj_id"), F.col("class_id").alias("_nj_doc")))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_nj_row"), _text_id().alias("_nj_text"),
                        F.col("doc_id").cast("long").alias("_nj_key"))
    kept = keyed.join(chosen, (F.col("_nj_text") == F.col("_nj_id")) & F.col("_nj_key").eqNullSafe(F.col("_nj_doc")))
    return kept.dropDuplicates(["_nj_text", "_nj_key"]).select(*(F.col(f"_nj_row.`{c}`").alias(c) for c in names))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS tid, x, min(doc_id) AS text_class
  FROM (SELECT doc_id, coalesce("text", '') AS x FROM documents) GROUP BY x
), w AS (
  SELECT tid, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t
), s AS (
  SELECT DISTINCT tid, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT tid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT tid, count(*) AS n FROM s GROUP BY tid
), link AS (
  SELECT p.x, p.y FROM (
    SELECT a.tid AS x, b.tid AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.tid <> b.tid
    GROUP BY a.tid, b.tid) p JOIN n nx ON nx.tid = p.x JOIN n ny ON ny.tid = p.y
  WHERE 5 * shared >= 4 * (nx.n + ny.n - shared)
), reach(tid, other) AS (
  SELECT tid, tid FROM t UNION SELECT r.tid, l.y FROM reach r JOIN link l ON l.x = r.other
), class AS (
  SELECT r.tid, min(o.text_class) AS class_id FROM reach r JOIN t o ON o.tid = r.other GROUP BY r.tid
), links AS (SELECT x AS tid, count(*) AS n_links FROM link GROUP BY x)
SELECT d.doc_id, c.class_id, coalesce(k.n_links, 0) AS n_links, t.text_class
FROM documents d JOIN t ON t.x = coalesce(d."text", '') JOIN class c ON c.tid = t.tid LEFT JOIN links k ON k.tid = t.tid
"""
