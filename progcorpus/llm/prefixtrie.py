"""The prefix trie of conversations, from sorted sequences and range minima.

A conversation is a sequence of turns ``(role, text)``; each distinct sequence of its first
``d`` turns is a node of depth ``d``, the root (``d = 0``) included.  ``trie(turns)`` returns
one row per node:

``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``

``conv_id`` is the least of the node's members (the conversations that start with it),
``parent_conv_id`` its parent's; ``n_leaves`` counts the childless nodes of its subtree,
``saved_tokens`` adds up ``(n_convs - 1) x`` words of the last text over its subtree (what
sharing prefixes saves), ``ends_sha256`` digests the ascending ids of the members that
end there.  ``turns_of(conversations)`` makes the turns, ``splice(turns)`` gives every
conversation the first ``crc32(conv_id) mod 4`` turns of conversation ``conv_id -
conv_id % 20`` for its own.

1. A turn becomes a 16-byte digest; a conversation is the string of its digests.  All are
   sorted by ``(string, conv_id)`` in range partitions, so a node's members are an interval.
2. A task takes its rows in blocks and finds the longest common prefix (LCP) of neighbours;
   a sparse table answers range minima over them.  Candidate prefixes are the depths of a
   row beyond its LCP.  For each, binary searches over the table give the extents to the
   left (of the prefix without its last turn, which names the parent) and to the right,
   independently of one another: no stack of open nodes is kept.
3. Subtree sums are differences of prefix sums over the interval.  Nodes whose interval
   reaches over the end of a block (at most two paths a block) are partial; the partial
   rows are put together by the digest of their prefix, in block order.

Nulls: rows without a ``conv_id`` are ignored; a null role or text is empty, a null turn
comes first.  A negative id has a remainder of its sign, as in SQL.  Ties (turns of one number, repeated rows) are all kept, in the order of
their digests.  An empty table gives no rows, not even a root.  Other columns are ignored.

Scale: texts leave the scan as digests and word counts.  The turns of one conversation
are numbered over many tasks and gathered in pieces of ``PIECE``; its digests (24 bytes
a turn) are one row.  A prefix that a third of all conversations share spans blocks and
partitions like any other; equal conversations are cut apart by their ids.  The ids that
end in one node are streamed through the hash in pieces (a hash of a list is made in
order); the driver sees the first and last row of each partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.llm.common import ship, store
from progcorpus.operators.ordering import group_row_number
from progcorpus.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
BORROW, HEADS = 20, 4       # every 20th conversation lends its first 0 to 3 turns
PIECE = 512                 # turns of a conversation gathered at a time
PARTITION = 1 << 20         # turns of a range partition
BLOCK = 1 << 18             # turns of a block
LEAST = 1 << 12             # turns that are worth a partition
DIGEST = 16

NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")
_PART = ("node binary, parent binary, block long, depth long, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends string")
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


# -- turns and sequences -------------------------------------------------------------

def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, place, digest, words``: the turns of each conversation, numbered
    from 1, and a row of part -1 per conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    # stored: the range partitioning below reads its input twice
    rows = store(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")), "trie-digests")
    numbered = store(group_row_number(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest").asc()], "place"),
                     "trie-turns")
    turns = numbered.select("conv_id", F.lit(1).alias("part"), "place", "digest", "words")
    each = numbered.where(F.col("place") == 1).select(
        "conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"),
        F.lit(0).cast("long").alias("words"))
    return turns.union(each)


def splice(turns: DataFrame, every: int = BORROW, heads: int = HEADS) -> DataFrame:
    """The turns with the first ``h`` of each conversation replaced by the first ``h``
    of conversation ``conv_id - conv_id % every`` (all if it has fewer, none if there
    is no such one); ``h = crc32(conv_id) % heads``."""
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    lent = (turns.where((F.col("part") == 1) & (F.col("place") < heads) & (F.col("conv_id") % every == 0))
            .groupBy(F.col("conv_id").alias("_base"))
            .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("_lent")))
    each = turns.where(F.col("part") == -1)
    taken = (each.where(h > 0).select("conv_id", h.alias("_h"), (F.col("conv_id") - F.col("conv_id") % every).alias("_base"))
             .join(lent, "_base").select("conv_id", F.explode(F.slice("_lent", F.lit(1), F.col("_h"))).alias("_t"))
             .select("conv_id", F.lit(0).alias("part"), "_t.place", "_t.digest", "_t.words"))
    return turns.where((F.col("part") == -1) | (F.col("place") > h)).union(taken)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, key, words``: the digests of each conversation end to end, and the words
    of its turns."""
    pieces = (turns.groupBy("conv_id", "part", F.floor(F.col("place") / PIECE).alias("piece"))
              .agg(F.sort_array(F.collect_list(F.struct("place", F.hex("digest").alias("digest"), "words"))).alias("t"))
              .select("conv_id", F.struct(
                  "part", "piece", F.array_join(F.transform("t", lambda x: x["digest"]), "").alias("key"),
                  F.when(F.col("part") >= 0, F.transform("t", lambda x: x["words"])).otherwise(
                      F.array().cast("array<bigint>")).alias("words")).alias("p")))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("p", lambda x: x["key"]), "")).alias("key"),
                        F.flatten(F.transform("p", lambda x: x["words"])).alias("words"))


# -- a block -------------------------------------------------------------------------

class RangeMinimum:
    """Sparse table: level ``k`` holds the minima of ``2**k`` neighbours."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (step := 1 << len(self.levels) - 1) * 2 <= len(values):
            v = self.levels[-1]
            self.levels.append(np.minimum(v[:-step], v[step:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of the ranges ``first..last`` (not empty)."""
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            v = self.levels[k]
            out[at] = np.minimum(v[first[at]], v[last[at] + 1 - (1 << int(k))])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place from ``at`` on such that all values after ``at`` are at least ``least``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            v = self.levels[k]
            inside = at + 1 < len(v)
            ok = inside & (v[np.where(inside, at + 1, 0)] >= least)
            at[ok] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place up to ``at`` such that all values after it, to ``at``, are at least ``least``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            first = at - (1 << k) + 1
            inside = first > 0
            ok = inside & (self.levels[k][np.where(inside, first, 0)] >= least)
            at[ok] -= 1 << k
        return at


def common_prefix(a: bytes, b: bytes) -> int:
    """Turns that two strings of digests share at their beginning."""
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(s, dtype=np.uint64, count=2 * n).reshape(n, 2) for s in (a, b))
    off = np.flatnonzero((x != y).any(axis=1))
    return int(off[0]) if len(off) else n


def _neighbours(digests: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The common prefix of each row and the one before it (0 for the first)."""
    out = np.zeros(len(size), dtype=np.int64)
    n = np.minimum(size[1:], size[:-1])
    pair = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    off = (digests[start[pair] + place] != digests[start[pair + 1] + place]).any(axis=1)
    out[1:] = n
    np.minimum.at(out, pair[off] + 1, place[off])
    return out


def _prefix_ids(key: bytes, depth: int) -> list[bytes]:
    """Digests of the prefixes of depth 0 to ``depth``, each with its depth."""
    h = hashlib.md5()
    out = [h.digest() + bytes(8)]
    for d in range(1, depth + 1):
        h.update(key[DIGEST * (d - 1):DIGEST * d])
        out.append(h.copy().digest() + d.to_bytes(8, "big"))
    return out


def block_nodes(convs: np.ndarray, keys: list[bytes], words: np.ndarray, before: int, after: int, number: int):
    """The nodes of a block of sorted rows as columns of ``_PART``.  ``before`` and ``after``
    are the common prefixes with the rows next to the block (-1: there is none)."""
    m = len(keys)
    size = np.array([len(k) // DIGEST for k in keys], dtype=np.int64)
    start = np.cumsum(size) - size
    digests = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
    lcp = _neighbours(digests, start, size)
    lcp[0] = max(before, 0)
    said = np.concatenate([[0], np.cumsum(words)])
    upto = lambda row, depth: said[start[row] + depth] - said[start[row]]  # noqa: E731  words of the first turns
    table = RangeMinimum(lcp)

    # candidate prefixes: the depths of each row beyond its common prefix, all of the first row
    low = lcp + 1
    low[0] = 0
    n = np.maximum(size - low + 1, 0)
    base = np.cumsum(n) - n
    at = np.repeat(np.arange(m), n)
    depth = low[at] + np.arange(len(at)) - base[at]
    known = (at == 0) & (depth <= before)                       # found in an earlier block already
    right = table.right(at, depth)
    index = lambda row, d: base[row] + d - low[row]
    inner = np.flatnonzero(depth > 0)
    parent = np.full(len(at), -1, dtype=np.int64)
    parent[inner] = index(table.left(at[inner], depth[inner] - 1), depth[inner] - 1)

    rows, whole = np.arange(m), upto(np.arange(m), size)
    total = np.concatenate([[0], np.cumsum(whole)])
    fresh = np.concatenate([[0], np.cumsum(whole - upto(rows, lcp))])
    leaf = np.concatenate([[0], np.cumsum(np.append(lcp[1:], after) < size)])
    shared = upto(at, np.maximum(depth - 1, 0))
    first = whole[at] - np.where(known, upto(at, lcp[at]), shared)
    members = right - at + 1
    saved = total[right + 1] - total[at] - members * shared - (fresh[right + 1] - fresh[at + 1]) - first
    children = np.bincount(parent[(parent >= 0) & ~known], minlength=len(at))
    least = RangeMinimum(convs).least(at, right)

    # who ends where: rows of equal strings are neighbours, in the order of their ids
    end = index(table.left(rows, size), size)
    cut = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
    ends = [""] * len(at)
    for a, b in zip(cut, [*cut[1:], m]):
        ends[end[a]] = ",".join(map(str, convs[a:b].tolist()))

    opened = known | ((right == m - 1) & (depth <= after))
    ids: list[bytes | None] = [None] * len(at)
    for i, d in zip(np.flatnonzero(known).tolist(), _prefix_ids(keys[0], before)):
        ids[i] = d
    if after >= 0:
        last = _prefix_ids(keys[-1], after)
        for i in np.flatnonzero(opened & ~known):
            ids[i] = last[depth[i]]
    for i in np.flatnonzero(~opened):
        ends[i] = hashlib.sha256(ends[i].encode()).hexdigest()
    up = parent.tolist()
    over = [ids[p] if p >= 0 else None for p in up]
    above = [int(least[p]) if p >= 0 and ids[p] is None else None for p in up]
    return [ids, over, np.full(len(at), number), depth, least, above, members, children, leaf[right + 1] - leaf[at], saved, ends]


def _node_batches(edges):
    """Blocks of the sorted rows of a partition; ``edges``: common prefixes with the
    partitions before and after, by partition number."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        types = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
        kinds = [types[c.split()[1]] for c in _PART.split(", ")]
        held, size, number = [], 0, 0
        before, after = edges.value.get(pid, (-1, -1))

        def made(then: int):
            convs = np.concatenate([b.column(0).to_numpy() for b in held])
            keys = [k for b in held for k in b.column(1).to_pylist()]
            words = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False) for b in held])
            cols = block_nodes(convs, keys, words, before, then, (pid << 32) + number)
            for a in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[a:a + (1 << 16)], k) for c, k in zip(cols, kinds)],
                                                 names=_names(_PART))

        for batch in batches:
            at = 0
            turns = np.cumsum([len(k) // DIGEST + 1 for k in batch.column(1).to_pylist()])
            while at < batch.num_rows:
                done = turns[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(turns, done + BLOCK - size, side="right")))
                if held and size + turns[at] - done > BLOCK:
                    then = common_prefix(held[-1].column(1)[-1].as_py(), batch.column(1)[at].as_py())
                    yield from made(then)
                    held, size, before, number = [], 0, then, number + 1
                    continue
                held.append(batch.slice(at, to - at))
                size += int(turns[to - 1] - done)
                at = to
        if held:
            yield from made(after)
    return run


def _edge_batches(batches):
    """The first and last string of a partition."""
    import pyarrow as pa
    from pyspark import TaskContext

    first = last = None
    for b in batches:
        if b.num_rows:
            first = b.column(0)[0].as_py() if first is None else first
            last = b.column(0)[-1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([first], pa.binary()),
                                          pa.array([last], pa.binary())], names=["pid", "first", "last"])


def _merge_batches(batches):
    """Partial nodes, sorted by node and block, put together one after another."""
    import pyarrow as pa

    now, hashed, out = None, None, []

    def flush():
        cols = list(zip(*out))
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_names(_MERGED))

    def closed():
        return (now["node"], now["parent"], now["depth"], now["conv_id"], *(now[c] for c in _SUMS), hashed.hexdigest())

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or now["node"] != row["node"]:
                if now is not None:
                    out.append(closed())
                    if len(out) >= 1 << 14:
                        yield flush()
                        out = []
                now, hashed, some = row, hashlib.sha256(), False
            else:
                now["conv_id"] = min(now["conv_id"], row["conv_id"])
                for c in _SUMS:
                    now[c] += row[c]
            if row["ends"]:
                hashed.update((("," if some else "") + row["ends"]).encode())
                some = True
    if now is not None:
        out.append(closed())
        yield flush()


_MERGED = ("node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends_sha256 string")


def trie(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per node (see the module docstring)."""
    ship(__name__, "progcorpus.llm.common")
    spark = turns.sparkSession
    checkpoint_dir(spark)
    rows = store(sequences(turns), "trie-sequences")
    size = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    n = partitions or max(1, -(-size // PARTITION), min(spark.sparkContext.defaultParallelism, -(-size // LEAST)))
    # checkpoint() keeps the partitions, so both passes see the same numbers
    ranged = (rows.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
              .select("conv_id", "key", "words").checkpoint(eager=True))
    ends = sorted(ranged.select("key").mapInArrow(_edge_batches, "pid long, first binary, last binary").collect())
    between = [common_prefix(a.last, b.first) for a, b in zip(ends, ends[1:])]
    edges = spark.sparkContext.broadcast(
        {e.pid: x for e, x in zip(ends, zip([-1, *between], [*between, -1]))})
    found = store(ranged.mapInArrow(_node_batches(edges), _PART), "trie-nodes")
    merged = store(found.where(F.col("node").isNotNull()).repartition("node").sortWithinPartitions("node", "block")
                   .mapInArrow(_merge_batches, _MERGED), "trie-merged")
    above = merged.select(F.col("node").alias("_node"), F.col("conv_id").alias("_above"))
    done = found.where(F.col("node").isNull())
    keep = ["conv_id", "depth", *_SUMS, F.col("ends").alias("ends_sha256")]
    waiting = done.where(F.col("parent").isNotNull()).select("parent", *keep).union(
        merged.select("parent", "conv_id", "depth", *_SUMS, "ends_sha256"))
    linked = waiting.join(above, F.col("parent") == F.col("_node"), "left").withColumn("parent_conv_id", F.col("_above"))
    return (done.where(F.col("parent").isNull()).select("parent_conv_id", *keep).select(*_names(NODES))
            .union(linked.select(*_names(NODES))))


def conversation_trie(conversations: DataFrame, spliced: bool = False) -> DataFrame:
    """The trie of a table ``conv_id, turn, role, text``."""
    turns = turns_of(conversations)
    return trie(splice(turns) if spliced else turns)
