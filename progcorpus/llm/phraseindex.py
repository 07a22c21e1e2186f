"""Benchmark decontamination over a distributed positional inverted index.

``build_index(docs)`` stores the index in the shared folder, a row per segment:
a slice of about ``SEGMENT_BYTES`` of text from one task.  A segment holds the
sorted hashes of its words (64 bits), a posting list of word places for each
and the documents' ids and lengths.  Places count the words of the segment with
a gap between documents, so no phrase reaches over two of them.

``search(index, items)`` finds every occurrence of the items' windows (runs of
``WINDOW`` consecutive words; a shorter item is one window).  A segment is asked
for the posting lengths of a window's words; if one is missing the window is
done, else the posting list of the rarest word, moved back by its place in the
window, is intersected with the lists of the others from rare to frequent.
Result: ``segment, ordinal, doc_id, item_id, start, end`` with one row per run
of overlapping windows of one item in a document (words from ``start`` to before
``end`` of the document).

``proximity(index, items, distance)`` finds the spans of a document that hold every
word of an item, the first and the last at most ``distance`` words apart; the rows
have the same columns, one for every such span without a shorter one inside.  That
depends on the document and the item alone, not on the segments.

``decontaminate(docs, items)`` sums matches up per document:
``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
Nulls: a null text has no words; an item without words matches nothing; an item
with a null id marks its words as hit but is no counted item.  A null
``doc_id`` is passed through.  Repeated documents are documents of their own;
repeated items count once by id.  Empty tables give no rows (no items: no
hits).  Other columns are ignored.

Scale: the index is built where the documents are read, without a shuffle, and
searched by a scan; a frequent passage lengthens the lists of its segments
only.  Items are taken in blocks of at most about ``BLOCK_BYTES`` of text, one
broadcast and one scan of the index each, so a broadcast is bounded whatever
the benchmark's size.  Per-document sums are keyed by segment and ordinal, which no two
documents share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.llm.common import ship, store, text_blocks, utf8
from progcorpus.llm.textblocks import ALNUM, chain, words

WINDOW = 10
SEGMENT_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20       # benchmark text of one broadcast

INDEX_SCHEMA = ("segment long, doc_ids array<long>, n_words array<int>, terms binary, ends binary, places binary")
MATCH_SCHEMA = "segment long, ordinal int, doc_id long, item_id long, start int, end int"


def _index_batches(batches):
    import pyarrow as pa
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() << 32
    for i, part in enumerate(text_blocks(batches, SEGMENT_BYTES)):
        hashes, doc, _, _ = words(utf8(part.column(1)), ALNUM)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(hashes)) if len(hashes) else first
        n_words = np.bincount(doc, minlength=part.num_rows)
        yield pa.RecordBatch.from_arrays([
            pa.array([task + i], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
            pa.array([n_words.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([hashes[first].tobytes()], pa.binary()),
            pa.array([ends.astype("<u4").tobytes()], pa.binary()),
            pa.array([(order + doc[order]).astype("<u4").tobytes()], pa.binary()),
        ], names=["segment", "doc_ids", "n_words", "terms", "ends", "places"])


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``doc_id, text``; every word of every row is posted."""
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    return store(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_index_batches, INDEX_SCHEMA),
                 "phrase-index")


class Segment:
    """One row of the index, for look-ups."""

    def __init__(self, doc_ids, n_words, terms, ends, places):
        self.doc_ids = doc_ids
        self.terms = np.frombuffer(terms, dtype=np.uint64)
        self.ends = np.frombuffer(ends, dtype="<u4").astype(np.int64)
        self.places = np.frombuffer(places, dtype="<u4")
        n = np.array(n_words, dtype=np.int64)
        self.first = np.cumsum(n) - n + np.arange(len(n))     # place of each document's first word

    def find(self, wanted: np.ndarray):
        """``(from, to)`` of the posting list of each wanted term."""
        if not len(self.terms):
            zero = np.zeros(len(wanted), np.int64)
            return zero, zero
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        hit = self.terms[at] == wanted
        lo = np.where(at > 0, self.ends[at - 1], 0)
        return np.where(hit, lo, 0), np.where(hit, self.ends[at], 0)

    def documents(self, places: np.ndarray) -> np.ndarray:
        """The document ordinal of each place (documents without words own none)."""
        return np.searchsorted(self.first, places, side="right") - 1


def _windows(items, width: int):
    """``{length: (window rows of term numbers, item of each row)}`` and the
    sorted terms; equal windows of one item are kept once."""
    hashes, doc, _, _ = words([t.encode() for _, t in items], ALNUM)
    terms = np.unique(hashes)
    number = np.searchsorted(terms, hashes)
    bounds = np.searchsorted(doc, np.arange(len(items) + 1))
    out: dict[int, list] = {}
    for i in range(len(items)):
        seq = number[bounds[i]:bounds[i + 1]]
        if len(seq):
            n = min(width, len(seq))
            rows = np.unique(np.lib.stride_tricks.sliding_window_view(seq, n), axis=0)
            out.setdefault(n, []).append((rows, np.full(len(rows), i)))
    return {n: (np.concatenate([r for r, _ in parts]), np.concatenate([i for _, i in parts]))
            for n, parts in out.items()}, terms


def _phrase_starts(places, lo, hi, row) -> np.ndarray:
    """Where the window starts: lists intersected from the rarest term on."""
    order = np.argsort(hi[row] - lo[row], kind="stable")
    start = None
    for k in order:
        found = places[lo[row[k]]:hi[row[k]]].astype(np.int64) - k
        if start is None:
            start = found
        else:
            at = np.minimum(np.searchsorted(found, start), len(found) - 1)
            start = start[found[at] == start]
        if not len(start):
            break
    return start


def _merge_runs(doc, item, start, end):
    """Union of overlapping spans of one item in one document."""
    order = np.lexsort((start, item, doc))
    doc, item, start, end = doc[order], item[order], start[order], end[order]
    # spans of one item have one length, so their ends are sorted as their starts are
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > end[:-1])]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(new)) - 1
    return doc[at], item[at], start[at], end[last]


def _search_segment(seg: Segment, windows, terms):
    """Arrays ``doc, item, start, end`` (places) of all window occurrences."""
    lo, hi = seg.find(terms)
    size = hi - lo
    found = []
    for n, (rows, item) in windows.items():
        seen: dict[bytes, np.ndarray] = {}
        for r in np.flatnonzero((size[rows] > 0).all(axis=1)):
            key = rows[r].tobytes()
            start = seen.get(key)
            if start is None:
                start = seen[key] = _phrase_starts(seg.places, lo, hi, rows[r])
            if len(start):
                found.append((start, np.full(len(start), item[r]), np.full(len(start), n)))
    if not found:
        return None
    start, item, n = (np.concatenate(x) for x in zip(*found))
    return _merge_runs(seg.documents(start), item, start, start + n)


def _around(other: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """The places of ``other`` at most ``distance`` from one of ``at`` (both sorted)."""
    lo, hi = np.searchsorted(other, at - distance), np.searchsorted(other, at + distance, side="right")
    lo = np.maximum(lo, np.append(0, hi[:-1]))           # ranges may overlap
    n = np.maximum(hi - lo, 0)
    return other[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _near_segment(seg: Segment, queries, terms, distance: int):
    """The same for the shortest spans with all words of each query (rows of distinct
    terms).  Every span has a place of the rarest word here, which only saves work."""
    lo, hi = seg.find(terms)
    found = []
    for item, row in queries:
        size = hi[row] - lo[row]
        if not size.all():
            continue
        places = [seg.places[lo[t]:hi[t]].astype(np.int64) for t in row[np.argsort(size, kind="stable")]]
        places = [places[0], *(_around(p, places[0], distance) for p in places[1:])]
        if not all(map(len, places)):
            continue
        end = np.sort(np.concatenate(places))
        left = end.copy()
        for p in places:                                 # the last place of every word up to the end
            i = np.searchsorted(p, end, side="right") - 1
            left = np.where(i < 0, -1, np.minimum(left, p[np.maximum(i, 0)]))
        doc = seg.documents(end)
        keep = (left >= seg.first[doc]) & (end - left <= distance)
        left, end, doc = left[keep], end[keep], doc[keep]
        if len(end):
            new = np.r_[True, left[1:] != left[:-1]]     # the first end of a left one
            found.append((doc[new], np.full(int(new.sum()), item), left[new], end[new] + 1))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else None


def _match_batches(pack, find):
    def run(batches):
        import pyarrow as pa

        ids, *query = pack.value
        names = ["segment", "ordinal", "doc_id", "item_id", "start", "end"]
        for batch in batches:
            for row in range(batch.num_rows):
                segment, doc_ids, *rest = (batch.column(i)[row].as_py() for i in range(6))
                seg = Segment(doc_ids, *rest)
                got = find(seg, *query)
                if got is None:
                    continue
                doc, item, start, end = got
                base = seg.first[doc]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(doc), segment), pa.int64()), pa.array(doc, pa.int32()),
                    pa.array([doc_ids[d] for d in doc], pa.int64()), pa.array([ids[i] for i in item], pa.int64()),
                    pa.array(start - base, pa.int32()), pa.array(end - base, pa.int32())], names=names)
    return run


def _item_blocks(items: DataFrame, block_bytes: int):
    """The items in blocks of about ``block_bytes`` of text, as lists on the driver."""
    items = items.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r.item_id, r.text) for r in part.distinct().collect()]


def _run(index: DataFrame, items: DataFrame, block_bytes: int, pack, find) -> DataFrame:
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    spark = index.sparkSession
    out = spark.createDataFrame([], MATCH_SCHEMA)
    for block in _item_blocks(items, block_bytes):
        shared = spark.sparkContext.broadcast(([i for i, _ in block], *pack(block)))
        out = out.union(index.mapInArrow(_match_batches(shared, find), MATCH_SCHEMA))
    return out


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact phrase matches of every window of every item."""
    return _run(index, items, block_bytes, lambda block: _windows(block, window), _search_segment)


def proximity(index: DataFrame, items: DataFrame, distance: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The shortest spans with all words of an item, at most ``distance`` from first to last."""
    def pack(block):
        hashes, doc, _, _ = words([t.encode() for _, t in block], ALNUM)
        terms, number = np.unique(hashes, return_inverse=True)
        bounds = np.searchsorted(doc, np.arange(len(block) + 1))
        rows = [(i, np.unique(number[bounds[i]:bounds[i + 1]])) for i in range(len(block))]
        return [(i, r) for i, r in rows if len(r)], terms, distance

    return _run(index, items, block_bytes, pack, _near_segment)


def documents_of(index: DataFrame) -> DataFrame:
    """``segment, ordinal, doc_id, n_words`` of every indexed row."""
    return index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ordinal", "_d")).select(
        "segment", "ordinal", F.col("_d.doc_ids").alias("doc_id"), F.col("_d.n_words").cast("long").alias("n_words"))


def per_document(index: DataFrame, matches: DataFrame) -> DataFrame:
    """A row per indexed document with the sums over its matches."""
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    union = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["upto"]))).alias("n"),
                                F.greatest(acc["upto"], x["end"]).alias("upto")))
    per = matches.groupBy("segment", "ordinal").agg(
        union["n"].alias("_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    n_hit, items = F.coalesce("_hit", F.lit(0).cast("long")), F.coalesce("_items", F.array().cast("array<string>"))
    return documents_of(index).join(per, ["segment", "ordinal"], "left").select(
        "segment", "ordinal", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document (see the module docstring)."""
    index = build_index(docs)
    return per_document(index, store(search(index, items), "phrase-matches")).drop("segment", "ordinal")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) without any occurrence of an item's window.
    Rows are told apart by id and text; rows equal in both share their fate."""
    names = docs.columns
    key = F.xxhash64("doc_id", "text")
    index = build_index(docs.select(key.alias("doc_id"), "text"))
    hit = store(search(index, items), "phrase-matches").select(F.col("doc_id").alias("_pi_key")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_pi_row"), key.alias("_pi_key"))
    return rows.join(hit, "_pi_key", "left_anti").select(*(F.col(f"_pi_row.`{c}`").alias(c) for c in names))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), marks AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hit GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (rid) LEFT JOIN items USING (rid)
"""
