"""Spelling variants grouped by k-d trees over letter-count vectors.

Two words are *near* if one edit (a code point inserted, deleted or replaced) turns one
into the other.  A word's *form* is its near word of largest count ``n`` (ties: the
smallest in code-point order) if that is at least ``ratio`` times the word's own
count; its *root* is what following forms ends at (the word itself without a form).

``group_variants(vocabulary)`` takes ``word, n`` (distinct words) and returns

``word, form, root, n, n_near, form_n``

``count_words(docs)`` makes the vocabulary: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``
with A-Z lower-cased, of at least ``least_length`` code points and ``least_count``
occurrences in all texts.  ``slips=m`` deletes a code point from the occurrences whose
``h = crc32("<doc_id>:<run>")`` is a multiple of ``m`` (the one at ``h % length``).

An edit changes a word's vector of letter counts by one step up and one down (same
length) or one step up (one letter more), so by an L1 distance of two at most:

1. Words are dealt to cells, the leaves of a k-d tree per length whose cuts are fitted
   on a bounded sample (``SAMPLE`` words; the cuts only balance the cells).  Every word
   lies in one cell of its length and is sent as a query to all cells of its own and the
   next length whose box is within reach: at most one step up and one down.
2. In a cell a k-d tree over its words answers the queries by range search with the
   same box pruning; words at a squared distance of 2 (same length) or 1 are left.
3. These are verified letter by letter.  A cell returns, per word, the number of near
   words found there and the best of them, so no pairs leave it.
4. Roots come from pointer doubling over the forms; a form has at least ``ratio`` times the
   count, so chains are short.

Nulls: a null text has no words; a null ``doc_id`` counts as the empty text in the
hash.  Repeated rows are counted each.  An empty table gives no rows.  Other columns
are ignored.  A run of any length is a word; texts are read whole.

Scale: occurrences are counted in the tasks and aggregated before the shuffle, so a
frequent word is one row per task.  Cells hold at most about ``CELL`` words or
``CELL_BYTES``; one that turns out four times as large (words of equal vectors cannot be
cut apart) is split into chunks, and its queries go to every chunk.  The driver holds
the cuts and the sample, one cut per cell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.llm.common import share, ship, store, text_blocks, utf8
from progcorpus.llm.textblocks import LOWER

LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5               # times a word's count that its form has, at least
CELL = 4096             # words of a cell
CELL_BYTES = 32 << 20   # bytes of their vectors and letters
LEAF = 48               # words of a leaf of the tree inside a cell
SAMPLE = 200_000        # words the cells' cuts are fitted on, at most about
HELD = 200_000          # distinct words counted in a task before they are passed on
HELD_BYTES = 16 << 20
LETTERS = 26 + 64       # a-z and U+00C0 to U+00FF

_RUN = re.compile("[a-zÀ-ÿ]+")
_DIM = np.zeros(256, dtype=np.int64)
_DIM[97:123] = np.arange(26)
_DIM[0xC0:] = np.arange(26, LETTERS)
POINT, SAME, SHORTER = 0, 1, 2      # kinds of rows sent to a cell


# -- the vocabulary ---------------------------------------------------------------

def _occurrences(raw: bytes, doc_id, slips: int | None, least_length: int, total: Counter) -> int:
    """Add the words of a text; returns the code points added."""
    text = raw.translate(LOWER.tobytes()).decode()
    found = Counter(_RUN.findall(text) if len(raw) < 4 << 20 else (m.group() for m in _RUN.finditer(text)))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    size = 0
    for run, n in found.items():
        if len(run) < least_length:
            continue
        if slips:
            h = zlib.crc32(run.encode(), start)
            if not h % slips:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < least_length:
                    continue
        total[run] += n
        size += len(run)
    return size


def _word_batches(slips, least_length):
    def run(batches):
        import pyarrow as pa

        def passed(total):
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                              names=["word", "n"])

        total, size = Counter(), 0
        for part in text_blocks(batches, 1 << 20):
            for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                size += _occurrences(text, doc_id, slips, least_length, total)
                if len(total) > HELD or size > HELD_BYTES and sum(map(len, total)) > HELD_BYTES:
                    yield passed(total)
                    total, size = Counter(), 0
                elif size > HELD_BYTES:
                    size = 0
        if total:
            yield passed(total)
    return run


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                slips: int | None = None) -> DataFrame:
    """``word, n`` of all texts (see the module docstring)."""
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_word_batches(slips, least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- letter counts and trees --------------------------------------------------------

def letters(words: list[bytes], length: int) -> np.ndarray:
    """Words of one length (Latin-1) as a matrix of codes."""
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), length)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts of every row."""
    n = len(codes)
    at = _DIM[codes] + np.arange(n)[:, None] * LETTERS
    return np.bincount(at.reshape(-1), minlength=n * LETTERS).reshape(n, LETTERS).astype(np.int32)


@dataclass
class KdTree:
    """Cuts ``(dim, cut, left, right)``: vectors with ``v[dim] <= cut`` are on the left.
    A child below zero is the leaf ``-1 - child``; ``leaves`` holds the rows of each
    leaf of the vectors that the tree was built from."""
    cuts: list[tuple[int, int, int, int]]
    leaves: list[np.ndarray] = field(repr=False)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> KdTree:
        cuts, leaves = [], []

        def grow(rows):
            split = _best_cut(points[rows]) if len(rows) > leaf else None
            if split is None:
                leaves.append(rows)
                return -len(leaves)
            dim, cut = split
            me = len(cuts)
            cuts.append(None)
            left = points[rows, dim] <= cut
            cuts[me] = (dim, cut, grow(rows[left]), grow(rows[~left]))
            return me

        grow(np.arange(len(points)))
        return cls(cuts, leaves)

    def reach(self, queries: np.ndarray, up: int, down: int):
        """``(leaf, rows)``: the queries from which a leaf's box can be reached in at most
        ``up`` steps up and ``down`` steps down."""
        rows, zero = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int32)
        low, high = np.zeros(LETTERS, np.int64), np.full(LETTERS, np.iinfo(np.int32).max, np.int64)
        stack = [(0 if self.cuts else -1, rows, zero, zero, low, high)]
        while stack:
            node, rows, ups, downs, low, high = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            dim, cut, left, right = self.cuts[node]
            value = queries[rows, dim]
            more = downs - np.maximum(0, value - high[dim]) + np.maximum(0, value - cut)
            keep = more <= down
            box = high.copy()
            box[dim] = cut
            stack.append((left, rows[keep], ups[keep], more[keep], low, box))
            more = ups - np.maximum(0, low[dim] - value) + np.maximum(0, cut + 1 - value)
            keep = more <= up
            box = low.copy()
            box[dim] = cut + 1
            stack.append((right, rows[keep], more[keep], downs[keep], box, high))


def _best_cut(points: np.ndarray):
    """The cut that halves the points best; None if all are equal."""
    middle = np.sort(points, axis=0)[(len(points) - 1) // 2]
    best = None
    for cut in (middle, middle - 1):
        off = np.abs((points <= cut).mean(axis=0) - 0.5)
        dim = int(np.argmin(off))
        if off[dim] < 0.5 and (best is None or off[dim] < best[0]):
            best = (off[dim], dim, int(cut[dim]))
    return None if best is None else best[1:]


# -- cells --------------------------------------------------------------------------

def capacity(length: int) -> int:
    return max(1, min(CELL, CELL_BYTES // (4 * LETTERS + length)))


def fit_cells(vocabulary: DataFrame, sample: int = SAMPLE) -> dict[int, KdTree]:
    """A tree for each length with more words than a cell takes; its leaves are the cells."""
    size = F.char_length("word")
    room = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(CELL_BYTES) / (size + 4 * LETTERS))))
    large = {r.length: r.n for r in vocabulary.groupBy(size.alias("length"), room.alias("room")).agg(
        F.count("*").alias("n")).where(F.col("n") > F.col("room")).collect()}
    if not large:
        return {}
    share = min(1.0, sample / sum(large.values()))
    chosen = vocabulary.where(size.isin(list(large)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
    drawn: dict[int, list[bytes]] = {}
    for w in chosen.select("word").toArrow().column(0).to_pylist():
        drawn.setdefault(len(w), []).append(w.encode("latin-1"))
    trees = {}
    for length, n in large.items():
        words = drawn.get(length, [])
        if words:
            cells = -(-2 * n // capacity(length))
            tree = KdTree.build(vectors(letters(sorted(words), length)), -(-len(words) // cells))
            trees[length] = KdTree(tree.cuts, [])
    return trees


def _by_length(words: list[bytes]):
    """``(length, rows, codes)`` of the words of each length, in slices of bounded size."""
    size = np.array([len(w) for w in words])
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        step = max(1, (8 << 20) // (4 * LETTERS + length))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            yield length, some, letters([words[i] for i in some], length)


def _cell_batches(shared):
    """``length, cell`` of every word."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for length, rows, codes in _by_length(words):
                cell = np.zeros(len(rows), dtype=np.int32)
                if length in shared.value:
                    for leaf, at in shared.value[length].reach(vectors(codes), 0, 0):
                        cell[at] = leaf
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), length, np.int32)), pa.array(cell)],
                                                 names=["length", "cell"])
    return run


_SENT = "length int, cell int, chunk int, kind int, word string, n long"


def _send_batches(shared, split):
    """Every word as a point of its cell and as a query of all cells in reach."""
    def run(batches):
        import pyarrow as pa

        def sent(length, cell, chunk, kind, words, counts):
            k = len(words)
            return pa.RecordBatch.from_arrays([
                *(pa.array(np.full(k, x, np.int32)) for x in (length, cell)), pa.array(chunk.astype(np.int32)),
                pa.array(np.full(k, kind, np.int32)), words, counts], names=[c.split()[0] for c in _SENT.split(", ")])

        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for length, rows, codes in _by_length(words):
                v = vectors(codes)
                for kind, size, up, down in ((POINT, length, 0, 0), (SAME, length, 1, 1), (SHORTER, length + 1, 1, 0)):
                    tree = shared.value.get(size)
                    for cell, at in tree.reach(v, up, down) if tree else [(0, np.arange(len(rows)))]:
                        chunks = split.get((size, cell), 1)
                        here = [words[i] for i in rows[at]]
                        take = pa.array(rows[at])
                        text, count = batch.column(0).take(take), batch.column(1).take(take)
                        if kind == POINT:
                            chunk = np.array([zlib.crc32(w) % chunks for w in here])
                            yield sent(size, cell, chunk, kind, text, count)
                        else:
                            for c in range(chunks):
                                yield sent(size, cell, np.full(len(here), c), kind, text, count)
    return run


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` become those of ``b`` (as long, or one longer) by one edit."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    first = np.where((ahead := a != b[:, :length]).any(axis=1), ahead.argmax(axis=1), length)
    behind = a != b[:, 1:]
    last = np.where(behind.any(axis=1), length - 1 - behind[:, ::-1].argmax(axis=1), -1)
    return last < first


class Cell:
    """The words of a cell (of one length) in a tree, and what was found near them."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.words, self.counts = words, counts
        self.length = len(words[0])
        self.codes = letters(words, self.length)
        v = vectors(self.codes)
        self.tree = KdTree.build(v, LEAF)
        self.points = [v[rows].astype(np.float64) for rows in self.tree.leaves]
        self.squares = [(p * p).sum(axis=1) for p in self.points]
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.rank = np.empty(len(words), dtype=np.int64)
        self.rank[order] = np.arange(len(words))
        self.by_rank = np.array(order)
        self.near: dict[int, list] = {}         # point: number and best of the shorter words near it

    def pairs(self, codes: np.ndarray):
        """``(queries, points)`` one edit apart, leaf by leaf."""
        queries = vectors(codes)
        same = codes.shape[1] == self.length
        step = max(1, (4 << 20) // self.length)
        for leaf, rows in self.tree.reach(queries, 1, 1 if same else 0):
            q = queries[rows].astype(np.float64)
            apart = (q * q).sum(axis=1)[:, None] + self.squares[leaf][None, :] - 2 * (q @ self.points[leaf].T)
            i, j = np.nonzero(apart == (2 if same else 1))
            i, j = rows[i], self.tree.leaves[leaf][j]
            for at in range(0, len(i), step):
                a, b = i[at:at + step], j[at:at + step]
                ok = one_edit(codes[a], self.codes[b])
                yield a[ok], b[ok]

    def answer(self, words: list[bytes], counts: np.ndarray):
        """``(query, number near, best point)`` of the queries with near words; keeps the
        reverse side of queries that are a letter shorter."""
        codes = letters(words, len(words[0]))
        number, best = np.zeros(len(words), np.int64), np.full(len(words), len(self.words), np.int64)
        shorter, found = len(words[0]) < self.length, []
        for i, j in self.pairs(codes):
            np.add.at(number, i, 1)
            np.minimum.at(best, i, self.rank[j])
            if shorter:
                found.append((i, j))
        for i, j in found:
            for a, b in zip(i.tolist(), j.tolist()):
                have = self.near.setdefault(b, [0, (0, b"")])
                have[0] += 1
                have[1] = min(have[1], (-int(counts[a]), words[a])) if have[0] > 1 else (-int(counts[a]), words[a])
        at = np.flatnonzero(number)
        return at, number[at], self.by_rank[best[at]]


_FOUND = "word string, n_near long, best_n long, best string"


def _search_batches(batches):
    """``word, n_near, best_n, best`` per cell and word, from rows sorted by cell and kind."""
    import pyarrow as pa

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
            pa.string(), pa.int64(), pa.int64(), pa.string()))], names=[c.split()[0] for c in _FOUND.split(", ")])

    def reverse():
        if cell is not None and cell.near:
            yield out([(cell.words[p].decode("latin-1"), k, -n, w.decode("latin-1")) for p, (k, (n, w)) in cell.near.items()])

    key, cell, words, counts = None, None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(4)]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            length, _, _, kind = (int(c[a]) for c in cols)
            if key != (this := tuple(int(c[a]) for c in cols[:3])):
                yield from reverse()
                key, cell, words, counts = this, None, [], []
            here = [w.encode("latin-1") for w in batch.column(4).slice(a, b - a).to_pylist()]
            n = batch.column(5).slice(a, b - a).to_numpy()
            if kind == POINT:
                words += here
                counts.append(n)
                continue
            if not words:
                continue
            if cell is None:
                cell = Cell(words, np.concatenate(counts))
            step = max(1, (8 << 20) // (4 * LETTERS + length))
            for at in range(0, len(here), step):
                some = here[at:at + step]
                rows = [(some[q].decode("latin-1"), int(k), int(cell.counts[p]), cell.words[p].decode("latin-1"))
                        for q, k, p in zip(*cell.answer(some, n[at:at + step]))]
                if rows:
                    yield out(rows)
    yield from reverse()


def near_words(vocabulary: DataFrame, trees: dict[int, KdTree] | None = None) -> DataFrame:
    """``word, n_near, best_n, best``: the number of near words and the best of them;
    words without near words have no row."""
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    trees = fit_cells(vocabulary) if trees is None else trees
    shared = share(vocabulary.sparkSession, trees)
    words = vocabulary.select("word", "n")
    room = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(CELL_BYTES) / (F.col("length") + 4 * LETTERS))))
    full = words.mapInArrow(_cell_batches(shared), "length int, cell int").groupBy("length", "cell").agg(
        F.count("*").alias("n")).where(F.col("n") > 4 * room).collect() if trees else []
    split = {(r.length, r.cell): -(-r.n // (2 * capacity(r.length))) for r in full}
    sent = words.mapInArrow(_send_batches(shared, split), _SENT)
    found = (sent.repartition("length", "cell", "chunk").sortWithinPartitions("length", "cell", "chunk", "kind")
             .mapInArrow(_search_batches, _FOUND))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                      F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b"))
            .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form`` (no cycles) by pointer doubling."""
    now = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        far = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        then = store(now.join(far, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "spelling-roots")
        moved = then.where("_moved").limit(1).count()
        now = then.select("word", "root")
        if not moved:
            return now


def group_variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word (see the module docstring)."""
    words = store(vocabulary.select("word", "n"), "spelling-words")
    near = near_words(words)
    kept = (F.col("best_n") >= ratio * F.col("n"))
    table = store(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(kept, F.col("best")).alias("form"), F.when(kept, F.col("best_n")).alias("form_n")), "spelling-forms")
    root = roots(table.where(F.col("form").isNotNull()).select("word", "form"))
    return table.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
