"""Language-model scoring with a weighted backoff automaton.

The model has n-grams up to ``order`` words (3 by default), smoothed over one another:

* single words: ``(c(w) - D) / N`` for those seen, ``D V / N`` for all others together
  (``D`` from the counts of counts), so the mass of all V + 1 outcomes is 1;
* after a context ``h``: ``(c(hw) + MU P(w | h')) / (c(h) + MU)``, ``h'`` being ``h`` without
  its first word; this sums to 1 for every ``h``.

As an automaton: every context seen in training, of up to ``order - 1`` words, is a
state.  A seen n-gram ``hw`` is an arc of ``h`` with the weight above; it leads to the
longest state that ``hw`` ends with.  Each state has a failure arc of weight
``MU / (c(h) + MU)`` to the state ``h'``; the root has an arc for every word.  Reading a
text from left to right, a token takes the arc of the current state, or fails to
shorter contexts until there is one; the logarithms of the weights add up and the arc's
target is the state for the next token.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
lower-cased; each text ends with an end token and begins in a start state.

``score(docs)`` trains on rows with ``crc32(doc_id) mod 7 <> 2`` and returns

``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``

(log10 probabilities of whole texts; ``base_score`` is the add-one unigram model).

Nulls: a null text is an empty one (its end token alone); a null ``doc_id`` counts
as the empty text for the fold.  Repeated rows are trained on and scored each; an
empty table gives no rows; without training rows every token is unknown and
scores 0.  Other columns are ignored.

Scale: counts follow the input and never meet in one place.  Documents are
packed into blocks of text; a block sends its distinct n-grams (sorted hashes of 64 bits, of
two or more words 56, as differences, with counts) to hash-range shards, each shard adds the counts up and
answers every block with the totals of the block's own n-grams.  A block then holds
exactly the part of the automaton that its texts can touch.  A word that every document
has is one key per block, so no key is hot.  Blocks are stored once, compressed and
bucketed by their number, so only the answers travel to them; block and shard sizes
grow with the square root of the corpus (``plan_sizes``), which keeps a row of the exchange
at ``ROW_KEYS`` n-grams or more.  Only four numbers a shard (V, N and the counts of
counts) are added up, in Spark.  Inside a block the traversal runs over many stretches
of text side by side: a stretch starts ``order - 1`` tokens early, which is all that a
state can remember.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from progcorpus.llm.common import ship, store, text_blocks, utf8
from progcorpus.llm.textblocks import NONSPACE, chain, words
from progcorpus.session import materialize

FOLDS, HELD_OUT = 7, 2
ORDER = 3
BLOCK_BYTES = 4 << 20       # text of a block, at least
SHARD_BYTES = 8 << 20       # text of the corpus per shard of the counts, at least
ROW_KEYS = 256              # n-grams that a block sends to a shard, on average at least
TOKEN_BYTES = 6             # text per token (sizing only)
PIECE = 1 << 20             # text hashed at a time
STRETCH = 512               # tokens of a lane of the traversal
MU = 2000.0                 # weight of the shorter context in a state
END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A7757A7757A771)

SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")
_BLOCK = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, text binary, n_bytes long"
_KEYS = "shard int, block long, keys array<binary>, counts array<binary>"
_TOTALS = "block long, shard int, totals array<binary>, stats array<long>"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed (planes of zeros take no room)."""
    import pyarrow as pa

    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpack(raw: bytes) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(raw[:8], "little")
    planes = pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T.copy().view("<u8").reshape(-1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


def plan_sizes(total: int) -> tuple[int, int]:
    """Bytes of a block and of a shard for a corpus of ``total`` bytes: a row of the exchange
    holds about ``block * shard / (total * TOKEN_BYTES)`` n-grams."""
    even = math.sqrt(ROW_KEYS * TOKEN_BYTES * total / 2)
    return max(BLOCK_BYTES, int(even)), max(SHARD_BYTES, int(2 * even))


def _block_batches(block_bytes: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        size = 0

        def flush():
            ids, flags, texts = zip(*held)
            raw = b"".join(texts)
            return pa.RecordBatch.from_arrays([
                pa.array([task + number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([flags], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary()), pa.array([len(raw)], pa.int64())],
                names=[c.split()[0] for c in _BLOCK.split(", ")])

        for part in text_blocks(batches, block_bytes):
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2))):
                if held and size + len(row[2]) > block_bytes:
                    yield flush()
                    held, size, number = [], 0, number + 1
                held.append(row)
                size += len(row[2])
        if held:
            yield flush()
    return run


class Block:
    """The token stream of a block, a start token before and an end token after every text.

    ``grams[k - 1]``: sorted hashes (of longer n-grams 56 bits) of the distinct n-grams of ``k`` tokens; ``number[k - 1]``:
    at each place of the stream the n-gram that ends there (-1: it would begin before the
    text, or the place holds a start token); ``last[k - 1]``: a place where each ends."""

    def __init__(self, sizes, text: bytes, n_bytes: int, order: int):
        import pyarrow as pa

        raw = pa.decompress(text, decompressed_size=n_bytes, codec="zstd", asbytes=True) if n_bytes else b""
        at = np.cumsum([0, *sizes])
        texts = [raw[a:b] for a, b in zip(at, at[1:])]
        hashes, owner, i = [], [], 0
        while i < len(texts):               # a piece of the block at a time
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= PIECE):
                size += len(texts[j])
                j += 1
            h, doc, _, _ = words(texts[i:j], NONSPACE)
            hashes.append(np.concatenate([np.full(j - i, START), h, np.full(j - i, END)]))
            owner.append(np.concatenate([np.arange(j - i), doc, np.arange(j - i)]) + i)
            i = j
        tokens, doc = np.concatenate(hashes), np.concatenate(owner)
        turn = np.argsort(doc, kind="stable")       # start tokens lead their text's words, end tokens follow
        tokens, self.doc = tokens[turn], doc[turn].astype(np.int32)
        del raw, texts, hashes, owner, doc, turn
        self.begins = np.r_[True, self.doc[1:] != self.doc[:-1]]
        self.grams, self.number, self.last = [], [], []
        for k in range(1, order + 1):
            runs = tokens if k == 1 else chain(tokens, k)
            end = np.arange(k - 1, len(tokens))
            inside = (self.doc[end] == self.doc[:len(end)]) & ~self.begins[end]
            keys, place = runs[inside], end[inside].astype(np.int32)
            if k > 1:
                keys &= ~np.uint64(0xFF)
            values, first, which = np.unique(keys, return_index=True, return_inverse=True)
            del keys, runs, end
            number = np.full(len(tokens), -1, dtype=np.int32)
            number[place] = which
            self.grams.append(values)
            self.number.append(number)
            self.last.append(place[first])

    def counts(self, flags) -> list[np.ndarray]:
        """Training occurrences of each distinct n-gram."""
        training = ~np.array(flags, dtype=bool)[self.doc]
        return [np.bincount(n[(n >= 0) & training], minlength=len(g)) for n, g in zip(self.number, self.grams)]


def _key_batches(bits: int, order: int):
    """Distinct n-grams of each block with their training counts, by shard."""
    def run(batches):
        import pyarrow as pa

        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
        for batch in batches:
            for r in range(batch.num_rows):
                block_id, _, flags, sizes, text, n_bytes = (batch.column(i)[r].as_py() for i in range(6))
                block = Block(sizes, text, n_bytes, order)
                sides = list(zip(block.grams, block.counts(flags)))
                cuts = [np.concatenate([[0], np.searchsorted(g, edges), [len(g)]]) for g, _ in sides]
                del block
                for s in range(1 << bits):
                    if not any(c[s] < c[s + 1] for c in cuts):
                        continue
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s], pa.int32()), pa.array([block_id], pa.int64()),
                        pa.array([[_pack_sorted(g[c[s]:c[s + 1]]) for (g, _), c in zip(sides, cuts)]], pa.list_(pa.binary())),
                        pa.array([[_pack(n[c[s]:c[s + 1]]) for (_, n), c in zip(sides, cuts)]], pa.list_(pa.binary()))],
                        names=[c.split()[0] for c in _KEYS.split(", ")])
    return run


def _add_up(keys: list[bytes], counts: list[bytes]):
    """Totals of every block's keys (packed, in the blocks' order) and all totals."""
    keys = [_unpack_sorted(k) for k in keys]
    where = np.cumsum([0, *map(len, keys)])
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    totals = np.bincount(number, np.concatenate([_unpack(c) for c in counts])).astype(np.int64)
    return [_pack(totals[number[a:b]]) for a, b in zip(where, where[1:])], totals


def _shard_totals(table):
    """A shard: each block's totals, and a row of block -1 with N, V, n1, n2."""
    import pyarrow as pa

    shard, blocks = table.column("shard")[0].as_py(), table.column("block").to_pylist()
    keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
    out, stats = [], []
    for k in range(len(keys[0])):
        rows, totals = _add_up([x[k] for x in keys], [x[k] for x in counts])
        out.append(rows)
        if not k:
            stats = [int(x) for x in (totals.sum(), (totals > 0).sum(), (totals == 1).sum(), (totals == 2).sum())]
    return pa.table({
        "block": pa.array([*blocks, -1], pa.int64()), "shard": pa.array([shard] * (len(blocks) + 1), pa.int32()),
        "totals": pa.array([*map(list, zip(*out)), None], pa.list_(pa.binary())),
        "stats": pa.array([*[None] * len(blocks), stats], pa.list_(pa.int64()))})


class BackoffAutomaton:
    """The part of the automaton that a block's texts can touch.

    States are numbered: the root 0, the start state 1, then the n-grams of the block by
    length (those never seen in training are no state: no arc leads to them).  ``fail`` and
    ``fail_weight`` give each state's failure arc; ``weight[k - 1]`` and ``target[k - 1]`` those
    arcs that read an n-gram of ``k`` tokens, where ``seen[k - 1]``."""

    ROOT, BEGIN = 0, 1

    def __init__(self, block: Block, totals: list[np.ndarray], stats, mu: float = MU):
        self.block, self.order = block, len(totals)
        n, v, n1, n2 = stats
        discount = (n1 + 1) / (n1 + 2 * n2 + 2)
        words = totals[0]
        root = np.where(words > 0, words - discount, discount * v) / n if n else np.ones(len(words))
        self.base = np.log10((words + 1.0) / (n + (v + 1)))
        end = block.number[0][-1]
        texts = int(words[end])                         # training texts: the count of the end token
        offset = np.cumsum([2, *(len(t) for t in totals)]).astype(np.int32)
        context, fail = [np.array([0, texts])], [np.zeros(2, dtype=np.int32)]
        self.seen, self.weight, self.target = [np.ones(len(words), dtype=bool)], [np.log10(root)], []
        p = root
        for k in range(1, self.order + 1):
            total, last = totals[k - 1], block.last[k - 1]
            if k > 1:
                shorter, before = block.number[k - 2], totals[k - 2]
                ends_with, begins_with = shorter[last], shorter[last - 1]
                # an n-gram of two may begin with the start token
                c = np.where(begins_with < 0, texts, before[begins_with]) if len(before) else np.full(len(last), texts)
                p = (total + mu * p[ends_with]) / (c + mu)
                self.seen.append(total > 0)
                self.weight.append(np.log10(p))
                suffix = (offset[k - 2] + ends_with).astype(np.int32)
            else:
                suffix = np.zeros(len(last), dtype=np.int32)
            own = offset[k - 1] + np.arange(len(last), dtype=np.int32) if k < self.order else suffix
            self.target.append(np.where((total > 0) & (block.number[0][last] != end), own, self.ROOT))
            if k < self.order:
                context.append(total)
                fail.append(suffix)
        self.fail = np.concatenate(fail)
        self.fail_weight = np.log10(mu / (np.concatenate(context) + mu))
        self.depth = np.repeat(np.array([0, 1, *range(1, self.order)], np.int8), [1, 1, *(len(t) for t in totals[:-1])])

    def step(self, state: np.ndarray, place: np.ndarray):
        """Read the token at each ``place``: ``(next state, log10 weight)``."""
        state, weight = state.copy(), np.zeros(len(state))
        out = np.empty(len(state), dtype=np.int64)
        depth = self.depth[state]
        for m in range(self.order - 1, -1, -1):         # states of m tokens, from the longest
            at = np.flatnonzero(depth == m)
            if not len(at):
                continue
            gram = self.block.number[m][place[at]]
            arc = self.seen[m][gram]
            go, stay = at[arc], at[~arc]
            weight[go] += self.weight[m][gram[arc]]
            out[go] = self.target[m][gram[arc]]
            weight[stay] += self.fail_weight[state[stay]]
            state[stay] = self.fail[state[stay]]
            depth[stay] = self.depth[state[stay]]
        return out, weight

    def traverse(self) -> np.ndarray:
        """The log10 weight of every text: lanes of ``STRETCH`` tokens, read side by side from
        left to right, each carrying its state."""
        begins = np.flatnonzero(self.block.begins)
        n = len(begins)
        size = np.diff(np.append(begins, len(self.block.doc))) - 1          # tokens after the start token
        lanes = -(-size // STRETCH)
        text = np.repeat(np.arange(n), lanes)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = begins[text] + 1 + number * STRETCH
        end = np.minimum(first + STRETCH, begins[text] + 1 + size[text])
        place = np.maximum(begins[text] + 1, first - (self.order - 1))       # read early what a state remembers
        whole = place == begins[text] + 1
        state = np.where(whole & (self.order > 1), self.BEGIN, self.ROOT)
        score = np.zeros(len(text))
        live = np.arange(len(text))
        while len(live):
            state[live], weight = self.step(state[live], place[live])
            score[live] += np.where(place[live] >= first[live], weight, 0.0)
            place[live] += 1
            live = live[place[live] < end[live]]
        return np.bincount(text, score, minlength=n)


def _score_block(stats, order: int):
    def run(key, left, right):
        import pyarrow as pa

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        _, ids, flags, sizes, text, n_bytes = (left.column(i)[0].as_py() for i in range(6))
        block = Block(sizes, text, n_bytes, order)
        turn = np.argsort(right.column("shard").to_numpy())
        answers = right.column("totals").take(turn).to_pylist()
        totals = [np.concatenate([_unpack(a[k]) for a in answers]).astype(np.int64) for k in range(order)]
        del answers
        block.grams.clear()
        model = BackoffAutomaton(block, totals, stats)
        word = block.number[0]
        place = np.flatnonzero(word >= 0)
        word, doc, n = word[place], block.doc[place], len(ids)
        cols = [ids, flags, np.bincount(doc, minlength=n), np.bincount(doc, totals[0][word] > 0, minlength=n).astype(np.int64),
                np.full(n, stats[0]), np.bincount(doc, model.base[word], minlength=n), model.traverse()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)
    return run


def score(docs: DataFrame, order: int = ORDER, block_bytes: int | None = None, shard_bytes: int | None = None) -> DataFrame:
    """One row per document (see the module docstring)."""
    if order < 1:
        raise ValueError(f"no model of order {order}")
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sizes = plan_sizes(size)
    block_bytes, shard_bytes = block_bytes or sizes[0], shard_bytes or sizes[1]
    bits = max(0, math.ceil(math.log2(max(1, size / shard_bytes))))
    buckets = min(100_000, max(1, -(-size // max(4 * BLOCK_BYTES, block_bytes))))
    blocks = materialize(rows.mapInArrow(_block_batches(block_bytes), _BLOCK), key="block", num_buckets=buckets)
    keys = blocks.mapInArrow(_key_batches(bits, order), _KEYS)
    totals = store(keys.groupBy("shard").applyInArrow(_shard_totals, _TOTALS), "lm-totals")
    sums = totals.where(F.col("block") == -1).agg(*(F.sum(F.get("stats", F.lit(i))) for i in range(4))).first()
    stats = [int(x or 0) for x in sums]
    answers = totals.where(F.col("block") >= 0).select("block", "shard", "totals")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block(stats, order), SCHEMA)
