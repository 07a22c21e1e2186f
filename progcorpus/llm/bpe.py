"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text is cut at special tokens, then into pre-tokens by the vocabulary's
pattern; every pre-token starts as its bytes.  A segment tree holds the merge
rank of each adjacent pair, its root the lowest rank and, of equal ranks, the
leftmost place.  Merging there changes at most three leaves, each a logarithmic
update, until the root holds no mergeable pair.  Pre-tokens of similar length
are merged side by side: the trees of many pre-tokens are the rows of one
matrix and every step merges at the root of each row.  A pre-token is encoded
once per task (its ids are kept, in a dictionary of bounded size).

``encode(docs, vocabulary)`` takes any table with ``doc_id`` and ``text`` and
returns ``doc_id, ids array<int>``; ``decode`` turns ids back into text;
``encode_digest`` returns counts and digests instead of the arrays:

``doc_id, n_tokens, ids_sha256, decoded_sha256``

Nulls: a null text is an empty one (no ids, hashes of nothing); a null
``doc_id`` is passed through; ids outside the vocabulary decode to nothing, a
null array to an empty text.  Repeated rows give repeated rows, an empty table
no rows.  Whole texts are encoded; one pre-token may be as long as the text
(n log n).  Both jobs are one map step without a shuffle.  The vocabulary file
(a byte-level BPE in the format of the tokenizers library) is read by the
driver and broadcast; its size is fixed by the vocabulary (a few MB).
"""

from __future__ import annotations

import hashlib
import json
from collections import ChainMap

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.llm.common import share, ship, text_blocks

DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# fixed value: the byte-level pre-token pattern of the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << np.int64(62)      # the key of "no mergeable pair"
SIDE_BY_SIDE = 64                       # longest pre-token merged in a matrix
CACHE = 500_000                         # pre-tokens whose ids a task keeps, of at most SIDE_BY_SIDE bytes each
CACHE_BYTES = 128 << 20                 # what they may take, ids included (about)


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks, token bytes and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, model = byte_chars(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        ids = model["vocab"]
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in chars.items():
            self.byte_id[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank, self.pair_made = key[order], order.astype(np.int64), made[order]


class Encoder:
    """Encodes texts with a ``Vocabulary``; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v = vocabulary
        self.split = regex.compile(PATTERN).findall
        by_length = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.ranks = None
        self.cache: dict[str, list[int]] = {}
        self.held = 0           # bytes that the cache takes, about

    def pairs(self, left: np.ndarray, right: np.ndarray):
        """``(rank, merged id)`` of each pair; rank -1 where it can't merge."""
        v = self.v
        key = left << 32 | right
        at = np.minimum(np.searchsorted(v.pair_key, key), len(v.pair_key) - 1)
        ok = v.pair_key[at] == key
        return np.where(ok, v.pair_rank[at], -1), v.pair_made[at]

    def _matrix(self, words: list[bytes]) -> list[list[int]]:
        """Merge many short pre-tokens side by side; a row is a pre-token."""
        n, width = len(words), max(map(len, words))
        leaves = 1 << max(0, (width - 1).bit_length())
        lens = np.array([len(w) for w in words])
        ids = np.zeros((n, width + 1), dtype=np.int64)
        inside = np.arange(width + 1) < lens[:, None]
        ids[inside] = self.v.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        place = np.arange(width, dtype=np.int64)
        nxt = np.tile(np.arange(1, width + 2, dtype=np.int64), (n, 1))
        prv = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
        rank, made = self.pairs(ids[:, :-1], ids[:, 1:])
        key = np.where((rank >= 0) & inside[:, 1:], rank << 20 | place, NONE)
        tree[:, leaves:leaves + width] = key
        level = leaves
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        alive = inside
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            at = tree[rows, 1] & 0xFFFFF                  # leftmost place of the lowest rank
            mate = nxt[rows, at]
            ids[rows, at] = self.pairs(ids[rows, at], ids[rows, mate])[1]
            alive[rows, mate] = False
            after, before = nxt[rows, mate], prv[rows, at]
            nxt[rows, at] = after
            inner = after < lens[rows]
            prv[rows[inner], after[inner]] = at[inner]
            self._set(tree, leaves, rows, mate, np.full(len(rows), NONE))
            self._set(tree, leaves, rows, at, self._key(ids, rows, at, after, inner))
            left = before >= 0
            self._set(tree, leaves, rows[left], before[left],
                      self._key(ids, rows[left], before[left], at[left], np.True_))
            rows = rows[tree[rows, 1] < NONE]
        return [row[keep].tolist() for row, keep in zip(ids, alive)]

    def _key(self, ids, rows, at, mate, valid):
        rank, _ = self.pairs(ids[rows, at], ids[rows, np.where(valid, mate, at)])
        return np.where((rank >= 0) & valid, rank << 20 | at, NONE)

    @staticmethod
    def _set(tree, leaves, rows, at, key) -> None:
        """Point update: the leaf, then its ancestors."""
        node = leaves + at
        tree[rows, node] = key
        size = leaves
        while size > 1:
            node >>= 1
            size >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _single(self, word: bytes) -> list[int]:
        """The same for one long pre-token, with scalars."""
        if self.ranks is None:
            v = self.v
            self.ranks = {int(k): (int(r), int(m)) for k, r, m in zip(v.pair_key, v.pair_rank, v.pair_made)}
        ranks, n, none = self.ranks, len(word), int(NONE)
        ids = self.v.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        leaves = 1 << (n - 1).bit_length()
        tree = [none] * (2 * leaves)

        def key(a, b):
            got = ranks.get(ids[a] << 32 | ids[b])
            return none if got is None else got[0] << 40 | a

        for i in range(n - 1):
            tree[leaves + i] = key(i, i + 1)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at, value):
            node = leaves + at
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low

        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        while tree[1] < none:
            at = tree[1] & 0xFFFFFFFFFF
            mate = nxt[at]
            ids[at] = ranks[ids[at] << 32 | ids[mate]][1]
            alive[mate] = 0
            after, before = nxt[mate], prv[at]
            nxt[at] = after
            put(mate, none)
            if after < n:
                prv[after] = at
                put(at, key(at, after))
            else:
                put(at, none)
            if before >= 0:
                put(before, key(before, at))
        return [i for i, keep in zip(ids, alive) if keep]

    def _learn(self, fresh: list[str]) -> dict:
        """Encode pre-tokens not met yet, those of similar length together.  Returns the
        ids of the long ones, which are not kept."""
        by_width: dict[int, list[str]] = {}
        long = {}
        for w in fresh:
            size = len(w.encode())
            if size > SIDE_BY_SIDE:
                long[w] = self._single(w.encode())
            else:
                by_width.setdefault(max(2, 1 << (size - 1).bit_length()), []).append(w)
        for group in by_width.values():
            for i in range(0, len(group), 16384):
                part = group[i:i + 16384]
                ids = self._matrix([w.encode() for w in part])
                self.cache.update(zip(part, ids))
                self.held += sum(200 + len(w) + 8 * len(x) for w, x in zip(part, ids))
        return long

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        special = self.v.special
        parts = [self.special.split(t) if self.special else [t] for t in texts]
        cut = [[p if p in special else self.split(p) for p in ps] for ps in parts]
        met = set()
        for ps in cut:
            for p in ps:
                if not isinstance(p, str):
                    met.update(p)
        if len(self.cache) + len(met) > CACHE or self.held > CACHE_BYTES:
            self.cache, self.held = {}, 0
        long = self._learn([w for w in met if w not in self.cache])
        get, out = (ChainMap(long, self.cache) if long else self.cache).__getitem__, []
        for ps in cut:
            ids: list[int] = []
            for p in ps:
                if isinstance(p, str):
                    ids.append(special[p])
                else:
                    for piece in map(get, p):
                        ids += piece
            out.append(np.array(ids, dtype="<u4"))
        return out


def decode_ids(token_bytes: list[bytes], ids) -> str:
    """The text of a list of ids (bytes that are no UTF-8 become U+FFFD)."""
    size = len(token_bytes)
    return b"".join([token_bytes[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")


def _batches(vocabulary, make_columns, names):
    """An Arrow batch function over ``doc_id, text``."""
    def run(batches):
        import pyarrow as pa

        encoder = Encoder(vocabulary.value)
        for part in text_blocks(batches, 2 << 20):
            texts = [t or "" for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *make_columns(encoder, texts)], names=names)
    return run


def _digests(encoder: Encoder, texts: list[str]):
    import pyarrow as pa

    ids = encoder.encode(texts)
    sha = hashlib.sha256
    table = encoder.v.bytes
    return (pa.array([len(x) for x in ids], pa.int64()),
            pa.array([sha(x.tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([sha(decode_ids(table, x.tolist()).encode()).hexdigest() for x in ids], pa.string()))


def _everything(encoder: Encoder, texts: list[str]):
    import pyarrow as pa

    ids = encoder.encode(texts)
    back = [decode_ids(encoder.v.bytes, x.tolist()) for x in ids]
    return (pa.array([len(x) for x in ids], pa.int64()),
            pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
            pa.array([b == t for b, t in zip(back, texts)], pa.bool_()))


def _arrays(encoder: Encoder, texts: list[str]):
    import pyarrow as pa

    return (pa.array([x.astype(np.int32) for x in encoder.encode(texts)], pa.list_(pa.int32())),)


def _run(docs: DataFrame, path: str, make, names: list[str], schema: str) -> DataFrame:
    ship(__name__, "progcorpus.llm.common")
    vocabulary = share(docs.sparkSession, Vocabulary(path))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_batches(vocabulary, make, names), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text."""
    return _run(docs, path, _arrays, ["doc_id", "ids"], "doc_id long, ids array<int>")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text:
    encoded, the ids hashed as little-endian 32-bit integers, decoded again and
    the decoded text hashed."""
    return _run(docs, path, _digests, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], DIGEST_SCHEMA)


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip``: the ids, and whether they decode to the
    very text."""
    return _run(docs, path, _everything, ["doc_id", "n_tokens", "ids", "round_trip"],
                "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    ship(__name__, "progcorpus.llm.common")
    vocabulary = share(tokens.sparkSession, Vocabulary(path))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [decode_ids(vocabulary.value.bytes, [i for i in ids or () if i is not None])
                     for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
