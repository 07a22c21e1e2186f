"""Toxicity by multiple-instance learning: sentences are scored, documents labelled.

A document is a bag of sentences.  Each sentence has a logistic score from its
words, and the document's score is their noisy-or, ``1 - prod(1 - p)``: one
offending sentence is enough, harmless ones change nothing.  Only documents have
labels; the sentence weights follow from the likelihood of the labels.

``fit(docs, labels)`` learns from the labelled rows whose ``crc32(doc_id) mod 5``
is not 0, a sample of at most about ``SAMPLE`` of them (chosen by a hash of the
id; ``sample`` is the documented bound of the classifier).  Features are hashed
words and word beginnings of 4, 5 and 6 bytes with A-Z lower-cased; those that
tell the classes apart best get a weight.  ``score(docs, model)`` scores whole
texts and names the sentences that offend:

``doc_id, held_out, score, predicted, offending``

``offending`` lists ``start:end`` (code points) of the sentences whose own score is
at least 0.5, comma-joined.  Only ``text`` enters a score.

Nulls: a null or wordless text scores 0; a null ``doc_id`` counts as the empty text
for the fold (held out); labels without an id or value are ignored, and of several
labels of one id the largest counts; of several texts of one id
the one with the least MD5 is learned from.  With labels of a single class, or none, every
document with words gets the share of class 1 (0 without labels).  Repeated rows are
scored each; an empty table gives no rows.  Other columns are ignored.

Scale: scoring is one map step with the weights broadcast (at most ``FEATURES``).
The labels of the sample are broadcast (bounded by ``SAMPLE``), so only the sample's
texts are shuffled, one per id.  The sample's bags are a stored table; every step of the
fit is a job over it, whose tasks send back one gradient per block of bags, and the
driver holds nothing but the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from progcorpus.llm.common import share, ship, store, text_blocks, utf8
from progcorpus.llm.textblocks import ALNUM, mix, words

SAMPLE = 16_000         # labelled documents the classifier is fitted on, at most about
FEATURES = 4_096        # features with a weight, at most
MIN_DOCS = 3            # toxic documents of the sample that a feature occurs in, at least
PREFIXES = (4, 5, 6)    # bytes of the word beginnings used as features
FOLDS = 5
DECAY = 1e-4            # of the weights' squares, halved
STEPS, MEMORY, FLAT = 100, 10, 1e-6     # of the quasi-Newton climb; the gradient it ends at

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, offending string"
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    """Sorted feature hashes with their weights, the bias, and the share of
    class 1 (the score where nothing could be learned)."""
    features: np.ndarray
    weights: np.ndarray
    bias: float
    share: float | None = None


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def sentences(texts: list[bytes]):
    """Word hashes (whole words and beginnings, a row each) with the sentence
    and document of every word, and the sentences' byte spans in the block."""
    hashes, doc, starts, ends = words(texts, ALNUM)
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    mark = np.cumsum(_BREAK[buf])[starts] + doc          # one step per break and per document
    new = np.r_[True, mark[1:] != mark[:-1]] if len(mark) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    kinds = [hashes, *(_beginnings(buf, starts, ends, k) for k in PREFIXES)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return np.stack(kinds), number, doc, doc[first], starts[first], ends[last]


def _beginnings(buf, starts, ends, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes of each word (all of a shorter one)."""
    value = np.zeros(len(starts), dtype=np.uint64)
    last = len(buf) - 1
    for i in range(size):
        byte = buf[np.minimum(starts + i, last)]
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint64)
        value = value << np.uint64(8) | np.where(starts + i < ends, byte, 0)
    return mix(value ^ np.uint64(size << 56))


class _Lookup:
    """Feature number of hashes that have one (a small table rules most out)."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[features & np.uint64((1 << 20) - 1)] = True

    def __call__(self, hashes: np.ndarray):
        """``(positions, feature numbers)`` of the hits in a flat array."""
        at = np.flatnonzero(self.table[hashes & np.uint64((1 << 20) - 1)])
        if not len(at):
            return at, at
        number = np.minimum(np.searchsorted(self.features, hashes[at]), len(self.features) - 1)
        ok = self.features[number] == hashes[at]
        return at[ok], number[ok]


def _pairs(texts: list[bytes], lookup: _Lookup):
    """Distinct ``(sentence, feature)`` of a block, with the sentences' documents and spans."""
    kinds, number, _, owner, start, end = sentences(texts)
    found = [lookup(row) for row in kinds]
    sentence = np.concatenate([number[at] for at, _ in found])
    feature = np.concatenate([f for _, f in found])
    key = np.unique(sentence.astype(np.int64) << 32 | feature)
    return key >> 32, key & 0xFFFFFFFF, owner, start, end


def _feature_batches(batches):
    """Documents of each class per feature of a block: ``feature, pos, neg``."""
    import pyarrow as pa

    for part in text_blocks(batches, 1 << 20):
        toxic = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
        kinds, _, doc, *_ = sentences(utf8(part.column(0)))
        features, docs = kinds.reshape(-1), np.tile(doc, len(kinds))
        order = np.lexsort((docs, features))
        features, docs = features[order], docs[order]
        once = np.r_[True, (features[1:] != features[:-1]) | (docs[1:] != docs[:-1])][:len(features)]
        features, y = features[once], toxic[docs[once]]
        values, where = np.unique(features, return_inverse=True)
        pos = np.bincount(where[y], minlength=len(values))
        neg = np.bincount(where[~y], minlength=len(values))
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(pos, pa.int64()),
                                          pa.array(neg, pa.int64())], names=["feature", "pos", "neg"])


_BAGS = "first long, toxic binary, n binary, doc binary, sentence binary, feature binary"


def _bag_batches(wanted):
    """The bags of a batch, packed: class and sentences of every document, and the
    ``(document, sentence, feature)`` triples."""
    def run(batches):
        import pyarrow as pa

        lookup = _Lookup(wanted.value)
        for part in text_blocks(batches, 1 << 20):
            sentence, feature, owner, _, _ = _pairs(utf8(part.column(0)), lookup)
            toxic = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            arrays = (toxic, np.bincount(owner, minlength=part.num_rows), owner[sentence], sentence, feature)
            packed = [a.astype(bool if a is toxic else np.int32).tobytes() for a in arrays]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column(2)[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)],
                names=[c.split()[0] for c in _BAGS.split(", ")])
    return run


def bag_likelihood(toxic, n, doc, sentence, feature, x, weight):
    """The weighted log-likelihood of a block of bags and its gradient; ``x`` holds the
    weights and, last, the bias; ``weight`` those of the classes 0 and 1."""
    w, bias = x[:-1], x[-1]
    _, row = np.unique(sentence, return_inverse=True)                  # rows: sentences with features
    n_rows = int(row.max()) + 1 if len(row) else 0
    row_doc = np.zeros(n_rows, dtype=np.int64)
    row_doc[row] = doc
    plain = n - np.bincount(row_doc, minlength=len(toxic))
    z = bias + np.bincount(row, w[feature], minlength=n_rows)
    p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
    q = np.bincount(row_doc, -np.logaddexp(0, z), minlength=len(toxic)) - plain * np.logaddexp(0, bias)
    q = np.minimum(q, -1e-12)                                           # log of (1 - score)
    counts = np.asarray(weight, dtype=np.float64)[toxic.astype(np.int64)]
    value = (counts * np.where(toxic, np.log(-np.expm1(q)), q)).sum()
    slope = np.where(toxic, np.exp(q) / np.expm1(q), 1.0) * counts      # d likelihood / d q
    g_row = -slope[row_doc] * p
    return value, np.append(np.bincount(feature, g_row[row], minlength=len(w)), g_row.sum() - (slope * plain).sum() * p0)


def _gradient_batches(x, weight):
    """Per row of ``_BAGS`` its likelihood and gradient at ``x``."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                first, toxic, *rest = (c[r].as_py() for c in batch.columns)
                arrays = [np.frombuffer(b, dtype=np.int32) for b in rest]
                value, slope = bag_likelihood(np.frombuffer(toxic, dtype=bool), *arrays, x, weight)
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([value], pa.float64()),
                                                  pa.array([slope.tobytes()], pa.binary())], names=["first", "value", "slope"])
    return run


def climb(evaluate, x, steps: int = STEPS, memory: int = MEMORY, flat: float = FLAT):
    """The maximum of a function near ``x`` by limited-memory quasi-Newton steps with
    backtracking; ``evaluate(x)`` gives value and gradient."""
    value, g = evaluate(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < flat:
            break
        d, kept = g.copy(), []
        for s, y in reversed(moves):
            a = s @ d / (s @ y)
            kept.append(a)
            d -= a * y
        d *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.abs(g).max())
        for (s, y), a in zip(moves, reversed(kept)):
            d += (a - y @ d / (s @ y)) * s
        t = 1.0
        while t > 1e-6:
            v2, g2 = evaluate(x + t * d)
            if v2 >= value + 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            break
        s, y = t * d, g - g2
        if s @ y > 1e-12:
            moves = [*moves, (s, y)][-memory:]
        x, value, g = x + s, v2, g2
    return x


def _train(bags: DataFrame, n_features: int, n_pos: int, n_neg: int):
    """Weights and bias that maximise the noisy-or likelihood.  Each step is a job over
    the stored bags: tasks add up likelihood and gradient, and ``n_features + 1``
    numbers per row of ``_BAGS`` come back."""
    n = n_pos + n_neg
    # the rarer class counts more, by the square root of its rarity
    weight = (np.sqrt(0.5 * n / n_neg), np.sqrt(0.5 * n / n_pos))

    def evaluate(x):
        parts = sorted(bags.mapInArrow(_gradient_batches(x, weight), "first long, value double, slope binary").collect())
        value, slope = sum(r.value for r in parts), sum(np.frombuffer(r.slope) for r in parts)
        held = np.append(DECAY * x[:-1], 0.0)
        return value / n - 0.5 * (held[:-1] @ x[:-1]), slope / n - held

    x = climb(evaluate, np.append(np.zeros(n_features), -6.0))
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, min_docs: int = MIN_DOCS) -> Model:
    """The model learned from the training fold of ``labels`` (see above)."""
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    spark = docs.sparkSession
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).alias("toxic"))
             .where(~held_out(F.col("_id"))))
    share = min(1.0, sample / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))
    # one text per id: an id that many rows share is a single document of the sample
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = store(docs.select(F.col("doc_id").cast("long"), text.alias("text"))
                  .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
                  .groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.md5("text"), "text")).alias("text"))
                  .select("text", "toxic", "doc_id"), "toxicity-sample")
    count = {bool(r.toxic): r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_pos, n_neg = count.get(True, 0), count.get(False, 0)
    empty = np.zeros(0, dtype=np.uint64)
    if not n_pos or not n_neg:
        return Model(empty, np.zeros(0), 0.0, n_pos / max(1, n_pos + n_neg))

    seen = (texts.mapInArrow(_feature_batches, "feature long, pos long, neg long")
            .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= min_docs))
    # how far the rates of the classes are apart, in standard errors
    rate = (F.col("pos") + F.col("neg")) / (n_pos + n_neg)
    z = (F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt(rate * (1.0001 - rate) * (1 / n_pos + 1 / n_neg))
    best = seen.select("feature", z.alias("z")).where(F.col("z") > 1).orderBy(F.desc("z"), "feature").limit(features)
    hashes = np.sort(np.array([r.feature for r in best.select("feature").collect()], dtype=np.int64).view(np.uint64))
    if not len(hashes):
        return Model(empty, np.zeros(0), 0.0, n_pos / (n_pos + n_neg))
    bags = store(texts.mapInArrow(_bag_batches(spark.sparkContext.broadcast(hashes)), _BAGS), "toxicity-bags")
    return Model(hashes, *_train(bags, len(hashes), n_pos, n_neg))


def _document_scores(part, m: Model, lookup: _Lookup):
    """The score of every text of a batch, and its sentences with their spans."""
    texts = utf8(part.column(part.schema.get_field_index("text")))
    sentence, feature, owner, start, end = _pairs(texts, lookup)
    n = np.bincount(owner, minlength=len(texts))
    z = m.bias + np.bincount(sentence, m.weights[feature], minlength=len(owner))
    loss = np.bincount(owner, np.logaddexp(0, z), minlength=len(texts))         # -log(1 - p), summed up
    score = -np.expm1(-loss) if m.share is None else np.where(n > 0, m.share, 0.0)
    return score, (texts, z, owner, start, end)


def _score_batches(model):
    def run(batches):
        import pyarrow as pa

        m: Model = model.value
        lookup = _Lookup(m.features)
        for part in text_blocks(batches, 2 << 20):
            score, (texts, z, owner, start, end) = _document_scores(part, m, lookup)
            offend: list[list[str]] = [[] for _ in texts]
            begins = np.cumsum([0] + [len(t) + 1 for t in texts])
            for s in np.flatnonzero(z >= 0) if m.share is None else ():
                d = owner[s]
                a, b = start[s] - begins[d], end[s] - begins[d]
                at = len(texts[d][:a].decode())
                offend[d].append(f"{at}:{at + len(texts[d][a:b].decode())}")
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)),
                pa.array([",".join(x) for x in offend], pa.string())],
                names=["doc_id", "held_out", "score", "predicted", "offending"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document (see the module docstring)."""
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    shared = share(docs.sparkSession, model)
    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        _score_batches(shared), SCHEMA)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) with a score below 0.5, by a model fitted on
    ``docs`` and ``labels``."""
    ship(__name__, "progcorpus.llm.common", "progcorpus.llm.textblocks")
    shared = share(docs.sparkSession, fit(docs, labels))

    def run(batches):
        import pyarrow as pa

        lookup = _Lookup(shared.value.features)
        for part in text_blocks(batches, 2 << 20):
            yield part.filter(pa.array(_document_scores(part, shared.value, lookup)[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels and score every document."""
    return score(docs, fit(docs, labels))
