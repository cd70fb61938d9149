"""Quality classifier: supervised subword embeddings.

A document is the bag of its words, word pairs and character 3- and 4-grams (inside a word and its
edges), each hashed to a row of an embedding table; the mean of the rows goes through a softmax. Both
tables are learnt by stochastic gradient descent in numpy, from a bounded sample of labelled rows
(``PER_CLASS`` of each label, chosen by the hash of the id, with one text of each). As the softmax's input is linear in the
rows, scoring needs one number for each bucket: its row times the difference of the output vectors.

Defined cases: a null or empty text has no feature and scores 0.5; a conflict of labels of an id is
the larger label; without labelled rows every text scores 0.5; repeated rows stay; a very long text is
scored whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.bpe import groups
from brindle.llm.common import bounded_batches, held_out, whole

#: Buckets (a power of two; the last is for a word that repeats the word before it), embedding size.
BITS, DIM = 16, 8
#: Labelled documents that each class is learnt from, at most; passes; documents of a step; rate.
PER_CLASS, EPOCHS, STEP, RATE = 2500, 8, 16, 10.0
THRESHOLD = 0.7

_BASE = np.uint64(0x100000001B3)
_BACK = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    return ((h * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Features:
    """Buckets of all texts, text after text for each kind; ``ends`` has each kind's end of each text."""

    kinds: list[tuple[np.ndarray, np.ndarray]]


def features(texts: list[str]) -> Features:
    sizes = np.array([len(t) + 2 for t in texts])
    ends = np.cumsum(sizes)
    c = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = (c <= 32) | (c == 0x85) | (c == 0xA0) | ((c >= 0x2000) & (c <= 0x200A)) | (c == 0x2028) | (c == 0x2029) | (c == 0x3000)
    c = np.where(space, np.uint64(32), c)
    with np.errstate(over="ignore"):
        # words: a polynomial's prefix sums, brought back to exponent 0
        up = np.cumprod(np.full(len(c), _BASE, np.uint64))
        down = np.cumprod(np.full(len(c), _BACK, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * up)])
        edge = np.diff(space.astype(np.int8))
        begin, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        word = (total[end] - total[begin]) * down[begin]
        owner = np.searchsorted(ends, begin, side="right")
        kinds = [(np.minimum(_bucket(word), (1 << BITS) - 2), np.searchsorted(owner, np.arange(len(texts)), side="right"))]
        same = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
        first, second = word[:-1][same], word[1:][same]
        pair = np.minimum(_bucket(first * np.uint64(31) + second * np.uint64(0xC2B2AE3D27D4EB4F)), (1 << BITS) - 2)
        kinds.append((np.where(first == second, (1 << BITS) - 1, pair).astype(np.int32), np.searchsorted(owner[1:][same] if len(owner) else owner, np.arange(len(texts)), side="right")))
        for n in (3, 4):
            m = len(c) - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n))
            inner = np.zeros(m, bool)
            for k in range(n):
                h = h * np.uint64(0xD6E8FEB86659FD93) + c[k : k + m]
                if 0 < k < n - 1:
                    inner |= space[k : k + m]
            at = np.flatnonzero(~inner)
            kinds.append((np.minimum(_bucket(h[at]), (1 << BITS) - 2), np.searchsorted(at, ends - n, side="right")))
    return Features(kinds)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    out = []
    for part in groups(texts):
        found = features(part).kinds
        for i in range(len(part)):
            ids = np.concatenate([b[e[i - 1] if i else 0 : e[i]] for b, e in found])
            b, n = np.unique(ids, return_counts=True)
            out.append((b.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Stochastic gradient descent; returns each bucket's part of the logit of label 1."""
    rng = np.random.default_rng(seed)
    rows = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    docs, labels = [d for d in docs if len(d[0])], labels[[bool(len(d[0])) for d in docs]] if len(docs) else labels
    steps, done = max(1, EPOCHS * -(-len(docs) // STEP)), 0
    for _ in range(EPOCHS if docs else 0):
        order = rng.permutation(len(docs))
        for k in range(0, len(docs), STEP):
            picked = order[k : k + STEP]
            ids = np.concatenate([docs[i][0] for i in picked])
            share = np.concatenate([docs[i][1] for i in picked])
            size = np.array([len(docs[i][0]) for i in picked])
            mean = np.add.reduceat(rows[ids] * share[:, None], np.cumsum(size) - size, axis=0)
            logit = mean @ out.T
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(picked)), labels[picked]] -= 1
            rate = RATE * (1 - done / steps)
            back = p @ out
            out -= rate / len(picked) * (p.T @ mean)
            for i, b in zip(picked, back):  # a document's buckets are distinct
                rows[docs[i][0]] -= docs[i][1][:, None] * (rate * b)
            done += 1
    return rows @ (out[1] - out[0]) if docs else np.zeros(1 << BITS, np.float32)


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    at = 0
    for part in groups(texts):
        span = slice(at, at + len(part))
        for ids, ends in features(part).kinds:
            run = np.concatenate([np.zeros(1), np.cumsum(weights[ids], dtype=np.float64)])
            begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
            total[span] += run[ends] - run[begins]
            count[span] += ends - begins
        at += len(part)
    return 1 / (1 + np.exp(-total / np.maximum(count, 1)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray:
    """Weights of the buckets, from rows that aren't held out. ``labels``: doc_id, quality."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    picked = [known.where(F.col("label") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    text = docs.select("doc_id", whole("text").alias("text"))
    rows = text.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # 2 x per_class rows at most, however often an id is repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bags(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["doc_id", "label", "ids", "share"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))), key=lambda r: r[:3])
        weights = train([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in got], np.array([r[1] for r in got], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    kind = text.schema["doc_id"].dataType.simpleString()
    bagged = rows.mapInArrow(run, f"doc_id {kind}, label int, ids binary, share binary")
    # 2 x per_class rows at most; a task learns from them, as the driver's memory holds the plans of all stages
    found = bagged.repartition(1).mapInArrow(learn, "weights binary").first()
    return np.frombuffer(found[0], np.float32) if found else train([], np.zeros(0, np.int64))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it a name that ``docs`` doesn't have."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def score(docs: DataFrame, weights: np.ndarray, name: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``name``, 0 to 1; one pass, no shuffle."""
    if _free(docs, name) != name:
        raise ValueError(f"there is a column {name} already")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't be given to mapInArrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(texts, shared.value), pa.float64())], [*batch.schema.names, name])

    return plain.mapInArrow(run, type(docs.schema)([*plain.schema.fields]).add(name, "double")).toDF(*docs.columns, name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    weights = fit(docs, labels)
    slim = docs.select("doc_id", "text")
    bounded = score(slim, weights)
    return bounded.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns, whatever their names."""
    name = _free(docs, "quality_score")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).drop(name)
