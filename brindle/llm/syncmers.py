"""Document fingerprints of closed syncmers.

A k-mer of the text is an anchor when the smallest (by hash) of its inner s-mers is its first or its
last one. That depends on the k-mer alone, so the same passage has the same anchors in any text, and
anchors are at most k - s apart. A fingerprint lists, for each anchor, its 32-bit hash and its distance
from the one before. Likeness is positional: the share (Dice) of anchors on the longest chain that two
fingerprints have in the same order, at whatever distance between the texts; each anchor counts once,
and repeats of a passage count as often as both have them in order.

The next document is found without a global sort: ids are cut into ranges, and the first row of each
range is copied to the range before it (the very first to the last).

Defined cases: a null text is the empty text, with the empty fingerprint; a text without such a k-mer
(it is shorter than 2 k - s - 1) has one anchor, the whole text; two empty fingerprints are alike (1); a null id comes last; equal ids are
ordered by text, and an only row is its own next; ids are whole numbers; rows of one id (or without any)
lie in one range; repeated rows stay; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, whole

K, S = 24, 8
#: Text of a range of ids, and most ranges, as their bounds are part of the plan: beyond 1.3 TB a range holds more.
RANGE_BYTES, MOST_RANGES = 64 << 20, 20_000
#: Pairs of equal anchors, for each anchor, that are chained one by one; texts with more repeats take rows of bits.
FEW = 8
LAST = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_down(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << max(12, n.bit_length())
        for i, x in enumerate((np.uint64(_BASE), _BACK)):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, x, np.uint64))])
    return [p[:n] for p in _powers]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint32) and positions of the text's anchors."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(c):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        up, down = _up_down(len(c) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * up[:-1])])
        alone = (_mix(total[-1:] + np.uint64(len(c))) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)
        if len(c) < K:
            return alone
        inner = _mix((total[S:] - total[:-S]) * down[: len(c) - S + 1])
        width, low, have = K - S + 1, inner, 1
        while have * 2 <= width:
            low, have = np.minimum(low[:-have], low[have:]), have * 2
        n = len(c) - K + 1
        low = np.minimum(low[:n], low[width - have : width - have + n])
        at = np.flatnonzero((inner[:n] == low) | (inner[K - S : K - S + n] == low))
        if not len(at):
            return alone
        h = _mix((total[at + K] - total[at]) * down[at])
    return (h >> np.uint64(32)).astype(np.uint32), at


def chain(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest chain of equal hashes in the same order in both: exact, with all repeats."""
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    head = int(unlike[0]) if len(unlike) else n
    a, b, n = a[head:], b[head:], n - head
    unlike = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    tail = n - 1 - int(unlike[-1]) if len(unlike) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    names, x = np.unique(a, return_inverse=True)
    order = np.argsort(x, kind="stable")
    begin = np.searchsorted(x[order], np.arange(len(names) + 1))
    y = np.searchsorted(names, b)
    known = (y < len(names)) & (names[np.minimum(y, len(names) - 1)] == b)
    y = y[known]
    if (begin[y + 1] - begin[y]).sum() <= FEW * (len(a) + len(b)):
        # few pairs: the least end of a chain of each length
        ends: list[int] = []
        where = order.tolist()
        for k in y.tolist():
            for at in reversed(where[begin[k] : begin[k + 1]]):
                i = bisect_left(ends, at)
                ends[i : i + 1] = [at]
        return head + tail + len(ends)
    # many repeats: a row of the table of chains is a number, a bit for each of a's anchors
    full = (1 << len(a)) - 1
    row = full
    for k in y.tolist():
        bits = np.zeros(len(a), np.uint8)
        bits[order[begin[k] : begin[k + 1]]] = 1
        hit = row & int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        row = ((row + hit) | (row - hit)) & full
    return head + tail + len(a) - row.bit_count()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    return float(2 * chain(a[0], b[0]) / (len(a[0]) + len(b[0])))


def packed(found: tuple[np.ndarray, np.ndarray]) -> str:
    h, at = found
    row = np.empty((len(h), 5), np.uint8)
    row[:, :4] = h.astype("<u4").view(np.uint8).reshape(-1, 4)
    row[:, 4] = np.diff(at, prepend=0)
    return base64.b64encode(row.tobytes()).decode()


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are <= key: first by every ``step``-th, then within one step."""
    step = math.isqrt(len(bounds)) + 1
    coarse, fine = _literal(bounds[step - 1 :: step], "bigint"), _literal(bounds, "bigint")
    passed = F.size(F.filter(coarse, lambda b: b <= key)) * step
    return passed + F.size(F.filter(F.slice(fine, passed + 1, F.lit(step)), lambda b: b <= key))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, range, own`` in ranges of ids, each range in order, followed by its next row. There are as
    many ranges as hold ``RANGE_BYTES`` of text each, ``MOST_RANGES`` at most, and a task for each, which reads its range in
    batches."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("key")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    keys = docs.select(key)
    cuts = keys.agg(F.percentile_approx("key", [(i + 1) / ranges for i in range(ranges - 1)] or [0.5], max(10_000, 20 * ranges))).first()[0]
    bounds = sorted(set(cuts or []))[: ranges - 1]
    place = _range_of(F.col("key"), bounds).alias("range")
    firsts = sorted((r["range"], r["first"]) for r in keys.select("key", place).groupBy("range").agg(F.min("key").alias("first")).collect())  # a row a range
    first_of, before = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for i, (at, first) in enumerate(firsts):
        first_of[at], before[at] = first, firsts[i - 1][0]
    placed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"), key).select("*", place)
    carried = F.when(F.get(_literal(first_of, "bigint"), F.col("range")) == F.col("key"), F.struct(F.get(_literal(before, "int"), F.col("range")).alias("range"), F.lit(False).alias("own")))
    homes = F.array_compact(F.array(F.struct(F.col("range"), F.lit(True).alias("own")), carried))
    spread = placed.select("doc_id", "text", "key", F.inline(homes))
    return spread.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", F.desc("own"), "key", "text").select("doc_id", "text", "range", "own")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns of every row; the texts are shuffled once."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for doc_id, text, where, own in zip(*[c.to_pylist() for c in batch.columns]):
                found = anchors(text) if own or last else None
                if last and last[0] == where:
                    _, before, old, mark = last
                    n = len(old)
                    edited = old[: n - n // 2] + text[: n // 2]
                    other = anchors(edited)
                    out.append((before, n, hashlib.sha256(edited.encode()).hexdigest(), packed(mark), packed(other), likeness(mark, other), likeness(mark, found)))
                last = (where, doc_id, text, found) if own else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return with_next(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
