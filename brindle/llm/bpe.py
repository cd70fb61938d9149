"""Byte-level BPE encoding and decoding with a public rank file.

A text is split by the pattern; every distinct piece is encoded once in a batch. Pieces lie as rows
of padded matrices, one matrix for each range of lengths. In each round every row merges its leftmost
pair of minimum rank (``argmin``); the ranks of the two new pairs come from a hashed pair table, and
rows without a pair left leave the matrix. A piece of over ``WIDEST`` bytes would need as many rounds
as it has bytes, so such a piece (rare: a word of hundreds of letters) is merged with a heap in the
same order, in O(n log n).

Defined cases: a null text is the empty text, with no ids; repeated rows stay; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, whole

NONE = np.int32(2**31 - 1)
#: Upper ends of the matrices' lengths; bytes above the last go to the heap.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256)
WIDEST = WIDTHS[-1]
#: Pieces kept between batches of a worker; characters encoded at a time.
KEPT, CHARS = 300_000, 1_000_000


class Pairs:
    """(left id, right id) -> id of the joined bytes: an open-addressed table in two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, to: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(to)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.full(1 << self.bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            _, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[slot[won]], self.to[slot[won]] = keys[won], to[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, ``NONE`` where a pair has none or an id is padding (negative)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys, flat = keys.ravel(), out.ravel()
        slot = self._slot(keys[todo])
        while len(todo):
            at = self.keys[slot]
            hit = at == keys[todo]
            flat[todo[hit]] = self.to[slot[hit]]
            on = ~hit & (at != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)


def merged(ids: np.ndarray, pairs: Pairs) -> list[bytes]:
    """Every row of the padded matrix ``ids``, with its pairs joined: each round every row joins its leftmost pair of
    the least number in ``pairs``, until it has none. What is left of a row, as bytes of int32."""
    ranks = pairs.find(ids[:, :-1], ids[:, 1:])
    out: list[bytes] = [b""] * len(ids)
    row = np.arange(len(ids))
    while len(row):
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(row)), at]
        done = best == NONE
        if done.any():
            for r, x in zip(row[done], ids[done]):
                out[r] = x[x >= 0].tobytes()
            keep = ~done
            row, ids, ranks, at, best = row[keep], ids[keep], ranks[keep], at[keep], best[keep]
            if not len(row):
                break
        every, width = np.arange(len(row)), ids.shape[1]
        ids[every, at] = best
        ids = np.where(np.arange(width - 1) <= at[:, None], ids[:, :-1], ids[:, 1:])
        if width == 2:
            ranks = np.full((len(row), 1), NONE, np.int32)
            ids = np.hstack([ids, np.full((len(row), 1), -1, np.int32)])
            continue
        ranks = np.where(np.arange(width - 2) < at[:, None], ranks[:, :-1], ranks[:, 1:])
        for side in (at - 1, at):
            ok = (side >= 0) & (side < width - 2)
            r, c = every[ok], side[ok]
            ranks[r, c] = pairs.find(ids[r, c], ids[r, c + 1])
    return out


class Table:
    """Bytes of every id laid end to end, to gather many ids at once."""

    def __init__(self, values: list[bytes]):
        self.blob = np.frombuffer(b"".join(values), np.uint8)
        self.size = np.array([len(v) for v in values], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        shift = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.blob[shift + np.arange(len(shift))].tobytes()


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rows = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        left, right, to = (np.array(x, np.int32) for x in (zip(*rows) if rows else ((), (), ())))
        self.pairs = Pairs(left, right, to)
        values = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            values[r] = token
        self.bytes = Table(values)
        self.decimal = Table([b" %d" % i for i in range(len(values))])
        self.kept: dict[str, bytes] = {}

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        return merged(ids, self.pairs)

    def _heap(self, piece: bytes) -> bytes:
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:])
        ids = ids.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        now = first.tolist() + [int(NONE)]
        heapq.heapify(heap)
        values = self.values

        def rank(i: int) -> int:
            j = after[i]
            return self.ranks.get(values[ids[i]] + values[ids[j]], int(NONE)) if j < n else int(NONE)

        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], now[j] = r, -1, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    now[k] = rank(k)
                    if now[k] != NONE:
                        heapq.heappush(heap, (now[k], k))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    @property
    def values(self) -> dict[int, bytes]:
        if not hasattr(self, "_values"):
            self._values = {r: t for t, r in self.ranks.items()}
        return self._values

    def pieces(self, words: list[str]) -> list[bytes]:
        """int32 ids of each piece, as bytes."""
        out: list[bytes] = [b""] * len(words)
        of: dict[int, list[int]] = {}
        raw = [w.encode() for w in words]
        for i, p in enumerate(raw):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.int32(r).tobytes()
            elif len(p) > WIDEST:
                out[i] = self._heap(p)
            else:
                of.setdefault(next(w for w in WIDTHS if len(p) <= w), []).append(i)
        for width, at in of.items():
            rows = max(1, (1 << 21) // width)
            for k in range(0, len(at), rows):
                for i, ids in zip(at[k : k + rows], self._matrix([raw[i] for i in at[k : k + rows]], width)):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pattern.findall(t) for t in texts]
        fresh = {p for pieces in split for p in pieces if p not in self.kept}
        if len(self.kept) + len(fresh) > KEPT:
            self.kept.clear()
            fresh = {p for pieces in split for p in pieces}
        fresh_list = list(fresh)
        self.kept.update(zip(fresh_list, self.pieces(fresh_list)))
        return [np.frombuffer(b"".join([self.kept[p] for p in pieces]), np.int32) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes.join(ids)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The tokenizer of a rank file; a worker keeps it for its later tasks."""
    with open(path, "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def groups(texts: list[str], most: int = CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters together; a longer text is alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def tokenise(docs: DataFrame, path: str | None = None, pattern: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``carry``, ``n_tokens`` and ``ids`` of every row."""
    return _mapped(docs, path, pattern, "n_tokens bigint, ids array<int>", lambda bpe, ids: {"n_tokens": len(ids), "ids": ids}, carry)


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: the ids are decoded again."""

    def one(bpe: ByteBPE, ids: np.ndarray) -> dict:
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(bpe.decimal.join(ids)[1:]).hexdigest(), "decoded_sha256": hashlib.sha256(bpe.decode(ids)).hexdigest()}

    return _mapped(docs, path, pattern, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", one, ())


def _mapped(docs: DataFrame, path: str | None, pattern: str | None, schema: str, one, carry: tuple[str, ...]) -> DataFrame:
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    bounded_batches(docs.sparkSession)
    kept = ["doc_id", *carry]
    slim = docs.select(*kept, whole("text").alias("text"))
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            rows = [one(bpe, ids) for part in groups(batch.columns[-1].to_pylist()) for ids in bpe.encode(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names]], [*kept, *names])

    return slim.mapInArrow(run, ", ".join([*[f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in kept], schema]))
