"""Ranked lexical search over a bit-sliced impact index.

Documents lie in blocks of at most ``BLOCK`` rows, in order of their ids. ``build`` reads the texts once and writes,
for every term of a block, the places that hold it and how often (``postings``), and each block's ids and lengths
(``blocks``). What a term adds to a document's score, its impact, depends on counts of the whole table, which
any new document changes; so bitmaps are made when a batch of queries is searched: for each term of the batch one
bitmap for each bit of its impacts. A query's bitmaps are added by carries: three numbers become a sum and a carry
with a few bitwise operations on all documents of the block at once, until two are left, and these are added
from the lowest slice up. The best k are found from the highest slice down: while more than k documents are left,
those without the bit go; ties that remain go to the smaller id. Blocks' best rows are merged by rank.

A search keeps the rows of its own terms. A term that stands in every document has one row in each block, so rows
meet by block and never by term: some blocks are a tile, and the batch of queries goes to each tile once (in parts of
``ASKS``, where it is larger).

Defined cases: a null or termless text has no term, is not counted and is never found. Every row is a document of
its own, also where an id comes twice; rows without an id come last among equal scores. An item that is there more
than once is asked once, with its greatest text; an item without a term gives no rows. A very long text closes its
block early. Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import bounded_batches, scratch

#: Documents and postings of a block; bytes of bitmaps that a task keeps of terms; most terms that are broadcast.
BLOCK, POSTINGS, KEPT_BYTES, BROADCAST_TERMS = 16_384, 1_500_000, 96 << 20, 20_000
#: Blocks of a tile, if there are more tiles than cores; items that a task holds at a time.
TILE, ASKS = 2, 10_000
#: Every character that ends a term becomes a space, A-Z become small; bytes from 0x80 on belong to terms.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass(frozen=True)
class Stored:
    """A written index: the folders of its two tables."""

    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        """``block, ids, lengths``, a row for each block."""
        return self._table("blocks", "block", "ids", "lengths")

    @property
    def postings(self) -> DataFrame:
        """``block, term, held, places, counts``, a row for each term of a block; arrays as bytes."""
        return self._table("postings", "block", "term", "held", "places", "counts")

    def _table(self, kind: str, *columns: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self.path).where(F.col("kind") == kind).select(*columns)


def _block(number: int, ids: list, lengths: list[int], names: dict[bytes, int], term: list[np.ndarray], count: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of one block. Places follow the ids' order, null ids last, so that a smaller place is a smaller id."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    where, what, many = np.repeat(place, [len(x) for x in term]), np.concatenate(term), np.concatenate(count)
    at = np.lexsort((where, what))
    where, what, many = where[at].astype("<u2"), what[at], many[at].astype("<i4")
    words = list(names)
    by_word = sorted(range(len(words)), key=words.__getitem__)  # rows in order of terms: files are skipped by them
    start = np.searchsorted(what, np.arange(len(words) + 1))
    yield _rows(number, [None], ["blocks"], [0], [None], [None], [[ids[i] for i in order]], [[lengths[i] for i in order]])
    for lo in range(0, len(by_word), 10_000):
        part = by_word[lo : lo + 10_000]
        cuts = [(start[w], start[w + 1]) for w in part]
        yield _rows(number, [words[w] for w in part], ["postings"] * len(part), [b - a for a, b in cuts], [where[a:b].tobytes() for a, b in cuts], [many[a:b].tobytes() for a, b in cuts], [None] * len(part), [None] * len(part))


_NAMES = ["block", "term", "kind", "held", "places", "counts", "ids", "lengths"]
_SCHEMA = "block bigint, term binary, kind string, held bigint, places binary, counts binary, ids array<bigint>, lengths array<int>"


def _rows(number: int, term, kind, held, places, counts, ids, lengths) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([number] * len(term), pa.int64()), *(pa.array(x, t) for x, t in zip((term, kind, held, places, counts, ids, lengths), kinds))], _NAMES)


def build(docs: DataFrame, path: str | None = None) -> Stored:
    """Writes the index of ``docs`` (doc_id, text): one pass, no shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or scratch(spark, "impacts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, ids, lengths, names, term, count = TaskContext.get().partitionId() << 32, 0, [], [], {}, [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                found = Counter(words)
                ids.append(doc)
                lengths.append(len(words))
                term.append(np.fromiter((names.setdefault(w, len(names)) for w in found), np.int32, len(found)))
                count.append(np.fromiter(found.values(), np.int32, len(found)))
                n += len(found)
                if len(ids) >= BLOCK or n >= POSTINGS:
                    yield from _block(number, ids, lengths, names, term, count)
                    number, n, ids, lengths, names, term, count = number + 1, 0, [], [], {}, [], []
        if ids:
            yield from _block(number, ids, lengths, names, term, count)

    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, _SCHEMA).write.partitionBy("kind").parquet(path)
    return Stored(spark, path)


def planes(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bitmaps (rows of 64-bit words) of whole numbers below 2^width; their number is padded to a multiple of 64."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def added(numbers: list[np.ndarray]) -> np.ndarray:
    """The sum of sliced numbers of one shape: three become two (sum and carry) until two are left, then slices are
    added from the lowest up. The shape must have room for the sum."""
    while len(numbers) > 2:
        left = numbers[len(numbers) // 3 * 3 :]
        for i in range(0, len(numbers) - 2, 3):
            a, b, c = numbers[i : i + 3]
            odd = a ^ b
            carry = np.zeros_like(a)
            carry[1:] = ((a & b) | (odd & c))[:-1]
            left += [odd ^ c, carry]
        numbers = left
    if len(numbers) == 1:
        return numbers[0]
    a, b = numbers
    out, carry = np.empty_like(a), np.zeros_like(a[0])
    for i in range(len(a)):
        odd = a[i] ^ b[i]
        out[i] = odd ^ carry
        carry = (a[i] & b[i]) | (odd & carry)
    return out


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``k`` greatest positive numbers of a sliced sum, ties to the smaller place."""
    held = np.bitwise_or.reduce(total, axis=0)
    sure, tied = np.zeros_like(held), held
    for plane in total[::-1]:
        up = sure | (tied & plane)
        n = int(np.bitwise_count(up).sum())
        if n > k:
            tied &= plane
        else:
            sure, tied = up, tied & ~plane
            if n == k:
                tied = np.zeros_like(tied)
                break
    where = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    found = where(sure)
    found = np.sort(np.concatenate([found, where(tied)[: k - len(found)]])).astype(np.int64)
    bit = (total[:, found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)
    value = (bit.astype(np.int64) << np.arange(len(total), dtype=np.int64)[:, None]).sum(axis=0)
    order = np.lexsort((found, -value))
    return found[order], value[order]


class Block:
    """One block while it is searched: postings by term, bitmaps as they are needed."""

    def __init__(self, ids: list, lengths: np.ndarray, documents: int, tokens: int):
        self.ids, self.words = ids, -(-len(ids) // 64)
        self.bottom = 8 * (25 + (75 * lengths.astype(np.int64) * documents) // tokens)
        self.postings: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.kept: dict[tuple[bytes, int], np.ndarray] = {}
        self.bytes = 0

    def impacts(self, term: bytes, weight: int) -> np.ndarray:
        where, many = self.postings[term]
        tf = many.astype(np.int64)
        out = np.zeros(64 * self.words, np.int64)
        out[where] = weight * ((1_000_000_000 * tf) // (1000 * tf + self.bottom[where]))
        return out

    def sliced(self, term: bytes, weight: int) -> np.ndarray:
        if (found := self.kept.get((term, weight))) is None:
            values = self.impacts(term, weight)
            found = planes(values, max(1, int(values.max()).bit_length()))
            if self.bytes + found.nbytes > KEPT_BYTES:
                self.kept.clear()
                self.bytes = 0
            self.kept[term, weight] = found
            self.bytes += found.nbytes
        return found

    def search(self, asked: list[tuple[bytes, int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``asked``: terms with weights and how often they are asked for. A term asked for r times is added with its
        slices moved up, once for each bit of r."""
        parts = [(self.sliced(t, w), bit) for t, w, r in asked if t in self.postings for bit in range(r.bit_length()) if r >> bit & 1]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = max(len(p) + s for p, s in parts) + len(parts).bit_length()
        numbers = []
        for p, s in parts:
            number = np.zeros((width, self.words), np.uint64)
            number[s : s + len(p)] = p
            numbers.append(number)
        return best(added(numbers), k)


def asked_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """``item_id, term, repeats``; terms as bytes."""
    rows = items.groupBy("item_id").agg(F.max(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t, n) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t, n in Counter(terms_of(x)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["item_id", "term", "repeats"])

    return rows.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(run, "item_id bigint, term binary, repeats bigint")


def search(index: Stored, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item (item_id, text)."""
    spark = index.spark
    bounded_batches(spark)
    at = scratch(spark, "asked")
    asked_terms(items).write.parquet(at)
    asked = spark.read.schema("item_id bigint, term binary, repeats bigint").parquet(at)
    documents, tokens = index.blocks.agg(F.coalesce(F.sum(F.size("lengths")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()
    words = asked.select("term").distinct()
    few = words.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS  # else a join by term, whose large sides are split at run time
    wanted = index.postings.join(F.broadcast(words) if few else words, "term", "left_semi")
    df = wanted.groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    weighed = asked.join(df.select("term", weight.alias("weight")), "term").where("weight > 0")
    asks = weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight", "repeats")).alias("asked"))  # an item's terms, as long as its text
    parts = max(1, -(-asks.count() // ASKS))
    n = index.blocks.count()
    tiles = max(1, min(n, spark.sparkContext.defaultParallelism), -(-n // TILE))
    tile, part = F.pmod(F.xxhash64("block"), F.lit(tiles)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    none = {"item_id": "bigint", "asked": "array<struct<term:binary,weight:bigint,repeats:bigint>>", "ids": "array<bigint>", "lengths": "array<int>", "term": "binary", "places": "binary", "counts": "binary"}

    def rows(df: DataFrame, kind: int, *has: str) -> DataFrame:
        return df.select("tile", "part", F.lit(kind).alias("kind"), F.col("block") if kind else F.lit(-1).cast("bigint").alias("block"), *(F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in none.items()))

    met = (
        rows(asks.select("*", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")), 0, "item_id", "asked")
        .unionByName(rows(index.blocks.select("*", tile.cast("int").alias("tile"), part.alias("part")), 1, "ids", "lengths"))
        .unionByName(rows(wanted.select("*", tile.cast("int").alias("tile"), part.alias("part")), 2, "term", "places", "counts"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, block, asked = None, None, None, []

        def found() -> Iterator[pa.RecordBatch]:
            out = [[], [], []]
            for item, queries in asked if block else []:
                at, score = block.search(queries, k)
                out[0] += [item] * len(at)
                out[1] += [block.ids[i] for i in at]
                out[2] += score.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item_id", "doc_id", "score"])

        for batch in batches:
            for t, p, kind, b, item, queries, ids, lengths, term, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, p) != key or b != number:
                    yield from found()
                    block = None
                    if (t, p) != key:
                        asked = []
                    key, number = (t, p), b
                if kind == 0:
                    asked.append((item, [(q["term"], q["weight"], q["repeats"]) for q in queries]))
                elif kind == 1:
                    block = Block(ids, np.array(lengths, np.int64), documents, tokens)
                else:
                    block.postings[term] = np.frombuffer(places, "<u2"), np.frombuffer(counts, "<i4")
        yield from found()

    near = met.repartitionById(tiles * parts, F.col("tile") * parts + F.col("part")).sortWithinPartitions("tile", "part", "block", "kind").mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Builds the index of ``docs`` and searches it for every item."""
    return search(build(docs), items, k)


_TERMS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format(t="text")} AS ts FROM documents WHERE text IS NOT NULL),
 s AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
 p AS MATERIALIZED (SELECT row, doc_id, len(ts) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, ts, unnest(ts) AS term FROM d) GROUP BY ALL),
 q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS.format(t="max(text)")}) AS term FROM benchmark GROUP BY item_id) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
 h AS (SELECT item_id, row, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM h WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10"""
