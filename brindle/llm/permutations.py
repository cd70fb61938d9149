"""Approximate nearest neighbours with a permutation index.

``PIVOTS`` vectors of a bounded sample order the space: a vector is represented by its ``PREFIX``
nearest pivots, nearest first; every row's order is found once, when it is posted. Rows are dealt to
blocks; a block keeps an inverted file for each pivot: rows and the rank that they give the pivot. A
query adds up, over its own pivots' files, what footrule distance with missing pivots at rank PREFIX
comes to: two orders that share a pivot at ranks r and s are nearer by 2 * (PREFIX - max(r, s)). Of n
rows the nearest ``RERANK`` * n ** (2/3) are reranked (each block its share) by their inner product on
the original vectors, which is summed from the first component on, so that equal vectors score alike
wherever they lie. Every row is indexed and every query meets every block; blocks' best rows are merged.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do
vectors of another length than the commonest; a row that is there more than once counts once; an id with
several vectors is a candidate with each, and asks with the greatest of them; equal scores go to the smaller id;
products that overflow rank as infinite, and last where they are no number; rows with the query's id are its own;
fewer candidates than asked for give fewer rows; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import bounded_batches, settle

PIVOTS, PREFIX = 1024, 64
#: Rows that are reranked, as a multiple of the 2/3rd power of all; rows of a block on average.
RERANK, BLOCK_ROWS = 2.5, 16_384


def orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, nearest first (by inner product; ties: the first pivot)."""
    near = (vectors / np.abs(vectors).max(axis=1, keepdims=True)) @ (pivots / np.abs(pivots).max()).T  # of one order, and finite
    return np.argsort(-near, axis=1, kind="stable")[:, :PREFIX].astype(np.int16)


def products(columns: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of ``query`` and the vectors that are the columns of ``columns``, in order of components."""
    total = np.zeros(columns.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        for column, x in zip(columns, query):
            total += column * x
    return total


class Index:
    """One block: its vectors, and for each pivot the rows and ranks of its inverted file."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, share: float):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors, order = ids[by_id], vectors[by_id], order[by_id]
        self.share, m = share, order.shape[1]
        at = np.argsort(order.ravel(), kind="stable")
        self.rows, self.ranks = (at // m).astype(np.int32), (at % m).astype(np.int32)
        self.begin = np.searchsorted(order.ravel()[at], np.arange(PIVOTS + 1))

    def search(self, query_id: int, query: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(self.ids), len(order)
        spans = [slice(self.begin[p], self.begin[p + 1]) for p in order]
        rows = np.concatenate([self.rows[s] for s in spans])
        near = m - np.maximum(np.concatenate([self.ranks[s] for s in spans]), np.repeat(np.arange(m), [s.stop - s.start for s in spans]))
        shared = np.bincount(rows, near, minlength=n).astype(np.int64)
        shared[self.ids == query_id] = -1
        picked = min(n, max(k + 1, int(np.ceil(self.share * n))))
        key = shared * n + np.arange(n)[::-1]  # ties: the smaller id
        found = np.argpartition(-key, picked - 1)[:picked] if picked < n else np.arange(n)
        found = found[shared[found] >= 0]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = self.vectors[found] @ query
        if len(found) > k and np.isfinite(rough).all():
            # whatever rounding might bring among the best; where products overflow, all
            found = found[rough >= -np.partition(-rough, k - 1)[k - 1] - 1e-9 * np.abs(rough).max()]
        score = products(self.vectors[found].T, query)
        best = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found][best], score[best]


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """``vec_id, v`` (array of double) of the rows that take part; a repeated row once."""
    v = F.col(vec).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0 and vec_id is not null").where(fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (length[0]["n"] if length else 0)).distinct()


def search(vectors: DataFrame, every: int = 20, k: int = 20, vec: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = settle(usable(vectors, vec))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * PIVOTS).collect()
    distinct = list(dict.fromkeys(tuple(r["v"]) for r in sample))[:PIVOTS]
    pivots = spark.sparkContext.broadcast(np.array(distinct, np.float64))  # PIVOTS vectors
    n = rows.count()
    share, blocks = RERANK * max(n, 1) ** (-1 / 3), max(1, -(-n // BLOCK_ROWS))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            flat = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o.tobytes() for o in orders(flat, pivots.value)], pa.binary())], ["vec_id", "v", "o"])

    posted = settle(rows.mapInArrow(post, "vec_id bigint, v array<double>, o binary"))
    base = posted.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "v", "o")
    asks = posted.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max(F.struct("v", "o")).alias("ask")).select("vec_id", "ask.*").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "v", "o")
    schema = "query_id bigint, vec_id bigint, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, parts, kept, index = None, [], [], [], None
        for batch in batches:
            out = [[], [], []]
            blocks_, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            names = batch.column(2).to_numpy()
            flat = batch.column(3).flatten().to_numpy().reshape(len(names), -1)
            order = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int16).reshape(len(names), -1)
            cuts = np.flatnonzero((np.diff(blocks_) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(names)]):
                if blocks_[lo] != block:
                    block, ids, parts, kept, index = blocks_[lo], [], [], [], None
                if kinds[lo] == 0:
                    ids.append(names[lo:hi].copy())
                    parts.append(flat[lo:hi].copy())
                    kept.append(order[lo:hi])
                    continue
                if not ids:
                    continue
                index = index or Index(np.concatenate(ids), np.concatenate(parts), np.concatenate(kept), share)
                for q, v, o in zip(names[lo:hi], flat[lo:hi], order[lo:hi]):
                    found, score = index.search(q, v, o, k)
                    out[0].append(np.full(len(found), q))
                    out[1].append(found)
                    out[2].append(score)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    near = base.unionByName(asks).repartition("block").sortWithinPartitions("block", "asks").mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, every: int = 20, k: int = 20, vec: str = "embedding") -> list[tuple[int, int, int, float]]:
    """The same rows by brute force, on the driver: the measure of recall, for small tables."""
    rows = usable(vectors, vec).collect()
    ids, all_rows = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = []
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        own = ids == q
        score = products(all_rows.T, np.array(max(all_rows[own].tolist())))
        order = [i for i in np.lexsort((ids, -score)) if not own[i]][:k]
        out += [(q, r + 1, int(ids[i]), float(score[i])) for r, i in enumerate(order)]
    return out
