"""Vector search: the nearest chunks of each query of a batch.

Chunks and queries meet in tiles: one matrix product for a tile of each, of which a query's best ``k`` go on
and are merged. A batch that is small, by a count of its numbers, is sent to wherever chunks lie, so that they
don't move; a larger one is cut into tiles, and each tile of chunks goes to each tile of queries. The product
only chooses: rows within its rounding of the k-th are scored again, added up from the first component on, so that
equal vectors score alike wherever they lie.

Vectors that are null, or hold a null or a number that isn't finite, and chunks of another length than the query have
no score. A vector of norm 0 scores 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.config import SearchOptions
from brindle.runtime import planned_bytes, workers_see_package

#: Numbers of a batch of queries that is sent to the chunks; queries and chunks of a tile; rows of a matrix product, and queries.
SENT_NUMBERS, QUERY_TILE, CHUNK_TILE, PRODUCT_ROWS, PRODUCT_QUERIES = 4_000_000, 2_048, 65_536, 8_192, 128
#: Pairs of a task where every pair is put out; most tasks.
TASK_PAIRS, MOST_TASKS = 4_000_000, 100_000
#: Plans whose input seems smaller than this are dealt to all cores, as it may lie in one file.
SMALL_BYTES = 64 << 20
Batches = Iterator[pa.RecordBatch]
#: Queries, or chunks: names, vectors and norms of one length.
Part = tuple[list[pa.Array], np.ndarray, np.ndarray]


def exact(columns: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products with ``query`` of the vectors that are the columns, added up from the first component on."""
    total = np.zeros(columns.shape[1:])
    for column, x in zip(columns, query):
        total += column * x
    return total


def _ratio(products: np.ndarray, norms: np.ndarray, norm: float) -> np.ndarray:
    bottom = norms * norm
    return np.divide(products, bottom, out=np.zeros_like(products), where=bottom != 0)


def _parts(batches: Batches, names: int) -> Iterator[Part]:
    """Batches (``names`` columns, then vectors) as matrices, each of vectors of one length."""
    for batch in batches:
        lists = batch.column(names)
        size = np.diff(lists.offsets.to_numpy())
        for n in np.unique(size):
            at = pa.array(np.flatnonzero(size == n))
            flat = lists.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
            fine = np.isfinite(flat).all(axis=1)
            at, flat = at.filter(pa.array(fine)), flat[fine].astype(np.float64, copy=False)
            for lo in range(0, len(flat), PRODUCT_ROWS):
                part = flat[lo : lo + PRODUCT_ROWS]
                yield [batch.column(i).take(at.slice(lo, PRODUCT_ROWS)) for i in range(names)], part, np.sqrt(exact(part.T, part.T))


def _blocks(queries: list[Part]) -> Iterator[Part]:
    """At most ``PRODUCT_QUERIES`` queries at once, so that a product takes as much memory whatever their number."""
    for (names,), asked, norms in queries:
        for lo in range(0, len(asked), PRODUCT_QUERIES):
            yield [names.slice(lo, PRODUCT_QUERIES)], asked[lo : lo + PRODUCT_QUERIES], norms[lo : lo + PRODUCT_QUERIES]


def _nearest(queries: list[Part], chunks: Part, k: int, least: float | None) -> Batches:
    """``query_id, doc_id, chunk_id, score``: of each query at least its best ``k`` of a part, with all ties."""
    (docs, ids), vectors, norms = chunks
    for (names,), asked, asked_norms in _blocks(queries):
        if asked.shape[1] != vectors.shape[1]:
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            rough = vectors @ asked.T
            rough = np.divide(rough, norms[:, None] * asked_norms, out=np.zeros_like(rough), where=(norms[:, None] * asked_norms) != 0)
        rough[~np.isfinite(rough)] = np.inf  # what overflowed is scored again
        bar = np.full(len(asked), -np.inf)
        if len(vectors) > k:
            bar = -np.partition(-rough, k - 1, axis=0)[k - 1] - 1e-9
        if least is not None:
            bar = np.maximum(bar, least - 1e-9)
        row, col = np.nonzero((rough >= bar).T)
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.concatenate([_ratio(exact(vectors[c].T, asked[q]), norms[c], asked_norms[q]) for q, c in _runs(row, col)] or [np.zeros(0)])
        good = np.isfinite(score) if least is None else score >= least
        row, col = pa.array(row[good]), pa.array(col[good])
        yield pa.RecordBatch.from_arrays([names.take(row), docs.take(col), ids.take(col), pa.array(score[good])], ["query_id", "doc_id", "chunk_id", "score"])


def _runs(row: np.ndarray, col: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.flatnonzero(np.diff(row)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(row)]) if len(row) else ():
        yield row[lo], col[lo:hi]


def _joined(chunks: DataFrame, queries: DataFrame, kernel: Callable[[list[Part], Part], Batches], every_pair: bool = False) -> DataFrame:
    """``kernel`` of every part of the queries and every part of the chunks. Where it puts out ``every_pair``, tasks are cut by
    their pairs, so that more rows make more tasks and not longer ones."""
    spark = chunks.sparkSession
    workers_see_package(spark)
    number = lambda c: F.transform(c, lambda x: x.cast("double"))
    has = lambda df: df.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    names = {"query_id": queries, "doc_id": chunks, "chunk_id": chunks}
    schema = ", ".join([*(f"{n} {df.schema[n].dataType.simpleString()}" for n, df in names.items()), "score double"])
    asks = has(queries).select("query_id", number("embedding").alias("embedding"))
    rows = has(chunks).select("doc_id", "chunk_id", number("embedding").alias("embedding"))
    n, numbers = asks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    if numbers <= SENT_NUMBERS:
        sent = spark.sparkContext.broadcast(asks.toArrow().to_batches())

        def run(batches: Batches) -> Batches:
            asked = list(_parts(iter(sent.value), 1))
            for part in _parts(batches, 2):
                yield from kernel(asked, part)

        if every_pair:
            pairs = n * rows.count()
            rows = rows.repartition(max(spark.sparkContext.defaultParallelism, min(MOST_TASKS, -(-pairs // TASK_PAIRS))))
        elif planned_bytes(rows) < SMALL_BYTES:
            rows = rows.repartition(spark.sparkContext.defaultParallelism)
        return rows.mapInArrow(run, schema)

    over, down = -(-n // QUERY_TILE), max(1, -(-rows.count() // (TASK_PAIRS // QUERY_TILE if every_pair else CHUNK_TILE)))
    of = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda c: F.lit(None).cast(names[c].schema[c].dataType).alias(c)
    left = asks.select("*", each(down).alias("at")).select((of(over, "query_id", "embedding") * down + F.col("at")).alias("tile"), F.lit(0).alias("kind"), "query_id", none("doc_id"), none("chunk_id"), "embedding")
    right = rows.select("*", each(over).alias("at")).select((F.col("at") * down + of(down, "chunk_id", "doc_id")).alias("tile"), F.lit(1).alias("kind"), none("query_id"), "doc_id", "chunk_id", "embedding")

    def run(batches: Batches) -> Batches:
        tile, asked = None, []
        for batch in batches:
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(of)]) if len(of) else ():
                if of[lo] != tile:
                    tile, asked = of[lo], []
                same = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    asked += _parts(iter([pa.RecordBatch.from_arrays([same.column(2), same.column(5)], ["query_id", "embedding"])]), 1)
                    continue
                for part in _parts(iter([pa.RecordBatch.from_arrays([same.column(3), same.column(4), same.column(5)], ["doc_id", "chunk_id", "embedding"])]), 2):
                    yield from kernel(asked, part)

    return left.unionByName(right).repartitionById(over * down, F.col("tile").cast("int")).sortWithinPartitions("tile", "kind").mapInArrow(run, schema)


def similarities(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, doc_id, chunk_id, score`` of every chunk for every query."""

    def every(asked: list[Part], part: Part) -> Batches:
        (docs, ids), vectors, norms = part
        for (names,), wanted, wanted_norms in asked:
            if wanted.shape[1] != vectors.shape[1]:
                continue
            for q in range(len(wanted)):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(vectors), q))), docs, ids, pa.array(_ratio(exact(vectors.T, wanted[q]), norms, wanted_norms[q]))], ["query_id", "doc_id", "chunk_id", "score"])

    return _joined(chunks, queries, every, every_pair=True)


def search(chunks: DataFrame, queries: DataFrame, top_k: int, options: SearchOptions = SearchOptions()) -> DataFrame:
    """``query_id, doc_id, chunk_id, score, source``: filter, threshold, then top k by (-score, doc, chunk)."""
    if options.filter_doc_id is not None:
        chunks = chunks.where(F.col("doc_id") == options.filter_doc_id)
    k, least = max(top_k, 0), options.min_score
    found = _joined(chunks, queries, lambda asked, part: _nearest(asked, part, k, least) if k else iter(()))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank").withColumn("source", F.lit("vector"))
