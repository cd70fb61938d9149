"""Co-occurrence counted by stripes: of each term the terms beside it, with counts.

A task counts the pairs of some chunks by a sort, and gives one row (a stripe) for each term that they hold; stripes
go to the bucket of their term and are added up there, a few million entries at a time. So what is shuffled are a few bytes of
a pair of terms that a task has seen, and not a row with two names. The ``COMMON`` most frequent terms stand in
stripes as two bytes each, the others by name. A store counts each pair at its rarer term, whose neighbours then nearly all
have two bytes; from these edges each term's first neighbours are found in the same form, of each few millions of edges the first alone.

What is shuffled grows with the pairs, so beyond ``ROUND_PAIRS`` they are counted in rounds. A round counts, in all chunks, the pairs of its own
sources (by their names' checksum) alone, so that no pair is counted twice, and each source's edges come whole."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.runtime import settle_freed, workers_see_package

#: Terms that have numbers (of two bytes); pairs that are counted, and entries that are added up, at once.
COMMON, PAIRS, ENTRIES = 1 << 16, 8_000_000, 4_000_000
#: Pairs of a bucket, about; most buckets.
BUCKET_PAIRS, MOST_BUCKETS = 8_000_000, 16_384
#: Pairs of a round, about: some 3 bytes of each are shuffled.
ROUND_PAIRS = 4_000_000_000
STRIPES = "bucket int, source string, ids binary, n binary, rare array<string>, rare_n binary"
#: A round: which one, of how many.
Round = tuple[int, int]
WHOLE: Round = (0, 1)
Batches = Iterator[pa.RecordBatch]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values cut at ``ends``, as bytes."""
    at = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of ``_binary``, and how many each row has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return values, np.diff(at) // np.dtype(kind).itemsize


def _stripes(bucket: pa.Array, source: pa.Array, ends: np.ndarray, ids: np.ndarray, n: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """Rows of stripes: of each source its entries up to its end. ``ids``: below ``COMMON``, or beyond it places in ``names``."""
    few = ids < COMMON
    cut = np.concatenate([[0], np.cumsum(few)])[ends]
    rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends - cut]).astype(np.int32)), names.take(pa.array(ids[~few] - COMMON)))
    return pa.RecordBatch.from_arrays([bucket, source, _binary(ids[few].astype("<u2"), cut), _binary(n[few].astype("<u4"), cut), rare, _binary(n[~few].astype("<u4"), ends - cut)], ["bucket", "source", "ids", "n", "rare", "rare_n"])


def _pairs(codes: np.ndarray, sizes: np.ndarray, bits: int, both: bool, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unlike codes of one chunk each, as numbers (the first one's code above ``bits``), and how often each is there.
    ``chosen``: of each code whether its pairs are counted where it comes first."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    codes = codes[np.lexsort((codes, owner))].astype(np.int64)
    end = np.cumsum(sizes)[owner]
    begin = end - sizes[owner] if both else np.arange(1, len(codes) + 1)
    if chosen is not None:
        mine = chosen[codes]
        left, begin, end = codes[mine], begin[mine], end[mine]
    else:
        left = codes
    n = end - begin
    first = np.repeat(left, n)
    second = codes[np.arange(len(first)) + np.repeat(begin - (np.cumsum(n) - n), n)]
    apart = first != second
    if not apart.all():
        first, second = first[apart], second[apart]
    return np.unique((first << bits) | second, return_counts=True)


def _numbered(names: pa.Array, common: pa.Array) -> np.ndarray:
    """The numbers of ``names`` in stripes: beyond ``COMMON`` their places."""
    number = pc.fill_null(pc.index_in(names, value_set=common), -1).to_numpy().astype(np.int64)
    return np.where(number < 0, COMMON + np.arange(len(number)), number)


def _chosen(names: pa.Array, which: Round) -> np.ndarray | None:
    nth, of = which
    return None if of == 1 else np.fromiter((zlib.crc32(x.as_buffer()) % of == nth for x in names), bool, len(names))


def _gathered(batches: Batches, pairs: int) -> Iterator[pa.ListArray]:
    """Arrays of terms of some batches together, of about so many pairs at least."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0))
        n += int((np.diff(batch.column(0).offsets.to_numpy()).astype(np.int64) ** 2).sum())
        if n >= pairs:
            yield pa.concat_arrays(held)
            held, n = [], 0
    if held:
        yield pa.concat_arrays(held)


def _counted(batches: Batches, common: pa.Array, both: bool, rare_first: bool, pairs: int, which: Round = WHOLE) -> Batches:
    pairs = pairs * which[1] // (2 if both else 1)  # of which a round counts its share
    for lists in _gathered(batches, pairs):
        size = np.diff(lists.offsets.to_numpy())
        at = np.concatenate([[0], np.cumsum(size.astype(np.int64) ** 2)])
        lo = 0
        while lo < len(lists):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + pairs, side="right")) - 1)
            part, sizes = lists.slice(lo, hi - lo).flatten().dictionary_encode(), size[lo:hi]
            lo = hi
            order = pc.sort_indices(part.dictionary).to_numpy()  # by bytes, as Spark orders strings
            if rare_first:  # names without a number in their order, then the others, the most frequent last
                number = _numbered(part.dictionary.take(pa.array(order)), common)
                order = order[np.argsort(-np.minimum(number, COMMON), kind="stable")]
            names, rank = part.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            bits = max(1, len(order)).bit_length()
            key, n = _pairs(rank[part.indices.to_numpy()], sizes, bits, both, _chosen(names, which))
            if not len(key):
                continue
            source, target = key >> bits, key & ((1 << bits) - 1)
            number = _numbered(names, common)
            ends = np.append(np.flatnonzero(np.diff(source)) + 1, len(source))
            yield _stripes(pa.array(np.zeros(len(ends), np.int32)), names.take(pa.array(source[ends - 1])), ends, number[target], n, names)


def _added(rows: pa.RecordBatch, common: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Sources in order, and entries: place of the source, number and sum; names of the numbers beyond ``COMMON``."""
    source = rows.column(1).dictionary_encode()
    place = source.indices.to_numpy().astype(np.int64)
    ids, few = _numbers(rows.column(2), "<u2")
    rare = rows.column(4).flatten().dictionary_encode()
    more = np.diff(rows.column(4).offsets.to_numpy())
    key = np.concatenate([(np.repeat(place, few) << 32) | ids.astype(np.int64), (np.repeat(place, more) << 32) | (rare.indices.to_numpy().astype(np.int64) + COMMON)])
    n = np.concatenate([_numbers(rows.column(3), "<u4")[0], _numbers(rows.column(5), "<u4")[0]]).astype(np.int64)
    low, high = (COMMON + len(rare.dictionary)).bit_length(), max(1, len(source.dictionary)).bit_length()
    most = (1 << (63 - low - high)) - 1
    if len(n) and n.max() <= most:  # as one number, which sorts several times as fast
        spare = 63 - low - high
        key = np.sort(((key >> 32) << (63 - high)) | ((key & 0xFFFFFFFF) << spare) | n)
        n, key = key & most, key >> spare
        key = ((key >> low) << 32) | (key & ((1 << low) - 1))
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    return source.dictionary, key[begin] >> 32, key[begin] & 0xFFFFFFFF, np.add.reduceat(n, begin) if len(begin) else n, rare.dictionary


def _edges(rows: pa.RecordBatch, common: pa.Array, prefix: int, last: bool, told: bool = False) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The edges of all sources of ``rows`` but, unless ``last``, the greatest one, whose sums so far are given as a stripe (False).
    ``told``: of each source one row, with the number of its edges, their sum and the greatest."""
    sources, place, ids, n, rare = _added(rows, common)
    bucket = rows.column(0).take(pa.array(np.flatnonzero(np.diff(rows.column(1).dictionary_encode().indices.to_numpy(), prepend=-1))))
    end = len(place) if last else int(np.searchsorted(place, len(sources) - 1))
    names = pa.concat_arrays([common, pa.nulls(COMMON - len(common), pa.string()), rare])
    if end < len(place):
        yield False, _stripes(bucket.slice(len(bucket) - 1), sources.slice(len(sources) - 1), np.array([len(place) - end]), ids[end:], n[end:], rare)
    place, ids, n = place[:end], ids[:end], n[:end]
    if told:
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        if len(begin):
            edges = np.diff(np.append(begin, end))
            yield True, pa.RecordBatch.from_arrays([sources.take(pa.array(place[begin])), pa.array(edges), pa.array(np.add.reduceat(n, begin)), pa.array(np.maximum.reduceat(n, begin))], ["source", "edges", "weight", "heaviest"])
        return
    nth = np.zeros(end, np.int32)
    if prefix:
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        order = np.lexsort((rank[ids], -n, place))
        place, ids, n = place[order], ids[order], n[order]
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        nth = (np.arange(end) - np.repeat(begin, np.diff(np.append(begin, end))) + 1).astype(np.int32)
    for lo in range(0, end, COMMON):
        at = pa.array(place[lo : lo + COMMON])
        yield True, pa.RecordBatch.from_arrays([bucket.take(at), sources.take(at), names.take(pa.array(ids[lo : lo + COMMON])), pa.array(n[lo : lo + COMMON]), pa.array(np.minimum(nth[lo : lo + COMMON], prefix + 1).astype(np.int32))], ["bucket", "source", "target", "n", "place"])


def _summed(batches: Batches, common: pa.Array, prefix: int, most: int, told: bool = False) -> Batches:
    """Edges of stripes that come in order of their source."""
    held, entries = [], 0

    def out(last: bool) -> Batches:
        nonlocal held, entries
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held, entries = [], 0
        for done, part in _edges(rows, common, prefix, last, told):
            if done:
                yield part
            else:
                held, entries = [part], len(part.column(4).values) + len(_numbers(part.column(2), "<u2")[0])

    for batch in batches:
        ends = np.cumsum(_numbers(batch.column(2), "<u2")[1] + np.diff(batch.column(4).offsets.to_numpy())) if len(batch) else np.zeros(0)
        lo = 0
        while lo < len(batch):  # a few millions of entries, or one row
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
            held.append(batch.slice(lo, hi - lo))
            entries += int(ends[hi - 1] - before)
            lo = hi
            if entries >= most:
                yield from out(False)
    if held:
        yield from out(True)


def _firsts(edges: pa.Table, common: pa.Array, prefix: int) -> pa.RecordBatch:
    """Stripes of some edges (two names and n, each pair once), seen from both ends: of each term its first ``prefix`` by (-n, name)."""
    ends = pa.chunked_array([*edges.column(0).chunks, *edges.column(1).chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    names, rank = ends.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    source = rank[ends.indices.to_numpy()]
    target, n = np.roll(source, len(edges)), np.tile(edges.column(2).to_numpy(), 2)
    bits = max(1, len(names)).bit_length()
    most = (1 << (63 - 2 * bits)) - 1
    if n.max() <= most:  # as one number, which sorts several times as fast
        key = np.sort((((source << (63 - 2 * bits)) | (most - n)) << bits) | target)
        source, n, target = key >> (63 - bits), most - ((key >> bits) & most), key & ((1 << bits) - 1)
    else:
        order = np.lexsort((target, -n, source))
        source, target, n = source[order], target[order], n[order]
    begin = np.flatnonzero(np.diff(source, prepend=-1))
    kept = np.arange(len(source)) - np.repeat(begin, np.diff(np.append(begin, len(source)))) < prefix
    source, target, n = source[kept], target[kept], n[kept]
    cuts = np.append(np.flatnonzero(np.diff(source)) + 1, len(source))
    return _stripes(pa.array(np.zeros(len(cuts), np.int32)), names.take(pa.array(source[cuts - 1])), cuts, _numbered(names, common)[target], n, names)


def _first_of(batches: Batches, common: pa.Array, prefix: int, most: int) -> Batches:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            yield _firsts(pa.Table.from_batches(held), common, prefix)
            held, rows = [], 0
    if rows:
        yield _firsts(pa.Table.from_batches(held), common, prefix)


def total(chunks: DataFrame) -> int:
    """Pairs of places in the arrays of ``chunks``."""
    n = F.size("terms").cast("bigint")
    return chunks.agg(F.coalesce(F.sum(F.when(n > 1, n * (n - 1) / 2).cast("bigint")), F.lit(0))).first()[0]


def buckets_for(pairs: int) -> int:
    return max(1, min(MOST_BUCKETS, pairs // BUCKET_PAIRS))


def rounds_for(pairs: int) -> list[Round]:
    n = max(1, -(-pairs // ROUND_PAIRS))
    return [(i, n) for i in range(n)]


def bucket_of(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def commonest(counts: DataFrame) -> pa.Array:
    """The names of the ``COMMON`` most frequent terms of ``counts`` (term, count)."""
    top = counts.orderBy(F.desc("count"), "term").limit(COMMON)
    return pa.array([r["term"] for r in top.select("term").collect()], pa.string())


def _added_up(stripes: DataFrame, buckets: int, sent, prefix: int, told: bool = False) -> DataFrame:
    entries = ENTRIES
    dealt = stripes.withColumn("bucket", bucket_of("source", buckets)).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "source")
    schema = "source string, edges bigint, weight bigint, heaviest bigint" if told else "bucket int, source string, target string, n bigint, place int"
    return dealt.mapInArrow(lambda batches: _summed(batches, sent.value, prefix, entries, told), schema)


def counted(chunks: DataFrame, buckets: int, both: bool = False, prefix: int = 0, rare_first: bool = False, common: pa.Array | None = None, which: Round = WHOLE, told: bool = False) -> DataFrame:
    """``bucket, source, target, n, place`` of every pair of terms that a chunk of ``chunks`` (terms) holds, in order of the
    bucket: source < target, or each pair ``both`` ways, or (``rare_first``) from its rarer term, by ``common``. ``place``: of the first
    ``prefix`` of a source by (-n, target) their places, of the others a greater number. ``which``: of one round's sources alone. ``told``: of each
    source ``source, edges, weight, heaviest`` instead (how many edges, their sum, the greatest)."""
    spark, pairs = chunks.sparkSession, PAIRS
    workers_see_package(spark)
    held = chunks.select(F.array_compact("terms").alias("terms")).where(F.size("terms") > 1)
    if common is None:
        common = commonest(held.select(F.explode("terms").alias("term")).groupBy("term").count())
    sent = spark.sparkContext.broadcast(common)  # COMMON names at most
    stripes = held.mapInArrow(lambda batches: _counted(batches, sent.value, both, rare_first, pairs, which), STRIPES)
    return _added_up(stripes, buckets, sent, prefix, told)


def by_source(chunks: DataFrame) -> DataFrame:
    """``source, edges, weight, heaviest`` of all edges from source to a greater term. It is counted now, in rounds, of each of which a
    row of each source is left."""
    n = total(chunks)
    rounds = rounds_for(n)
    common = commonest(chunks.select(F.explode(F.array_compact("terms")).alias("term")).groupBy("term").count())
    return reduce(DataFrame.unionByName, [settle_freed(counted(chunks, buckets_for(n // len(rounds)), common=common, which=r, told=True)) for r in rounds])


def firsts(edges: DataFrame, buckets: int, prefix: int, common: pa.Array) -> DataFrame:
    """The same columns: of every term of ``edges`` (two terms and n, each pair once) its first ``prefix`` neighbours. What is
    among the first of all is among the first of the edges that a task sees at once, so that no more goes on."""
    spark, most = edges.sparkSession, ENTRIES // 2
    workers_see_package(spark)
    sent = spark.sparkContext.broadcast(common)
    return _added_up(edges.mapInArrow(lambda batches: _first_of(batches, sent.value, prefix, most), STRIPES), buckets, sent, prefix).where(F.col("place") <= prefix)
