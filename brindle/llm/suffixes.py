"""Suffix-array dedup: bytes of passages that occurred before are removed.

A byte goes if a ``WINDOW``-byte string that covers it also starts earlier (smaller id, or earlier in
the same text). Building the transform of all texts column by column takes as many rounds as the
longest text has bytes, each over all that was built. So the collection is cut first, without loss:

1. Every window has an anchor, its leftmost K-mer of smallest hash, fixed by the window's bytes alone.
   An anchor's surroundings hold all windows that it can be the anchor of. Anchors with equal
   surroundings are resolved by their hashes: all but the first are covered throughout.
2. What is left are anchors that occur with unlike surroundings. These short strings, aligned at their
   anchors, are the documents of the column-wise construction: from the last column to the first, one
   symbol of each string is inserted in a round, which updates the order of the suffixes (a stable sort
   by the new symbol) and the common prefixes of neighbours (the least of those between two equal
   symbols, plus one). Runs of common prefixes of WINDOW or more are equal windows; all but a run's
   earliest are removed. Columns lie one after the other and are read in sequence, from files of the
   task once a bin is larger than ``BIN`` strings; strings are appended to them as they come.
3. An anchor with more than ``MOST`` strings would be a bin without a bound. Its windows are compared one
   by one instead, by hash, with the same result.

Texts are shuffled once; positions return to them by id.

Defined cases: a null text is the empty text; a text shorter than the window loses nothing; ids are whole
numbers; rows with the same id and text aren't earlier than each other, and of unlike texts under one
id the one with the smaller hash is earlier; a row without an id takes no part and loses nothing; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, scratch, settle, whole

WINDOW, K = 100, 32
#: K-mers of a window; bytes of an anchor's surroundings.
SPREAD = WINDOW - K + 1
AROUND = SPREAD - 1 + WINDOW
#: Strings of a bin whose columns are in memory; strings of one anchor that a bin takes.
BIN, MOST = 60_000, 1 << 20
#: Of the texts one in so many is sampled for common anchors; a name with a HOT-th of the sample's, and over FEW, is hot.
SAMPLED, HOT, FEW = 64, 512, 16
#: Tasks that the places of one window are dealt to.
SALTS = 16
#: Bytes of a text that are looked at together (pieces overlap by a window).
PIECE = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PLACE = np.uint64((1 << 24) - 1)


def _up_down(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << max(12, n.bit_length())
        for i, x in enumerate((np.uint64(_BASE), _BACK)):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, x, np.uint64))])
    return [p[:n] for p in _powers]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, their K-mers' hashes, and hashes of their surroundings."""
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    places = []
    with np.errstate(over="ignore"):
        up, down = _up_down(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n])])
        for lo in range(0, n - WINDOW + 1, PIECE):
            hi = min(n, lo + PIECE + WINDOW - 1)
            m = hi - lo - K + 1
            h = _mix((total[lo + K : hi + 1] - total[lo : lo + m]) * down[lo : lo + m])
            key = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
            low, have = key, 1
            while have * 2 <= SPREAD:
                low, have = np.minimum(low[:-have], low[have:]), have * 2
            windows = m - SPREAD + 1
            low = np.minimum(low[:windows], low[SPREAD - have : SPREAD - have + windows])
            places.append(np.unique(low & _PLACE).astype(np.int64) + lo)
        at = np.unique(np.concatenate(places)) if len(places) > 1 else places[0]
        name = _mix((total[at + K] - total[at]) * down[at])
        left, right = np.maximum(at - (SPREAD - 1), 0), np.minimum(at + WINDOW, n)
        around = _mix((total[right] - total[left]) * down[left] + _mix(((at - left) * 1024 + right - at).astype(np.uint64)))
    return at, name, np.where(around == 0, np.uint64(1), around)


def _runs(begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals, by owner; given in any order."""
    if not len(begin):
        return owner, begin, end
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    _, nth = np.unique(owner, return_inverse=True)
    step = int(end.max()) + 2
    far = np.maximum.accumulate(end + nth * step) - nth * step
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (begin[1:] > far[:-1])])
    first = np.flatnonzero(fresh)
    return owner[first], begin[first], np.maximum.reduceat(end, first)


def repeated_windows(columns: np.ndarray | Files, left: np.ndarray, right: np.ndarray, order_of: np.ndarray) -> list[np.ndarray]:
    """For each offset 0 to SPREAD - 1, the strings whose window there has an earlier equal.

    ``columns`` [AROUND, strings]; string i is real from column ``left[i]`` to ``right[i]``; of equal
    windows the one with the least ``order_of`` is the earliest."""
    width, n = columns.shape
    order, common = np.arange(n), np.full(n, 0, np.int64)  # common[i]: of order[i - 1] and order[i]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * SPREAD
    for j in range(width - 1, -1, -1):
        symbol = np.asarray(columns[j])[order]
        moved = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[moved]
        same = np.flatnonzero(sorted_symbol[1:] == sorted_symbol[:-1]) + 1
        fresh = np.zeros(n, np.int64)
        if len(same):
            if j == width - 1:
                fresh[same] = 1
            else:
                spans = np.empty(2 * len(same), np.int64)
                spans[::2], spans[1::2] = moved[same - 1] + 1, moved[same] + 1
                fresh[same] = 1 + np.minimum.reduceat(np.append(common, 0), spans)[::2]
        order, common = order[moved], fresh
        if j < SPREAD:
            first = np.flatnonzero(common < WINDOW)
            real = (left[order] <= j) & (right[order] >= j + WINDOW)
            place = np.where(real, order_of[order], np.iinfo(np.int64).max)
            earliest = np.repeat(np.minimum.reduceat(place, first), np.diff(np.append(first, n)))
            out[j] = order[real & (place > earliest)]
    return out


class Files:
    """Columns that lie one after the other in files of the task, one for each symbol of the strings. Strings are
    appended as they come; a round reads one column, from its beginning to its end."""

    def __init__(self):
        self.folder = tempfile.TemporaryDirectory()
        self.files = [open(f"{self.folder.name}/{j}", "wb", 1 << 14) for j in range(AROUND)]
        self.shape = (AROUND, 0)

    def add(self, flat: np.ndarray) -> None:
        for column, file in zip(flat.T, self.files):
            file.write(column.tobytes())
        self.shape = (AROUND, self.shape[1] + len(flat))

    def __getitem__(self, j: int) -> np.ndarray:
        self.files[j].flush()
        return np.fromfile(f"{self.folder.name}/{j}", np.uint8)

    def close(self) -> None:
        for file in self.files:
            file.close()
        self.folder.cleanup()


class Bin:
    """Strings of some anchors; their columns are in memory up to ``limit`` strings, beyond that in files. A bin has
    at most ``MOST`` strings of one anchor, and so its order and common prefixes are bounded."""

    def __init__(self, limit: int = BIN):
        self.limit = limit
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.flat: list[np.ndarray] = []
        self.files: Files | None = None
        self.size = 0

    def add(self, *row: np.ndarray) -> None:
        """Ids, positions, first and last columns, and the strings as rows of bytes."""
        self.rows.append(row[:4])
        self.size += len(row[0])
        if self.files is None and self.size > self.limit:
            self.files = Files()
            for flat in self.flat:
                self.files.add(flat)
            self.flat = []
        if self.files is None:
            self.flat.append(row[4])
        else:
            self.files.add(row[4])

    def resolve(self) -> pa.RecordBatch:
        ids, at, left, right = (np.concatenate([r[i] for r in self.rows]) for i in range(4))
        by = np.lexsort((at, ids))
        place = np.empty(len(ids), np.int64)
        place[by] = np.concatenate([[0], np.cumsum((np.diff(ids[by]) != 0) | (np.diff(at[by]) != 0))])  # the same place of the same id is one place
        columns = self.files or np.ascontiguousarray(np.concatenate(self.flat).T)
        self.flat = []
        found = repeated_windows(columns, left, right, place)
        if self.files:
            self.files.close()
        who = np.concatenate(found)
        offset = np.repeat(np.arange(SPREAD), [len(x) for x in found])
        begin = at[who] - (SPREAD - 1) + offset
        return _intervals(*_runs(begin, begin + WINDOW, ids[who]))


def _intervals(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int64)), pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64))], ["id", "begin", "end"])


INTERVALS = "id bigint, begin bigint, end bigint"


def anchored(docs: DataFrame) -> DataFrame:
    """``name, around, id, place`` of all anchors (place: position x 128 + bytes to the right, at most
    WINDOW). Anchors that a batch has resolved are intervals: around 0, name at random, the interval
    in place as begin x 2^31 + length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            parts = []
            for i, t in zip(ids, texts):
                raw = t.encode()
                at, name, around = anchors(raw)
                parts.append((name, around, np.full(len(at), i), at, np.minimum(len(raw) - at, WINDOW)))
            name, around, who, at, right = (np.concatenate([p[k] for p in parts]) for k in range(5))
            if not len(name):
                continue
            order = np.lexsort((at, who, around, name))
            name, around, who, at, right = name[order], around[order], who[order], at[order], right[order]
            same = np.concatenate([[False], (name[1:] == name[:-1]) & (around[1:] == around[:-1])])
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(name))))
            later = same & ((who != who[first]) | (at != at[first]))
            left = np.minimum(at, SPREAD - 1)
            o, b, e = _runs((at - left)[later], (at + right)[later], who[later])
            keep = ~same
            with np.errstate(over="ignore"):
                scattered = _mix(o.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([name[keep], scattered]).view(np.int64)), pa.array(np.concatenate([around[keep], np.zeros(len(o), np.uint64)]).view(np.int64)),
                pa.array(np.concatenate([who[keep], o]).astype(np.int64)), pa.array(np.concatenate([at[keep] * 128 + right[keep], (b << 31) + (e - b)]).astype(np.int64)),
            ], ["name", "around", "id", "place"])

    return docs.mapInArrow(run, "name bigint, around bigint, id bigint, place bigint")


def _dealt(named: DataFrame) -> DataFrame:
    """``name, around, id, place, hot`` of all anchors, each name in one task and in order (name, around, id, place). A name
    that is common in a sample of the texts is ``hot``: it is dealt by its surroundings, so that equal ones still
    meet, and no task holds all of it. Which names are hot changes no result."""
    found = anchored(named)
    some = anchored(named.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)).where("around <> 0").groupBy("name").count()
    n = some.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = some.where(F.col("count") > max(FEW, n // HOT)).select("name").limit(HOT).collect()  # HOT names at most have that share
    hot = F.col("name").isin([r["name"] for r in often]) if often else F.lit(False)
    rows = found.withColumn("hot", hot & (F.col("around") != 0)).withColumn("salt", F.when(F.col("hot"), F.col("around")).otherwise(0))
    return rows.repartition("name", "salt").sortWithinPartitions("name", "around", "id", "place").select("name", "around", "id", "place", "hot")


def _split(rows: DataFrame) -> DataFrame:
    """From rows in order (name, around, id, place): intervals (name null, begin, end), and anchors that
    occur with unlike surroundings, or are hot (name, begin: their position, end: bytes to the right)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last first-of-its-surroundings: name, around, id, place, hot, already told
        for batch in batches:
            name, around, who, place, hot = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if last is not None:
                name, around, who, place, hot = (np.concatenate([[x], y]) for x, y in zip(last[:5], (name, around, who, place, hot)))
            done = around == 0
            same = np.concatenate([[False], (name[1:] == name[:-1]) & (around[1:] == around[:-1])]) & ~done
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(name))))
            later = same & ((who != who[first]) | (place != place[first]))
            at, right = place >> 7, place & 127
            begin = np.concatenate([(at - np.minimum(at, SPREAD - 1))[later], (place >> 31)[done]])
            end = np.concatenate([(at + right)[later], ((place >> 31) + (place & ((1 << 31) - 1)))[done]])
            o, b, e = _runs(begin, end, np.concatenate([who[later], who[done]]))
            heads = np.flatnonzero(~same & ~done)
            tell = np.zeros(0, np.int64)
            if len(heads):
                hn = name[heads]
                like = hn[1:] == hn[:-1]
                unlike = np.concatenate([[False], like]) | np.concatenate([like, [False]]) | hot[heads]
                told = last is not None and last[5] and heads[0] == 0
                tell = heads[unlike & ~(told & (np.arange(len(heads)) == 0))]
                h = heads[-1]
                last = (name[h], around[h], who[h], place[h], bool(hot[h]), bool(unlike[-1]) or (told and len(heads) == 1))
            yield pa.RecordBatch.from_arrays([
                pa.array([None] * len(o) + name[tell].tolist(), pa.int64()), pa.array(np.concatenate([o, who[tell]]).astype(np.int64)),
                pa.array(np.concatenate([b, at[tell]]).astype(np.int64)), pa.array(np.concatenate([e, right[tell]]).astype(np.int64)),
            ], ["name", "id", "begin", "end"])

    return rows.mapInArrow(run, "name bigint, id bigint, begin bigint, end bigint")


def _surroundings(texts: DataFrame) -> DataFrame:
    """``name, id, at, first, last, bytes`` of every anchor of ``texts`` (id, text, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for who, text, found in zip(*[batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("id", "text", "anchors")]):
                raw = text.encode()
                for a in found:
                    at = a["begin"]
                    left, right = max(0, at - SPREAD + 1), min(len(raw), at + WINDOW)
                    first = SPREAD - 1 - (at - left)
                    out.append((a["name"], who, at, first, first + right - left, (b"\0" * first + raw[left:right]).ljust(AROUND, b"\0")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()])], ["name", "id", "at", "first", "last", "bytes"])

    return texts.mapInArrow(run, "name bigint, id bigint, at bigint, first int, last int, bytes binary")


def _resolved(strings: DataFrame) -> DataFrame:
    """Intervals of repeated windows among strings in order of their names."""

    limit = BIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bin_, last = Bin(limit), None
        for batch in batches:
            name = batch.column(0).to_numpy()
            rows = [batch.column(i).to_numpy() for i in range(1, 5)]
            flat = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, AROUND)
            cut = np.flatnonzero(np.concatenate([[name[0] != last], name[1:] != name[:-1]]))
            # a bin may end where a name begins
            k = 0
            for c in cut:
                if bin_.size + c - k > limit:
                    if c > k:
                        bin_.add(*[r[k:c] for r in rows], flat[k:c])
                    if bin_.size:
                        yield bin_.resolve()
                    bin_, k = Bin(limit), c
            if k < len(name):
                bin_.add(*[r[k:] for r in rows], flat[k:])
            last = name[-1]
        if bin_.size:
            yield bin_.resolve()

    return strings.mapInArrow(run, INTERVALS)


def _kept(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(*[batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("text", "spans")]):
                raw = text.encode()
                pairs = np.array([(s["begin"], s["end"]) for s in spans or []], np.int64).reshape(-1, 2)
                _, begin, end = _runs(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))
                rest, at = [], 0
                for b, e in zip(begin.tolist(), end.tolist()):
                    rest.append(raw[at:b])
                    at = e
                rest.append(raw[at:])
                out.append((len(raw), int((end - begin).sum()), len(begin), b"".join(rest)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def _by_windows(strings: DataFrame) -> DataFrame:
    """The same intervals for anchors too common for a bin: each window of their strings by two 64-bit hashes, of
    which the earliest place is found with partial sums, so that no task holds an anchor or a window."""
    last = F.least(F.col("last") - WINDOW, F.lit(SPREAD - 1))
    rows = strings.where(F.col("first") <= last).select("id", "at", "bytes", F.explode(F.sequence("first", last)).alias("offset"))
    window = F.col("bytes").substr(F.col("offset") + 1, F.lit(WINDOW))
    begin = F.col("at") - (SPREAD - 1) + F.col("offset")
    placed = rows.select("id", begin.alias("begin"), F.xxhash64(F.lit(1), window).alias("h"), F.xxhash64(F.lit(2), window).alias("g"))
    first = placed.groupBy("h", "g").agg(F.min(F.struct("id", "begin")).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salted = first.select("h", "g", "earliest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    again = placed.withColumn("salt", F.pmod(F.xxhash64("id", "begin"), F.lit(SALTS)).cast("int")).join(salted, ["h", "g", "salt"])
    return again.where(F.struct("id", "begin") != F.col("earliest")).select("id", "begin", (F.col("begin") + WINDOW).alias("end"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``id, text`` of the rows with an id. ``id`` is the document's own, unless some id names unlike texts: then
    texts are numbered in order of id and hash, so that spans of one never reach another, and there is ``doc_id`` too."""
    named = docs.where("doc_id is not null")
    tagged = named.select("doc_id", F.xxhash64("text").alias("tag"))
    if not tagged.groupBy("doc_id").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a <> b").limit(1).count():
        return named.select(F.col("doc_id").alias("id"), "text")
    numbers = settle(tagged.distinct().orderBy("doc_id", "tag").withColumn("id", F.monotonically_increasing_id()))  # grows with the order
    return named.withColumn("tag", F.xxhash64("text")).join(numbers, ["doc_id", "tag"]).select("doc_id", "id", "text")


def repeats(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``named`` (id, text and maybe doc_id) dealt by id, and the repeated intervals: ``id, begin, end, way`` (0: equal
    surroundings, 1: the column-wise construction, 2: windows of anchors too common for it)."""
    spark = named.sparkSession
    path = scratch(spark, "anchors")
    _split(_dealt(named.select("id", "text"))).write.parquet(path)
    split = spark.read.parquet(path)
    texts = named.repartition("id")  # the same exchange for both joins, so both take all of its columns
    unlike = split.where("name is not null").groupBy("id").agg(F.collect_list(F.struct("name", "begin")).alias("anchors"))
    strings = _surroundings(texts.join(unlike, "id"))
    common = split.where("name is not null").groupBy("name").count().where(F.col("count") > MOST).select("name")
    parts = [split.where("name is null").select("id", "begin", "end", F.lit(0).alias("way"))]
    if common.limit(1).count():
        whole_path = scratch(spark, "surroundings")
        strings.write.parquet(whole_path)
        strings = spark.read.parquet(whole_path)
        parts.append(_by_windows(strings.join(common, "name", "left_semi")).withColumn("way", F.lit(2)))
        strings = strings.join(common, "name", "left_anti").select("name", "id", "at", "first", "last", "bytes")
    parts.append(_resolved(strings.repartition("name").sortWithinPartitions("name")).withColumn("way", F.lit(1)))
    return texts, reduce(DataFrame.unionByName, parts)


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay) of every row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"))
    texts, found = repeats(_keyed(docs))
    by_text = found.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    rest = docs.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<begin:bigint,end:bigint>>"))
    return _kept(texts.join(by_text, "id", "left").select(F.col("doc_id" if "doc_id" in texts.columns else "id").alias("doc_id"), "text", "spans").unionByName(rest))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: What op8 returns: every window of 100 bytes (200 digits) but the first of its kind covers what goes.
ORACLE = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS w
  FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM texts)),
 numbered AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM windows),
 again AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true)::INT AS fresh
  FROM numbered WHERE nth > 1),
 runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM again) GROUP BY doc_id, run),
 kept AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM runs),
 cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
   string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM kept JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
 coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)"""
