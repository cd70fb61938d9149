"""What an index keeps by term: postings, document frequencies, edges of co-occurrence, first neighbours.

Each is a few Parquet folders (runs) in buckets of terms. The first run holds what was there when it was written; every
later write adds one of signed rows, made from the chunks that it took away and put: what is live is the sum over the runs.
When the rows of the later runs are over ``SHARE`` of the first, all become a new first run. A search joins
with the buckets of its own terms, and Spark prunes the others when it runs.

The first run of edges has each pair once, at its rarer term, and no more than that: it is for all edges, and what first neighbours come from.
Later ones have it both ways, to be looked up. Where first neighbours stand ``alone``, the first run of edges isn't kept: all edges are then
counted from the chunks when they are asked for, and later runs alone stand under edges.

Of each term the first ``PREFIX`` neighbours (by weight, then name) are kept apart from the edges. Later runs may
lower these, and may raise others that aren't kept; none of those can weigh more than the last one kept plus the most that a later
run gives to any of them. Neighbours above that bound are certain, so that a term's chunks are counted again
only when fewer of them are certain than the search needs.

Edges are counted by stripes (``operators.stripes``). Where a write changes over ``SHARE``, they are counted from the chunks
that are live then, which is less than to add signed rows to all that there are. A large first run is written in rounds, each of its own terms,
and what a round shuffles is gone before the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import stripes
from brindle.operators.batch import sized
from brindle.runtime import freed_shuffles, settle

KEYS = {"postings": ["term", "chunk_id", "doc_id"], "counts": ["term"], "edges": ["term", "neighbour"]}
SCHEMAS = {
    "postings": "term string, chunk_id string, doc_id string, n bigint",
    "counts": "term string, n bigint, docs bigint",
    "edges": "term string, neighbour string, n bigint",
    "near": "term string, neighbour string, n bigint, place int",
}
#: Rows of a bucket, about, and most buckets; beyond that a bucket has more files.
BUCKET_ROWS = {"postings": 65_536, "counts": 65_536, "edges": 1_000_000, "near": 65_536}
MOST_BUCKETS = 4_096
#: Rows that are dealt to buckets at once.
ROUND_ROWS = 200_000_000
#: Neighbours that are kept of each term; later runs' share of the first run's rows from which they are merged.
PREFIX, SHARE = 64, 0.25
#: Bytes of a file's dictionary: room for the numbered terms' names.
DICTIONARY = 4 << 20

Run = dict  # kind, name, buckets, rows; once: of edges that stand there one way (rows counts them both ways); alone: of first neighbours without a first run of edges


def folder_of(run: Run) -> str:
    return f"{run['kind']}/run={run['name']}"


def _edges(chunks: DataFrame) -> DataFrame:
    """``term, neighbour, n`` of every pair of terms that a chunk holds: counted one way, and put out both ways."""
    pairs = chunks.select("terms", F.explode("terms").alias("a")).select("a", F.explode("terms").alias("b")).where("a < b")
    ends = F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("term"), F.col("a").alias("neighbour")))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select(F.inline(ends), "n")


def rows_of(kind: str, chunks: DataFrame) -> DataFrame:
    """The rows of ``kind`` that ``chunks`` (chunk_id, doc_id, terms) alone give."""
    if kind == "edges":
        return _edges(chunks)
    held = chunks.select("chunk_id", "doc_id", F.explode("terms").alias("term"))
    if kind == "postings":
        return held.select("term", "chunk_id", "doc_id", F.lit(1).cast("bigint").alias("n"))
    return held.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def summed(kind: str, rows: DataFrame) -> DataFrame:
    """Signed rows added up; what cancels out goes."""
    numbers = [c for c in rows.columns if c in ("n", "docs")]
    out = rows.groupBy(*KEYS[kind]).agg(*(F.sum(c).alias(c) for c in numbers))
    return out.where(" or ".join(f"{c} <> 0" for c in numbers))


def changes(kind: str, new: DataFrame, old: DataFrame) -> DataFrame:
    """The signed rows of a write that puts the chunks ``new`` in the place of ``old``."""
    minus = rows_of(kind, old)
    minus = minus.select(*((-F.col(c)).alias(c) if c in ("n", "docs") else F.col(c) for c in minus.columns))
    return summed(kind, rows_of(kind, new).unionByName(minus))


class TermTables:
    """The runs in ``path`` that a commit names."""

    def __init__(self, spark: SparkSession, path: str, runs: list[Run]):
        self.spark, self.path, self.runs = spark, path, runs

    def of(self, kind: str) -> list[Run]:
        return [r for r in self.runs if r["kind"] == kind]

    def alone(self) -> bool:
        """Whether first neighbours are kept without all edges."""
        return any(r.get("alone") for r in self.of("near"))

    def _later(self) -> list[Run]:
        """The runs of edges that first neighbours don't have."""
        return self.of("edges") if self.alone() else self.of("edges")[1:]

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")

    @staticmethod
    def _buckets(kind: str, about: int) -> int:
        return max(1, min(MOST_BUCKETS, about // BUCKET_ROWS[kind]))

    def put(self, kind: str, rows: DataFrame, about: int) -> Run:
        """Writes a run of about so many rows. Spark splits large buckets, so that no task holds one."""
        buckets, rounds = self._buckets(kind, about), max(1, min(self._buckets(kind, about), -(-about // ROUND_ROWS)))
        names = [x.split()[0] for x in SCHEMAS[kind].split(", ")]
        dealt = rows.withColumn("bucket", self._bucket(buckets))
        return self._put(kind, buckets, [dealt.where(F.col("bucket") % rounds == r).hint("rebalance", "bucket") for r in range(rounds)] if rounds > 1 else [dealt.hint("rebalance", "bucket")], *names[:2])

    def _put(self, kind: str, buckets: int, dealt: list[DataFrame], *order: str) -> Run:
        """Writes rows that lie by their column ``bucket``, in an ``order`` there or as they come, a round after the other."""
        run = {"kind": kind, "name": uuid.uuid4().hex, "buckets": buckets, "rows": 0}
        names = [x.split()[0] for x in SCHEMAS[kind].split(", ")]
        with freed_shuffles(self.spark):
            for rows in dealt:
                rows.select(*names, "bucket").sortWithinPartitions("bucket", *order).write.mode("append").option("parquet.dictionary.page.size", DICTIONARY).partitionBy("bucket").parquet(f"{self.path}/{folder_of(run)}")
        run["rows"] = self.scan([run]).count()  # of the files' footers
        return run

    def scan(self, runs: list[Run]) -> DataFrame:
        """The rows of runs of one kind, with ``run`` and ``bucket``, by which Spark prunes files."""
        base = f"{self.path}/{runs[0]['kind']}"
        return self.spark.read.schema(f"{SCHEMAS[runs[0]['kind']]}, run string, bucket int").option("basePath", base).parquet(*(f"{self.path}/{folder_of(r)}" for r in runs))

    def pairs(self) -> DataFrame:
        """``source < target, n`` of all live edges."""
        rows = []
        for run in self.of("edges"):
            here = self.scan([run]) if run.get("once") else self.scan([run]).where("term < neighbour")
            rows.append(here.select(F.least("term", "neighbour").alias("source"), F.greatest("term", "neighbour").alias("target"), "n"))
        if len(rows) == 1:
            return rows[0]
        every = reduce(DataFrame.unionByName, rows, self.spark.createDataFrame([], "source string, target string, n bigint"))
        return every.groupBy("source", "target").agg(F.sum("n").alias("n")).where("n <> 0")

    def every(self, kind: str) -> DataFrame:
        """All live rows of ``kind``, but edges (``pairs`` has them)."""
        runs = self.of(kind)
        if not runs:
            return self.spark.createDataFrame([], SCHEMAS[kind])
        rows = self.scan(runs).drop("run", "bucket")
        return rows if len(runs) == 1 else summed(kind, rows)

    def _lookup(self, runs: list[Run], wanted: DataFrame, small: bool) -> DataFrame:
        """The rows of ``wanted`` terms (column term, among others) in ``runs``: of each run the terms' buckets are read.
        That no term is empty is said, as it lets Spark prune buckets by what it finds."""
        if not runs:
            return self.spark.createDataFrame([], SCHEMAS["edges"]).join(wanted, "term")
        at = F.array(*(F.struct(F.lit(r["name"]).alias("run"), self._bucket(r["buckets"]).alias("bucket")) for r in runs))
        asked = wanted.where("term > ''").select("*", F.inline(at))
        return self.scan(runs).join(sized(asked, small), ["run", "bucket", "term"]).drop("run", "bucket")

    def lookup(self, kind: str, wanted: DataFrame, small: bool) -> DataFrame:
        """The live rows of ``kind`` for the terms of ``wanted``, with its columns."""
        runs = self.of(kind)
        if not runs:
            return self.spark.createDataFrame([], SCHEMAS[kind]).join(wanted, "term")
        if len(runs) == 1:
            return self._lookup(runs, wanted, small)
        rows = summed(kind, self._lookup(runs, wanted.select("term").distinct(), small))
        return rows.join(sized(wanted, small), "term")

    def near(self, wanted: DataFrame, small: bool, beside: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``term, neighbour, weight``: of each term of ``wanted`` (term, need) its first ``need`` neighbours at least, or all.
        What is kept of the terms is looked up at once, as most of a batch's plan follows from it. ``beside`` gives the same
        columns in full, of terms (term) of which too few neighbours are certain."""
        kept = self._lookup(self.of("near"), wanted, small).select("term", "need", "neighbour", "n", "place")
        later = self._lookup(self._later(), wanted, small).select("term", "need", "neighbour", "n", F.lit(None).cast("int").alias("place"))
        old = F.when(F.col("place").isNotNull(), F.col("n"))
        rows = settle(kept.unionByName(later).groupBy("term", "need", "neighbour").agg(F.sum("n").alias("n"), F.max("place").alias("place"), F.max(old).alias("old")))
        last, outside = F.col("place") == PREFIX, F.when(F.col("place").isNull(), F.col("n"))  # a term with fewer has no others
        bounds = rows.groupBy("term").agg(F.max(F.when(last, F.col("old"))).alias("low"), F.max(F.when(last, F.col("neighbour"))).alias("name"), F.greatest(F.coalesce(F.max(outside), F.lit(0)), F.lit(0)).alias("rise"))
        tied = (F.col("rise") == 0) & (F.col("n") == F.col("low")) & (F.col("neighbour") <= F.col("name"))
        sure = F.when(F.col("low").isNull(), F.col("n") > 0).otherwise(F.col("place").isNotNull() & ((F.col("n") > F.col("low") + F.col("rise")) | tied))
        judged = rows.join(sized(bounds, small), "term").withColumn("sure", sure)
        terms = settle(judged.groupBy("term").agg((F.max("low").isNotNull() & (F.count_if("sure") < F.max("need"))).alias("short")))
        certain = judged.where("sure").join(sized(terms.where("not short"), small), "term").select("term", "neighbour", F.col("n").cast("double").alias("weight"))
        short = terms.where("short").select("term")
        return certain.unionByName(beside(short)) if short.limit(1).count() else certain

    def written(self, chunks: DataFrame, edges: bool | str) -> list[Run]:
        """The first runs, of ``chunks`` alone; ``edges`` "near": first neighbours without all edges."""
        held = chunks.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
        runs = [self.put("postings", rows_of("postings", chunks), held), self.put("counts", rows_of("counts", chunks), held)]
        return runs + self._edges(chunks, held, runs[1:], edges == "near") if edges else runs

    def _edges(self, chunks: DataFrame, held: int, counts: list[Run], alone: bool) -> list[Run]:
        """A first run of edges, unless they are left out (``alone``), and first neighbours; ``counts`` are of the same chunks, which
        hold so many terms. Each round counts its own terms: for first neighbours alone from both ends of a pair."""
        common = stripes.commonest(TermTables(self.spark, self.path, counts).every("counts").select("term", F.col("n").alias("count")))
        total = stripes.total(chunks)
        named = lambda rows: rows.select("bucket", F.col("source").alias("term"), F.col("target").alias("neighbour"), "n", "place")
        if alone:
            rounds = stripes.rounds_for(2 * total)
            n = max(self._buckets("near", held // len(rounds)), stripes.buckets_for(2 * total // len(rounds)))
            found = [stripes.counted(chunks, n, both=True, prefix=PREFIX, common=common, which=r).where(F.col("place") <= PREFIX) for r in rounds]
            return [self._put("near", n, [named(rows) for rows in found]) | {"alone": True}]
        rounds, n = stripes.rounds_for(total), self._buckets("edges", total)
        run = self._put("edges", n, [named(stripes.counted(chunks, n, rare_first=True, common=common, which=r)) for r in rounds])
        run |= {"once": True, "rows": 2 * run["rows"]}
        n = self._buckets("near", held)
        return [run, self._put("near", n, [named(stripes.firsts(self.scan([run]).select("term", "neighbour", "n"), n, PREFIX, common))])]

    def changed(self, new: DataFrame, old: DataFrame, live: DataFrame) -> list[Run]:
        """The runs after a write that puts the chunks ``new`` in the place of ``old``, from which on ``live`` are there.
        ``self.runs`` stay."""
        about = sum(x.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] for x in (new, old))
        if about > SHARE * max(1, self.of("postings")[0]["rows"]):  # so much that it isn't written apart
            return self.written(live, "near" if self.alone() else bool(self.of("edges")))
        out = []
        for kind in KEYS:
            mine, alone = self.of(kind), kind == "edges" and self.alone()
            first = self.of("near") if alone else mine[:1]
            if not first:
                continue
            added = self.put(kind, changes(kind, new, old), about)
            mine += [added] if added["rows"] else []
            full = sum(r["rows"] for r in (mine if alone else mine[1:])) > SHARE * first[0]["rows"]
            if kind == "edges":
                counts = [r for r in out if r["kind"] == "counts"]
                mine = self._edges(live, self.of("postings")[0]["rows"] + about, counts, alone) if full else mine + self.of("near")
            elif full:
                mine = [self.put(kind, TermTables(self.spark, self.path, mine).every(kind), sum(r["rows"] for r in mine))]
            out += mine
        return out
