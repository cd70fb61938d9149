"""The index: chunks with terms and embeddings, in buckets of documents, and what is kept of them by term.

A write puts new files for the buckets that it touches in a folder of its own, then commits by a small
file that names the folder of each bucket and the tables by term. Readers follow the newest commit, so they see all
of a write or nothing; a write that dies leaves a folder that nothing names; of two writers at once the second
commit fails."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, TimestampNTZType, TimestampType

from brindle.config import RetrievalConfig
from brindle.errors import ConflictError, NotFoundError, ValidationError
from brindle.functions.text import extract_terms, strip
from brindle.functions.vectors import hash_embedding, norm
from brindle.observe import Trace
from brindle.operators import terms
from brindle.operators.access import Rows
from brindle.operators.batch import is_small, sized
from brindle.operators.chunking import chunk_documents
from brindle.runtime import planned_bytes, settle
from brindle.schemas import INDEX
from brindle.sources.by_term import SCHEMAS, TermTables, folder_of

Embedder = Callable[[Column], Column]
COLUMNS = [x.split()[0] for x in INDEX.split(", ")]


def reject_report(docs: DataFrame) -> DataFrame:
    """Documents that can't be ingested, and why."""
    why = F.when(strip(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) == "", "empty doc_id").when(strip(F.coalesce("text", F.lit(""))) == "", "empty text")
    return docs.select("doc_id", why.alias("reason")).where("reason is not null")


def last_of_each(docs: DataFrame, order: str) -> DataFrame:
    """One row (doc_id, text, version) of each document: the last by ``order``, of equals the greater text."""
    return docs.groupBy("doc_id").agg(F.max(F.struct(F.col(order).alias("by"), F.col("text"))).alias("last")).select("doc_id", "last.text", _version(F.col("last.by"), docs.schema[order].dataType).alias("version"))


def _version(order: Column, kind: DataType) -> Column:
    """A number that grows with ``order``: a whole number, a date or a time (in microseconds)."""
    if isinstance(kind, TimestampType | TimestampNTZType | DateType):
        return F.unix_micros(order.cast("timestamp"))
    return order.cast("bigint") if isinstance(kind, IntegralType) else F.lit(None).cast("bigint")


def build_index(docs: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), embed: Embedder | None = None, strict: bool = False, order: str | None = None) -> DataFrame:
    """Index rows of ``docs`` (doc_id, text). One narrow pass: no shuffle. Documents that can't be
    ingested are left out (``reject_report`` has them), or raise if ``strict``. If documents may be there more
    than once, ``order`` names the column by which the last one counts; without it a store refuses them. An order of whole
    numbers, dates or times is also the documents' version: a store doesn't replace a document by an older one."""
    if strict and (bad := reject_report(docs).first()):
        raise ValidationError(f"{bad['reason']}: {bad['doc_id']}")
    docs = last_of_each(docs, order) if order is not None else docs.select("doc_id", "text", F.lit(None).cast("bigint").alias("version"))
    chunks = chunk_documents(docs.where(strip(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) != ""), cfg, ("version",))
    vector = (embed or (lambda t: hash_embedding(t, cfg.embedding_dim)))(F.col("text"))
    rows = chunks.select("chunk_id", F.col("parent_id").alias("doc_id"), "position", "text", "length", extract_terms(F.col("text")).alias("terms"), vector.alias("embedding"), "version")
    return rows.withColumn("norm", norm(F.col("embedding"))).select(*COLUMNS)


def replaced(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """``existing`` with the documents of ``batch`` put in the place of their old chunks."""
    ids = batch.select("doc_id").distinct()
    return existing.join(ids, "doc_id", "left_anti").select(*batch.columns).unionByName(batch)


#: Bytes of a bucket (at the first write by the planner's guess); fewest and most buckets.
BUCKET_BYTES, BUCKETS = 16 << 20, (8, 65_536)
#: Bytes of an index for each of its texts, about (check_s: 219 MB of 168).
BUILT_SHARE = 1.3


class Stored(Rows):
    """A committed index. Its searches read by key: postings and neighbours by their terms' buckets, texts by the
    documents' buckets; vectors alone are read whole, and no other column with them."""

    def __init__(self, store: IndexStore, commit: dict):
        super().__init__(store._rows(commit))
        self.by_term = TermTables(store.spark, store._terms_path, commit["terms"])
        self.one_row_each = not self.by_term.of("postings")  # a write refuses a chunk that is there twice
        self.located, self.bucket = store._rows(commit, located=True), store._bucket(commit)

    def held(self, wanted: DataFrame, small: bool) -> DataFrame:
        return self.by_term.lookup("postings", wanted, small).drop("n") if self.by_term.of("postings") else super().held(wanted, small)

    def near(self, wanted: DataFrame, small: bool) -> DataFrame:
        return self.by_term.near(wanted, small, self._beside) if self.by_term.of("near") else super().near(wanted, small)

    def _beside(self, wanted: DataFrame) -> DataFrame:
        """``term, neighbour, weight`` of the terms ``wanted`` (term), counted from their chunks, which are found by key if they are few."""
        small = is_small(wanted)
        at = self.by_term.lookup("postings", wanted, small).select("term", "doc_id", "chunk_id").withColumn("bucket", self.bucket)
        if not is_small(at):
            return super().near(wanted, small)
        rows = self.located.select("bucket", "doc_id", "chunk_id", "terms").join(F.broadcast(at.where("chunk_id > ''")), ["bucket", "doc_id", "chunk_id"])
        pairs = rows.select("term", F.explode("terms").alias("neighbour")).where("term <> neighbour")
        return pairs.groupBy("term", "neighbour").agg(F.count(F.lit(1)).cast("double").alias("weight"))

    def document_frequency(self) -> DataFrame:
        if not self.by_term.of("counts"):
            return super().document_frequency()
        return self.by_term.every("counts").select("term", F.col("n").alias("chunk_count"), F.col("docs").alias("doc_count"))

    def edges(self) -> DataFrame:
        """``source < target, weight``, as ``terms.cooccurrence`` gives them: those that are kept, else counted from the chunks."""
        if self.by_term.alone() or not self.by_term.of("edges"):
            return terms.cooccurrence(self.chunks)
        return self.by_term.pairs().select("source", "target", F.col("n").cast("double").alias("weight"))

    def edges_by_source(self) -> DataFrame:
        """``source, edges, weight, heaviest`` of ``edges``."""
        if self.by_term.alone() or not self.by_term.of("edges"):
            return terms.cooccurrence_by_source(self.chunks)
        return self.edges().groupBy("source").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"), F.max("weight").alias("heaviest"))

    def with_text(self, rows: DataFrame, small: bool) -> DataFrame:
        """``rows`` are found first; then the files of their buckets alone are read (that no id is empty is said, as it
        lets Spark prune)."""
        wanted = settle(rows).withColumn("bucket", self.bucket).where("chunk_id > ''")
        return self.located.select("bucket", "doc_id", "chunk_id", "text").join(sized(wanted, small), ["bucket", "doc_id", "chunk_id"]).drop("bucket")


class IndexStore:
    """An index at ``path``. ``buckets`` is what the first write begins with (None: by its size); when they
    hold over ``bucket_bytes`` on average, an upsert adds some, and only those buckets that part with documents for it
    are written again besides the ones it touches. ``edges`` and ``postings``, fixed by the first write, say whether co-occurrence,
    and whether anything by term, is kept (``edges`` "near": each term's first neighbours, which searches need, without all edges); without, searches read the chunks' arrays of terms. ``keep`` commits stay readable.
    ``defer``: for a load of several writes. They leave what is kept by term to ``reindex``, or to the first write by a store that
    doesn't defer; until then searches and edges come from the live chunks."""

    def __init__(self, spark: SparkSession, path: str, trace: Trace | None = None, buckets: int | None = None, edges: bool | str = False, keep: int = 2, bucket_bytes: int = BUCKET_BYTES, postings: bool = True, defer: bool = False):
        self.spark, self.path, self.trace, self.bucket_bytes = spark, path.rstrip("/"), trace or Trace(), bucket_bytes
        self.buckets, self.edges, self.keep, self.postings, self.defer = buckets, edges, keep, postings or bool(edges), defer
        self._terms_path = f"{self.path}/terms"
        self._jvm = spark._jvm
        self._files = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *below: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below]))

    def _names(self, below: str) -> list[str]:
        at = self._at(below)
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("commits") if n.startswith("v") and n.endswith(".json"))

    def _commit_of(self, version: int | None) -> dict:
        if version is None:
            return {"version": 0, "buckets": self.buckets, "edges": self.edges, "postings": self.postings, "dim": None, "parts": {}, "terms": []}
        stream = self._files.open(self._at("commits", f"v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _newest(self) -> dict:
        return self._commit_of((self.versions() or [None])[-1])

    def _rows(self, commit: dict, buckets: list[str] | None = None, located: bool = False) -> DataFrame:
        """Rows of a commit; ``located``: with ``bucket``, by which Spark prunes files."""
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in commit["parts"].items() if buckets is None or b in buckets]
        schema = f"{INDEX}, bucket int"
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.select(*COLUMNS, "bucket") if located else rows.select(*COLUMNS)

    def open(self) -> Stored:
        """The newest version, for searches."""
        return Stored(self, self._newest())

    @staticmethod
    def _bucket(commit: dict) -> Column:
        """The bucket of a document, of n: with one more, a single bucket parts with some of its documents."""
        half = 1 << (commit["buckets"].bit_length() - 1)
        place = F.pmod(F.xxhash64("doc_id"), F.lit(2 * half))
        return F.when(place < commit["buckets"], place).otherwise(place - half).cast("int")

    def _grown(self, commit: dict, touched: list[str], more: int) -> tuple[int, list[str]]:
        """How many buckets there should be when so many bytes come, by the size of the ``touched`` ones; and those of the present
        buckets that part with documents then."""
        now, there = commit["buckets"], [b for b in touched if b in commit["parts"]]
        size = sum(self._files.getContentSummary(self._at("data", commit["parts"][b], f"bucket={b}")).getLength() for b in there)
        half = 1 << (now.bit_length() - 1)
        share = sum(1 if int(b) >= half or int(b) < now - half else 2 for b in there) / (2 * half)  # of all documents, by their hash
        total = size / share + more if there else more
        n = max(now, min(BUCKETS[1], int(total // self.bucket_bytes)))
        halved = {k - (1 << (k.bit_length() - 1)) for k in range(now, n)}
        while later := {b for b in halved if b >= now}:
            halved = halved - later | {b - (1 << (b.bit_length() - 1)) for b in later}
        return n, [str(b) for b in halved]

    def read(self, doc_id: str | None = None) -> DataFrame:
        """The newest version, or an empty index; of one document, from the files of its bucket alone."""
        commit = self._newest()
        if doc_id is None:
            return self._rows(commit)
        bucket = self.spark.range(1).select(F.lit(doc_id).alias("doc_id")).select(self._bucket(commit)).first()[0]
        return self._rows(commit, [str(bucket)]).where(F.col("doc_id") == doc_id)

    def _checked(self, rows: DataFrame, dim: int | None) -> int | None:
        """The length of the vectors of ``rows``. Vectors of unlike lengths, or a chunk twice, raise."""
        low, high = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if low != high or (dim is not None and low is not None and low != dim):
            raise ValidationError(f"vectors of {low} to {high} numbers in an index of {dim or low}")
        if twice := rows.groupBy("chunk_id").count().where("count > 1").limit(1).collect():
            raise ConflictError(f"chunk {twice[0]['chunk_id']} is there more than once")
        return low if low is not None else dim

    def _put(self, rows: DataFrame, commit: dict, folder: str, lies: bool = False) -> list[str]:
        """Writes ``rows`` to a new folder; the buckets that are there then. Spark splits large buckets into
        files, so that no task holds one; rows that lie by their buckets already stay where they are."""
        dealt = rows.select(*COLUMNS, self._bucket(commit).alias("bucket"))
        dealt = dealt if lies else dealt.hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", "doc_id", "position").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return [n.split("=")[1] for n in self._names(f"data/{folder}") if n.startswith("bucket=")]

    def _by_size(self, rows: DataFrame) -> int:
        return max(BUCKETS[0], min(BUCKETS[1], planned_bytes(rows) // self.bucket_bytes))

    def _commit(self, commit: dict, dim: int | None, parts: dict[str, str], terms: list[dict] | None = None) -> int:
        version = commit["version"] + 1
        kept = commit["terms"] if terms is None else terms
        pending = commit.get("postings", True) and bool(parts) and not kept
        text = json.dumps(commit | {"version": version, "dim": dim, "parts": parts, "terms": kept, "pending": pending})
        draft, final = self._at("commits", f".{uuid.uuid4().hex}"), self._at("commits", f"v{version:08d}.json")
        stream = self._files.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            # a rename that never overwrites: of two writers one fails
            context.rename(self._files.makeQualified(draft), self._files.makeQualified(final), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._files.delete(draft, False)
            raise ConflictError(f"version {version} was committed by another writer") from e
        self.trace.event("ingest_done", version=version)
        self._forget(version - self.keep)
        return version

    def _forget(self, last: int) -> None:
        """Removes the commits up to ``last``, and the folders that only they name."""
        old = [self._commit_of(v) for v in self.versions() if v <= last]
        kept = [self._commit_of(v) for v in self.versions() if v > last]
        live = {(f, b) for c in kept for b, f in c["parts"].items()}
        runs = {r["name"] for c in kept for r in c["terms"]}
        for commit in old:
            for b, folder in commit["parts"].items():
                if (folder, b) not in live:
                    self._files.delete(self._at("data", folder, f"bucket={b}"), True)
            for run in commit["terms"]:
                if run["name"] not in runs:
                    self._files.delete(self._at("terms", folder_of(run)), True)
            self._files.delete(self._at("commits", f"v{commit['version']:08d}.json"), False)

    def write(self, rows: DataFrame) -> int:
        """A version of ``rows`` alone."""
        commit = self._newest()
        return self._written(rows, commit | {"buckets": commit["buckets"] or self._by_size(rows)}, False)

    def build(self, docs: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), embed: Embedder | None = None) -> int:
        """A version of the documents ``docs`` (doc_id, text; each once) alone. They go to their buckets before they are cut,
        as chunks with terms and vectors are several times as large; a task cuts and writes one bucket."""
        commit = self._newest()
        docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("doc_id is not null")
        if not commit["buckets"]:
            size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
            few = max(BUCKETS[0], docs.sparkSession.sparkContext.defaultParallelism)
            commit |= {"buckets": max(few, min(BUCKETS[1], int(BUILT_SHARE * size / self.bucket_bytes)))}
        return self._written(build_index(docs.repartitionById(commit["buckets"], self._bucket(commit)), cfg, embed), commit, True)

    def _written(self, rows: DataFrame, commit: dict, lies: bool) -> int:
        folder = f"write={uuid.uuid4().hex}"
        self.trace.event("ingest_start", version=commit["version"] + 1)
        parts = {b: folder for b in self._put(rows, commit, folder, lies)}
        put = self._rows(commit | {"parts": parts})
        try:
            dim = self._checked(put, None)
        except Exception:
            self._files.delete(self._at("data", folder), True)
            raise
        return self._commit(commit, dim, parts, self._terms_of(commit, put))

    def _terms_of(self, commit: dict, chunks: DataFrame) -> list[dict]:
        """The first runs of what is kept by term."""
        return [] if self.defer else self._counted(commit, chunks)

    def _counted(self, commit: dict, chunks: DataFrame) -> list[dict]:
        return TermTables(self.spark, self._terms_path, []).written(chunks, commit["edges"]) if commit.get("postings", True) else []

    def _not_late(self, commit: dict, staged: DataFrame) -> DataFrame:
        """``staged`` without the documents that the index has in a greater version."""
        if staged.agg(F.max("version")).first()[0] is None:
            return staged
        buckets = [str(r[0]) for r in staged.select(self._bucket(commit)).distinct().collect()]
        live = self._rows(commit, buckets).groupBy("doc_id").agg(F.max("version").alias("live"))
        late = staged.select("doc_id", "version").distinct().join(live, "doc_id").where("version < live").select("doc_id")
        return staged.join(late, "doc_id", "left_anti").select(*COLUMNS)

    def _changed(self, commit: dict, touched: list[str], ids: DataFrame, staged: DataFrame, parts: dict[str, str]) -> list[dict]:
        """The tables by term when the documents ``ids`` (doc_id) of the touched buckets give way to ``staged``, and ``parts`` are there."""
        tables, live = TermTables(self.spark, self._terms_path, commit["terms"]), self._rows(commit | {"parts": parts})
        if self.defer or commit.get("pending"):
            return self._terms_of(commit, live)
        if not commit["terms"]:
            return self._terms_of(commit, staged)
        old = self._rows(commit, touched).join(ids, "doc_id", "left_semi")
        return tables.changed(staged, old, live)

    def reindex(self) -> int:
        """What is kept by term, where writes left it, counted once from the live chunks."""
        commit = self._newest()
        if not commit.get("pending"):
            return commit["version"]
        return self._commit(commit, commit["dim"], commit["parts"], self._counted(commit, self._rows(commit)))

    def upsert(self, batch: DataFrame) -> int:
        """The documents of ``batch`` replace theirs; only the buckets that hold one are written again, and by term
        only what changes is added."""
        commit, folder = self._newest(), f"write={uuid.uuid4().hex}"
        commit |= {"buckets": commit["buckets"] or self._by_size(batch)}
        self.trace.event("ingest_start", version=commit["version"] + 1)
        terms = commit["terms"]
        try:
            batch.select(*COLUMNS).write.parquet(f"{self.path}/data/{folder}-in")
            staged = self.spark.read.schema(INDEX).parquet(f"{self.path}/data/{folder}-in")
            dim = self._checked(staged, commit["dim"])
            staged = self._not_late(commit, staged)
            touched = [str(r[0]) for r in staged.select(self._bucket(commit)).distinct().collect()]  # a number for each bucket
            n, parting = self._grown(commit, touched, self._files.getContentSummary(self._at("data", f"{folder}-in")).getLength())
            again = sorted({*touched, *parting})
            kept = {b: f for b, f in commit["parts"].items() if b not in again}
            put = self._put(replaced(self._rows(commit, again), staged), commit | {"buckets": n}, folder) if touched else []
            parts = kept | {b: folder for b in put}
            if touched:
                terms = self._changed(commit, touched, staged.select("doc_id").distinct(), staged, parts)
            commit = commit | {"buckets": n}
        finally:
            self._files.delete(self._at("data", f"{folder}-in"), True)
        return self._commit(commit, dim, parts, terms)

    def delete(self, doc_id: str) -> int:
        commit, folder = self._newest(), f"write={uuid.uuid4().hex}"
        if not self.read(doc_id).limit(1).count():
            raise NotFoundError(doc_id)
        ids = self.spark.range(1).select(F.lit(doc_id).alias("doc_id"))
        bucket = str(ids.select(self._bucket(commit)).first()[0])
        rows = self._rows(commit, [bucket])
        put = self._put(rows.where(F.col("doc_id") != doc_id), commit, folder)
        parts = {b: f for b, f in commit["parts"].items() if b != bucket} | {b: folder for b in put}
        terms = self._changed(commit, [bucket], ids, rows.limit(0), parts)
        return self._commit(commit, commit["dim"], parts, terms)

    def vacuum(self) -> None:
        """Removes folders that no commit names: of writes that died. Not to be run while another writes."""
        commits = [self._commit_of(v) for v in self.versions()]
        live = {f"data/{f}" for c in commits for f in c["parts"].values()} | {f"terms/{folder_of(r)}" for c in commits for r in c["terms"]}
        for below in ("data", *(f"terms/{kind}" for kind in SCHEMAS)):
            for folder in self._names(below):
                if f"{below}/{folder}" not in live:
                    self._files.delete(self._at(below, folder), True)

    def wipe(self) -> None:
        self._files.delete(self._at(), True)


def ingest(store: IndexStore, docs: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), embed: Embedder | None = None, order: str | None = None) -> DataFrame:
    """Upserts ``docs`` and tells what was loaded and how it was cut; ``doc_id, chunks`` of each document."""
    trace = store.trace
    trace.event("document_loaded", **docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first().asDict())
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    store.upsert(build_index(docs, cfg, embed, order=order))
    new = store.read().join(ids, "doc_id", "left_semi")
    trace.event("chunk_quality", **new.agg(F.count(F.lit(1)).alias("chunk_count"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.avg("length").alias("avg_length")).first().asDict())
    trace.event("chunk_lengths_preview", lengths=[r["length"] for r in new.orderBy("doc_id", "position").select("length").limit(10).collect()])
    return new.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
