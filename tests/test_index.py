"""Index, loaders, incremental ingest, and the small benchmark."""

from __future__ import annotations

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from brindle.config import QueryOptions, RetrievalConfig
from brindle.errors import ConflictError, DependencyError, NotFoundError, ValidationError
from brindle.observe import RecordedTrace
from brindle.operators import terms
from brindle.plans import hybrid
from brindle.sources.index import IndexStore, build_index, ingest, reject_report, replaced
from brindle.sources.loaders import docx_text, ingest_files, load_documents, load_or_reject, pdf_text
from brindle.streaming.ingest import ingest_stream

#: The published small benchmark, its passage and its samples.
CITY = """At the far eastern corner of the Eastern Continent lies a region that appears on maps only as a boundary, without any label. People call it Meteor City.
    In the eyes of most, it is a barren wasteland, uninhabited and covered with centuries of accumulated garbage.
    Some information-privileged individuals know that people do live here, and in considerable numbers, surviving by scavenging waste.
    Those in high positions but operating in the shadows know even more — there are many people here, many exceptional individuals, who can be bought cheaply with food, drugs, or heavy metals.
    But only those who live in Meteor City truly understand it —
    This is Meteor City, a place that accepts all things discarded, where fallen stars gather."""
SAMPLES = [("q1", "What is Meteor City like in the eyes of outsiders?", ["doc1#1", "doc1#2"]), ("q2", "How do people in Meteor City primarily survive?", ["doc1#3", "doc1#4"]), ("q3", "What is Meteor City truly like?", ["doc1#6", "doc1#7"])]


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


@pytest.mark.parametrize("expansion", ["greedy", "ranked"])
@pytest.mark.parametrize("cap", [2.0, None])
def test_small_benchmark(spark, expansion, cap):
    cfg = RetrievalConfig(chunk_size=100, chunk_overlap=0, expansion=expansion, expansion_score_cap=cap, alpha=1.0, beta=1.0, normalise=False)
    index = build_index(docs(spark, doc1=CITY), cfg).cache()
    assert [r.length for r in index.orderBy("position").collect()] == [96, 93, 79, 95, 99, 97, 89, 94]
    samples = spark.createDataFrame(SAMPLES, "query_id string, query string, relevant_chunk_ids array<string>")
    rows = hybrid.evaluate_dataset(index, samples, ["graph"], 3, cfg).collect()
    assert round(sum(r.recall_at_k for r in rows) / 3, 4) == 0.6667 and round(sum(r.mrr for r in rows) / 3, 4) == 0.8333
    final = hybrid.hybrid(index, samples.select("query_id", "query"), cfg, QueryOptions(top_k=3, enable_vector=False))
    first = {r.query_id: r.score for r in final.where("rank = 1").collect()}
    if expansion == "greedy":
        assert first == {"q1": 5.0 if cap else 5.5, "q2": 5.0, "q3": 5.0}
    with pytest.raises(ValueError):
        hybrid.evaluate_dataset(index, samples.where("false"), ["graph"], 3, cfg)


def test_debug(spark):
    index = build_index(docs(spark, doc1=CITY), RetrievalConfig(chunk_size=100, chunk_overlap=0))
    q = spark.createDataFrame([("q", "Meteor City"), ("r", "zzzz")], "query_id string, query string")
    rows = hybrid.retrieval_debug(index, q).orderBy("query_id").collect()
    assert rows[0].summary.mode == "hybrid" and rows[0].summary.vector_count == 5 and rows[0].summary.final_count == 5
    assert rows[0].summary.postprocess_removed_count == rows[0].summary.fused_count - 5 and len(rows[0].ranking_preview) == 5
    assert rows[1].summary.graph_count == 0 and rows[1].summary.vector_count == 5
    assert rows[0].vector_top_k == 5 == rows[0].graph_top_k and rows[0].summary.vector_enabled and rows[0].summary.graph_enabled
    stats = rows[0].stats.asDict()
    assert stats == {"vector_count": len(rows[0].vector_hits), "graph_count": len(rows[0].graph_hits), "fusion_count": len(rows[0].fusion.chunks), "citation_count": 5}
    assert set(rows[0].timings.asDict()) == {"vector_retrieval_time", "graph_retrieval_time", "postprocess_time"} and all(t > 0 for t in rows[0].timings)
    only = hybrid.retrieval_debug(index, q, options=QueryOptions(enable_graph=False)).where("query_id = 'q'").first()
    assert only.summary.mode == "vector" and only.timings.graph_retrieval_time == 0 and only.fusion.overlap_count == 0 and "graph_hits" not in only.asDict()


def test_debug_searches_once_and_counts_as_it_writes(spark, tmp_path):
    """Four scans of the index at most, and no job that only counts: rows are observed as they are written."""
    store = IndexStore(spark, str(tmp_path / "index"))
    store.write(build_index(docs(spark, doc1=CITY), RetrievalConfig(chunk_size=100, chunk_overlap=0)))
    q, trace = spark.createDataFrame([("q", "Meteor City")], "query_id string, query string"), RecordedTrace()
    out = hybrid.retrieval_debug(store.open(), q, trace=trace)
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()
    row = out.first()
    events = {name: fields for name, fields in trace.events}
    assert events["vector_retrieved"]["count"] == row.stats.vector_count and events["graph_retrieved"]["count"] == row.stats.graph_count


def test_same_result_for_any_partitions(spark):
    cfg = RetrievalConfig(chunk_size=100, chunk_overlap=0)
    q = spark.createDataFrame([("q", "Meteor City people")], "query_id string, query string")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append([tuple(r) for r in hybrid.hybrid(build_index(docs(spark, a=CITY, b=CITY[:300]).repartition(n), cfg), q, cfg).orderBy("rank").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_replace_and_store(spark, tmp_path):
    cfg = RetrievalConfig(chunk_size=30, chunk_overlap=0)
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.read().count() == 0
    first = build_index(docs(spark, d1="python fastapi tutorial\n\nfastapi backend service", d2="other text"), cfg)
    store.upsert(first)
    store.upsert(first)
    assert store.versions() == [1, 2] and {r.weight for r in terms.cooccurrence(store.read("d1")).collect()} == {1.0}
    store.upsert(build_index(docs(spark, d1="python"), cfg))
    assert [r.text for r in store.read("d1").collect()] == ["python"] and terms.cooccurrence(store.read("d1")).count() == 0
    assert store.read("d2").count() == 1
    store.delete("d2")
    with pytest.raises(NotFoundError):
        store.delete("d2")
    assert replaced(store.read(), first).count() == first.count()
    store.wipe()
    assert store.versions() == []


def test_store_after_a_crash_and_two_writers(spark, tmp_path):
    cfg = RetrievalConfig(chunk_size=30, chunk_overlap=0)
    store = IndexStore(spark, str(tmp_path / "index"), buckets=4)
    store.upsert(build_index(docs(spark, a="one two", b="three four"), cfg))
    store._put(build_index(docs(spark, a="never"), cfg), store._newest(), "dead")  # a write that dies before its commit
    stale = store._newest()
    store.upsert(build_index(docs(spark, a="five"), cfg))
    assert sorted(r.text for r in store.read().collect()) == ["five", "three four"]
    with pytest.raises(ConflictError):
        store._commit(stale, stale["dim"], {})
    assert sorted(r.text for r in store.read().collect()) == ["five", "three four"]
    store.vacuum()
    assert "dead" not in store._names("data") and store.read().count() == 2


def test_store_rewrites_touched_buckets_and_forgets(spark, tmp_path):
    cfg = RetrievalConfig(chunk_size=30, chunk_overlap=0)
    store = IndexStore(spark, str(tmp_path / "index"), buckets=8)
    store.write(build_index(docs(spark, **{f"d{i}": f"text {i}" for i in range(40)}), cfg))
    before = store._newest()["parts"]
    for n in range(4):
        store.upsert(build_index(docs(spark, d3=f"again {n}"), cfg))
    after = store._newest()["parts"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    assert store.versions() == [4, 5] and store.read().count() == 40 and [r.text for r in store.read("d3").collect()] == ["again 3"]


def test_buckets_grow_with_the_index(spark, tmp_path):
    """Fifty times the documents in upserts: buckets stay of like size, and those that nothing concerns stay as they are."""
    cfg = RetrievalConfig(chunk_size=200, chunk_overlap=0)
    some = lambda lo, hi: build_index(spark.range(lo, hi).selectExpr("concat('d', id) AS doc_id", "repeat(concat(sha2(cast(id AS string), 512), ' '), 4) AS text"), cfg)
    store = IndexStore(spark, str(tmp_path / "index"), buckets=2, bucket_bytes=60_000)
    store.write(some(0, 60))
    for lo, hi in ((60, 600), (600, 1500), (1500, 3000)):
        store.upsert(some(lo, hi))
    commit = store._newest()
    sizes = [sum(f.getLen() for f in store._files.listStatus(store._at("data", folder, f"bucket={b}"))) for b, folder in commit["parts"].items()]
    assert 12 < commit["buckets"] == len(sizes) and max(sizes) < 2.5 * 60_000
    assert store.read().select("doc_id").distinct().count() == 3000 == store.read().select(F.xxhash64("doc_id")).distinct().count()
    assert all(store.read(f"d{i}").select("doc_id").distinct().count() == 1 for i in (0, 77, 2999))
    store.bucket_bytes = sum(sizes) // (len(sizes) + 1)  # room for one bucket more
    before, n = commit["parts"], commit["buckets"]
    touched = store.read("d5").select(store._bucket(commit)).first()[0]
    store.upsert(some(5, 6))
    after = store._newest()
    changed = {int(b) for b, f in after["parts"].items() if before.get(b) != f}
    grown = range(n, after["buckets"])
    assert changed <= {touched, *grown, *(k - (1 << (k.bit_length() - 1)) for k in grown)} and len(changed) < len(before) / 2
    assert store.read().select("doc_id").distinct().count() == 3000
    assert sorted(map(tuple, store.open().document_frequency().collect())) == sorted(map(tuple, terms.document_frequency(store.read()).collect()))


def test_store_refuses_repeated_chunks_and_other_lengths(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    twice = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1)], "doc_id string, text string, at int")
    with pytest.raises(ConflictError):
        store.upsert(build_index(twice))
    with pytest.raises(ConflictError):
        store.write(build_index(twice))
    assert store.versions() == [] and store._names("data") == []
    store.upsert(build_index(twice, order="at"))
    assert sorted(r.text for r in store.read().collect()) == ["new", "x"]
    with pytest.raises(ValidationError):
        store.upsert(build_index(docs(spark, c="y"), RetrievalConfig(embedding_dim=8)))
    assert store.versions() == [1]


def test_ingest_tells_what_it_loaded(spark, tmp_path):
    trace = RecordedTrace()
    store = IndexStore(spark, str(tmp_path / "index"), trace)
    rows = ingest(store, docs(spark, a="x" * 50, b="y" * 20), RetrievalConfig(chunking="fixed", chunk_size=30, chunk_overlap=0))
    assert {r.doc_id: r.chunks for r in rows.collect()} == {"a": 2, "b": 1}
    told = dict(trace.events)
    assert [n for n, _ in trace.events] == ["document_loaded", "ingest_start", "ingest_done", "chunk_quality", "chunk_lengths_preview"]
    assert told["document_loaded"] == {"documents": 2, "chars": 70} and told["chunk_lengths_preview"] == {"lengths": [30, 20, 20]}
    assert told["chunk_quality"]["chunk_count"] == 3 and told["chunk_quality"]["max_length"] == 30


def test_rejects(spark):
    bad = spark.createDataFrame([("d", " 　"), (" ", "x"), (None, "x"), ("e", "fine")], "doc_id string, text string")
    assert sorted(r.reason for r in reject_report(bad).collect()) == ["empty doc_id", "empty doc_id", "empty text"]
    assert [r.doc_id for r in build_index(bad).collect()] == ["e"]
    with pytest.raises(ValidationError):
        build_index(bad, strict=True)


def test_stream(spark, tmp_path):
    source, store = tmp_path / "in", IndexStore(spark, str(tmp_path / "index"))
    docs(spark, a="one two", b="three four").write.parquet(str(source))
    read = lambda: spark.readStream.schema("doc_id string, text string").parquet(str(source))
    ingest_stream(read(), store, str(tmp_path / "check")).awaitTermination()
    docs(spark, a="five").write.mode("append").parquet(str(source))
    ingest_stream(read(), store, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.text for r in store.read().collect()) == ["five", "three four"]
    spark.createDataFrame([("b", "longer but older", 1), ("b", "last", 2)], "doc_id string, text string, at int").write.parquet(str(tmp_path / "more"))
    ingest_stream(spark.readStream.schema("doc_id string, text string, at int").parquet(str(tmp_path / "more")), store, str(tmp_path / "check2"), order="at").awaitTermination()
    assert sorted(r.text for r in store.read().collect()) == ["five", "last"]


def write_docx(path, *paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')


def test_late_documents_of_a_stream_lose(spark, tmp_path):
    """Micro-batches in any order end in the same index; columns with odd names are no matter."""
    rows = [(f"d{i % 5}", f"text {i} of {i % 5}", i, "x", "y") for i in range(20)]
    want = {f"d{i}": f"text {15 + i} of {i}" for i in range(5)}
    for n, order in enumerate((range(20), reversed(range(20)), (3, 19, 0, 17, 16, 4, 18, 9, 15, 2, 14, 8, 13, 1, 12, 5, 11, 6, 10, 7))):
        order, source = list(order), tmp_path / f"in{n}"
        schema = "doc_id string, text string, at bigint, `by` string, `__order` string"
        for part in range(0, 20, 7):
            spark.createDataFrame([rows[i] for i in order[part : part + 7]], schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        store = IndexStore(spark, str(tmp_path / f"index{n}"))
        ingest_stream(stream, store, str(tmp_path / f"checkpoint{n}"), RetrievalConfig(), order="at").awaitTermination()
        assert {r.doc_id: r.text for r in store.read().collect()} == want and len(store.versions()) == 2
        assert store.open().document_frequency().where("term = 'text'").first().doc_count == 5
    store.upsert(build_index(docs(spark, d1="without a version"), RetrievalConfig()))  # which is never late
    assert [r.text for r in store.read("d1").collect()] == ["without a version"]


def test_loaders(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("﻿héllo\n")
    write_docx(tmp_path / "b.docx", " one ", "", "two")
    rows = {r.path.rsplit("/", 1)[1]: r.text for r in load_documents(spark, [str(tmp_path / "a.TXT"), str(tmp_path / "b.docx")]).collect()}
    assert rows == {"a.TXT": "﻿héllo\n", "b.docx": "one\ntwo"}
    got = ingest_files(spark, {str(tmp_path / "a.TXT"): "x"}).first()
    assert (got.doc_id, got.text) == ("x", "﻿héllo")
    assert ingest_files(spark, {os.path.relpath(tmp_path / "a.TXT"): "y", f"file://{tmp_path}/b.docx": "z"}).where("doc_id is not null").count() == 2
    with pytest.raises(ValidationError):
        ingest_files(spark, {str(tmp_path / "a.TXT"): " "})
    (tmp_path / "c.md").write_text("x")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "e.txt").write_text("  ")
    write_docx(tmp_path / "f.docx")
    for name, what in (("c.md", "unsupported"), ("d.txt", "UTF-8"), ("f.docx", "no text")):
        with pytest.raises(Exception, match=what):
            load_documents(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="empty"):
        ingest_files(spark, {str(tmp_path / "e.txt"): "x"}).collect()


def test_one_bad_file_of_each_kind(spark, tmp_path):
    """The others load; what failed is told with its reason, by one pass over the files."""
    good = {"a.txt": "one", "deep/b.TXT": "two"}
    (tmp_path / "deep").mkdir()
    for name, text in good.items():
        (tmp_path / name).write_text(text)
    write_docx(tmp_path / "c.docx", "three")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "e.docx").write_bytes(b"no archive")
    write_docx(tmp_path / "f.docx")
    (tmp_path / "g.md").write_text("x")
    (tmp_path / "h.pdf").write_bytes(b"%PDF broken")
    (tmp_path / "none").write_text("no suffix")
    docs_, failed = load_or_reject(spark, [str(tmp_path), str(tmp_path / "deep")])
    name = lambda r: r.path.rsplit("/", 1)[1]
    assert {name(r): r.text for r in docs_.collect()} == {"a.txt": "one", "b.TXT": "two", "c.docx": "three"}
    reasons = {name(r): r.reason for r in failed.collect()}
    assert reasons.pop("e.docx").startswith("not readable") and reasons.pop("h.pdf").startswith("not readable")
    assert reasons == {"d.txt": "not UTF-8", "f.docx": "no text", "g.md": "unsupported file", "none": "unsupported file"}
    assert load_or_reject(spark, str(tmp_path / "a.txt"))[1].count() == 0
    with pytest.raises(Exception, match="not UTF-8"):
        load_documents(spark, str(tmp_path / "d.txt")).collect()


def test_pdf_needs_a_library():
    try:
        import fitz  # noqa: F401
    except ImportError:
        with pytest.raises(DependencyError):
            pdf_text(b"%PDF")


def test_docx_text(tmp_path):
    write_docx(tmp_path / "x.docx", "a", "b")
    assert docx_text((tmp_path / "x.docx").read_bytes()) == "a\nb"


def test_a_built_index_is_the_written_one_and_moves_no_chunk(spark, tmp_path, monkeypatch):
    """``build`` deals documents, not chunks; without postings a store answers from its chunks."""
    docs = spark.createDataFrame([(str(i), f"word{i % 3} common text {i} " * (1 + i)) for i in range(4)] + [(None, "lost")], "doc_id string, text string")
    cfg = RetrievalConfig(chunking="fixed", chunk_size=40, chunk_overlap=5)
    built, want = IndexStore(spark, str(tmp_path / "built"), buckets=2, postings=False), build_index(docs, cfg)
    with monkeypatch.context() as m:
        m.setattr(type(docs), "hint", None)  # by which chunks would be dealt
        built.build(docs, cfg)
    key = lambda df: sorted(map(str, df.collect()))
    found = built.open()
    assert key(built.read()) == key(want) and not found.by_term.runs
    assert key(found.document_frequency()) == key(terms.document_frequency(want))
    wanted = spark.createDataFrame([("word1",), ("none",)], "term string")
    assert key(found.held(wanted, True).select("term", "chunk_id")) == key(terms.postings(want).where("term = 'word1'").select("term", "chunk_id"))
