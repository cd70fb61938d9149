"""What a store keeps by term: equal to what its chunks give, whatever was written, and read by key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pyspark.sql import functions as F

from brindle.config import QueryOptions, RetrievalConfig
from brindle.operators import graph, stripes, terms
from brindle.plans import hybrid
from brindle.sources import by_term
from brindle.sources.index import IndexStore, build_index

CFG = RetrievalConfig(chunk_size=60, chunk_overlap=0)


def docs(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id string, text string")


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def some_text(rng, words):
    return " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))


def rows(df):
    return sorted(map(tuple, df.collect()))


def check(store):
    """Every table by term against the chunks that are live."""
    chunks, found = store.read(), store.open()
    assert rows(found.edges()) == rows(terms.cooccurrence(chunks))
    assert rows(found.document_frequency()) == rows(terms.document_frequency(chunks))
    assert rows(found.by_term.every("postings").select("chunk_id", "doc_id", "term")) == rows(terms.postings(chunks))
    return chunks, found


@pytest.mark.parametrize("prefix, share", [(3, 100.0), (4, 0.5), (64, 0.25)])
def test_random_writes_equal_a_rebuild(spark, tmp_path, monkeypatch, prefix, share):
    """Upserts and deletes; short prefixes, so that bounds matter; runs merged never, at times, and as usual."""
    monkeypatch.setattr(by_term, "PREFIX", prefix)
    monkeypatch.setattr(by_term, "SHARE", share)
    monkeypatch.setattr(by_term, "BUCKET_ROWS", dict.fromkeys(by_term.BUCKET_ROWS, 400))
    rng = random.Random(prefix)
    words = [f"w{i}" for i in range(12)]
    texts = {f"d{i}": some_text(rng, words) for i in range(14)}
    store = IndexStore(spark, str(tmp_path / "index"), edges=True)
    store.write(build_index(docs(spark, texts), CFG))
    for step in range(3):
        changed = {f"d{i}": some_text(rng, words + [f"new{step}"]) for i in rng.sample(range(18), 4)}
        texts |= changed
        store.upsert(build_index(docs(spark, changed), CFG))
        if step % 2:
            gone = rng.choice(sorted(texts))
            texts.pop(gone)
            store.delete(gone)
    chunks, found = check(store)
    assert {r.doc_id for r in chunks.collect()} == set(texts)
    queries = asked(spark, "w1 w2 w3", "w4", "w5 w1 new3", "nowhere w7", *words)
    for kind in ("greedy", "ranked"):
        cfg = RetrievalConfig(chunk_size=60, chunk_overlap=0, expansion=kind, max_expanded_terms=3)
        asks = graph.query_terms(queries)
        expanded = [rows(graph.expand(asks, graph.near(x, asks, cfg, True), cfg)) for x in (chunks, found)]
        assert expanded[0] == expanded[1]
        assert rows(graph.search(chunks, queries, 5, cfg)) == rows(graph.search(found, queries, 5, cfg))


def files_read(df):
    """Runs ``df``; the numbers of Parquet files that its scans read, by folder."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = {}, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            folder = node.relation().location().rootPaths().apply(0).toString()
            kind = next((k for k in ("postings", "near", "edges", "data") if f"/{k}" in folder.split("index", 1)[-1]), folder)
            columns = node.requiredSchema().fieldNames()
            out.setdefault((kind, "text" in list(columns)), []).append(node.metrics().apply("numFiles").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_searches_read_by_key(spark, tmp_path, monkeypatch):
    """Of postings, neighbours and texts only the buckets that a batch needs; no edge, no array of terms."""
    monkeypatch.setattr(by_term, "BUCKET_ROWS", dict.fromkeys(by_term.BUCKET_ROWS, 80))
    rng = random.Random(1)
    texts = {f"d{i}": some_text(rng, [f"w{j}" for j in range(400)]) for i in range(300)}
    store = IndexStore(spark, str(tmp_path / "index"), buckets=64, edges=True)
    store.write(build_index(docs(spark, texts), CFG))
    found = store.open()
    queries = asked(spark, "w1")
    total = {r["kind"]: len(found.by_term.scan([r]).inputFiles()) for r in found.by_term.runs}
    read = files_read(graph.search(found, queries, 3, CFG))
    assert total["postings"] > 40 and 0 < max(read["postings", False]) <= 12  # the term and at most ten expanded ones
    assert ("data", False) not in read and ("data", True) not in read and ("edges", False) not in read
    wanted = graph.query_terms(queries).select("term", F.lit(5).alias("need"))
    near = files_read(found.by_term._lookup(found.by_term.of("near"), wanted, True))
    assert total["near"] > 20 and near == {("near", False): [1]}
    read = files_read(found.near(wanted, True))
    assert not any(read.get(("edges", False), [])) and ("data", False) not in read  # no term is short of certain neighbours
    read = files_read(hybrid.hybrid(found, queries, CFG, QueryOptions(top_k=3)))
    buckets = {r.bucket for r in hybrid.hybrid(found, queries, CFG, QueryOptions(top_k=3)).select(found.bucket.alias("bucket")).collect()}
    assert 0 < max(read["data", True]) <= len(buckets) < 64
    assert rows(hybrid.hybrid(found, queries, CFG)) == rows(hybrid.hybrid(store.read(), queries, CFG).select(*hybrid.hybrid(found, queries, CFG).columns))


def test_a_write_adds_only_what_changes(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), edges=True)
    store.write(build_index(docs(spark, {f"d{i}": f"common word{i} word{i + 1}" for i in range(60)}), CFG))
    store.upsert(build_index(docs(spark, {"d1": "common word1 word2"}), CFG))  # the same text again
    assert [r["kind"] for r in store.open().by_term.runs] == ["postings", "counts", "edges", "near"]
    store.upsert(build_index(docs(spark, {"d1": "common word1 other"}), CFG))
    runs = store.open().by_term.runs
    added = {k: [r["rows"] for r in runs if r["kind"] == k][1:] for k in by_term.KEYS}
    assert added == {"postings": [2], "counts": [2], "edges": [8]}  # word2 goes, other comes, each with common and word1, both ways
    check(store)


def test_stores_without_edges_and_old_folders(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), keep=1)
    for text in ("alpha beta", "alpha gamma", "alpha delta"):
        store.upsert(build_index(docs(spark, {"d1": text, "d2": "alpha beta"}), CFG))
    found = store.open()
    assert {r["kind"] for r in found.by_term.runs} == {"postings", "counts"}
    assert rows(graph.search(found, asked(spark, "alpha"), 5, CFG)) == rows(graph.search(store.read(), asked(spark, "alpha"), 5, CFG))
    store.vacuum()
    named = {by_term.folder_of(r) for v in store.versions() for r in store._commit_of(v)["terms"]}
    assert {f"{kind}/{n}" for kind in by_term.KEYS for n in store._names(f"terms/{kind}")} == named
    store.delete("d1")
    store.delete("d2")
    assert store.open().document_frequency().count() == 0 and graph.search(store.open(), asked(spark, "alpha"), 5, CFG).count() == 0


def test_a_load_counts_once(spark, tmp_path, monkeypatch):
    """Writes that defer keep nothing by term, and all is right meanwhile; ``reindex``, or a write that doesn't defer, counts from the live chunks."""
    counted = []
    monkeypatch.setattr(by_term.TermTables, "written", lambda self, *a, f=by_term.TermTables.written: counted.append(1) or f(self, *a))
    for last in ("reindex", "upsert", "delete"):
        path = str(tmp_path / last / "index")
        store = IndexStore(spark, path, edges=True, defer=True)
        store.write(build_index(docs(spark, {f"d{i}": f"common word{i} word{i + 1}" for i in range(9)}), CFG))
        store.upsert(build_index(docs(spark, {f"d{i}": f"common other word{i}" for i in range(5, 12)}), CFG))
        store.delete("d1")
        found = store.open()
        assert not found.by_term.runs and not counted
        assert rows(found.edges()) == rows(terms.cooccurrence(store.read()))
        assert rows(graph.search(found, asked(spark, "common"), 5, CFG)) == rows(graph.search(store.read(), asked(spark, "common"), 5, CFG))
        if last == "reindex":
            store.reindex()
        elif last == "upsert":
            IndexStore(spark, path, edges=True).upsert(build_index(docs(spark, {"d7": "common last"}), CFG))
        else:
            IndexStore(spark, path, edges=True).delete("d2")
        assert counted == [1]
        chunks, found = check(store)
        assert {r["kind"] for r in found.by_term.runs} == {"postings", "counts", "edges", "near"}
        assert rows(found.edges_by_source()) == rows(terms.cooccurrence_by_source(chunks))
        counted.clear()


def test_first_neighbours_alone(spark, tmp_path, monkeypatch):
    """A store without all edges, written in rounds: edges, neighbours and a later write are as of its chunks."""
    for owner, name, value in ((by_term, "PREFIX", 3), (by_term, "SHARE", 100.0), (by_term, "ROUND_ROWS", 60), (stripes, "ROUND_PAIRS", 400), (by_term, "BUCKET_ROWS", dict.fromkeys(by_term.BUCKET_ROWS, 40))):
        monkeypatch.setattr(owner, name, value)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    store = IndexStore(spark, str(tmp_path / "index"), edges="near")
    store.write(build_index(docs(spark, {f"d{i}": some_text(rng, words) for i in range(10)}), CFG))
    assert [r["kind"] for r in store.open().by_term.runs] == ["postings", "counts", "near"] and len(stripes.rounds_for(2 * stripes.total(store.read()))) > 1
    store.upsert(build_index(docs(spark, {"d3": some_text(rng, words), "d20": "w1 new w2"}), CFG))
    found, chunks = store.open(), spark.createDataFrame(store.read().collect(), store.read().schema)
    assert rows(found.edges()) == rows(terms.cooccurrence(chunks))
    asks, cfg = graph.query_terms(asked(spark, "w1 w2 w3", "w4", "w5 w1 new")), RetrievalConfig(chunk_size=60, chunk_overlap=0, expansion="greedy", max_expanded_terms=3)
    assert rows(graph.expand(asks, graph.near(found, asks, cfg, True), cfg)) == rows(graph.expand(asks, graph.near(chunks, asks, cfg, True), cfg))
