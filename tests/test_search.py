"""Vector and graph search, fusion, post-processing, evaluation: fixed cases."""

from __future__ import annotations

import functools
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.config import QueryOptions, RetrievalConfig, SearchOptions
from brindle.errors import QueryExecutionError, ValidationError
from brindle.functions.vectors import norm
from brindle.observe import RecordedTrace, Trace, set_up_logging
from brindle.operators import answer, batch, evaluate, fusion, graph, terms, vector
from brindle.plans import hybrid

GREEDY, RANKED = RetrievalConfig(expansion="greedy"), RetrievalConfig(expansion="ranked")


def chunk_rows(spark, records):
    rows = [(c, c.split("#")[0], t, t.split()) for c, t in records.items()]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, terms array<string>")


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def scores(spark, records, query, cfg, k=20):
    rows = graph.search(chunk_rows(spark, records), asked(spark, query), k, cfg).orderBy(F.desc("score"), "chunk_id").collect()
    return [(r.chunk_id, r.score) for r in rows]


CASES = [
    ({"c1": "python fastapi tutorial", "c2": "fastapi backend service"}, "python", {}, [("c1", 2.0), ("c2", 0.5)], None),
    ({"c1": "graph", "c2": "ranking", **{f"extra_g_{i}": "rag graph" for i in range(4)}, "extra_r": "rag ranking"}, "rag", {"expand_per_term_limit": 5}, [(f"extra_g_{i}", 3.0) for i in range(4)] + [("c1", 2.0), ("extra_r", 1.5), ("c2", 0.5)], None),
    ({"c1": "alpha beta gamma", "c2": "alpha delta", "c3": "queryterm alpha beta gamma"}, "queryterm", {"expanded_hit_weight": 1.0, "expand_per_term_limit": 10, "max_expanded_terms": 20, "expansion_score_cap": 0.1}, [("c3", 1.1), ("c1", 0.1), ("c2", 0.1)], None),
    ({"c1": "alpha beta gamma", "c2": "alpha delta", "c3": "queryterm alpha beta gamma"}, "queryterm", {"expanded_hit_weight": 1.0, "expand_per_term_limit": 10, "max_expanded_terms": 20, "expansion_score_cap": None}, [("c3", 4.0), ("c1", 3.0), ("c2", 1.0)], None),
    ({"c1": "aa xx yy", "c2": "aa xx", "c3": "bb xx zz", "c4": "bb xx", "c5": "bb zz ww"}, "aa bb", {}, [("c3", 3.0), ("c1", 2.5), ("c5", 2.5), ("c2", 2.0), ("c4", 2.0)], [("c3", 3.0), ("c1", 2.5), ("c2", 2.0), ("c4", 2.0), ("c5", 2.0)]),
    ({"c1": "privacy encryption", "c2": "encryption ciphertext"}, "privacy", {}, [("c1", 1.5), ("c2", 0.5)], None),
    ({"doc_1#0": "python fastapi sqlite vector retrieval", "doc_2#0": "neo4j graph entity relation retrieval"}, "graph retrieval", {}, [("doc_2#0", 3.0), ("doc_1#0", 2.0)], [("doc_2#0", 3.0), ("doc_1#0", 1.5)]),
    ({"c1": "alpha", "c2": "alpha"}, "alpha", {}, [("c1", 1.0), ("c2", 1.0)], None),
    ({"c1": "alpha"}, "unknown", {}, [], None),
]


@pytest.mark.parametrize("records, query, settings, greedy, ranked", CASES)
def test_graph_search(spark, records, query, settings, greedy, ranked):
    assert scores(spark, records, query, RetrievalConfig(expansion="greedy", **settings)) == greedy
    assert scores(spark, records, query, RetrievalConfig(expansion="ranked", **settings)) == (ranked or greedy)


def test_graph_search_limits(spark):
    assert scores(spark, CASES[0][0], "python", GREEDY, 0) == [] == scores(spark, CASES[0][0], "python", GREEDY, -1) == scores(spark, CASES[0][0], " ", GREEDY)
    assert scores(spark, CASES[0][0], "python", GREEDY, 1) == [("c1", 2.0)]


def test_supplied_terms_win(spark):
    q = asked(spark, "python").withColumn("terms", F.array(F.lit(" Backend! ")))
    rows = graph.search(chunk_rows(spark, CASES[0][0]), q, 5, GREEDY).orderBy(F.desc("score")).collect()
    assert rows[0].chunk_id == "c2"


def plain_greedy(query, weights, limit, most):
    out, seen = [], set(query)
    for t in query:
        n = 0
        for w, x in sorted(((-w, x) for x, w in weights.get(t, {}).items())):
            if n == limit:
                break
            if x not in seen:
                seen.add(x)
                out.append((t, x, -w))
                n += 1
        if len(out) >= most:
            break
    return sorted(out, key=lambda r: (-r[2], r[1], r[0]))[:most]


def plain_ranked(query, weights, limit, most):
    best = [(t, x, w) for t in sorted(query) for x, w in sorted(((x, w) for x, w in weights.get(t, {}).items() if x not in query), key=lambda r: (-r[1], r[0]))[:limit]]
    out, seen = [], set()
    for t, x, w in best:
        if x not in seen and len(out) < most:
            seen.add(x)
            out.append((t, x, w))
    return sorted(out, key=lambda r: (-r[2], r[1], r[0]))


def test_expansions_against_loops(spark):
    rng = random.Random(4)
    names = [f"t{i}" for i in range(9)]
    near, queries = [], []
    graphs = {}
    for g in range(25):
        weights = {}
        for a in names:
            for b in names:
                if a < b and rng.random() < 0.5:
                    w = rng.randint(1, 3)
                    weights.setdefault(f"{g}{a}", {})[f"{g}{b}"] = w
                    weights.setdefault(f"{g}{b}", {})[f"{g}{a}"] = w
        query = [f"{g}{x}" for x in rng.sample(names, rng.randint(1, 4))]
        graphs[f"q{g}"] = (query, weights)
        near += [(a, b, float(w)) for a, m in weights.items() for b, w in m.items()]
        queries += [(f"q{g}", query, i, t) for i, t in enumerate(query)]
    n = spark.createDataFrame(near, "term string, neighbour string, weight double")
    q = spark.createDataFrame(queries, "query_id string, directs array<string>, nth int, term string")
    for limit, most in ((2, 3), (3, 10), (1, 2)):
        for kind, plain in (("greedy", plain_greedy), ("ranked", plain_ranked)):
            got = {}
            for r in graph.expand(q, n, RetrievalConfig(expansion=kind, expand_per_term_limit=limit, max_expanded_terms=most)).collect():
                got.setdefault(r.query_id, []).append((r.query_term, r.expanded_term, r.weight))
            for name, (query, weights) in graphs.items():
                assert sorted(got.get(name, []), key=lambda r: (-r[2], r[1], r[0])) == plain(query, weights, limit, most)


def test_lazy_and_written_edges_agree(spark):
    c = chunk_rows(spark, CASES[4][0])
    t = graph.query_terms(asked(spark, "aa bb", "xx"))
    key = lambda df: sorted(map(tuple, df.select("term", "neighbour", "weight").collect()))
    assert key(terms.neighbours(c, t)) == key(terms.neighbours_from_edges(terms.cooccurrence(c), t))


def test_explain(spark):
    row = graph.explained(chunk_rows(spark, CASES[4][0]), asked(spark, "aa bb", "none"), 5, GREEDY).orderBy("query_id").collect()
    assert row[0].direct_terms == ["aa", "bb"] and [c.chunk_id for c in row[0].chunks] == ["c3", "c1", "c5", "c2", "c4"]
    assert row[0].chunks[0].direct_terms == ["bb"] and row[0].chunks[0].expansion_capped is False and row[0].meta.expansion_depth == 1
    assert [(x.expanded_term, x.contribution) for x in row[0].chunks[0].expanded_hits][0] == ("xx", 1.0)
    assert row[1].chunks == [] and row[1].expanded_terms == []


def vectors(spark):
    rows = [("doc1", "a1", [1.0, 0.0]), ("doc1", "b1", [0.8, 0.2]), ("doc2", "a1", [0.0, 1.0]), ("doc2", "b1", [0.2, 0.8])]
    return spark.createDataFrame(rows, "doc_id string, chunk_id string, embedding array<double>").withColumn("norm", norm(F.col("embedding")))


def test_vector_search(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    run = lambda k=9, **o: [(r.doc_id, r.chunk_id, round(r.score, 6)) for r in vector.search(vectors(spark), q, k, SearchOptions(**o)).orderBy(F.desc("score"), "doc_id", "chunk_id").collect()]
    assert run() == [("doc1", "a1", 1.0), ("doc1", "b1", 0.970143), ("doc2", "b1", 0.242536), ("doc2", "a1", 0.0)]
    assert {r[0] for r in run(filter_doc_id="doc2")} == {"doc2"}
    assert len(run(min_score=0.8)) == 2 and run(min_score=1.1) == [] and len(run(min_score=0.0)) == 4
    assert run(1) == [("doc1", "a1", 1.0)] and run(0) == []


def side(spark, *rows):
    return spark.createDataFrame([("q", *r) for r in rows], "query_id string, doc_id string, chunk_id string, score double")


def fused(spark, v, g, **cfg):
    got = fusion.fuse(side(spark, *v), side(spark, *g), RetrievalConfig(**({"alpha": 1.0, "beta": 1.0, "normalise": False} | cfg)))
    return [(r.chunk_id, round(r.score, 4), r.source) for r in got.orderBy(F.desc("score"), "chunk_id", "doc_id").collect()]


def test_fusion(spark):
    assert fused(spark, [("d", "c1", 0.8)], [("d", "c1", 1.5)]) == [("c1", 2.3, "hybrid")]
    assert fused(spark, [("d", "c1", 0.7)], []) == [("c1", 0.7, "vector")]
    assert fused(spark, [], [("d", "c1", 1.2)]) == [("c1", 1.2, "graph")]
    assert fused(spark, [("d", "c1", 0.3), ("d", "c2", 0.9)], [("d", "c1", 1.0)]) == [("c1", 1.3, "hybrid"), ("c2", 0.9, "vector")]
    v, g = [("d1", "c1", 0.3), ("d2", "c2", 0.9)], [("d1", "c1", 2.0), ("d3", "c3", 5.0)]
    assert fused(spark, v, g, normalise=True) == [("c2", 1.0, "vector"), ("c3", 1.0, "graph"), ("c1", 0.7333, "hybrid")]
    v, g = [("d", "a", 0.9), ("d", "b", 0.1)], [("d", "a", 1.0), ("d", "b", 10.0)]
    assert fused(spark, v, g, normalise=True, beta=0.1)[0][0] == "a" and fused(spark, v, g, normalise=True, alpha=0.1)[0][0] == "b"


def test_min_max_of_equal_scores(spark):
    assert [s for _, s, _ in fused(spark, [("d", x, 5.0) for x in "abc"], [], normalise=True, beta=0.0)] == [1.0, 1.0, 1.0]
    assert [s for _, s, _ in fused(spark, [("d", x, 0.0) for x in "ab"], [], normalise=True, beta=0.0)] == [0.0, 0.0]


def test_last_of_repeated_scores_wins(spark):
    rows = side(spark, ("d", "c", 0.9), ("d", "c", 0.2)).withColumn("nth", F.monotonically_increasing_id())
    assert fusion.last_wins(rows.coalesce(1), "nth").first().score == 0.2


def kept(spark, rows, k, least=None):
    df = spark.createDataFrame([("q", "d", c, s, "vector") for c, s in rows], "query_id string, doc_id string, chunk_id string, score double, source string")
    return [r.score for r in fusion.postprocess(df, k, least).orderBy("rank").collect()]


def test_postprocess(spark):
    assert kept(spark, [("a", 0.55), ("b", 0.95), ("c", 0.75)], 5) == [0.95, 0.75, 0.55]
    assert kept(spark, [("a", 0.70), ("a", 0.92), ("b", 0.95), ("c", 0.85)], 5) == [0.95, 0.92, 0.85]
    assert kept(spark, [("a", 0.90), ("a", 0.92), ("b", 0.88), ("c", 0.85)], 2) == [0.92, 0.88]
    assert kept(spark, [("a", 0.90), ("b", 0.70), ("c", 0.69)], 5, 0.70) == [0.90, 0.70]


def measured(spark, got, want, k):
    df = spark.createDataFrame([("m", "q", got, want)], "mode string, query string, retrieved_chunk_ids array<string>, relevant_chunk_ids array<string>")
    return evaluate.evaluated(df, k).first()


def test_measures(spark):
    assert measured(spark, ["c1", "c2", "c3"], ["c2", "c4"], 2).recall_at_k == 0.5
    assert round(measured(spark, ["c1", "c2", "c3"], ["c1", "c2", "c5"], 2).recall_at_k, 4) == 0.6667
    empty = measured(spark, [], ["c1", "c2"], 3)
    assert (empty.recall_at_k, empty.mrr) == (0.0, 0.0)
    row = measured(spark, ["c2", "c3", "c1"], ["c1"], 2)
    assert row.recall_at_k == 0.0 and round(row.mrr, 4) == 0.3333
    row = measured(spark, ["c1", "c3"], ["c1", "c2"], 2)
    assert "ranks of relevant: c1: 1, c2: not found" in evaluate.case_report(evaluate.evaluated(spark.createDataFrame([("m", "q", ["c1", "c3"], ["c1", "c2"])], "mode string, query string, retrieved_chunk_ids array<string>, relevant_chunk_ids array<string>"), 2))
    assert row.relevant_ranks == {"c1": 1, "c2": None} and row.false_negatives == ["c2"] and row.false_positives == ["c3"]
    assert measured(spark, ["c1", "c3", "c1"], ["c1"], 3).relevant_ranks == {"c1": 3}
    assert measured(spark, ["x", "x"], ["y", "y"], 3).false_positives == ["x", "x"]
    with pytest.raises(ValueError):
        measured(spark, ["c1"], ["c1"], 0)
    with pytest.raises(Exception, match="relevant"):
        measured(spark, ["c1"], [], 1)
    with pytest.raises(ValueError):
        evaluate.mode_flags("x")


def test_answers(spark):
    final = spark.createDataFrame([("q0", 1, "d", "d#0", "hybrid", 0.98765, "one\ntwo ")], "query_id string, rank int, doc_id string, chunk_id string, source string, score double, text string")
    q = asked(spark, "what", "nothing")
    got = {r.query_id: r.answer for r in answer.listing(final, q).collect()}
    assert got["q0"].endswith("\n- [hybrid] d/d#0 score=0.988: one two") and got["q1"] == answer.NOTHING + "nothing"
    model = answer.FakeModel()
    assert answer.generate(final, q, model) == [("q0", "fake-answer"), ("q1", "fake-answer")] and "nothing" in model.last_prompt
    prompt = answer.prompts(final, q).orderBy("query_id").first().prompt
    assert "[d:d#0|hybrid|score=0.9877]\none\ntwo " in prompt and prompt.startswith(answer.PROMPT[0])

    def broken(_):
        raise RuntimeError("down")

    with pytest.raises(QueryExecutionError) as e:
        answer.generate(final, q, broken)
    assert e.value.stage == "generation" and isinstance(e.value.cause, RuntimeError)


def test_bad_queries(spark):
    with pytest.raises(ValidationError):
        hybrid.checked_queries(asked(spark, "fine", " 　"))

    def broken(_):
        raise RuntimeError("no model")

    with pytest.raises(QueryExecutionError) as e:
        hybrid.hybrid(chunk_rows(spark, {"c": "x"}), asked(spark, "fine"), embed=broken)
    assert e.value.stage == "embedding"


def test_batches_of_any_size(spark, monkeypatch):
    """What is too large to be broadcast is joined, with the same result; only ``execute`` has a bound."""
    c, q = chunk_rows(spark, CASES[4][0]), asked(spark, "aa bb", "xx", "zz ww", "aa", "none")
    rows = lambda: sorted(map(tuple, graph.search(c, q, 5, GREEDY).collect()))
    few = rows()
    monkeypatch.setattr(batch, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(batch.is_small, "__defaults__", (2,))
    assert rows() == few and "SortMergeJoin" in graph.search(c, q, 5, GREEDY)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(hybrid, "MOST_EXECUTED", 4)
    with pytest.raises(ValidationError, match="more than 4 queries"):
        hybrid.execute(c, q, GREEDY, QueryOptions(enable_vector=False))


def loop_of_vectors(chunks, queries, k, least=None):
    """Every pair by itself, the products added up from the first component on."""
    out = []
    for name, q in queries:
        found = []
        for doc, chunk, v in chunks:
            if q is None or v is None or len(q) != len(v) or any(x is None or not math.isfinite(x) for x in [*q, *v]):
                continue
            dot = lambda a, b: functools.reduce(lambda s, xy: s + xy[0] * xy[1], zip(a, b), 0.0)
            bottom = math.sqrt(dot(v, v)) * math.sqrt(dot(q, q))
            score = dot(q, v) / bottom if bottom else 0.0
            if least is None or score >= least:
                found.append((-score, doc, chunk))
        out += [(name, d, c, -s) for s, d, c in sorted(found)[:k]]
    return sorted(out)


@pytest.mark.parametrize("numbers, queries_, chunks_", [(4_000_000, 2_048, 65_536), (0, 3, 7), (0, 100, 5)])
def test_vector_search_in_tiles(spark, monkeypatch, numbers, queries_, chunks_):
    for name, value in (("SENT_NUMBERS", numbers), ("QUERY_TILE", queries_), ("CHUNK_TILE", chunks_), ("PRODUCT_ROWS", 5)):
        monkeypatch.setattr(vector, name, value)
    rng = random.Random(6)
    v = lambda: [float(rng.randint(-2, 2)) for _ in range(4)]  # noqa: E731  (many ties)
    chunks = [(f"d{i % 9}", f"c{i}", v()) for i in range(60)] + [("d1", "n", None), ("d1", "m", [1.0, None, 0.0, 0.0]), ("d1", "nan", [float("nan")] * 4), ("d1", "inf", [float("inf")] + [1.0] * 3), ("d1", "short", [1.0]), ("d0", "zero", [0.0] * 4), ("d0", "empty", [])]
    queries = [(f"q{i}", v()) for i in range(11)] + [("zero", [0.0] * 4), ("none", None), ("one", [2.0])]
    c = spark.createDataFrame(chunks, "doc_id string, chunk_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    for k, least in ((5, None), (100, 0.25), (1, None), (0, None)):
        got = vector.search(c, q, k, SearchOptions(min_score=least))
        assert got.columns == ["query_id", "doc_id", "chunk_id", "score", "source"]
        assert sorted(tuple(r)[:4] for r in got.collect()) == loop_of_vectors(chunks, queries, k, least)
    assert sorted(map(tuple, vector.similarities(c, q).collect())) == loop_of_vectors(chunks, queries, 1000)
    assert vector.search(c, q.where("false"), 5).count() == 0 == vector.search(c.where("false"), q, 5).count()


def test_twenty_thousand_queries(spark):
    rng = np.random.default_rng(7)
    rows, asks = rng.normal(size=(700, 8)), rng.normal(size=(20_000, 8))
    c = spark.createDataFrame([("d", f"{i:04}", v.tolist()) for i, v in enumerate(rows)], "doc_id string, chunk_id string, embedding array<double>")
    q = spark.createDataFrame(pd.DataFrame({"query_id": np.arange(20_000), "embedding": asks.tolist()}), "query_id bigint, embedding array<double>")
    for numbers in (vector.SENT_NUMBERS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(vector, "SENT_NUMBERS", numbers)
            got = vector.search(c, q, 3).toPandas().sort_values(["query_id", "score"], ascending=[True, False])
        assert len(got) == 60_000
        score = (asks @ rows.T) / np.linalg.norm(asks, axis=1)[:, None] / np.linalg.norm(rows, axis=1)
        assert (got["chunk_id"].astype(int).to_numpy().reshape(-1, 3) == np.argsort(-score, axis=1)[:, :3]).all()


def test_modes_need_only_their_side(spark):
    c = chunk_rows(spark, CASES[0][0])  # no embeddings
    rows = hybrid.hybrid(c, asked(spark, "python"), GREEDY, QueryOptions(enable_vector=False)).orderBy("rank").collect()
    assert [(r.chunk_id, r.source, r.text) for r in rows] == [("c1", "graph", "python fastapi tutorial"), ("c2", "graph", "fastapi backend service")]


def test_execute_tells_of_its_stages(spark):
    c, trace = chunk_rows(spark, CASES[0][0]), RecordedTrace()
    model = answer.FakeModel("yes")
    final, answers, took = hybrid.execute(c, asked(spark, "python", "zzzz"), GREEDY, QueryOptions(enable_vector=False), model=model, trace=trace)
    assert [e for e, _ in trace.events] == ["query_start", "graph_retrieved", "retrieval_timing", "retrieval_query_done", "query_done"]
    assert dict(trace.events)["graph_retrieved"] == {"count": 2} and set(took) == {"check", "graph", "postprocess", "generation"}
    assert [(r.chunk_id, r.rank) for r in final] == [("c1", 1), ("c2", 2)] and [a for _, a in answers] == ["yes", "yes"]
    listed = hybrid.execute(c, asked(spark, "zzzz"), GREEDY, QueryOptions(enable_vector=False))
    assert listed[0] == [] and listed[1][0][1].endswith("zzzz")


def test_failures_of_actions_carry_their_stage(spark):
    c = chunk_rows(spark, CASES[0][0]).withColumn("terms", F.when(F.length("text") > 0, F.raise_error(F.lit("bad file"))).otherwise(F.col("terms")))
    trace = RecordedTrace()
    with pytest.raises(QueryExecutionError, match="bad file") as e:
        hybrid.execute(c, asked(spark, "python"), GREEDY, QueryOptions(enable_vector=False), trace=trace)
    assert e.value.stage == "retrieval" and trace.events[-1][0] == "query_failed" and trace.events[-1][1]["stage"] == "retrieval"

    def broken(_):
        raise RuntimeError("down")

    with pytest.raises(QueryExecutionError) as e:
        hybrid.execute(chunk_rows(spark, CASES[0][0]), asked(spark, "python"), GREEDY, QueryOptions(enable_vector=False), model=broken)
    assert e.value.stage == "generation"


def test_models_behind_http():
    import http.server
    import json
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            out = {"response": f"local {body['prompt']}"} if self.path == "/api/generate" else {"output": [{"content": [{"text": f"{self.headers['Authorization']} {body['input']}"}]}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{server.server_port}"
    assert answer.ollama("m", host)("hi") == "local hi" and answer.openai_responses("m", "k", host)("hi") == "Bearer k hi"
    server.shutdown()


def test_trace(tmp_path, monkeypatch):
    import logging

    monkeypatch.setattr(logging.getLogger("brindle"), "handlers", [])
    set_up_logging(str(tmp_path / "log"))
    trace = Trace("t1", lambda: "now").bind(doc_id="d")
    trace.event("ingest_start", n=1)
    assert '{"event": "ingest_start", "trace_id": "t1", "doc_id": "d", "n": 1}' in (tmp_path / "log").read_text() and trace.started_at == "now"


def test_a_product_takes_as_much_memory_whatever_the_number_of_queries():
    """Queries meet a part of the chunks some at a time: 4,000 queries and 4,000 chunks at once took 128 MB for each matrix."""
    rng = np.random.default_rng(5)
    asked, vectors = rng.normal(size=(4_000, 8)), rng.normal(size=(4_000, 8))
    part = lambda names, v: (names, v, np.sqrt((v * v).sum(axis=1)))
    ids = pa.array([str(i) for i in range(4_000)])
    tracemalloc.start()
    found = {q: [] for q in ids.to_pylist()}
    for batch in vector._nearest([part([ids], asked)], part([ids, ids], vectors), 2, None):
        for q, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            found[q].append(c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and all(len(x) >= 2 for x in found.values())


def test_all_pairs_are_cut_into_tasks_by_their_number(spark, monkeypatch):
    """More pairs make more tasks, on both ways by which queries reach chunks."""
    rows = spark.createDataFrame([(str(i), str(i), [float(i), 1.0]) for i in range(40)], "doc_id string, chunk_id string, embedding array<double>")
    asks = rows.selectExpr("chunk_id as query_id", "embedding")
    want = sorted(map(tuple, vector.similarities(rows, asks).collect()))
    monkeypatch.setattr(vector, "TASK_PAIRS", 100)
    monkeypatch.setattr(vector, "QUERY_TILE", 10)
    for numbers in (vector.SENT_NUMBERS, 0):
        monkeypatch.setattr(vector, "SENT_NUMBERS", numbers)
        got = vector.similarities(rows, asks)
        assert got.rdd.getNumPartitions() == 16 and sorted(map(tuple, got.collect())) == want
