"""Graph search where chunks lie: as by rows of hits, without a shuffle of these."""

from __future__ import annotations

import random

import pytest

from brindle.config import RetrievalConfig
from brindle.operators import graph
from brindle.sources.index import IndexStore


@pytest.mark.parametrize("cap, most", [(2.0, 2_000_000), (None, 7)])
def test_hits_are_added_up_where_chunks_lie(spark, tmp_path, monkeypatch, cap, most):
    """Many equal scores, so that names decide; a few hits at once."""
    monkeypatch.setattr(graph, "HITS", most)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    texts = spark.createDataFrame([(f"d{i}é" if i % 9 == 0 else f"d{i}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(200)], "doc_id string, text string")
    cfg = RetrievalConfig(chunk_size=20, chunk_overlap=0, chunking="fixed", expansion="ranked", expansion_score_cap=cap)
    store = IndexStore(spark, str(tmp_path / "index"), postings=False)
    store.build(texts, cfg)
    found = store.open()
    queries = spark.createDataFrame([("q1", "w1 w2 w3"), ("q2", "w4"), ("q3", "nowhere"), ("q4", "w1 w9")], "query_id string, query string")
    for k in (1, 10, 10_000):
        got, want = (graph.search(x, queries, k, cfg).drop("source") for x in (found, store.read()))
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    explained = [{(r.query_id, r.chunk_id): (r.score, tuple(r.direct_terms), sorted(r.expanded_hits)) for r in graph.search(x, queries, 4, cfg, explain=True).collect()} for x in (found, store.read())]
    assert explained[0] == explained[1]
    plan = graph.search(found, queries, 10, cfg)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Aggregate" not in plan
