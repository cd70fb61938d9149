"""Co-occurrence by stripes, against pairs that are counted one by one."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest

from brindle.operators import stripes, terms


def by_hand(chunks):
    return Counter(p for c in chunks for p in itertools.combinations(sorted(c), 2))


def made(spark, chunks):
    return spark.createDataFrame([(c,) for c in chunks], "terms array<string>").repartition(3)


@pytest.mark.parametrize("common, entries, pairs", [(1 << 16, 4_000_000, 8_000_000), (5, 40, 200)])
def test_edges_are_those_counted_one_by_one(spark, monkeypatch, common, entries, pairs):
    """Few numbered terms, and few pairs and entries at once, so that names, cuts and sums in parts are met."""
    for name, value in (("COMMON", common), ("ENTRIES", entries), ("PAIRS", pairs)):
        monkeypatch.setattr(stripes, name, value)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["é", "zz", "Z", "_", ""]
    chunks = [rng.sample(words, min(len(words), int(rng.expovariate(0.1)))) for _ in range(300)] + [[], ["only"]]
    want, df = by_hand(chunks), made(spark, chunks)
    assert {(r.source, r.target): r.weight for r in terms.cooccurrence(df).collect()} == want
    both = {p: n for (a, b), n in want.items() for p in ((a, b), (b, a))}
    got = stripes.counted(df, 4, both=True, prefix=3).collect()
    assert len(got) == len(both) and {(r.source, r.target): r.n for r in got} == both
    for source in {a for a, _ in both}:
        first = sorted((-n, b) for (a, b), n in both.items() if a == source)[:3]
        assert sorted((r.place, r.target) for r in got if r.source == source and r.place <= 3) == [(i, b) for i, (_, b) in enumerate(first, 1)]


def test_what_is_shuffled_is_small(spark):
    """Equal chunks of one task give a stripe for each term, and no row for each pair."""
    chunks = made(spark, [[f"t{i}" for i in range(40)]] * 500).coalesce(1)
    plan = stripes.counted(chunks, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and terms.cooccurrence(chunks).count() == 780


@pytest.mark.parametrize("common, entries", [(1 << 16, 4_000_000), (5, 40)])
def test_edges_from_the_rarer_term_and_first_neighbours(spark, monkeypatch, common, entries):
    """Each pair once, a term without a number or the rarer one first; of these each term's first three, from both ends."""
    for name, value in (("COMMON", common), ("ENTRIES", entries)):
        monkeypatch.setattr(stripes, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["é", "Z", ""]
    chunks = [[w for i, w in enumerate(words) if rng.random() < 3 / (i + 3)] for _ in range(300)]
    count = Counter(w for c in chunks for w in c)
    numbered = sorted(count, key=lambda w: (-count[w], w.encode()))[:common]
    order = {w: (-numbered.index(w) if w in numbered else -common, w) for w in count}
    want, df = by_hand(chunks), made(spark, chunks)
    names = stripes.commonest(spark.createDataFrame(list(count.items()), "term string, count bigint"))
    assert names.to_pylist() == numbered
    edges = stripes.counted(df, 4, rare_first=True, common=names).select("source", "target", "n")
    got = edges.collect()
    assert {tuple(sorted(r[:2])): r.n for r in got} == want and len(got) == len(want) and all(order[r.source] < order[r.target] for r in got)
    first = {(r.source, r.place): (r.target, r.n) for r in stripes.firsts(edges, 4, 3, names).collect()}
    beside = {w: sorted((-n, next(x for x in p if x != w)) for p, n in want.items() if w in p)[:3] for w in count}
    assert first == {(w, i): (x, -n) for w, found in beside.items() for i, (n, x) in enumerate(found, 1)}


def test_a_store_writes_each_edge_once(spark, tmp_path):
    """Edges aren't sorted or shuffled as rows, and the files hold them one way."""
    from brindle.config import RetrievalConfig
    from brindle.sources.index import IndexStore, build_index

    store = IndexStore(spark, str(tmp_path / "index"), edges=True)
    texts = spark.createDataFrame([(f"d{i}", "alpha beta gamma delta") for i in range(8)], "doc_id string, text string")
    store.write(build_index(texts, RetrievalConfig()))
    found = store.open()
    run = found.by_term.of("edges")[0]
    assert found.by_term.scan([run]).count() == 6 and run["rows"] == 12
    assert {(r.source, r.target): r.weight for r in found.edges().collect()} == {p: 8.0 for p in itertools.combinations(["alpha", "beta", "delta", "gamma"], 2)}


def test_rounds_count_each_pair_once_and_leave_no_shuffle(spark, monkeypatch):
    """Beyond so many pairs, a round counts its own sources alone; what it shuffled is gone when it ends."""
    monkeypatch.setattr(stripes, "ROUND_PAIRS", 3_000)
    monkeypatch.setattr(stripes, "PAIRS", 500)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["é", "Z", ""]
    chunks = [rng.sample(words, min(len(words), int(rng.expovariate(0.1)))) for _ in range(200)] + [[], ["only"]]
    want, df = by_hand(chunks), made(spark, chunks)
    rounds = stripes.rounds_for(stripes.total(df))
    assert len(rounds) > 3
    each = [{(r.source, r.target): r.n for r in stripes.counted(df, 4, both=True, which=r).collect()} for r in rounds]
    assert sum(map(len, each)) == 2 * len(want) and {k: n for x in each for k, n in x.items()} == {p: n for (a, b), n in want.items() for p in ((a, b), (b, a))}
    left = []
    shuffles = lambda: set(re.findall(r"shuffle_(\d+)", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before, whole = shuffles(), stripes.settle_freed
    monkeypatch.setattr(stripes, "settle_freed", lambda rows: (out := whole(rows), left.append(shuffles() - before))[0])
    got = {r.source: (r.edges, r.weight, r.heaviest) for r in terms.cooccurrence_by_source(df).collect()}
    of = {a: [n for p, n in want.items() if p[0] == a] for a, _ in want}
    assert got == {a: (len(n), float(sum(n)), float(max(n))) for a, n in of.items()}
    assert len(left) == len(rounds) and left[-1] <= left[0]  # of the count of terms alone
