"""Mixing, sharding, joins, dedup, neighbours and the pipeline: against brute force and invariants."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import components, jaccard, mixing, permutations, secrets, sharding, suffixes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, rank string, block string, shard string, stratum string, id string"


def docs(spark, texts, sources=None):
    """Rows with null and clashing columns."""
    return spark.createDataFrame([(i, t, (sources or [None])[i % len(sources or [None])], "x", "x", "x", None, "x") for i, t in enumerate(texts)], SCHEMA)


def mixture_of(sizes, **target):
    """Weights by a plain bisection."""
    total = sum(sizes.values())
    share = {s: n / total for s, n in sizes.items()}

    def at(x):
        raised = {s: p**x for s, p in share.items()}
        z = sum(raised.values())
        return {s: r / z for s, r in raised.items()}

    def meets(x):
        q = at(x)
        if "target_entropy" in target:
            return -sum(p * math.log(p) for p in q.values()) <= target["target_entropy"]
        ratio = {s: q[s] / share[s] for s in q}
        return max(ratio.values()) <= target["max_repetition"] * min(ratio.values())

    low, high = 0.0, 16.0 if "target_entropy" in target else 1.0
    if meets(0.0):
        return at(0.0)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if meets(mid) else (mid, high)
    return at(high)


@pytest.mark.parametrize("target", [{"max_repetition": 3.0}, {"max_repetition": None, "target_entropy": 0.9}])
def test_mixing_weights(spark, target, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    rng = random.Random(1)
    names = ["big"] * 12 + ["mid"] * 3 + [None]
    texts = [" ".join(["w"] * rng.randint(1, 20)) for _ in range(480)]
    d = docs(spark, texts, names)
    sizes = collections.Counter()
    for i, t in enumerate(texts):
        sizes[names[i % 16]] += len(t.split())
    rows = mixing.mixture(d, **target).collect()
    want = mixture_of(sizes, **{k: v for k, v in target.items() if v is not None})
    assert {r.source: round(r.weight, 6) for r in rows} == {s: round(w, 6) for s, w in want.items()}
    budget = max(sizes[s] / want[s] for s in sizes)
    drawn, times = collections.Counter(), collections.Counter()
    for r in rows:
        drawn[r.source] += r.n_tokens
        times[r.source, r.doc_id] += 1
    for s in sizes:
        assert 0 <= drawn[s] - want[s] * budget < 20 or abs(drawn[s] - want[s] * budget) < 1
        counts = {times[s, i] for i in range(480) if names[i % 16] == s}
        assert min(counts) >= 1 and max(counts) - min(counts) <= 1  # whole epochs and a part of one
    for (s, e), group in group_by(rows, lambda r: (r.source, r.epoch)).items():
        ranks = {(r.block, r.block_rank) for r in group}
        assert sorted(k for _, k in ranks) == list(range(len(ranks)))
        for block in group_by(group, lambda r: r.block).values():
            assert sorted(r.slot for r in block) == list(range(len(block)))
    orders = {e: [r.doc_id for r in sorted(g, key=lambda r: (r.block_rank, r.slot))] for (s, e), g in group_by(rows, lambda r: (r.source, r.epoch)).items() if s is None}
    assert len(orders) < 2 or orders[1] != orders[2]


def group_by(rows, key):
    out = collections.defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def test_mix_keeps_rows(spark):
    d = docs(spark, ["a b c"] * 30 + ["a"] * 3 + [None, "", " "], ["x"] * 11 + ["y"])
    got = mixing.mix(d, max_repetition=2.0)
    assert got.columns == d.columns and {r.doc_id for r in got.collect()} == set(range(36))
    counts = collections.Counter(r.doc_id for r in got.collect())
    assert sorted(map(tuple, mixing.mixture(d, max_repetition=2.0).groupBy("doc_id").count().collect())) == sorted(counts.items())
    assert mixing.mix(d.where("false")).count() == 0 and mixing.mixture(docs(spark, [None, ""])).count() == 2
    fixed = mixing.mixture(d, max_repetition=10.0, budget=45.0)
    assert sum(r.n_tokens for r in fixed.collect()) < 45 + 6


def test_many_sources_with_a_target_entropy(spark):
    """Weights take time with the number of sources, not with its square."""
    import time

    n = 10_000
    slim = spark.range(n).select(F.concat(F.lit("s:"), F.col("id").cast("string")).alias("stratum"), (F.col("id") % 97 + 1).alias("n_tokens"))
    began = time.time()
    rows = mixing.plan(slim, max_repetition=None, target_entropy=9.0).collect()
    assert time.time() - began < 60 and len(rows) == n
    q = [r.weight for r in rows]
    assert abs(sum(q) - 1) < 1e-6 and abs(-sum(x * math.log(x) for x in q) - 9.0) < 1e-3


def test_mixing_repeated_and_long_rows(spark):
    d = docs(spark, ["w " * 200_000, "same"] + ["same"] * 20).unionAll(docs(spark, ["w " * 200_000, "same"]))
    rows = mixing.mixture(d, max_repetition=2.0).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter([0, 0, 1, 1, *range(2, 22)])
    assert {r.n_tokens for r in rows if r.doc_id == 0} == {200_000}


def plain_ring(nodes, rows, shards):
    """Each row alone: its arc's shard if there is room, and the overflow clockwise, arc after arc."""
    total = sum(map(len, rows))
    room = [total // shards + (s < total % shards) for s in range(shards)]
    home, over = {}, []
    for arc, (_, s) in enumerate(nodes):
        for r in rows[arc]:
            if room[s]:
                room[s] -= 1
                home[r] = s
            else:
                over.append((arc, r))
    for arc, r in over:
        while not room[nodes[arc % len(nodes)][1]]:
            arc += 1
        s = nodes[arc % len(nodes)][1]
        room[s] -= 1
        home[r] = s
    return home


def test_layout_like_a_ring():
    rng = random.Random(2)
    for _ in range(30):
        shards = rng.randint(1, 6)
        nodes = sorted((rng.randrange(1000), s) for s in range(shards) for _ in range(rng.randint(1, 4)))
        counts = {a: rng.choice([0, 1, 5, 60]) for a in range(len(nodes))}
        home = plain_ring(nodes, [[(a, i) for i in range(counts[a])] for a in range(len(nodes))], shards)
        got = {(s.arc, i): s.shard for s in sharding.lay(nodes, counts, shards) for i in range(s.start, s.stop)}
        assert got == home


def test_sharding(spark):
    texts = ["hot"] * 150 + [f"text {i} é" for i in range(331)] + [None, "", "x" * 50_000]
    rows = sharding.shard(docs(spark, texts), shards=7, replicas=5).collect()
    assert len(rows) == len(texts)
    by = group_by(rows, lambda r: r.shard)
    sizes = [len(g) for g in by.values()]
    assert len(by) == 7 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())
    import zlib

    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert sorted(map(tuple, sharding.shard(docs(spark, texts).repartition(9), shards=7, replicas=5).collect()), key=str) == sorted(map(tuple, rows), key=str)
    loose = group_by(sharding.shard(docs(spark, texts), shards=7, replicas=5, slack=0.25).collect(), lambda r: r.shard)
    assert max(map(len, loose.values())) <= -(-int(len(texts) * 1.25) // 7)
    assert sharding.shard(docs(spark, texts).where("false")).count() == 0
    assert sharding.shard(docs(spark, ["a", "b"]), shards=7, replicas=5).count() == 2


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == plain_components([(a, b) for a, b in edges if a != b])


def plain_join(texts, k, percent):
    sets, index, edges = [], collections.defaultdict(list), []
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
        shared = collections.Counter()
        for x in sets[i]:
            shared.update(index[x])
            index[x].append(i)
        edges += [(j, i) for j, o in shared.items() if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o)]
    roots = plain_components(edges)
    return {i: (len(s), roots.get(i, i)) for i, s in enumerate(sets)}


def near_copies(rng, words, groups, most):
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 11, 12, 20, 40, 80]))]
        for _ in range(rng.choice([1, 2, 3, most])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[rng.choice(words)], [w[at], rng.choice(words)], [] if len(w) > 1 else [w[at]]])
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k, percent, block", [(3, 90, 10**6), (5, 80, 10**6), (2, 80, 60)])
def test_jaccard_join(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(k)
    texts = near_copies(rng, [f"w{i}" for i in range(50)], 40, 20) + [None, "", " \t", "A b", "a B", "x"] + near_copies(rng, [f"v{i}" for i in range(2000)], 20, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts), k, percent).collect()}
    assert got == plain_join(texts, k, percent)


def test_join_odd_rows(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, base), (3, base), (None, base), (None, None), (8, base + " thirteen"), (9, "other")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(str, [tuple(r) for r in jaccard.join(d, 3, 80).collect()])) == sorted(map(str, [(3, 10, 3), (3, 10, 3), (None, 10, 3), (None, 0, None), (8, 11, 3), (9, 1, 9)]))
    assert sorted((r.doc_id is not None, r.doc_id, r.text) for r in jaccard.one_of_each(d, 3, 80).collect() if r.doc_id) == [(True, 3, base), (True, 9, "other")]
    assert jaccard.join(d.where("false")).count() == 0


def test_blocks_skip(spark):
    base = list(range(400))
    sets = [np.array(sorted({*base[:-1], 1000 + i}), np.int64) for i in range(200)]
    block = jaccard.Block(list(range(200)), sets, 90)
    assert len(block.links()) == 199 and block.compared == 199  # not the 19,900 pairs


def plain_links(texts, k, percent):
    """Every pair of linked texts, copies too."""
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    return [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b and 100 * len(a & b) >= percent * len(a | b)], sets


@pytest.mark.parametrize("k, percent, block", [(3, 90, 10**6), (5, 80, 10**6), (2, 80, 60)])
def test_every_link(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(10 + k)
    base = " ".join(rng.choice([f"w{i}" for i in range(50)]) for _ in range(60))
    texts = near_copies(rng, [f"w{i}" for i in range(50)], 30, 20) + [None, "", "A b", "a B"] + [f"{base} end{i % 25}" for i in range(30)]
    want, sets = plain_links(texts, k, percent)
    counts = collections.Counter(x for pair in want for x in pair)
    rows = {r.doc_id: r for r in jaccard.counted(docs(spark, texts), k, percent).collect()}
    assert {i: r.n_links for i, r in rows.items()} == {i: counts[i] for i in range(len(texts))}
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == plain_join(texts, k, percent)
    first = {frozenset(x): i for i, x in reversed(list(enumerate(sets)))}
    got = [tuple(r) for r in jaccard.pairs(docs(spark, texts), k, percent).collect()]
    assert sorted(got) == sorted({tuple(sorted((first[frozenset(sets[a])], first[frozenset(sets[b])]))) for a, b in want if sets[a] != sets[b]})


def test_common_parts_over_many_tasks(spark, monkeypatch):
    """Lists of common parts are dealt to pieces, and blocks to cuts of few sets, without losing a link."""
    monkeypatch.setattr(jaccard, "LIST", 4)
    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    monkeypatch.setattr(jaccard, "SETS", 7)
    rng = random.Random(21)
    base = [rng.choice([f"w{i}" for i in range(50)]) for _ in range(80)]
    texts = [" ".join([*base, f"end{i}"]) for i in range(60)] + [" ".join(["common"] * 9 + [f"u{i}x{k}" for k in range(30)]) for i in range(30)]
    d = docs(spark, texts).select("doc_id", "text")
    assert jaccard._common(d, 3, 90).count() > 0
    want, _ = plain_links(texts, 3, 90)
    counts = collections.Counter(x for pair in want for x in pair)
    assert {r.doc_id: r.n_links for r in jaccard.counted(d, 3, 90).collect()} == {i: counts[i] for i in range(len(texts))}


def test_join_tells_texts_of_one_id_apart(spark):
    """Unlike texts under one id: each has the component of its own text."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    d = spark.createDataFrame([(1, a + " x"), (5, a), (5, b), (7, b + " y"), (7, b + " y")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in jaccard.counted(d, 3, 80).collect()) == [(1, 1, 1), (5, 1, 1), (5, 5, 2), (7, 5, 2), (7, 5, 2)]
    assert sorted((r.doc_id, r.text) for r in jaccard.one_of_each(d, 3, 80).collect()) == [(1, a + " x"), (5, b)]
    odd = d.selectExpr("doc_id", "text", "1 AS tag", "2 AS row", "3 AS component_id", "4 AS `a.b`")
    assert jaccard.one_of_each(odd, 3, 80).columns == odd.columns and jaccard.one_of_each(odd, 3, 80).count() == 2


def test_links_two_size_classes_apart(spark):
    # a class lies between those of 209 and 315 shingles
    assert jaccard.size_class(209) == (140, 210) and jaccard.size_class(210)[1] == 315
    words = [f"w{i}" for i in range(315)]
    texts = [" ".join(words[:209]), " ".join(words), "x y"]
    for percent, want in ((66, [1, 1, 0]), (67, [0, 0, 0])):
        rows = sorted(tuple(r) for r in jaccard.counted(docs(spark, texts), 1, percent).collect())
        assert [r[3] for r in rows] == want and [r[2] for r in rows] == [0, 1 - want[0], 2]
    rng = random.Random(12)
    long = [" ".join(rng.sample(words, n)) for n in (30, 40, 60, 90, 120, 160, 200, 240, 265) for _ in range(3)]
    got = {r.doc_id: r.n_links for r in jaccard.counted(docs(spark, long), 1, 30).collect()}
    counts = collections.Counter(x for pair in plain_links(long, 1, 30)[0] for x in pair)
    assert got == {i: counts[i] for i in range(len(long))}
    with pytest.raises(ValueError):
        jaccard.join(docs(spark, texts), 1, 0)


def test_links_of_odd_rows(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, base), (3, base), (None, base), (None, None), (8, base + " thirteen"), (9, "other")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard.counted(d, 3, 80)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted((str(r.doc_id), r.n_links) for r in got.collect()) == [("3", 2), ("3", 2), ("8", 2), ("9", 0), ("None", 0), ("None", 3)]
    assert jaccard.counted(d.where("false")).count() == 0 and jaccard.pairs(d.where("false")).count() == 0


def test_block_gives_every_link():
    base = list(range(400))
    sets = [np.array(sorted({*base[:-1], 1000 + i}), np.int64) for i in range(200)]
    block = jaccard.Block(list(range(200)), sets, 90)
    assert sum(len(j) for _, j in block.every()) == 19_900 and block.compared < 1000 < block.derived
    rng = np.random.default_rng(4)
    for percent in (50, 70, 80, 90):
        sets = [np.unique(rng.choice(40 + 10 * (i % 3), rng.integers(20, 40))) for i in range(150)]
        block = jaccard.Block(list(range(150)), sets, percent)
        got = sorted(tuple(sorted((block.ids[i], block.ids[k]))) for i, j in block.every() for k in j.tolist())
        assert got == [(a, b) for a in range(150) for b in range(a + 1, 150) if 100 * (o := len(np.intersect1d(sets[a], sets[b]))) >= percent * (len(sets[a]) + len(sets[b]) - o)]


def test_similar_sets_bound_each_other():
    # two clusters that share 85 of 100, and small sets that make what they don't share common
    rng = np.random.default_rng(3)
    sets = []
    for i in range(12):
        own = range(100, 115) if i % 2 else range(200, 215)
        sets.append(np.array(sorted({*range(85), *own, 900 + i}), np.int64))
    sets += [np.sort(rng.choice([*range(100, 115), *range(200, 215)], 20, replace=False)).astype(np.int64) for _ in range(60)]
    block = jaccard.Block(list(range(len(sets))), sets, 80)
    want = plain_components([(a, b) for a in range(len(sets)) for b in range(a) if 100 * (o := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - o)])
    assert plain_components(block.links()) == want and want[2] == 0 and want[3] == 1 and block.derived > 0


def plain_dedup(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for j in range(len(raw)) if gone[j] and not (j and gone[j - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("bin_, most, hot", [(60_000, 1 << 20, False), (3, 1 << 20, False), (3, 6, False), (3, 6, True), (60_000, 1 << 20, True)])
def test_suffix_dedup(spark, monkeypatch, bin_, most, hot):
    """Bins in memory, in files, anchors too common for a bin, and anchors dealt by their surroundings."""
    if hot:
        for name, value in (("SAMPLED", 1), ("HOT", 100_000), ("FEW", 1)):
            monkeypatch.setattr(suffixes, name, value)
    monkeypatch.setattr(suffixes, "BIN", bin_)
    monkeypatch.setattr(suffixes, "MOST", most)
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([20, 40, 60, 80, 99, 100, 101, 150, 400]))) for _ in range(12)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(0, 6))) for _ in range(200)]
    texts += [None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 1000, "De " * 400, "De " * 400, "ab" * 300, "y" * 20_000]
    rng.shuffle(texts)
    d = docs(spark, texts).repartition(5)
    want = plain_dedup(texts)
    assert {r.doc_id: tuple(r[1:]) for r in suffixes.digest(suffixes.dedup(d)).collect()} == want
    if bin_ == 3:
        ways = {r.way for r in suffixes.repeats(suffixes._keyed(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))[1].collect()}
        assert ways == ({0, 1} if most > 6 else {0, 1, 2})
    assert suffixes.dedup(d.where("false")).count() == 0
    odd = spark.createDataFrame([(1, "q" * 150), (1, "q" * 150), (None, "q" * 150)], "doc_id bigint, text string")
    assert {(r.doc_id, r.n_removed) for r in suffixes.dedup(odd).collect()} == {(1, 149), (None, 0)}


def test_a_hot_k_mer_is_dealt_to_many_tasks(spark, monkeypatch):
    """One passage amid unlike surroundings in every text: its anchors lie in many tasks, and what is removed stays right."""
    monkeypatch.setattr(suffixes, "SAMPLED", 4)
    rng = random.Random(9)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = own(70)
    texts = [own(120) + passage + own(120) for _ in range(400)] + [passage * 3, passage * 3]
    texts += texts[:50]
    d = docs(spark, texts).repartition(4)
    rows = suffixes._dealt(suffixes._keyed(d)).withColumn("task", F.spark_partition_id()).where("around <> 0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tasks of a few rows would be joined
    common = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks"), F.min("hot").alias("hot")).where("n > 300").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert common and all(r.hot and r.tasks == int(spark.conf.get("spark.sql.shuffle.partitions")) for r in common)
    assert {r.doc_id: tuple(r[1:]) for r in suffixes.digest(suffixes.dedup(d)).collect()} == plain_dedup(texts)


def test_suffix_dedup_of_one_id_with_unlike_texts(spark):
    rng = random.Random(6)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(150)) for _ in range(2))
    d = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b + "!"), (3, b + "!")], "doc_id bigint, text string")
    got = sorted((r.doc_id, bytes(r.kept).decode()) for r in suffixes.dedup(d).collect())
    assert got == sorted([(1, a), (2, ""), (2, b), (3, "!"), (3, "!")])


def test_columns_in_a_file():
    rng = np.random.default_rng(1)
    n = 300
    flat = rng.integers(97, 99, (n, suffixes.AROUND)).astype(np.uint8)
    for i in range(1, n, 2):
        flat[i, 20:150] = flat[i - 1, 20:150]
    columns, zero = np.ascontiguousarray(flat.T), np.zeros(n, np.int64)
    found = suffixes.repeated_windows(columns, zero, zero + suffixes.AROUND, np.arange(n))
    for j, f in enumerate(found):
        seen, want = set(), []
        for i in range(n):
            w = flat[i, j : j + 100].tobytes()
            want += [i] if w in seen else []
            seen.add(w)
        assert sorted(f.tolist()) == want
    bin_ = suffixes.Bin(10)
    for k in range(0, n, 50):
        part = slice(k, k + 50)
        bin_.add(np.arange(n)[part], zero[part] + 500, zero[part].astype(np.int32), (zero + suffixes.AROUND)[part].astype(np.int32), flat[part])
    assert bin_.files and not bin_.flat
    assert bin_.resolve().num_rows == n // 2


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(900, 16))
    rows[100:160] = rows[100] + rng.normal(size=(60, 16)) * 0.01
    rows[200:230] = rows[200]
    data = [(i, [float(x) for x in v], "x") for i, v in enumerate(rows)]
    data += [(900, None, "x"), (920, [0.0] * 16, "x"), (940, [float("nan")] * 16, "x"), (960, [1.0] * 15 + [None], "x"), (980, [1.0], "x"), (None, [1.0] * 16, "x")]
    d = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, rank string")
    got = permutations.search(d).collect()
    exact = permutations.exact(d)
    assert len(got) == len(exact) == 45 * 20
    hit = {(r.query_id, r.vec_id) for r in got} & {(q, v) for q, _, v, _ in exact}
    assert len(hit) >= 0.9 * len(exact)
    for q, group in group_by(got, lambda r: r.query_id).items():
        group.sort(key=lambda r: r.rank)
        assert [r.rank for r in group] == list(range(1, 21)) and q not in {r.vec_id for r in group}
        assert [(-r.score, r.vec_id) for r in group] == sorted((-r.score, r.vec_id) for r in group)
        assert all(r.score == pytest.approx(float(rows[q] @ rows[r.vec_id]), abs=1e-12) for r in group)
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 200), key=lambda r: r.rank)] == list(range(201, 221))
    assert permutations.search(d.where("vec_id < 3")).count() == 2 and permutations.search(d.where("false")).count() == 0


def test_neighbours_of_repeated_rows_and_of_ids_with_two_vectors(spark):
    """Every row twice gives what every row once gives; an id with two vectors asks with one and is found by either."""
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))]
    schema = "vec_id bigint, embedding array<double>"
    once, twice = spark.createDataFrame(data, schema), spark.createDataFrame(data * 2, schema).repartition(7)
    rows = lambda d: sorted(map(tuple, permutations.search(d).collect()))
    assert rows(once) == rows(twice) and len({(q, v) for q, _, v, _ in rows(twice)}) == 15 * 20
    own = spark.createDataFrame(data + [(20, [9.0] + [0.0] * 7), (21, [9.0] + [0.0] * 7)], schema)
    got, exact = rows(own), sorted(permutations.exact(own))
    assert [r for q, r, _, _ in got if q == 20] == list(range(1, 21)) and len(got) == len(exact)
    assert next(r for r in got if r[0] == 20) == (20, 1, 21, 81.0)  # asked with the greater vector, not found by itself


def test_neighbours_whose_products_overflow(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(200, 6))
    rows[::3] *= 1e200
    rows[7, 0], rows[9] = 1e308, -rows[9]
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got, exact = permutations.search(d).collect(), permutations.exact(d)
    assert len(got) == len(exact) == 10 * 20 and {r.query_id for r in got} == set(range(0, 200, 20))
    hit = {(r.query_id, r.vec_id) for r in got} & {(q, v) for q, _, v, _ in exact}
    assert len(hit) >= 0.75 * len(exact) and any(math.isinf(r.score) for r in got)
    score = {(q, v): str(x) for q, _, v, x in exact}
    assert all(str(r.score) == score[r.query_id, r.vec_id] for r in got if (r.query_id, r.vec_id) in score)


def test_neighbours_of_few_reranked_rows(spark, monkeypatch):
    """Recall where under a fifth is reranked, over more than one block; equal vectors tie in all of them."""
    monkeypatch.setattr(permutations, "BLOCK_ROWS", 2000)
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(5000, 48))
    rows[3000:4400] = rows[3000]
    assert permutations.RERANK * 5000 ** (-1 / 3) < 0.2
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>").repartition(5)
    got, exact = permutations.search(d).collect(), permutations.exact(d)
    hit = {(r.query_id, r.vec_id) for r in got if not 3000 <= r.query_id < 4400} & {(q, v) for q, _, v, _ in exact}
    assert len(got) == len(exact) and len(hit) >= 0.9 * sum(not 3000 <= q < 4400 for q, *_ in exact)
    ties = [r.vec_id for r in sorted((r for r in got if r.query_id == 3100), key=lambda r: r.rank)]
    assert ties == list(range(3000, 3020)) and len({r.score for r in got if r.query_id == 3100}) == 1
    score = {(q, v): x for q, _, v, x in exact}
    assert all(r.score == score[r.query_id, r.vec_id] for r in got if (r.query_id, r.vec_id) in score)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_recall_of_the_registered_query(spark):
    from brindle.llm.queries import QUERIES

    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got, exact = QUERIES["op6_nearest_neighbours"](spark, SF).collect(), permutations.exact(table)
    assert len({(r.query_id, r.vec_id) for r in got} & {(q, v) for q, _, v, _ in exact}) >= 0.9 * len(exact)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "tokens"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, stage(spark, seen, SF).cache()
        if name != "tokens":
            assert seen.columns == docs.columns
        if name == "near_duplicates":
            rows = before.orderBy("doc_id").collect()
            want = plain_join([r.text for r in rows], 5, 80)
            kept = {rows[i].doc_id for i, (n, c) in want.items() if c == i}
            assert {r.doc_id for r in seen.collect()} == kept and seen.count() == len(kept)
        if name == "secrets":
            assert seen.count() == before.count() and secrets.digest(secrets.scan(seen)).where("spans <> ''").count() == 0
        if name in ("mixing", "tokens"):
            assert {r.doc_id for r in seen.collect()} == {r.doc_id for r in before.collect()}
    assert seen.where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert corpus_pipeline.run(spark, SF).count() == seen.count()
