"""The registered queries that SQL can't express, against plain Python over the whole tables."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
import xxhash

from brindle.llm import langid, quality, sharding, syncmers
from brindle.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = 1 << 64


@pytest.fixture(scope="module")
def rows(spark):
    return sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def spark_hash(*values):
    """Spark's xxhash64: numpy ints by their width, texts by their bytes, each seeded by the one before."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.tobytes()
        h = xxhash.xxh64_intdigest(raw, h)
    return h - WORD if h >= WORD >> 1 else h


def test_quality_by_hand(spark, rows):
    """Features one by one, and descent one document after the other."""

    def mixed(h):
        h %= WORD
        h ^= h >> 29
        return (h * 0x9E3779B97F4A7C15 % WORD) >> (64 - quality.BITS)

    last = (1 << quality.BITS) - 1

    def bag(text):
        s = re.sub(r"[\0-\x20\x85\xa0 -   　]", " ", f" {text or ''} ")
        words = [sum((ord(c) + 1) * pow(0x100000001B3, i, WORD) for i, c in enumerate(w)) % WORD for w in s.split(" ") if w]
        found = [min(mixed(w), last - 1) for w in words]
        found += [last if a == b else min(mixed(a * 31 + b * 0xC2B2AE3D27D4EB4F), last - 1) for a, b in zip(words, words[1:])]
        for n in (3, 4):
            for i in range(len(s) - n + 1):
                if " " not in s[i + 1 : i + n - 1]:
                    h = n
                    for c in s[i : i + n]:
                        h = (h * 0xD6E8FEB86659FD93 + ord(c)) % WORD
                    found.append(min(mixed(h), last - 1))
        counts = collections.Counter(found)
        return {b: c / len(found) for b, c in counts.items()}

    labels: dict[int, int] = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.quality in (0, 1) and not held(r.doc_id):
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.quality)
    bags = {r.doc_id: bag(r.text) for r in rows}
    learn = [(bags[i], q) for i, q in sorted(labels.items()) if bags.get(i)]
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (last + 1, quality.DIM)).astype(np.float32).astype(float)
    out, done, steps = np.zeros((2, quality.DIM)), 0, quality.EPOCHS * -(-len(learn) // quality.STEP)
    for _ in range(quality.EPOCHS):
        order = rng.permutation(len(learn))
        for k in range(0, len(order), quality.STEP):
            rate, push, moves = quality.RATE * (1 - done / steps), np.zeros_like(out), []
            for i in order[k : k + quality.STEP]:
                features, label = learn[i]
                mean = sum(share * table[b] for b, share in features.items())
                p = np.exp(out @ mean)
                p /= p.sum()
                p[label] -= 1
                push += np.outer(p, mean)
                moves.append((features, p @ out))
            for features, back in moves:
                for b, share in features.items():
                    table[b] -= rate * share * back
            out -= rate / len(moves) * push
            done += 1
    weight = table @ (out[1] - out[0])
    got = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, SF).collect()}
    assert len(got) == len(rows) and len(learn) > 50
    for i, features in bags.items():
        want = 1 / (1 + math.exp(-sum(weight[b] * s for b, s in features.items())))
        assert got[i].score == pytest.approx(want, abs=2e-3) and got[i].held_out == held(i)
        assert got[i].predicted == (got[i].score >= 0.7)


def test_mixture_by_hand(spark, rows):
    """Weights by bisection, then every block and row by its key; sources here have one block each."""
    tokens, sizes = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in rows}, collections.Counter()
    for r in rows:
        sizes[r.source] += tokens[r.doc_id]
    total = sum(sizes.values())
    share = {s: n / total for s, n in sizes.items() if n}

    def at(x):
        z = sum(p**x for p in share.values())
        return {s: p**x / z for s, p in share.items()}

    def spread(x):
        q = at(x)
        rates = [q[s] / share[s] for s in q]
        return max(rates) / min(rates)

    low, high = (0.0, 1.0) if spread(0.0) > 4.0 else (0.0, 0.0)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if spread(mid) <= 4.0 else (mid, high)
    weight = at(high)
    budget = max(sizes[s] / weight[s] for s in weight)
    assert max(sizes.values()) < 1_000_000

    def key(r, epoch):
        own = () if r.doc_id is None else (np.int64(r.doc_id),)
        return spark_hash(np.int32(11), np.int32(epoch), *own, np.int64(spark_hash(r.text or "")))

    want = set()
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        whole = int(weight[s] * budget / sizes[s] + 1e-9)
        rest = weight[s] * budget - whole * sizes[s]
        for epoch in range(1, whole + 2):
            so_far = 0
            for slot, r in enumerate(sorted(mine, key=lambda r: key(r, epoch))):
                if epoch <= whole or (rest >= 0.5 and so_far < rest):
                    want.add((r.doc_id, r.source, tokens[r.doc_id], epoch, slot))
                so_far += tokens[r.doc_id]
    got = QUERIES["op2_mixing_sources"](spark, SF).collect()
    assert {(r.doc_id, r.source, r.n_tokens, r.epoch, r.slot) for r in got} == want and len(got) == len(want)
    assert all(r.weight == pytest.approx(weight[r.source], abs=1e-9) and (r.block, r.block_rank) == (0, 0) for r in got)


def test_bpe_by_the_library(spark, rows):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from tiktoken.load import load_tiktoken_bpe

    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=load_tiktoken_bpe(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in QUERIES["op4_byte_bpe"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids, sha = enc.encode_ordinary(r.text or ""), lambda raw: hashlib.sha256(raw).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode()))


def test_language_by_hand(spark, rows):
    """Counts in dictionaries, and every word of a text on its own."""
    words = lambda t: [w for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    langs = sorted({r.lang for r in rows if r.lang and r.text and not held(r.doc_id)})
    seen = {lang: collections.Counter(w for r in rows if r.lang == lang and not held(r.doc_id) for w in words(r.text)) for lang in langs}
    tables = [{lang: {w: n for w, n in seen[lang].items() if n >= 2} for lang in langs}]
    pieces = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    for n in range(1, 6):
        tables.append({lang: collections.Counter() for lang in langs})
        for lang in langs:
            for w, times in seen[lang].items():
                for g in pieces(w, n):
                    tables[n][lang][g] += times
    names = [set().union(*(t[lang] for lang in langs)) for t in tables]
    totals = [{lang: sum(t[lang].values()) for lang in langs} for t in tables]

    def score(k, name):
        return np.array([math.log((tables[k][lang].get(name, 0) + 0.5) / (totals[k][lang] + 0.5 * len(names[k]))) for lang in langs])

    def of_word(w):
        if w in names[0]:
            return score(0, w)
        for n in range(5, 0, -1):
            if known := [g for g in pieces(w, n) if g in names[n]]:
                return sum(score(n, g) for g in known) / len(known)
        return np.zeros(len(langs))

    kept: dict[str, np.ndarray] = {}
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, SF).collect()}
    assert len(got) == len(rows) and len(langs) > 1
    for r in rows:
        found = words(r.text)
        if not found:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        total = sum(kept[w] if w in kept else kept.setdefault(w, of_word(w)) for w in found)
        p = np.exp(total - total.max())
        assert got[r.doc_id].lang_pred == langs[int(total.argmax())] and got[r.doc_id].held_out == held(r.doc_id)
        assert got[r.doc_id].score == pytest.approx(p.max() / p.sum(), abs=1e-3)


def test_shards_by_hand(spark, rows):
    """The ring walked row by row: own arcs first, then what overflows, clockwise."""
    nodes = sorted((spark_hash("node", np.int64(i)) % sharding.CELLS, i % 40) for i in range(40 * 64))
    ends = [c for c, _ in nodes]
    placed = collections.defaultdict(list)
    for r in rows:
        place = spark_hash(r.text or "")
        cell = place % sharding.CELLS
        arc = next((a for a, e in enumerate(ends) if e >= cell), 0)
        share = sum((spark_hash(x.text or "") % sharding.CELLS) == cell for x in rows)
        part = spark_hash(np.int64(r.doc_id)) % (share * sharding.PARTS // len(rows) + 1)
        placed[arc].append((cell - sharding.CELLS if arc == 0 and cell > ends[0] else cell, part, place, r.doc_id))
    room = [len(rows) // 40 + (s < len(rows) % 40) for s in range(40)]
    home, used, over = {}, [0] * 40, []

    def put(doc_id, shard):
        home[doc_id] = (shard, used[shard])
        used[shard] += 1

    for arc in sorted(placed):
        for row in sorted(placed[arc]):
            s = nodes[arc][1]
            put(row[-1], s) if used[s] < room[s] else over.append((arc, row[-1]))
    for arc, doc_id in over:
        while used[s := nodes[arc % len(nodes)][1]] >= room[s]:
            arc += 1
        put(doc_id, s)
    got = QUERIES["op7_sharding"](spark, SF).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == home and len(got) == len(rows)
    raw = {r.doc_id: (r.text or "").encode() for r in rows}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw[r.doc_id]) + 16, zlib.crc32(raw[r.doc_id]), "rows", None) for r in got)


def test_fingerprints_by_hand(spark, rows):
    """Anchors from each k-mer alone; chains by the whole table, a row of it at a time."""
    powers = [pow(0x9E3779B97F4A7C15, i, WORD) for i in range(syncmers.K)]

    def hashed(x):
        h = sum((ord(c) + 1) * p for c, p in zip(x, powers)) % WORD
        h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 % WORD
        return h ^ (h >> 29)

    def anchors(text):
        k, s = syncmers.K, syncmers.S
        inner = [hashed(text[i : i + s]) for i in range(len(text) - s + 1)]
        at = [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
        return [hashed(text[i : i + k]) >> 32 for i in at] or [text][: len(text)]

    def chain(a, b):
        b, row = np.array(b, object), np.zeros(len(b) + 1, int)
        for x in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
        return int(row[-1])

    got = {r.doc_id: r for r in QUERIES["op9_document_fingerprints"](spark, SF).collect()}
    assert len(got) == len(rows)
    texts = [r.text or "" for r in rows]
    marks = [anchors(t) for t in texts]
    for i, r in enumerate(rows):
        j = (i + 1) % len(rows)
        n = len(texts[i])
        edited = texts[i][: n - n // 2] + texts[j][: n // 2]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        if max(n, len(texts[j])) < 20_000:
            other = anchors(edited)
            assert g.near_next == (2 * chain(marks[i], marks[j]) / (len(marks[i]) + len(marks[j])) if texts[i] or texts[j] else 1.0)
            assert g.near_edited == (2 * chain(marks[i], other) / (len(marks[i]) + len(other)) if texts[i] else 1.0)
    same = collections.defaultdict(set)
    for i, r in enumerate(rows):
        same[texts[i]].add(got[r.doc_id].fingerprint)
    assert all(len(x) == 1 for x in same.values())
