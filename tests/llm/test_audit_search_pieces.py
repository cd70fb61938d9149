"""Filter audit, impact index and pieces: against loops, whole numbers and the library."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from brindle.errors import ValidationError
from brindle.llm import filter_audit, impact_index, pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, part string, mask string, n string, term string, block string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


# --- filter audit


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    failing = []
    for i, t, p in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ["A"] * (len(words) < 100) + ["B"] * (100 * len(set(words)) < 80 * len(words)) + ["C"] * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + ["D"] * bool(re.search(r"[#$%&*|]", t))
        failing.append((i, p or "", set(fails + ["E"] * (i is not None and i > least[t]))))
    out = []
    for part in {p for _, p, _ in failing}:
        mine = [(i, f) for i, p, f in failing if p == part]
        removals = Counter()
        rows_of = []
        for order in itertools.permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                here = [(i, f) for i, f in mine if c in f and not f & set(order[: step - 1])]
                removals[c] += len(here)
                rows_of.append((part, "".join(order), step, sum(not f & set(order[:step]) for _, f in mine), len(here), sum(c in f for _, f in mine) - len(here), sum(f == {c} for _, f in mine), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)))
        out += [(*r, removals[r[1][r[2] - 1]]) for r in rows_of]
    return sorted(out)


def test_audit_against_every_order(spark):
    rng = random.Random(1)
    words = ["river", "stone", "LOUD", "a$b", "garden", "Winter"] + [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 30, 206])]) for _ in range(rng.choice([5, 99, 100, 160]))) for _ in range(40)] + [None, "", " ", "X" * 20_000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)] + [(None, texts[0], "en"), (None, texts[0], "en"), (3, "twice", "de"), (3, "twice", "en")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    got = filter_audit.audit(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_audit_of_other_filters_and_no_rows(spark):
    rows = docs(spark, [(1, "short", "en"), (2, "#", "en"), (3, "#", "en")])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    two = {"x": lambda t: F.length(t) < 3, "y": lambda t: t.rlike("#")}
    got = filter_audit.audit(rows, none, two, copy=None)
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in got.collect()} == {("xy", 1): (1, 2, 0, 2), ("xy", 2): (1, 0, 2, 2), ("yx", 1): (1, 2, 0, 2), ("yx", 2): (1, 0, 2, 2)}
    assert filter_audit.audit(rows.where("false"), none).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(rows, none, {c: two["x"] for c in "abcdef"})


def test_copies_of_one_text_meet_in_no_task(spark):
    """The rows that are moved back are found by text and id, so a text of many copies is spread."""
    rows = filter_audit.masks(docs(spark, [(i, "same", "en") for i in range(5000)]))
    counted = filter_audit.with_copies(filter_audit.labelled(rows, spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")), 16)
    assert sorted(map(tuple, counted.groupBy("mask", "good").agg(F.sum("n")).where("`sum(n)` <> 0").collect())) == [(1, False, 1), (17, False, 4998), (17, True, 1)]


# --- impact index


def plain_search(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    documents, tokens = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 25 + (75 * sum(c.values()) * documents) // tokens
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("block, postings, asks, few", [(16_384, 1 << 20, 10_000, 20_000), (7, 1 << 20, 2, 0), (5, 30, 3, 20_000)])
def test_search_against_a_loop(spark, monkeypatch, block, postings, asks, few):
    for name, value in (("BLOCK", block), ("POSTINGS", postings), ("ASKS", asks), ("BROADCAST_TERMS", few)):
        monkeypatch.setattr(impact_index, name, value)
    rng = random.Random(2)
    words = ["the", "The", "été", "x1", "a-b", "ÀB", "中文", "q_r", "ﬁ"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(120)] + [(200, None), (201, ""), (202, "-- !"), (203, "the " * 3000), (204, "the"), (204, "the"), (None, "the x1"), (-5, "the")]
    items = [(n, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for n in range(9)] + [(20, None), (21, ""), (22, "nowhere"), (23, "the " * 13), (24, "x1")]
    got = impact_index.ranked(docs(spark, [(i, t, "en") for i, t in rows]).repartition(3), spark.createDataFrame(items + [(24, "a"), (0, items[0][1])], "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == plain_search(rows, items)


def test_search_of_nothing(spark):
    rows = docs(spark, [(1, "the", "en"), (2, None, "en")])
    items = spark.createDataFrame([(1, "the")], "item_id bigint, text string")
    assert impact_index.ranked(rows.where("false"), items).count() == 0 == impact_index.ranked(rows, items.where("false")).count()
    assert impact_index.ranked(rows.where("text is null"), items).count() == 0


def test_a_stored_index_answers_later_batches(spark, tmp_path):
    index = impact_index.build(docs(spark, [(1, "red fox", "en"), (2, "red", "en"), (3, "blue", "en"), (4, "grey", "en")]), str(tmp_path / "index"))
    for text, first in (("fox", 1), ("blue", 3)):
        rows = impact_index.search(impact_index.Stored(spark, index.path), spark.createDataFrame([(7, text)], "item_id bigint, text string"), 1).collect()
        assert [(r.item_id, r.doc_id) for r in rows] == [(7, first)]


def test_slices_are_whole_numbers():
    rng = np.random.default_rng(3)
    numbers = [rng.integers(0, 1 << 35, 200) * (rng.random(200) < 0.3) for _ in range(23)]
    total = sum(numbers)
    room = np.zeros((41, 4), np.uint64)
    sliced = []
    for x in numbers:
        one = room.copy()
        part = impact_index.planes(np.pad(x, (0, 56)), 35)
        one[: len(part)] = part
        sliced.append(one)
    for n in (1, 2, 3, 5, 23):
        at, value = impact_index.best(impact_index.added(sliced[:n]), 10)
        want = sum(numbers[:n])
        order = [i for i in np.lexsort((np.arange(200), -want)) if want[i] > 0][:10]
        assert at.tolist() == order and value.tolist() == want[order].tolist()
    same = impact_index.planes(np.pad(np.full(100, 6), (0, 28)), 3)
    assert impact_index.best(same, 10)[0].tolist() == list(range(10)) and total.max() < 1 << 41


# --- pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


ALPHABET = ["a", "b", " ", "  ", "▁", "é", "中", "🙂", "\n", "\t", "\0", "the", "ing", "<0x41>", "<s>", "</s>", "<unk>", "�", "Ω", "́", "½", "ﬁ"]


def spans_of(library, text):
    at = np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()
    return [(at[i], at[j]) for i, j in library.encode(text, out_type="offset_mapping")["offsets"]]


def test_pieces_like_the_library(library, model):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "x" * 3000, " " * 1000, "ab" * 700 + "中" * 500, "a" * 25 + "\n" * 25]
    for text, (ids, start, end) in zip(texts, model.encode(texts)):
        assert ids.tolist() == library.encode(text) and model.decode(ids) == library.decode(ids.tolist())
        assert list(zip(start.tolist(), end.tolist())) == spans_of(library, text)


def test_decoding_any_ids(library, model):
    rng = random.Random(6)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(262)]) for _ in range(rng.randrange(12))]
        assert model.decode(np.array(ids, int)) == library.decode(ids)


def test_pieces_of_odd_rows(spark, library):
    rows = [(1, None, "en"), (2, "", "en"), (3, "a b", "en"), (3, "a b", "en"), (None, " x", "en"), (5, "wort " * 20_000, "de")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digest(docs(spark, rows)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    of = lambda t: library.encode(t or "")
    assert got == {(i, len(of(t)), sha(",".join(map(str, of(t)))), sha(library.decode(of(t)))) for i, t, _ in rows}
    assert pieces.digest(docs(spark, rows)).count() == 6 and pieces.digest(docs(spark, rows).where("false")).count() == 0
    row = pieces.tokenise(docs(spark, [(1, "é b", "en")])).first()
    assert list(zip(row.starts, row.ends)) == spans_of(library, "é b")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(fields):
    out = b""
    for f, v in fields:
        out += varint(f << 3) + varint(v) if isinstance(v, int) else varint(f << 3 | 2) + varint(len(v)) + v
    return out


def compiled(rules):
    """The double array of ``rules``, placed first fit, and their values."""
    values, at = b"", {}
    for key, value in rules.items():
        at[key.encode()] = len(values)
        values += value.encode() + b"\0"
    units, used = {}, {0}

    def put(node, keys):
        labels = sorted({k[0] for k in keys if k})
        leaf = [k for k, full in keys.items() if not k]
        want = labels + ([0] if leaf else [])
        base = next(b for b in itertools.count(1) if not any(b ^ x in used for x in want))
        used.update(base ^ x for x in want)
        units[node] = units.get(node, 0) | (base ^ node) << 10 | (256 if leaf else 0)
        if leaf:
            units[base] = at[keys[b""]] | 1 << 31
        for x in labels:
            units[base ^ x] = x
            put(base ^ x, {k[1:]: full for k, full in keys.items() if k and k[0] == x})

    put(0, {k: k for k in at})
    size = -(-(max(units) + 1) // 256) * 256
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size))) + values


def test_normalising_by_a_compiled_map(library):
    """A model with a map of characters, keys within keys, values longer, shorter and empty."""
    rules = {"ﬁ": "fi", "½": "1/2", "a": "á", "ab": "x", "abc": "yy z", "é": "e", "\t": " ", "\n": "", "中": " 文 ", "́": "", "🙂b": "B"}
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = list(pieces._fields(f.read()))
    blob = message([(1, b"own"), (2, compiled(rules)), (3, 1), (4, 0), (5, 1)])
    own = message([(f, blob if f == 3 else v) for f, v in raw])
    model, library = pieces.Pieces(own), sentencepiece.SentencePieceProcessor(model_proto=own)
    rng = random.Random(7)
    for _ in range(1500):
        text = "".join(rng.choice([*ALPHABET, "c", "ab", "abc"]) for _ in range(rng.randint(0, 30)))
        ids, start, end = next(model.encode([text]))
        assert ids.tolist() == library.encode(text), text
        assert list(zip(start.tolist(), end.tolist())) == spans_of(library, text), text


def test_models_of_another_kind_raise():
    trainer = message([(3, 1), (35, 1)])
    with pytest.raises(ValidationError):
        pieces.Pieces(message([(1, message([(1, b"<unk>"), (3, 2)])), (2, trainer), (3, message([(4, 0)]))]))
