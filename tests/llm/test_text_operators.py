"""Quality, language, BPE, secrets, fingerprints: against plain Python, libraries and held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, langid, quality, secrets, syncmers

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, blob string, label string, found string"


def docs(spark, texts, **columns):
    """Rows with null and clashing columns."""
    rows = [(i, t, columns.get("lang", [None] * len(texts))[i], None, None, "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


ODD = [None, "", " ", "x" * 30_000, "same", "same", "a\0b", "ümlaut 😀 中文"]


def texts_of(rng, words, n):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) for _ in range(n)]


def test_quality(spark):
    rng = random.Random(1)
    good = texts_of(rng, ["river", "stone", "letter", "garden", "winter"], 60)
    bad = [re.sub(" ", "$$ ", t).upper() for t in texts_of(rng, ["river", "stone", "letter", "garden", "winter"], 60)]
    d = docs(spark, [x for pair in zip(good, bad) for x in pair] + ODD)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)] + [(0, 1), (None, 1), (5, None)], "doc_id bigint, quality int")
    rows = {r.doc_id: r for r in quality.classify(d, labels).collect()}
    assert len(rows) == 120 + len(ODD) and all(r.held_out == held(i) for i, r in rows.items())
    assert all(rows[i].predicted == 1 - i % 2 for i in range(120) if held(i))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert rows[120].score == rows[121].score == 0.5 and rows[124].score == rows[125].score
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and kept.where("doc_id < 120").count() == 60
    assert {r.score for r in quality.classify(d, labels.where("false")).collect()} == {0.5}
    assert quality.classify(d.where("false"), labels).count() == 0


def test_quality_scores_are_the_softmax_of_the_mean():
    import numpy as np

    texts = ["one two two three", "", "a", "één twee"]
    w = np.random.default_rng(0).normal(size=1 << quality.BITS).astype("float32")
    got = quality.scores(texts, w)
    for t, s, (ids, share) in zip(texts, got, quality.bags(texts)):
        assert s == pytest.approx(1 / (1 + np.exp(-(w[ids] * share).sum())), abs=1e-5)


def test_language(spark):
    rng = random.Random(2)
    langs = {"en": ["the", "river", "stone", "running"], "de": ["der", "fluss", "stein", "laufend"], "fr": ["le", "rivière", "pierre", "courant"]}
    texts, names = [], []
    for i in range(90):
        name = list(langs)[i % 3]
        texts.append(" ".join(rng.choice(langs[name]) for _ in range(12)))
        names.append(name)
    d = docs(spark, texts + ODD + ["steinfluss laufender", "1 2 3"], lang=names + [None] * 12)
    rows = {r.doc_id: r for r in langid.identify(d).collect()}
    assert all(rows[i].lang_pred == names[i] for i in range(90)) and all(rows[i].held_out == held(i) for i in rows)
    assert [rows[90 + i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[90].score == 0.0 and rows[99].lang_pred == "und"
    assert rows[98].lang_pred == "de"  # words that no document has
    assert {r.lang_pred for r in langid.identify(docs(spark, ["a b"])).collect()} == {"und"}
    assert langid.identify(d.where("false")).count() == 0


def test_language_of_few_words(spark, monkeypatch):
    free = [i for i in range(100) if not held(i)]
    texts, names = ["der hund und die katze"] * 100, ["de"] * 100
    texts[free[0]], names[free[0]] = "çok güzel yağmur", "tr"  # each word once
    d = docs(spark, texts + ["güzel yağmurlu"], lang=names + [None])
    rows = {r.doc_id: r for r in langid.identify(d).collect()}
    assert langid.fit(d).langs == ["de", "tr"]
    assert rows[free[0]].lang_pred == rows[100].lang_pred == "tr" and rows[free[1]].lang_pred == "de"
    monkeypatch.setattr(langid, "MOST_LANGS", 1)
    with pytest.raises(ValueError):
        langid.fit(d)


def byte_ranks():
    return {bytes([b]): b for b in range(256)}


def plain_bpe(ranks, piece):
    if piece in ranks:
        return [ranks[piece]]
    found = [piece[i : i + 1] for i in range(len(piece))]
    while len(found) > 1:
        best = min(range(len(found) - 1), key=lambda i: (ranks.get(found[i] + found[i + 1], 1 << 40), i))
        if found[best] + found[best + 1] not in ranks:
            break
        found[best : best + 2] = [found[best] + found[best + 1]]
    return [ranks[x] for x in found]


def test_bpe_merges_like_a_loop():
    rng = random.Random(3)
    ranks = byte_ranks()
    while len(ranks) < 500:
        a, b = rng.choice(list(ranks)[-60:] + [b"a", b"b", b"c"]), rng.choice([b"a", b"b", b"c", b"ab", b"ca"])
        if len(a + b) < 9:
            ranks.setdefault(a + b, len(ranks))
    tool = bpe.ByteBPE(ranks, r"\S+|\s+")
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in [*range(1, 40), 64, 65, 200, 256, 257, 300, 1000] for _ in range(4)]
    text = " ".join(words)
    ids = tool.encode([text, "", " "])
    assert ids[0].tolist() == [x for p in re.findall(r"\S+|\s+", text) for x in plain_bpe(ranks, p.encode())]
    assert tool.decode(ids[0]) == text.encode() and len(ids[1]) == 0
    assert [x.tolist() for w in words for x in tool.encode([w])] == [plain_bpe(ranks, w.encode()) for w in words]


def test_bpe_like_the_library(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    tool = bpe.load(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=tool.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ODD + ["<|endoftext|> it's 12  \n\n x", "".join(rng.choice("abé中😀 \n'1") for _ in range(3000)), "é" * 700]
    rows = {r.doc_id: r for r in bpe.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    got = bpe.tokenise(docs(spark, ["hello world"]), carry=("label",)).first()
    assert got.ids == enc.encode_ordinary("hello world") and got.label == "x"
    assert bpe.digest(docs(spark, texts).where("false")).count() == 0


def plain_spans(text):
    out = []
    for k, (kind, p, group, least) in enumerate((("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(p, text, re.A) if len(m[group]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


SECRETS = ["é token = 'abcdef12' PassWord:short token=token:abcdefg", "AKIA" + "A1" * 8 + " AKIASHORT " + "AKIAAKIA" + "B" * 11, "x" + "0123456789abcdef" * 2 + "g" + "ab" * 11, "api_key=" + "deadbeef" * 4 + " apikey : \"zzzzzzz\"", "secret=" * 3 + "abcdef", "😀token=abcdef"]


def test_secrets(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice(["token", "=", " ", ":", "abc", "AKIA", "A1B2", "0af", "'", "secret", "é"]) for _ in range(60)) for _ in range(40)]
    texts = SECRETS + made + ODD + SECRETS
    rows = {r.doc_id: r for r in secrets.digest(secrets.scan(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        assert rows[i].spans == want and rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert rows[i].n_assign + rows[i].n_access + rows[i].n_hex == len([x for x in want.split(",") if x])
    assert secrets.scan(docs(spark, texts).where("false")).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    d = docs(spark, SECRETS + SECRETS)
    secrets.update_ledger(d, path)
    first = secrets.read_ledger(spark, path).count()
    assert first == 3 * len(SECRETS)  # copies of a text are one blob
    secrets.update_ledger(d, path)
    assert secrets.read_ledger(spark, path).count() == first
    secrets.update_ledger(docs(spark, ["new token=abcdef"]), path)
    assert secrets.read_ledger(spark, path).count() == first + 3
    newer = (*secrets.BASE_RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{8,}"))
    secrets.update_ledger(d, path, newer)
    assert secrets.read_ledger(spark, path).where("rule = 'hex@2'").count() == len(SECRETS)
    assert secrets.read_ledger(spark, path).count() == first + 3 + len(SECRETS)


def test_redaction(spark):
    d = docs(spark, ["é token=abcdef end", None, "plain", "api_key=" + "deadbeef" * 4 + "!"])
    got = secrets.redact(d)
    assert got.columns == d.columns
    assert [r.text for r in got.orderBy("doc_id").collect()] == ["é [secret] end", None, "plain", "[secret]!"]


def test_history_of_paths_and_rules(spark, tmp_path):
    """Findings lead to every path that ever held the text, also by a later version of a rule."""
    path = str(tmp_path / "ledger")
    secrets.update_ledger(docs(spark, ["old token=abcdef", "plain", "deadbeef0"]), path)
    secrets.update_ledger(docs(spark, ["now clean", "old token=abcdef", "deadbeef0"]), path)
    secrets.update_ledger(docs(spark, ["now clean", "old token=abcdef", "deadbeef0"]), path)
    told = lambda rules: sorted((r.path, r.seen, [x.kind for x in r.found]) for r in secrets.history(spark, path, rules).collect())
    assert told(secrets.BASE_RULES) == [("0", 1, ["assign"]), ("1", 2, ["assign"])]
    assert secrets.read_paths(spark, path).count() == 5
    newer = (*secrets.BASE_RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{8,}"))
    secrets.update_ledger(docs(spark, ["now clean", None, "deadbeef0"]), path, newer)
    assert told(newer) == [("0", 1, ["assign"]), ("1", 2, ["assign"]), ("2", 1, ["hex"])]


def test_redaction_of_many_spans_and_odd_columns(spark):
    text = "".join(f"é{i} token=abcdef{i % 7} " for i in range(20_000))
    want = "".join(f"é{i} [secret] " for i in range(20_000))
    d = spark.createDataFrame([(1, text, "x", "y", "z")], "doc_id bigint, text string, __blob string, found string, `a.b` string")
    got = secrets.redact(d)
    assert got.columns == d.columns and tuple(got.first()) == (1, want, "x", "y", "z")


def test_keep_good_with_odd_columns(spark):
    d = spark.createDataFrame([(i, "good words here" if i % 2 else "bad !!", 1.0, "x") for i in range(40)], "doc_id bigint, text string, quality_score double, `a.b` string")
    labels = d.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    got = quality.keep_good(d, labels)
    assert got.columns == d.columns and {r.doc_id % 2 for r in got.collect()} == {1}


def plain_anchors(text):
    k, s = syncmers.K, syncmers.S
    mers = [hash_of(text[i : i + s]) for i in range(len(text) - s + 1)]
    return [i for i in range(len(text) - k + 1) if min(mers[i : i + k - s + 1]) in (mers[i], mers[i + k - s])]


def hash_of(x):
    h = sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(x)) % (1 << 64)
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) % (1 << 64)
    return h ^ (h >> 29)


def test_anchors_are_closed_syncmers():
    rng = random.Random(6)
    for text in ("".join(rng.choice("abcde é") for _ in range(400)), "ab" * 60, "x" * 24):
        assert syncmers.anchors(text)[1].tolist() == plain_anchors(text)
    assert len(syncmers.anchors("short")[0]) == 1 and len(syncmers.anchors("")[0]) == 0
    bare = [t for t in ("".join(rng.choice("abcde é") for _ in range(25)) for _ in range(60)) if not plain_anchors(t)]
    found = [syncmers.anchors(t) for t in bare]
    assert len(bare) > 5 and all(len(h) == 1 and at.tolist() == [0] for h, at in found) and syncmers.likeness(found[0], found[1]) == 0.0


def plain_chain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
    return row[-1]


def test_chain_like_a_table():
    rng = random.Random(8)
    for _ in range(300):
        names = rng.choice([2, 5, 100])
        a, b = ([rng.randrange(names) for _ in range(rng.randint(0, 70))] for _ in range(2))
        if rng.random() < 0.3:
            b = a[: rng.randint(0, 70)] + b[:5] + a[rng.randint(0, 70) :]
        assert syncmers.chain(np.array(a, np.uint32), np.array(b, np.uint32)) == plain_chain(a, b)


def test_likeness_over_shifts():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    middle = words[:200] + ["inserted"] + words[200:]
    spread = [w for i, x in enumerate(words) for w in ([x, "inserted"] if i % 80 == 40 else [x])]
    found = [syncmers.likeness(syncmers.anchors(" ".join(words)), syncmers.anchors(" ".join(w))) for w in (middle, spread, words[::-1])]
    assert found[0] > 0.95 and found[1] > 0.85 and found[2] < 0.1
    twice = syncmers.anchors(" ".join(words * 2))
    assert syncmers.likeness(twice, syncmers.anchors(" ".join(middle + words))) > 0.95 > 0.75 > syncmers.likeness(twice, syncmers.anchors(" ".join(words)))


@pytest.mark.parametrize("size", [200, 64 << 20])
def test_fingerprints(spark, monkeypatch, size):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", size)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 700))) for _ in range(60)] + ODD
    d = docs(spark, texts).repartition(7)
    rows = {r.doc_id: r for r in syncmers.fingerprints(d).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == syncmers.packed(syncmers.anchors(t)) and r.edited_fingerprint == syncmers.packed(syncmers.anchors(edited))
        assert r.near_next == syncmers.likeness(syncmers.anchors(t), syncmers.anchors(n)) and 0 <= r.near_edited <= 1
    same = len(texts) - 4
    assert texts[same] == texts[same + 1] == "same" and rows[same].near_next == 1.0 and rows[same].fingerprint == rows[same + 1].fingerprint
    long = [i for i in range(60) if len(texts[i]) > 300]
    assert all(rows[i].near_edited > 0.3 > rows[i].near_next for i in long)
    assert syncmers.fingerprints(d.where("false")).count() == 0
    assert syncmers.fingerprints(d.where("doc_id = 3")).first().near_next == 1.0
    odd = d.where("doc_id < 3").withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert syncmers.fingerprints(odd).count() == 3
