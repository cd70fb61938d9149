"""Language identification by words first, then by shorter and shorter character n-grams.

A word that the model knows scores its log relative frequency in each language. A word it doesn't
know backs off: the n-grams of the word and its edges, for the longest n that has a known n-gram;
their mean is the word's score. A text's score is the mean over its words; ``score`` is the share of
the best language under a softmax of the summed scores. Words and n-grams keep a number for each language that they
occur in; all others share one, so that the model grows with the sample and not with words times languages.

The model is fitted on a bounded sample (``PER_LANG`` documents of each language on average, chosen
by the hash of id and text, so that neither a repeated id nor rows without one swell it) of rows that aren't held out, and is bounded with it. Every language that has a
word there is learnt, at most ``MOST_LANGS``, else an error; n-grams are counted over all its words.

Defined cases: ``und`` and score 0 for a null text, a text without a letter, or a model without any
language; ties go to the first language in order; repeated rows stay; a very long text
is scored over all its words, some at a time; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, held_out, whole

#: Documents of a language in the sample; languages at most; fewest times that a known word is seen.
PER_LANG, MOST_LANGS, LEAST = 1500, 1000, 2
LONGEST = 5
#: Unknown words whose scores a worker keeps, and how many numbers they may have together.
KEPT, MOST_KEPT = 200_000, 20_000_000
WORD = regex.compile(r"\p{L}+")


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Frequencies:
    """Smoothed log relative frequencies of names (words, or n-grams of one length) by language, without the languages
    that a name doesn't occur in: those have their language's ``base``, the others ``add`` more, from ``start`` of a name on."""

    def __init__(self, langs: int):
        self.langs, self.names = langs, {}
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, lang: int, counts: dict[str, int]) -> None:
        at = np.fromiter((self.names.setdefault(x, len(self.names)) for x in counts), np.int64, len(counts))
        self._parts.append((at, np.full(len(at), lang, np.int32), np.fromiter(counts.values(), np.int64, len(counts))))

    def done(self) -> Frequencies:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        at, lang, n = (np.concatenate(x) for x in zip(*self._parts, none))
        total = np.bincount(lang, n, self.langs)
        self.base = np.log(0.5 / (total + 0.5 * max(1, len(self.names))))
        order = np.lexsort((lang, at))
        self.start = np.searchsorted(at[order], np.arange(len(self.names) + 1))
        self.lang, self.add = lang[order], np.log(2.0 * n[order] + 1)  # log (n + 0.5) - log 0.5
        self._parts = []
        return self


class Model:
    def __init__(self, langs: list[str], words: Frequencies, by_size: list[Frequencies]):
        self.langs, self.words, self.by_size = langs, words, by_size
        #: What a row adds to every language: that of known words, of n-grams by their length, and nothing.
        self.bases = np.array([words.base, *(g.base for g in by_size), np.zeros(len(langs))])
        self.extra: dict[str, int] = {}
        self.size = self.used = 0

    @classmethod
    def fit(cls, rows: list[tuple[str, str, int]]) -> Model:
        """``rows``: language, lower-case word, count."""
        by_lang: dict[str, dict[str, int]] = defaultdict(dict)
        for lang, word, n in rows:
            by_lang[lang][word] = n
        langs = sorted(by_lang)
        words, by_size = Frequencies(len(langs)), [Frequencies(len(langs)) for _ in range(LONGEST)]
        for k, lang in enumerate(langs):
            words.put(k, {w: n for w, n in by_lang[lang].items() if n >= LEAST})
            for size, table in enumerate(by_size, 1):
                found: dict[str, int] = defaultdict(int)
                for word, n in by_lang[lang].items():
                    for g in grams(word, size):
                        found[g] += n
                table.put(k, found)
        return cls(langs, words.done(), [g.done() for g in by_size])

    def back_off(self, word: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Of an unknown word: its base, and the languages that have more, with how much."""
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            table = self.by_size[n - 1]
            if known := [table.names[g] for g in grams(word, n) if g in table.names]:
                parts = [slice(table.start[i], table.start[i + 1]) for i in known]
                total = np.bincount(np.concatenate([table.lang[p] for p in parts]), np.concatenate([table.add[p] for p in parts]), len(self.langs))
                at = np.flatnonzero(total)
                return n, at, total[at] / len(known)
        return LONGEST + 1, np.zeros(0, np.int64), np.zeros(0)

    def _begin(self) -> None:
        """Rows of the known words, and room for unknown ones."""
        w = self.words
        self.extra, self.size, self.used = {}, len(w.names), len(w.lang)
        room = np.zeros(KEPT, np.int64)
        self.start, self.many = np.concatenate([w.start[:-1], room]), np.concatenate([np.diff(w.start), room])
        self.level = np.zeros(len(self.start), np.int64)
        self.lang, self.add = np.concatenate([w.lang, np.zeros(KEPT, np.int32)]), np.concatenate([w.add, np.zeros(KEPT)])

    def row(self, word: str) -> int:
        """The row of an unknown word, past the known words; scored on first sight."""
        i = self.extra.get(word)
        if i is None:
            level, lang, add = self.back_off(word)
            if self.used + len(lang) > len(self.lang):
                grow = max(len(lang), len(self.lang))
                self.lang, self.add = np.append(self.lang, np.zeros(grow, np.int32)), np.append(self.add, np.zeros(grow))
            i = self.extra[word] = self.size
            self.start[i], self.many[i], self.level[i] = self.used, len(lang), level
            self.lang[self.used : self.used + len(lang)], self.add[self.used : self.used + len(lang)] = lang, add
            self.size, self.used = self.size + 1, self.used + len(lang)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall((text or "").lower())
        if not words or not self.langs:
            return "und", 0.0
        total, known = np.zeros(len(self.langs)), self.words.names
        for k in range(0, len(words), KEPT // 2):
            part = words[k : k + KEPT // 2]
            if not self.size or len(self.extra) + len(part) > KEPT or self.used > len(self.words.lang) + MOST_KEPT:
                self._begin()
            rows = [known.get(w, -1) for w in part]
            rows = np.array([r if r >= 0 else self.row(w) for r, w in zip(rows, part)])
            many = self.many[rows]
            at = np.repeat(self.start[rows] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            total += np.bincount(self.lang[at], self.add[at], len(self.langs)) + np.bincount(self.level[rows], minlength=len(self.bases)) @ self.bases
        total = total.round(6)  # sums in another order are ties still
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sizes:
        return Model.fit([])
    # a share of each language's rows, by a hash: no sort, and no task with a whole language
    share = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"])))]), F.col("lang"))
    sample = learn.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
    counts = words.groupBy("lang", "word").count()
    return Model.fit([tuple(r) for r in counts.collect()])


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; one pass, no shuffle of texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang")))  # bounded by PER_LANG
    slim = docs.select("doc_id", held_out().alias("held_out"), whole("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
