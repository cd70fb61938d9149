"""How filters interact: what each removes in every order of them, by a Walsh-Hadamard transform.

A row of the corpus becomes a mask, one bit for each filter that it fails. For each part and label
class the 2^n signed parity sums of the masks (one for each set of filters: plus where the row fails an even
number of the set's filters, minus where odd) are one aggregation that combines before it shuffles. The
transform is its own inverse up to 2^n, so whole numbers give the count of each mask back exactly. All
orders are read from those counts, and a filter's removals over all orders are n! / failures summed over the
masks that hold it, as each of a row's failures comes first in as many orders.

The copy filter (a text that a smaller id has too) needs no join with the texts: every row counts as a
copy, and rows that have the least id of their text are moved to the mask without it. Texts are
read once; what is kept of a row is its id, part, mask and the text's SHA-256.

Defined cases: a null text is the empty text, a null part the empty string. Rows without an id are no
copies and make none; they have no label. Rows that share both id and text are not copies of one another.
An id's labels are joined by ``or``. Very long texts are split once, linearly. An empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import settle, whole

#: Most filters: their orders are listed for each part.
MOST = 6
WORD = r"[^\x20\x09-\x0D]+"
#: Failures that a text alone decides; ``copy`` is the filter that needs the other texts.
TEXT_FILTERS = {
    "A": lambda t: F.size("words") < 100,
    "B": lambda t: 100 * F.size(F.array_distinct("words")) < 80 * F.size("words"),
    "C": lambda t: 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 10 * F.length(t),
    "D": lambda t: t.rlike(r"[#$%&*|]"),
}


def masks(docs: DataFrame, filters: dict = TEXT_FILTERS, part: str = "lang") -> DataFrame:
    """``doc_id, part, digest, mask, n``: rows that agree in all of them are one, ``n`` of them. Bit i of ``mask`` is
    the i-th filter's; a filter is a function of the text column and may use the array ``words``."""
    text = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole("text").alias("text"))
    text = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(F.coalesce(fails(F.col("text")), F.lit(False)), 1 << i).otherwise(0)
    slim = text.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    return slim.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``. Ids that are null are dealt by their text, so that they meet in no task."""
    of = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    of = of.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("place"), "good", "toxic")
    placed = rows.withColumn("place", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.xxhash64("doc_id")))
    joined = placed.join(of, (placed["place"] == of["place"]) & (placed["doc_id"] == of["id"]), "left")
    return joined.select("doc_id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``part, good, toxic, mask, n`` with the bit of the copy filter set where a smaller id has the same text. ``n`` is
    signed: each first of its text is taken back from the mask with the bit and put to the one without."""
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = rows.join(least, ["digest", "doc_id"])  # by text and id: copies of one text are spread over all tasks
    names = ["part", "good", "toxic"]
    every = rows.select(*names, (F.col("mask") + F.when(F.col("doc_id").isNotNull(), bit).otherwise(0)).alias("mask"), "n")
    back = first.select(*names, (F.col("mask") + bit).alias("mask"), (-F.col("n")).alias("n"))
    return every.unionByName(back).unionByName(first.select(*names, "mask", "n"))


def _sign(mask: Column, subset: Column) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(subset)) % 2)


def spectrum(rows: DataFrame, n: int) -> DataFrame:
    """``part, good, toxic, sums``: the 2^n signed parity sums of each part and label class."""
    signed = [F.sum(F.col("n") * _sign(F.col("mask"), F.lit(s))) for s in range(1 << n)]
    return rows.groupBy("part", "good", "toxic").agg(F.array(*signed).alias("sums"))


def cells(sums: DataFrame, n: int) -> DataFrame:
    """``part, docs, good, toxic``: per part the count of each mask, of all rows, the good and the toxic: the transform
    again, over 2^n, which divides exactly."""
    inverse = F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda m: (F.aggregate(F.transform("sums", lambda x, s: x * _sign(m, s)), F.lit(0).cast("bigint"), lambda a, x: a + x) / F.lit(1 << n)).cast("bigint"))
    per_class = sums.select("part", "good", "toxic", F.posexplode(inverse).alias("mask", "n"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    per_mask = per_class.groupBy("part", "mask").agg(F.sum("n").alias("docs"), of("good"), of("toxic"))
    lists = per_mask.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "docs", "good", "toxic"))).alias("c"))  # 2^n of each part
    return lists.select("part", "c.docs", "c.good", "c.toxic")


def orders(per_part: DataFrame, letters: str) -> DataFrame:
    """The rows of every part, order and step, from the counts of the masks."""
    n, bit = len(letters), {c: 1 << i for i, c in enumerate(letters)}
    steps = []
    for order in permutations(letters):
        before = 0
        for i, c in enumerate(order, 1):
            steps.append(("".join(order), i, before, bit[c]))
            before |= bit[c]
    struct = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"f":{f}}}' for o, s, b, f in steps) + "]"), "array<struct<o:string,s:int,b:int,f:int>>")
    at = per_part.select("*", F.explode(struct).alias("x"))
    earlier, own = F.col("x.b"), F.col("x.f")

    def total(counts: str, holds, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(F.transform(counts, lambda c, m: F.when(holds(m), c * weight(m)).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a + x)

    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(earlier) != 0
    here = lambda m: fails(m) & ~gone(m)
    share = lambda m: (F.lit(factorial(n)) / F.greatest(F.bit_count(m), F.lit(1))).cast("bigint")
    return at.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"),
        total("docs", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("docs", here).alias("removed"),
        total("docs", lambda m: fails(m) & gone(m)).alias("redundant"), F.get("docs", own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("docs", fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict = TEXT_FILTERS, copy: str | None = "E", part: str = "lang") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, for every
    order of ``filters`` and, named ``copy``, the copy filter. Names are single letters, at most ``MOST``."""
    letters = "".join(filters) + (copy or "")
    if len(letters) > MOST or len(set(letters)) != len(filters) + bool(copy):
        raise ValueError(f"filters need distinct single letters, at most {MOST}")
    # read three times below (copies, their least ids, all rows): a few bytes of each row, written once
    rows = settle(labelled(masks(docs, filters, part), labels))
    counted = with_copies(rows, 1 << len(filters)) if copy else rows
    return orders(cells(spectrum(counted, len(letters)), len(letters)), letters)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
 l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT w.doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
   + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
   + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
 c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
 f(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
 o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
   WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
 s AS (SELECT filter_order, i::INT AS step, bits[i]::INT AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(i))
SELECT part, filter_order, step, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
 coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
 coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
 coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
 coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY ALL"""
