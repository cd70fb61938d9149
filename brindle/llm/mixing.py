"""Mixing sources to target weights by temperature.

A source's share of the tokens, raised to an exponent and normalised, is its weight: exponent 1 keeps
the shares, 0 makes all sources equal. The exponent is bisected, as a fold inside SQL, to the flattest
mixture that repeats no source more than a limit, or that has a target entropy. The token budget then
gives each source whole epochs and a part of one.

An epoch is a permutation of the source's blocks (about ``BLOCK_TOKENS`` tokens, dealt by hash of the
id and text) and of each block's rows; the part of an epoch ends inside one block. So what is drawn is
decided by comparing a row's keys with one boundary for each source: texts are never shuffled, and no
task holds a source, nor all blocks of one: they are ranked and summed in ``ZONES`` ranges of their keys.
Without a budget, the smallest one is taken that covers every row once.

Defined cases: a null source is a source of its own; a null, empty or blank text has no token and
shares its source's fate; a source without tokens is drawn once; repeated rows are drawn alike; an
empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions.arrays import bound
from brindle.llm.common import settle, whole

BLOCK_TOKENS = 1_000_000
#: Ranges of block keys, each summed in a task of its own (a power of two).
ZONES = 1 << 10
#: Sources at most: their table is broadcast, and its size is checked against this.
MOST_SOURCES = 100_000
STEPS, STEEPEST = 50, 16.0


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))


def _spread() -> Column:
    """Rows of one id, or without any, are told apart by their text."""
    return F.xxhash64(whole("text")).alias("spread")


def tokens() -> Column:
    return F.regexp_count(whole("text"), F.lit(r"\S+")).cast("bigint")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)


def weights(logs: Column, exponent: Column) -> Column:
    """Normalised powers of the shares whose logarithms are ``logs``."""
    raised = F.transform(logs, lambda x: F.exp(exponent * x))
    return bound(raised, lambda xs: bound(_sum(xs), lambda total: F.transform(xs, lambda x: x / total)))


def bisected(logs: Column, max_repetition: float | None, target_entropy: float | None, epochs: float | None) -> Column:
    """The smallest exponent that meets the target. ``epochs``: the budget as a multiple of all tokens."""

    def meets(exponent: Column) -> Column:
        if target_entropy is not None:
            return -_sum(F.transform(weights(logs, exponent), lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0))) <= target_entropy
        # repetition of a source: weight / share, here as exp((exponent - 1) log share) up to one factor
        rates = F.transform(logs, lambda x: F.exp((exponent - 1) * x))
        if epochs is None:
            return bound(rates, lambda xs: F.array_max(xs) <= F.array_min(xs) * max_repetition)
        return F.array_max(rates) * epochs <= max_repetition * _sum(F.transform(logs, lambda x: F.exp(exponent * x)))

    top = STEEPEST if target_entropy is not None else 1.0

    def step(so_far: Column, _: Column) -> Column:
        mid = (so_far["low"] + so_far["high"]) / 2
        return bound(meets(mid), lambda good: F.struct(F.when(good, so_far["low"]).otherwise(mid).alias("low"), F.when(good, mid).otherwise(so_far["high"]).alias("high")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("low"), F.lit(top).alias("high")), step, lambda x: x["high"])
    return F.when(meets(F.lit(0.0)), 0.0).otherwise(found)  # meets an array a few times, linear in the sources


def plan(slim: DataFrame, max_repetition: float | None = 4.0, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """A row for each source: ``stratum, n, weight, whole (epochs), rest (tokens of one more), blocks``.
    ``slim``: stratum, n_tokens."""
    sums = settle(slim.groupBy("stratum").agg(F.sum("n_tokens").alias("n")))
    if sums.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = sums.agg(F.sum("n")).first()[0] or 0
    every = sums.where("n > 0").agg(F.array_sort(F.collect_list(F.struct("stratum", "n"))).alias("all"))
    logs = F.transform("all", lambda x: F.ln(x["n"] / F.lit(float(max(total, 1)))))
    row = every.select("all", logs.alias("logs"))
    row = row.withColumn("exponent", bisected(F.col("logs"), max_repetition, target_entropy, budget / max(total, 1) if budget is not None else None))
    row = row.withColumn("weights", weights(F.col("logs"), F.col("exponent")))
    whole_budget = F.lit(float(budget)) if budget is not None else F.array_max(F.zip_with("all", "weights", lambda a, w: a["n"] / w))
    rows = row.withColumn("budget", whole_budget).select("exponent", "budget", F.inline(F.zip_with("all", "weights", lambda a, w: F.struct(a["stratum"].alias("stratum"), w.alias("weight")))))
    quota = F.col("weight") * F.col("budget")
    full = F.coalesce(F.floor(quota / F.col("n") + 1e-9), F.lit(1))
    out = sums.join(rows, "stratum", "left").withColumn("whole", F.when(F.col("n") > 0, full).otherwise(1).cast("int"))
    rest = F.when(F.col("n") > 0, F.greatest(quota - F.col("whole") * F.col("n"), F.lit(0.0))).otherwise(0.0)
    return settle(out.select("stratum", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"), "exponent", "whole", F.when(rest < 0.5, 0.0).otherwise(rest).alias("rest"), F.ceil(F.greatest(F.col("n"), F.lit(1)) / BLOCK_TOKENS).cast("int").alias("blocks")))


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "doc_id", "spread"), F.col("blocks")).cast("int")


def _block_key(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), "stratum", "block")


def _row_key(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), "doc_id", "spread")


def _zone(key: str) -> Column:
    return F.shiftright(key, 64 - (ZONES - 1).bit_length())


def boundaries(slim: DataFrame, rules: DataFrame, seed: int) -> DataFrame:
    """``rules`` with the keys at which each source's part of an epoch ends (null: no part)."""
    small = F.broadcast(rules)  # MOST_SOURCES rows at most, checked
    last = F.col("whole") + 1
    parts = slim.join(small.where("rest > 0"), "stratum").withColumn("block", _block(seed))
    blocks = settle(parts.groupBy("stratum", "block", "rest").agg(F.sum("n_tokens").alias("size"), F.first("whole").alias("whole")).withColumn("key", _block_key(seed, last)).withColumn("zone", _zone("key")).drop("whole"))
    earlier = Window.partitionBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    zones = blocks.groupBy("stratum", "zone", "rest").agg(F.sum("size").alias("size")).withColumn("ahead", F.coalesce(F.sum("size").over(earlier.orderBy("zone")), F.lit(0)))
    entered = zones.where("ahead < rest").groupBy("stratum").agg(F.max(F.struct("zone", "ahead")).alias("at")).select("stratum", "at.zone", "at.ahead")  # the zone where a part ends
    before = F.col("ahead") + F.coalesce(F.sum("size").over(earlier.orderBy("key", "block")), F.lit(0))
    reached = blocks.join(F.broadcast(entered), ["stratum", "zone"]).withColumn("before", before).where("before < rest")
    ends = reached.groupBy("stratum").agg(F.max(F.struct("key", "block", "before")).alias("end")).select("stratum", F.col("end.key").alias("end_key"), F.col("end.block").alias("end_block"), F.col("end.before").alias("end_before"))
    inside = parts.join(F.broadcast(ends), "stratum").where("block = end_block").withColumn("row_key", _row_key(seed, last))
    run = Window.partitionBy("stratum").orderBy("row_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    drawn = inside.withColumn("so_far", F.coalesce(F.sum("n_tokens").over(run), F.lit(0))).where("end_before + so_far < rest")
    stop = drawn.groupBy("stratum").agg(F.max("row_key").alias("end_row"))
    return settle(rules.join(ends.select("stratum", "end_key", "end_block"), "stratum", "left").join(stop, "stratum", "left"))


def drawn(rows: DataFrame, rules: DataFrame, seed: int) -> DataFrame:
    """``rows`` (doc_id, stratum and others), once for each ``epoch`` that draws them, with their block."""
    placed = rows.join(F.broadcast(rules), "stratum").withColumn("block", _block(seed))
    last = F.col("whole") + 1
    key = _block_key(seed, last)
    part = (key < F.col("end_key")) | ((key == F.col("end_key")) & ((F.col("block") < F.col("end_block")) | ((F.col("block") == F.col("end_block")) & (_row_key(seed, last) <= F.col("end_row")))))
    times = F.col("whole") + F.when(part, 1).otherwise(0)
    return placed.withColumn("times", times).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), "times")))


def _rules(docs: DataFrame, seed: int, **target: float | None) -> tuple[DataFrame, DataFrame]:
    slim = settle(docs.select("doc_id", "source", _stratum().alias("stratum"), tokens().alias("n_tokens"), _spread()))
    return slim, boundaries(slim, plan(slim, **target), seed)


def mixture(docs: DataFrame, seed: int = 11, **target: float | None) -> DataFrame:
    """``doc_id, source, n_tokens, weight, epoch, block, block_rank, slot`` of everything drawn, in reading
    order by (epoch, block_rank, slot) within a source."""
    slim, rules = _rules(docs, seed, **target)
    out = drawn(slim, rules, seed)
    out = out.withColumn("block_key", _block_key(seed, F.col("epoch"))).withColumn("row_key", _row_key(seed, F.col("epoch")))
    slot = F.row_number().over(Window.partitionBy("stratum", "epoch", "block").orderBy("row_key", "doc_id", "n_tokens")) - 1
    blocks = out.select("stratum", "epoch", "block", "block_key").distinct().withColumn("zone", _zone("block_key"))
    ahead = F.coalesce(F.sum("blocks").over(Window.partitionBy("stratum", "epoch").orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    zones = blocks.groupBy("stratum", "epoch", "zone").agg(F.count(F.lit(1)).alias("blocks")).withColumn("ahead", ahead).drop("blocks")
    nth = F.row_number().over(Window.partitionBy("stratum", "epoch", "zone").orderBy("block_key", "block")) - 1
    ranks = blocks.withColumn("nth", nth).join(zones, ["stratum", "epoch", "zone"]).select("stratum", "epoch", "block", (F.col("ahead") + F.col("nth")).cast("int").alias("block_rank"))
    return out.withColumn("slot", slot).join(ranks, ["stratum", "epoch", "block"]).select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "block_rank", "slot")


def mix(docs: DataFrame, seed: int = 11, **target: float | None) -> DataFrame:
    """``docs`` with each row as often as the mixture draws it; the texts aren't shuffled."""
    _, rules = _rules(docs, seed, **target)
    named = docs.select(F.struct("*").alias("row"), "doc_id", _stratum().alias("stratum"), _spread())
    return drawn(named, rules, seed).select("row.*")
