"""Evaluation: recall at k, reciprocal rank and error analysis, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = {"hybrid": (True, True), "vector": (True, False), "graph": (False, True)}


def mode_flags(mode: str) -> tuple[bool, bool]:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return MODES[mode]


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Distinct relevant among the first k, over the number of relevant (repeats count below)."""
    if k <= 0:
        raise ValueError("k must be > 0")
    some = F.when(F.size(relevant) > 0, F.size(relevant)).otherwise(F.raise_error(F.lit("relevant chunk ids must not be empty")).cast("int"))
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / some


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """1 / rank of the first relevant in the whole list, else 0."""
    ranks = F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1))
    return F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0))


def relevant_ranks(retrieved: Column, relevant: Column) -> Column:
    """Map of each relevant id to its last rank, null if it wasn't retrieved."""
    turned = F.reverse(retrieved)
    rank = lambda r: F.when(F.array_contains(retrieved, r), F.size(retrieved) - F.array_position(turned, r).cast("int") + 1)
    return F.map_from_entries(F.transform(F.array_distinct(relevant), lambda r: F.struct(r, rank(r))))


def missing(of: Column, among: Column) -> Column:
    """Those of ``of`` that aren't in ``among``, in order, repeats kept."""
    return F.filter(of, lambda x: ~F.array_contains(among, x))


def evaluated(results: DataFrame, k: int) -> DataFrame:
    """``results``: mode, query, retrieved_chunk_ids, relevant_chunk_ids. Adds the measures."""
    got, want = F.col("retrieved_chunk_ids"), F.col("relevant_chunk_ids")
    return results.select("mode", "query", got, recall_at_k(got, want, k).alias("recall_at_k"), reciprocal_rank(got, want).alias("mrr"), want, relevant_ranks(got, want).alias("relevant_ranks"), missing(want, got).alias("false_negatives"), missing(got, want).alias("false_positives"))


def summary(rows: DataFrame, k: int) -> DataFrame:
    """``mode, k, sample_count, avg_recall_at_k, avg_mrr``; no rows raise an error when it runs."""
    out = rows.groupBy("mode").agg(F.count(F.lit(1)).cast("int").alias("sample_count"), F.avg("recall_at_k").alias("avg_recall_at_k"), F.avg("mrr").alias("avg_mrr"))
    return out.select("mode", F.lit(k).alias("k"), "sample_count", "avg_recall_at_k", "avg_mrr")


def ranked_lists(final: DataFrame, samples: DataFrame, mode: str) -> DataFrame:
    """Per sample the ids in order of rank. ``samples``: query_id, query, relevant_chunk_ids."""
    lists = final.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    joined = samples.join(lists, "query_id", "left")
    return joined.select(F.lit(mode).alias("mode"), "query", F.coalesce("ids", F.array().cast("array<string>")).alias("retrieved_chunk_ids"), "relevant_chunk_ids")


def case_report(rows: DataFrame) -> str:
    """A block of lines for each sample of ``evaluated``; for people, over a bounded set of samples."""
    out = []
    for r in rows.orderBy("mode", "query").toLocalIterator():
        ranks = ", ".join(f"{k}: {'not found' if v is None else v}" for k, v in r["relevant_ranks"].items())
        out += [f"[{r['mode']}] {r['query']}", f"  recall {r['recall_at_k']:.4f}, mrr {r['mrr']:.4f}", f"  retrieved: {', '.join(r['retrieved_chunk_ids'])}", f"  ranks of relevant: {ranks}", f"  missed: {', '.join(r['false_negatives']) or '-'}; wrong: {', '.join(r['false_positives']) or '-'}"]
    return "\n".join(out)
