"""Fusion of the two rankings, post-processing, citations and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.config import RetrievalConfig

KEY = ["query_id", "doc_id", "chunk_id"]


def last_wins(rows: DataFrame, ordinal: str) -> DataFrame:
    """One score for each key of a list that repeats keys: the one that comes last."""
    return rows.groupBy(*KEY).agg(F.max_by("score", ordinal).alias("score"))


def _min_max(score: Column) -> Column:
    over = Window.partitionBy("query_id")
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(low == high, F.when(score > 0, 1.0).otherwise(0.0)).otherwise((score - low) / F.when(low == high, 1.0).otherwise(high - low))


def fuse(vector: DataFrame, graph: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Keys, ``vector_hit, graph_hit, raw_vector_score, raw_graph_score, vector_score, graph_score, score, source``.

    A missing side scores 0, also in the normalisation's minimum."""
    v = vector.select(*KEY, F.col("score").alias("v"))
    g = graph.select(*KEY, F.col("score").alias("g"))
    both = v.join(g, KEY, "full_outer").select(*KEY, F.col("v").isNotNull().alias("vector_hit"), F.col("g").isNotNull().alias("graph_hit"), F.coalesce("v", F.lit(0.0)).alias("raw_vector_score"), F.coalesce("g", F.lit(0.0)).alias("raw_graph_score"))
    for side in ("vector", "graph"):
        raw = F.col(f"raw_{side}_score")
        both = both.withColumn(f"{side}_score", _min_max(raw) if cfg.normalise else raw)
    source = F.when(F.col("vector_hit") & F.col("graph_hit"), "hybrid").when(F.col("vector_hit"), "vector").otherwise("graph")
    return both.withColumn("score", F.lit(cfg.alpha) * F.col("vector_score") + F.lit(cfg.beta) * F.col("graph_score")).withColumn("source", source)


def _best(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id", "doc_id")


def postprocess(rows: DataFrame, top_k: int, min_score: float | None = None) -> DataFrame:
    """Threshold (inclusive), the best row of each (chunk, source), top k; with ``rank`` from 1."""
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    once = rows.withColumn("copy", F.row_number().over(_best(*KEY, "source"))).where("copy = 1").drop("copy")
    return once.withColumn("rank", F.row_number().over(_best("query_id"))).where(F.col("rank") <= top_k)


def citations(final: DataFrame) -> DataFrame:
    return final.select("query_id", "doc_id", "chunk_id", "source", "score", "rank")


def ranking_preview(final: DataFrame, limit: int = 5) -> DataFrame:
    """The first ranks with both sides' raw and effective scores, and what matched."""
    matched = F.array_compact(F.array(F.when(F.col("vector_hit"), F.lit("vector")), F.when(F.col("graph_hit"), F.lit("graph"))))
    shown = F.when(F.size(matched) > 0, matched).otherwise(F.array_compact(F.array("source")))
    return final.where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "chunk_id", "source", shown.alias("matched_by"), "vector_hit", "graph_hit", "raw_vector_score", "raw_graph_score", F.col("vector_score").alias("effective_vector_score"), F.col("graph_score").alias("effective_graph_score"), F.col("score").alias("final_score"))


def weight_sweep(fused: DataFrame, weights: DataFrame, top_k: int) -> DataFrame:
    """Top k of each query under each (alpha, beta) of ``weights``; what was retrieved is computed once."""
    rows = fused.join(F.broadcast(weights.select("alpha", "beta")), F.lit(True)).withColumn("score", F.col("alpha") * F.col("vector_score") + F.col("beta") * F.col("graph_score"))  # a few weights, given by hand
    rank = F.row_number().over(Window.partitionBy("alpha", "beta", "query_id").orderBy(F.desc("score"), "chunk_id", "doc_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top_k)
