"""Hybrid queries: both searches, fusion, post-processing, text, explanation, evaluation."""

from __future__ import annotations

import dataclasses
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from brindle.config import QueryOptions, RetrievalConfig, SearchOptions
from brindle.errors import QueryExecutionError, ValidationError
from brindle.functions.text import strip
from brindle.functions.vectors import hash_embedding
from brindle.observe import Trace
from brindle.operators import answer, evaluate, fusion, graph, vector
from brindle.operators.access import Rows, access
from brindle.operators.batch import is_small
from brindle.runtime import settle
from brindle.sources.index import Embedder


def checked_queries(queries: DataFrame) -> DataFrame:
    """The batch with its text stripped. A blank query raises."""
    rows = queries.withColumn("query", strip(F.coalesce("query", F.lit(""))))
    if rows.where("query = ''").limit(1).count():
        raise ValidationError("query must not be empty")
    return rows


def _stage(name: str, make, trace: Trace | None = None):
    """What ``make`` gives, of a plan or of an action; a failure is told and raised with its stage."""
    try:
        return make()
    except (ValidationError, QueryExecutionError):
        raise
    except Exception as e:
        (trace or Trace()).event("query_failed", stage=name, error=str(e))
        raise QueryExecutionError(name, str(e), e) from e


def _sides(index: DataFrame | Rows, queries: DataFrame, cfg: RetrievalConfig, options: QueryOptions, embed: Embedder | None, explain: bool, trace: Trace | None) -> tuple[DataFrame | None, DataFrame | None]:
    vector_k, graph_k, _ = options.ks(cfg)
    found, linked = None, None
    if options.enable_vector:
        # a side that is off needs no embedding
        asks = _stage("embedding", lambda: queries.select("query_id", (embed or (lambda t: hash_embedding(t, cfg.embedding_dim)))(F.col("query")).alias("embedding")), trace)
        found = _stage("retrieval", lambda: vector.search(access(index).vectors(), asks, vector_k, SearchOptions()), trace)
    if options.enable_graph:
        linked = _stage("retrieval", lambda: graph.search(index, queries, graph_k, cfg, explain=explain), trace)
    return found, linked


def _fused(found: DataFrame | None, linked: DataFrame | None, cfg: RetrievalConfig, trace: Trace | None) -> DataFrame:
    none = (found if found is not None else linked).sparkSession.createDataFrame([], "query_id string, doc_id string, chunk_id string, score double")
    return _stage("retrieval", lambda: fusion.fuse(found if found is not None else none, linked if linked is not None else none, cfg), trace)


def retrieve(index: DataFrame | Rows, queries: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), options: QueryOptions = QueryOptions(), embed: Embedder | None = None, explain: bool = False, trace: Trace | None = None) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Vector rows, graph rows (None for a side that is off) and the fused rows."""
    found, linked = _sides(index, queries, cfg, options, embed, explain, trace)
    return found, linked, _fused(found, linked, cfg, trace)


def written_sides(index: DataFrame | Rows, queries: DataFrame, cfg: RetrievalConfig, options: QueryOptions, embed: Embedder | None = None, explain: bool = False, trace: Trace | None = None) -> tuple[DataFrame | None, DataFrame | None, dict[str, float]]:
    """Both sides' rows (None for a side that is off), each searched once and written to the shared folder, and the seconds
    that took. Rows are counted as they are written, without a job that counts."""
    trace, took, sides = trace or Trace(), {}, []
    for name, on in (("vector", options.enable_vector), ("graph", options.enable_graph)):
        if not on:
            sides.append(None)
            continue
        alone = dataclasses.replace(options, enable_vector=name == "vector", enable_graph=name == "graph")
        seen, began = Observation(f"{name}-{uuid.uuid4().hex}"), time.monotonic()

        def made(alone=alone, seen=seen) -> DataFrame:
            rows = next(x for x in _sides(index, queries, cfg, alone, embed, explain, trace) if x is not None)
            return settle(rows.observe(seen, F.count(F.lit(1)).alias("n")))

        sides.append(_stage("embedding" if name == "vector" and embed is not None else "retrieval", made, trace))
        took[name] = round(time.monotonic() - began, 3)
        trace.event(f"{name}_retrieved", count=seen.get["n"])
    return *sides, took


def with_text(rows: DataFrame, index: DataFrame | Rows, small: bool = True) -> DataFrame:
    """Texts of the few rows left: top k of a batch, which is broadcast if it is ``small``."""
    return access(index).with_text(rows, small)


def hybrid(index: DataFrame | Rows, queries: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), options: QueryOptions = QueryOptions(), embed: Embedder | None = None, text: bool = True, trace: Trace | None = None) -> DataFrame:
    """The final chunks of each query with ``rank``, all scores and (``text``) their text. Without text
    this is a plan, of which only the batch's expanded terms are known already; texts are looked up for the rows found.
    ``execute`` runs a batch and tells of it."""
    fused = retrieve(index, queries, cfg, options, embed, trace=trace)[2]
    final = _stage("postprocess", lambda: fusion.postprocess(fused, options.ks(cfg)[2], options.min_score), trace)
    return with_text(final, index, is_small(queries)) if text else final


#: Queries that ``execute`` takes: its rows go to its caller.
MOST_EXECUTED = 10_000


def execute(index: DataFrame | Rows, queries: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), options: QueryOptions = QueryOptions(), embed: Embedder | None = None, model=None, trace: Trace | None = None) -> tuple[list[Row], list[Row], dict[str, float]]:
    """Runs a checked batch stage by stage: its final chunks, its answers (query_id, answer), and the seconds
    of each stage. A failure of an action carries the stage it happened in. Each side's hits are written once and counted
    as they are; no job only counts. More than ``MOST_EXECUTED`` queries raise, as the rows are handed to the caller:
    ``hybrid`` takes any number. ``model``: as for ``answer.generate``; else the listing."""
    trace, took = trace or Trace(), {}
    trace.event("query_start", top_k=options.top_k, min_score=options.min_score, enable_vector=options.enable_vector, enable_graph=options.enable_graph)

    def timed(name: str, stage: str, run):
        began = time.monotonic()
        out = _stage(stage, run, trace)
        took[name] = round(time.monotonic() - began, 3)
        return out

    queries = timed("check", "retrieval", lambda: checked_queries(queries))
    if not is_small(queries, MOST_EXECUTED):
        raise ValidationError(f"more than {MOST_EXECUTED} queries in a batch")
    *sides, searched = written_sides(index, queries, cfg, options, embed, trace=trace)
    took |= searched
    trace.event("retrieval_timing", **took)
    fused = _fused(*sides, cfg, trace)
    final = timed("postprocess", "postprocess", lambda: with_text(fusion.postprocess(fused, options.ks(cfg)[2], options.min_score), index).orderBy("query_id", "rank").collect())
    trace.event("retrieval_query_done", count=len(final))
    kept = queries.sparkSession.createDataFrame(final, with_text(fusion.postprocess(fused, 1), index).schema)
    answers = timed("generation", "generation", lambda: answer.generate(kept, queries, model) if model else [tuple(r) for r in answer.listing(kept, queries).orderBy("query_id").collect()])
    trace.event("query_done", count=len(answers), seconds=round(sum(took.values()), 3))
    return final, answers, took


def retrieval_debug(index: DataFrame | Rows, queries: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), options: QueryOptions = QueryOptions(), embed: Embedder | None = None, trace: Trace | None = None) -> DataFrame:
    """A row for each query: summary, both sides' top k and hits, how they were merged (weights, method, counts, every
    chunk's raw and effective scores), the first ten fused and final hits, preview, scoring, stats, and the seconds of
    the batch. Both sides are searched once, and all lists are made by one aggregation."""
    found, linked, took = written_sides(index, queries, cfg, options, embed, True, trace)
    began = time.monotonic()
    fused = settle(_fused(found, linked, cfg, trace))
    final = settle(fusion.postprocess(fused, options.ks(cfg)[2], options.min_score))
    took["postprocess"] = round(time.monotonic() - began, 3)
    vector_k, graph_k, _ = options.ks(cfg)
    ordered = lambda *hit: F.struct((-F.col("score")).alias("down"), "chunk_id", "doc_id", F.struct("doc_id", "chunk_id", "score", *hit).alias("hit"))
    details = F.struct("doc_id", "chunk_id", "source", "vector_hit", "graph_hit", "raw_vector_score", "raw_graph_score", "vector_score", "graph_score", "score")
    shown = F.struct("rank", "doc_id", "chunk_id", "source", "matched_by", "vector_hit", "graph_hit", "raw_vector_score", "raw_graph_score", "effective_vector_score", "effective_graph_score", "final_score")
    tagged = [fused.select("query_id", details.alias("chunk"), ordered("source").alias("fused")), final.select("query_id", ordered("source").alias("final")), fusion.ranking_preview(final).select("query_id", shown.alias("preview"))]
    tagged += [found.select("query_id", ordered().alias("vector"))] if found is not None else []
    tagged += [linked.select("query_id", ordered("expansion_capped").alias("graph"))] if linked is not None else []
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    lists = every.groupBy("query_id").agg(*(F.array_sort(F.collect_list(c)).alias(c) for c in every.columns if c != "query_id"))
    out = queries.select("query_id", "query").join(lists, "query_id", "left")
    some = lambda c: F.coalesce(F.col(c), F.array()) if c in out.columns else F.array()
    size = lambda c: F.size(some(c)).cast("bigint")
    hits = lambda c, most=None: F.transform(F.slice(some(c), 1, most) if most else some(c), lambda x: x["hit"])
    both = lambda test: F.size(F.filter(some("chunk"), test)).cast("bigint")
    mode = "hybrid" if options.enable_vector and options.enable_graph else "vector" if options.enable_vector else "graph"
    method = "minmax" if cfg.normalise else "none"
    summary = F.struct(F.lit(mode).alias("mode"), F.lit(options.enable_vector).alias("vector_enabled"), F.lit(options.enable_graph).alias("graph_enabled"), size("vector").alias("vector_count"), size("graph").alias("graph_count"), size("fused").alias("fused_count"), size("final").alias("final_count"), F.greatest(size("fused") - size("final"), F.lit(0).cast("bigint")).alias("postprocess_removed_count"), F.lit(cfg.normalise).alias("normalization_enabled"), F.lit(method).alias("normalization_method"))
    capped = F.exists(some("graph"), lambda x: x["hit"]["expansion_capped"]) if linked is not None else F.lit(False)
    scoring = F.struct(F.lit(cfg.alpha).alias("alpha"), F.lit(cfg.beta).alias("beta"), F.lit(cfg.direct_hit_weight).alias("direct_hit_weight"), F.lit(cfg.expanded_hit_weight).alias("expanded_hit_weight"), F.lit(cfg.expansion_score_cap).cast("double").alias("expansion_score_cap"), capped.alias("has_expansion_capped_result"))
    merging = F.struct(F.lit(cfg.alpha).alias("alpha"), F.lit(cfg.beta).alias("beta"), F.lit(method).alias("method"), both(lambda x: x["vector_hit"]).alias("vector_count"), both(lambda x: x["graph_hit"]).alias("graph_count"), both(lambda x: x["vector_hit"] & x["graph_hit"]).alias("overlap_count"), some("chunk").alias("chunks"))
    stats = F.struct(size("vector").alias("vector_count"), size("graph").alias("graph_count"), size("fused").alias("fusion_count"), size("final").alias("citation_count"))
    timings = F.struct(*(F.lit(took.get(name, 0.0)).alias(key) for name, key in (("vector", "vector_retrieval_time"), ("graph", "graph_retrieval_time"), ("postprocess", "postprocess_time"))))
    sides = [(c, k) for c, k in (("vector", vector_k), ("graph", graph_k)) if c in out.columns]
    return out.select(
        "query_id", "query", summary.alias("summary"), scoring.alias("scoring_overview"), merging.alias("fusion"), *(F.lit(k).alias(f"{c}_top_k") for c, k in sides), *(hits(c).alias(f"{c}_hits") for c, _ in sides),
        hits("fused", 10).alias("fused_hits"), hits("final", 10).alias("final_hits"), some("preview").alias("ranking_preview"), timings.alias("timings"), stats.alias("stats"),
    )


def evaluate_dataset(index: DataFrame | Rows, samples: DataFrame, modes: list[str], k: int, cfg: RetrievalConfig = RetrievalConfig(), embed: Embedder | None = None) -> DataFrame:
    """Measures of every sample (query_id, query, relevant_chunk_ids) in every mode. Each side is searched once,
    whatever the number of modes: its hits (k of a checked batch) are kept, and modes fuse them."""
    if not samples.limit(1).count():
        raise ValueError("samples must not be empty")
    flags = {mode: evaluate.mode_flags(mode) for mode in modes}
    options = QueryOptions(top_k=k, enable_vector=any(v for v, _ in flags.values()), enable_graph=any(g for _, g in flags.values()))
    queries = checked_queries(samples.select("query_id", "query"))
    found, linked, _ = written_sides(index, queries, cfg, options, embed)
    parts = []
    for mode, (v, g) in flags.items():
        final = fusion.postprocess(_fused(found if v else None, linked if g else None, cfg, None), options.ks(cfg)[2])
        parts.append(evaluate.evaluated(evaluate.ranked_lists(final, samples, mode), k))
    return reduce(DataFrame.unionByName, parts)
