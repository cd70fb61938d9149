"""Graph search: direct terms, one hop of expansion over co-occurrence, weighted hits, top k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.config import RetrievalConfig
from brindle.functions.text import extract_terms, normalise_terms
from brindle.operators.access import Rows, access
from brindle.operators.batch import is_small
from brindle.runtime import settle, workers_see_package

#: Hits that are added up at once.
HITS = 2_000_000
_ITEM = "array<struct<query_term:string,expanded_term:string,weight:double>>"


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, nth, term, directs``: from the column ``terms`` where there is one and it isn't null, else from the text."""
    found = extract_terms(F.col("query"))
    if "terms" in queries.columns:
        found = F.coalesce(normalise_terms(F.col("terms")), found)
    return queries.select("query_id", found.alias("directs")).select("query_id", "directs", F.posexplode("directs").alias("nth", "term"))


def _candidates(terms: DataFrame, near: DataFrame) -> DataFrame:
    joined = terms.join(near, "term").where(~F.array_contains("directs", F.col("neighbour")))
    nth = F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.desc("weight"), "neighbour"))
    return joined.withColumn("place", nth)


def expand_ranked(terms: DataFrame, near: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """``query_id, query_term, expanded_term, weight``: each term's best, then each neighbour's first
    term in alphabetical order, then as many as allowed in that order."""
    best = _candidates(terms, near).where(F.col("place") <= cfg.expand_per_term_limit)
    first = F.row_number().over(Window.partitionBy("query_id", "neighbour").orderBy("term"))
    once = best.withColumn("first", first).where("first = 1")
    cut = F.row_number().over(Window.partitionBy("query_id").orderBy("term", F.desc("weight"), "neighbour"))
    return once.withColumn("cut", cut).where(F.col("cut") <= cfg.max_expanded_terms).select("query_id", F.col("term").alias("query_term"), F.col("neighbour").alias("expanded_term"), "weight")


def _heavier(a: Column, b: Column) -> Column:
    """Order of expanded terms: weight down, then expanded term, then query term."""
    less = (a["weight"] > b["weight"]) | ((a["weight"] == b["weight"]) & ((a["expanded_term"] < b["expanded_term"]) | ((a["expanded_term"] == b["expanded_term"]) & (a["query_term"] < b["query_term"]))))
    return F.when(less, -1).when((a["expanded_term"] == b["expanded_term"]) & (a["query_term"] == b["query_term"]) & (a["weight"] == b["weight"]), 0).otherwise(1)


def sorted_items(items: Column) -> Column:
    return F.array_sort(items, _heavier)


def expand_greedy(terms: DataFrame, near: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """The same columns; terms in query order, each taking its best neighbours that no earlier term took,
    until there are enough. A term can meet fewer than ``max`` taken names plus its own, so that
    many candidates of it suffice, and the fold's state is bounded."""
    most = cfg.expand_per_term_limit + cfg.max_expanded_terms - 1
    few = _candidates(terms, near).where(F.col("place") <= most)
    item = F.struct("place", F.col("term").alias("query_term"), F.col("neighbour").alias("expanded_term"), "weight")
    by_term = few.groupBy("query_id", "nth").agg(F.array_sort(F.collect_list(item)).alias("items"))
    by_query = by_term.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("nth", "items"))).alias("terms"))
    empty = F.array().cast(_ITEM)

    def take(so_far: Column, x: Column) -> Column:
        seen = F.exists(so_far["out"], lambda y: y["expanded_term"] == x["expanded_term"])
        skip = seen | (so_far["n"] >= cfg.expand_per_term_limit)
        grown = F.concat(so_far["out"], F.array(F.struct(x["query_term"], x["expanded_term"], x["weight"])))
        return F.struct(F.when(skip, so_far["out"]).otherwise(grown).alias("out"), F.when(skip, so_far["n"]).otherwise(so_far["n"] + 1).alias("n"))

    def term(out: Column, t: Column) -> Column:
        more = F.aggregate(t["items"], F.struct(out.alias("out"), F.lit(0).alias("n")), take, lambda s: s["out"])
        return F.when(F.size(out) >= cfg.max_expanded_terms, out).otherwise(more)

    taken = F.slice(sorted_items(F.aggregate("terms", empty, term)), 1, cfg.max_expanded_terms)
    return by_query.select("query_id", F.inline(taken))


def expand(terms: DataFrame, near: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    return (expand_greedy if cfg.expansion == "greedy" else expand_ranked)(terms, near, cfg)


def near(index: DataFrame | Rows, terms: DataFrame, cfg: RetrievalConfig, small: bool) -> DataFrame:
    """``term, neighbour, weight``: as many first neighbours of each term as an expansion can need, whichever of them
    are terms of the query themselves."""
    most = F.max(F.size("directs")) + cfg.expand_per_term_limit + cfg.max_expanded_terms
    return access(index).near(terms.groupBy("term").agg(most.alias("need")), small)


def hits(index: DataFrame | Rows, terms: DataFrame, expanded: DataFrame, small: bool = False) -> DataFrame:
    """``query_id, chunk_id, doc_id, term, direct, item``: one row for each direct term (item null) and each
    expanded term of a chunk."""
    return access(index).held(_wanted(terms, expanded), small)


def _wanted(terms: DataFrame, expanded: DataFrame) -> DataFrame:
    return terms.select("query_id", "term", F.lit(True).alias("direct"), F.lit(None).cast(_ITEM[6:-1]).alias("item")).unionByName(
        expanded.select("query_id", F.col("expanded_term").alias("term"), F.lit(False).alias("direct"), F.struct("query_term", "expanded_term", "weight").alias("item"))
    )


def _first_hits(batches: Iterator[pa.RecordBatch], wanted: pa.Table, cfg: RetrievalConfig, k: int, most: int) -> Iterator[pa.RecordBatch]:
    names, asks = (wanted.column(c).combine_chunks().dictionary_encode() for c in ("term", "query_id"))
    order = np.argsort(names.indices.to_numpy(), kind="stable")
    begin = np.searchsorted(names.indices.to_numpy()[order], np.arange(len(names.dictionary) + 1))
    of_query, direct, gain = asks.indices.to_numpy().astype(np.int64)[order], wanted.column("direct").to_numpy().astype(float)[order], wanted.column("gain").to_numpy()[order]
    per = np.diff(begin)
    for batch in batches:
        lists, ids = batch.column(2), batch.column(0)
        rank = np.empty(len(batch), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(batch))  # by bytes, as Spark orders strings
        term = pc.fill_null(pc.index_in(lists.flatten(), value_set=names.dictionary), -1).to_numpy()
        row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))[term >= 0]
        term = term[term >= 0]
        at = np.concatenate([[0], np.cumsum(np.bincount(row, per[term], len(batch)))])
        lo = 0
        while lo < len(batch):  # whole chunks, of so many hits
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
            part = slice(*np.searchsorted(row, [lo, hi]))
            n, lo = per[term[part]], hi
            which = np.repeat(begin[term[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pair, hit = np.unique(of_query[which] * len(batch) + np.repeat(row[part], n), return_inverse=True)
            if not len(pair):
                continue
            directs, added = np.bincount(hit, direct[which]), np.bincount(hit, gain[which])
            score = directs * cfg.direct_hit_weight + (added if cfg.expansion_score_cap is None else np.minimum(added, cfg.expansion_score_cap))
            query, chunk = pair // len(batch), pair % len(batch)
            order = np.lexsort((rank[chunk], -score, query))
            first = np.flatnonzero(np.diff(query[order], prepend=-1))
            best = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]
            expanded = np.bincount(hit)[best] - directs[best].astype(np.int64)
            found = [asks.dictionary.take(pa.array(query[best])), ids.take(pa.array(chunk[best])), batch.column(1).take(pa.array(chunk[best])), pa.array(directs[best].astype(np.int64)), pa.array(expanded), pa.array(added[best])]
            yield pa.RecordBatch.from_arrays(found, ["query_id", "chunk_id", "doc_id", "direct_hit_count", "expanded_hit_count", "expanded_score"])


def first_hits(chunks: DataFrame, terms: DataFrame, expanded: DataFrame, cfg: RetrievalConfig, k: int) -> DataFrame:
    """What ``scored`` adds up, for a small batch, where each chunk is one row with its terms: a chunk's hits are added up where
    it lies, and of some thousands of chunks each query's best ``k`` go on, so that hits aren't shuffled."""
    spark = chunks.sparkSession
    workers_see_package(spark)
    gain = F.coalesce(F.col("item.weight") * cfg.expanded_hit_weight, F.lit(0.0))
    wanted = _wanted(terms, expanded).where("term is not null").select("query_id", "term", "direct", gain.alias("gain"))
    sent, most = spark.sparkContext.broadcast(wanted.toArrow()), HITS
    schema = f"query_id {terms.schema['query_id'].dataType.simpleString()}, chunk_id string, doc_id string, direct_hit_count bigint, expanded_hit_count bigint, expanded_score double"
    rows = chunks.where("terms is not null").select("chunk_id", "doc_id", "terms")
    return rows.mapInArrow(lambda batches: _first_hits(batches, sent.value, cfg, k, most), schema)


def scored(found: DataFrame, cfg: RetrievalConfig, explain: bool = False) -> DataFrame:
    """``query_id, chunk_id, doc_id, direct_hit_count, expanded_hit_count, expanded_score, capped_expanded_score, expansion_capped, score``."""
    contribution = F.col("item.weight") * cfg.expanded_hit_weight
    extra = []
    if explain:
        item = F.struct("item.query_term", "item.expanded_term", "item.weight", contribution.alias("contribution"))
        extra = [F.array_sort(F.collect_list(F.when(F.col("direct"), F.col("term")))).alias("direct_terms"), F.collect_list(F.when(~F.col("direct"), item)).alias("expanded_hits")]
    sums = found.groupBy("query_id", "chunk_id", "doc_id").agg(F.count_if("direct").alias("direct_hit_count"), F.count_if(~F.col("direct")).alias("expanded_hit_count"), F.coalesce(F.sum(contribution), F.lit(0.0)).alias("expanded_score"), *extra)
    return _weighed(sums, cfg)


def _weighed(sums: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    cap = F.lit(cfg.expansion_score_cap).cast("double")
    capped = F.least("expanded_score", cap)  # a null cap is skipped
    return sums.withColumn("capped_expanded_score", capped).withColumn("expansion_capped", F.coalesce(F.col("expanded_score") > cap, F.lit(False))).withColumn("score", F.col("direct_hit_count") * F.lit(cfg.direct_hit_weight) + F.col("capped_expanded_score"))


def found(index: DataFrame | Rows, queries: DataFrame, cfg: RetrievalConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch's terms, their expansions, and its hits. What is broadcast follows from the number of its terms:
    each query adds at most ``max_expanded_terms`` of its own."""
    terms, expanded, small = _expanded(index, queries, cfg)
    return terms, expanded, hits(index, terms, expanded, small)


def _expanded(index: DataFrame | Rows, queries: DataFrame, cfg: RetrievalConfig) -> tuple[DataFrame, DataFrame, bool]:
    terms = query_terms(queries)
    small = is_small(terms)
    return terms, settle(expand(terms, near(index, terms, cfg, small), cfg)), small  # a few rows of each query


def best(rows: DataFrame, top_k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= max(top_k, 0)).drop("rank").withColumn("source", F.lit("graph"))


def search(index: DataFrame | Rows, queries: DataFrame, top_k: int, cfg: RetrievalConfig = RetrievalConfig(), explain: bool = False) -> DataFrame:
    """The best chunks of each query by (-score, chunk_id)."""
    terms, expanded, small = _expanded(index, queries, cfg)
    if small and top_k > 0 and access(index).one_row_each:
        rows = best(_weighed(first_hits(access(index).chunks, terms, expanded, cfg, top_k), cfg), top_k)
        if not explain:
            return rows
        few = F.broadcast(settle(rows.select("query_id", "chunk_id", "doc_id")))  # top k of a small batch
        return best(scored(hits(index, terms, expanded, small).join(few, ["query_id", "chunk_id", "doc_id"], "left_semi"), cfg, True), top_k)
    return best(scored(hits(index, terms, expanded, small), cfg, explain), top_k)


def explained(index: DataFrame | Rows, queries: DataFrame, top_k: int, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """A row for each query: its direct terms, expanded terms, and its chunks with all that scored them."""
    terms, expanded, held = found(index, queries, cfg)
    rows = best(scored(held, cfg, True), top_k).withColumn("expanded_hits", sorted_items(F.col("expanded_hits"))).withColumn("direct_score", F.col("direct_hit_count") * F.lit(cfg.direct_hit_weight)).withColumn("expansion_score_cap", F.lit(cfg.expansion_score_cap).cast("double"))
    names = ["chunk_id", "doc_id", "direct_terms", "expanded_hits", "direct_hit_count", "expanded_hit_count", "direct_score", "expanded_score", "capped_expanded_score", "expansion_score_cap", "expansion_capped", "score"]
    order = F.struct((-F.col("score")).alias("down"), F.col("chunk_id").alias("name"), F.struct(*names).alias("chunk"))
    by_query = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["chunk"]).alias("chunks"))
    items = expanded.groupBy("query_id").agg(sorted_items(F.collect_list(F.struct("query_term", "expanded_term", "weight"))).alias("expanded_terms"))
    none = lambda c: F.coalesce(F.col(c), F.array())
    out = queries.select("query_id", "query").join(terms.groupBy("query_id").agg(F.array_sort(F.first("directs")).alias("direct_terms")), "query_id", "left").join(items, "query_id", "left").join(by_query, "query_id", "left")
    weights = F.struct(F.lit(cfg.direct_hit_weight).alias("direct_hit_weight"), F.lit(cfg.expanded_hit_weight).alias("expanded_hit_weight"), F.lit(cfg.expansion_score_cap).cast("double").alias("expansion_score_cap"))
    meta = F.struct(F.lit(1).alias("expansion_depth"), F.lit(cfg.expand_per_term_limit).alias("expand_per_term_limit"), F.lit(cfg.max_expanded_terms).alias("max_expanded_terms"))
    return out.select("query_id", "query", none("direct_terms").alias("direct_terms"), none("expanded_terms").alias("expanded_terms"), none("chunks").alias("chunks"), weights.alias("weights"), F.lit(cfg.formula).alias("scoring_formula"), meta.alias("meta"))
