"""Terms of chunks: inverted index and co-occurrence.

A chunk row keeps its distinct terms as an array. So a term's chunks, and what occurs with it, come
from exploding that array: no join of postings with themselves, and no shuffle before the
partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import stripes


def postings(chunks: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, term``."""
    return chunks.select("chunk_id", "doc_id", F.explode("terms").alias("term"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """``term, chunk_count, doc_count``. The first aggregation's (term, document) pairs are few where a document's
    chunks lie together, as they do in an index; the second shuffles terms alone."""
    per_document = postings(chunks).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_document.groupBy("term").agg(F.sum("n").alias("chunk_count"), F.count(F.lit(1)).alias("doc_count"))


def cooccurrence(chunks: DataFrame) -> DataFrame:
    """``source < target, weight``: in how many chunks both terms occur. The full table; a batch of
    queries needs ``neighbours`` only."""
    edges = stripes.counted(chunks, stripes.buckets_for(stripes.total(chunks)))
    return edges.select("source", "target", F.col("n").cast("double").alias("weight"))


def cooccurrence_by_source(chunks: DataFrame) -> DataFrame:
    """``source, edges, weight, heaviest`` of ``cooccurrence``: added up where a source's edges are, so that no edge is put out."""
    rows = stripes.by_source(chunks)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("weight", "heaviest")})


def neighbours(chunks: DataFrame, terms: DataFrame, small: bool = True) -> DataFrame:
    """``term, neighbour, weight`` for ``terms``. A ``small`` batch's terms stand in the plan as a set, so that a chunk's
    array is copied for those alone that it holds; a larger batch's are joined."""
    wanted = terms.select("term").distinct()
    if small:
        names = [r["term"] for r in wanted.collect()]
        held = chunks.select("terms", F.filter("terms", lambda t: t.isin(names)).alias("held")).where(F.size("held") > 0)
        found = held.select("terms", F.explode("held").alias("term"))
    else:
        found = chunks.select("terms", F.explode("terms").alias("term")).join(wanted, "term")
    pairs = found.select("term", F.explode("terms").alias("neighbour")).where("term <> neighbour")
    return pairs.groupBy("term", "neighbour").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def neighbours_from_edges(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """The same from a written table of co-occurrence edges."""
    both = edges.select(F.col("source").alias("term"), F.col("target").alias("neighbour"), "weight").unionByName(edges.select(F.col("target").alias("term"), F.col("source").alias("neighbour"), "weight"))
    return both.join(terms.select("term").distinct(), "term")
