"""Chunkers: text to an array of chunks, and documents to chunk rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.config import RetrievalConfig
from brindle.errors import ValidationError
from brindle.functions.arrays import bound, emitted
from brindle.functions.text import strip

#: Separators of the recursive chunker, in order.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ".", "!", "?", " ")


def _checked(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValidationError("chunk size must be > 0, overlap >= 0 and < size")


def _windows(text: Column, size: int, step: int) -> Column:
    """Substrings of at most ``size`` characters that begin ``step`` apart, found in one pass over the text."""
    pattern = rf"(?s)(?=(.{{1,{size}}})).{{1,{step}}}" if step < size else rf"(?s)(.{{1,{size}}})"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def fixed_chunks(text: Column, size: int = 400, overlap: int = 50) -> Column:
    """Windows of ``size`` characters, ``size - overlap`` apart; those at the end may be shorter."""
    _checked(size, overlap)
    return _windows(strip(F.coalesce(text, F.lit(""))), size, max(size - overlap, 1))


def recursive_chunks(text: Column, size: int = 400, overlap: int = 50) -> Column:
    """Pieces of at most ``size``, cut at the separators one after the other, then packed greedily.

    A separator stays with the piece on its left; an empty piece goes with its separator. The
    recursion is a level for each separator: only pieces that are still too long are cut again.
    ``overlap`` is checked but not used."""
    _checked(size, overlap)
    pieces = F.filter(F.array(strip(F.coalesce(text, F.lit("")))), lambda t: t != "")

    def level(found: Column, sep: str) -> Column:
        def kept(parts: Column) -> Column:
            return F.array_compact(F.transform(parts, lambda x, i: F.when(x == "", None).when(i < F.size(parts) - 1, F.concat(x, F.lit(sep))).otherwise(x)))

        def cut(p: Column) -> Column:
            return F.when(F.length(p) <= size, F.array(p)).otherwise(bound(F.split(p, re.escape(sep), -1), kept))

        return F.flatten(F.transform(found, cut))

    for sep in SEPARATORS:
        pieces = level(pieces, sep)
    pieces = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_windows(p, size, size))))
    none = F.array().cast("array<string>")

    def pack(now: Column, p: Column) -> tuple[Column, Column]:
        fits = F.length(now) + F.length(p) <= size
        return F.when(fits, F.concat(now, p)).otherwise(p), F.when(fits | (now == ""), none).otherwise(F.array(now))

    return emitted(pieces, F.lit(""), "array<string>", pack, lambda now: F.when(now != "", F.array(now)).otherwise(none))


def chunk_documents(docs: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), carry: tuple[str, ...] = ()) -> DataFrame:
    """``chunk_id, text, position, parent_id, length, section`` of every document's chunks, and its columns ``carry``."""
    cut = fixed_chunks if cfg.chunking == "fixed" else recursive_chunks
    rows = docs.select(F.col("doc_id").cast("string").alias("parent_id"), *carry, F.posexplode(cut(F.col("text"), cfg.chunk_size, cfg.chunk_overlap)).alias("position", "text"))
    return rows.select(F.concat("parent_id", F.lit("#"), F.col("position").cast("string")).alias("chunk_id"), "text", "position", "parent_id", F.length("text").alias("length"), F.lit(None).cast("string").alias("section"), *carry)


def chunk_quality(chunks: DataFrame, preview: int = 10) -> DataFrame:
    """Per document: number of chunks, their least, most and mean length, and the first lengths."""
    firsts = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("position") < preview, F.struct("position", "length")))), 1, preview), lambda x: x["length"])
    return chunks.groupBy(F.col("parent_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunk_count"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.avg("length").alias("avg_length"), firsts.alias("first_lengths"))


def ingest_result(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.col("parent_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunks"))
