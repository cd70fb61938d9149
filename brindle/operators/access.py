"""How searches reach an index: by its rows, or (``sources.index.Stored``) by what a store keeps by term and document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import terms
from brindle.operators.batch import sized


class Rows:
    """An index as one table of chunks, whose arrays of terms are read for every search.

    ``small`` says that what is asked for may be broadcast. ``one_row_each``: no chunk has two rows, and hits are best found by
    reading them all."""

    one_row_each = False

    def __init__(self, chunks: DataFrame):
        self.chunks = chunks

    def vectors(self) -> DataFrame:
        return self.chunks

    def held(self, wanted: DataFrame, small: bool) -> DataFrame:
        """``chunk_id, doc_id`` and the columns of ``wanted`` (among them ``term``), for every chunk that holds the term."""
        return terms.postings(self.chunks).join(sized(wanted, small), "term")

    def near(self, wanted: DataFrame, small: bool) -> DataFrame:
        """``term, neighbour, weight``: of each term of ``wanted`` (term, need) at least its first ``need`` neighbours."""
        return terms.neighbours(self.chunks, wanted, small)

    def document_frequency(self) -> DataFrame:
        return terms.document_frequency(self.chunks)

    def with_text(self, rows: DataFrame, small: bool) -> DataFrame:
        """``rows`` (doc_id, chunk_id) with their text."""
        return self.chunks.select("doc_id", "chunk_id", "text").join(sized(rows, small), ["doc_id", "chunk_id"])


def access(index: DataFrame | Rows) -> Rows:
    return index if isinstance(index, Rows) else Rows(index)
