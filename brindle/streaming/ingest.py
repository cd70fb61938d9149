"""Incremental ingest: each micro-batch of documents replaces its documents in an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.config import RetrievalConfig
from brindle.sources.index import Embedder, IndexStore, build_index


def ingest_stream(docs: DataFrame, store: IndexStore, checkpoint: str, cfg: RetrievalConfig = RetrievalConfig(), embed: Embedder | None = None, order: str | None = None) -> StreamingQuery:
    """Of a document that a batch has more than once, the last by the column ``order`` counts; without an
    order, rows of a batch have none, and the greatest text counts. A repeated batch has the same effect. An order of
    whole numbers, dates or times holds over batches too: a late older row doesn't replace a newer document."""

    def put(batch: DataFrame, _: int) -> None:
        by = F.lit("") if order is None else F.col(f"`{order}`")
        store.upsert(build_index(batch.select("doc_id", "text", by.alias("by")), cfg, embed, order="by"))

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
