"""Batches of queries: how a batch meets an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a batch (or what comes of it) is broadcast. Larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def is_small(rows: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``rows``, a batch of queries, has at most ``most`` rows; counts no further than that."""
    return rows.limit(most + 1).count() <= most


def sized(rows: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(rows) if small else rows
