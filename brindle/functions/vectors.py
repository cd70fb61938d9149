"""Vector functions and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def dot(a: Column, b: Column) -> Column:
    """Dot product, added up from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a norm is 0; null where the lengths differ."""
    bottom = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(F.size(a) == F.size(b), F.when(bottom == 0, 0.0).otherwise(dot(a, b) / bottom))


def hash_embedding(text: Column, dim: int = 32) -> Column:
    """Bytes of the text's SHA-256, over 255; repeated beyond 32."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") / F.lit(255.0))


def fake_embedding(text: Column, dim: int = 32) -> Column:
    """999, then ones, whatever the text."""
    return F.concat(F.array(F.lit(999.0)), F.array_repeat(F.lit(1.0), dim - 1))


def to_json(embedding: Column) -> Column:
    return F.to_json(embedding)


def from_json(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def model_embedding(load: Callable[[], Callable[[list[str]], list[list[float]]]], normalise: bool = False) -> Callable[[Column], Column]:
    """An embedder from a model: ``load`` is called once in each worker, batches come through Arrow."""

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        model = load()
        for part in parts:
            rows = [np.asarray(v, float) for v in model(part.fillna("").tolist())]
            yield pd.Series([(v / n if normalise and (n := np.linalg.norm(v)) else v).tolist() for v in rows])

    return embed
