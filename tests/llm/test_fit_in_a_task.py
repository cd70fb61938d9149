"""The classifier learns in a task: the driver gets its weights alone."""

from __future__ import annotations

import numpy as np

from brindle.llm import quality


def test_the_driver_gets_one_row(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "spam spam buy ") * (1 + i % 3)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got, collect = [], type(docs).collect

    def spied(df):
        rows = collect(df)
        got.append(len(rows))
        return rows

    with monkeypatch.context() as m:
        m.setattr(type(docs), "collect", spied)
        weights = quality.fit(docs, labels)
    assert sum(got) <= 1 and weights.shape == (1 << quality.BITS,)
    found = quality.scores(["good words here", "spam spam buy"], weights)
    assert found[0] > 0.5 > found[1]
    assert not np.any(quality.fit(docs.limit(0), labels))
