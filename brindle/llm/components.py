"""Connected components of a graph that is too large for one machine: alternating star contraction.

Each round links every node to the smallest node of its neighbourhood: first from its larger
neighbours (large star), then from its smaller ones (small star), until nothing changes. A round is
two aggregations; its result is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import remove, scratch

ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (its smallest node) of every node that has an edge to another."""
    spark, paths = edges.sparkSession, []

    def written(rows: DataFrame) -> DataFrame:
        """``rows`` from the shared folder; what the rounds before wrote goes, as nothing reads it any more."""
        paths.append(scratch(spark, "components"))
        rows.write.parquet(paths[-1])
        for path in paths[:-1]:
            remove(spark, path)
        del paths[:-1]
        return spark.read.schema(rows.schema).parquet(paths[-1])

    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        shape = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if shape == before:
            break
        before = shape
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
