"""What the operators of this package share: reading tables, scratch space, batch limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.runtime import remove, scratch, shared_dir, workers_see_package

#: Rows and bytes of one Arrow batch, so that a Python worker holds a bounded piece of a partition.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """Settings of plans that run Python: batches bounded in rows and bytes, and this package's folder in
    the workers' path, where it isn't installed but lies in the same place."""
    workers_see_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


__all__ = ["remove", "scratch", "shared_dir"]


def whole(text: str | Column) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
