"""What plans need of the session: the folder that driver and executors share, and the workers' path."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from brindle.errors import ValidationError

#: The folder that holds this package.
HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where that is unset, a folder
    of this machine serves a local master (tests); on a cluster it would lose data, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if found is None:
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise ValidationError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="brindle-")
    if not current.isDefined():
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: With it Spark removes what an action shuffled as soon as the action ends.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Work in rounds: what a round's actions shuffle is gone before the next one begins, and not when the driver collects garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def settle_freed(df: DataFrame) -> DataFrame:
    """The same as ``settle``, of few rows, where what ``df`` shuffled is to be gone at once: Spark keeps that of a checkpoint."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "round")
    with freed_shuffles(spark):
        df.write.parquet(path)
    rows = settle(spark.read.schema(df.schema).parquet(path))
    remove(spark, path)
    return rows


def workers_see_package(spark: SparkSession) -> None:
    """Puts this package's folder in the workers' path, where it isn't installed but lies in the same place."""
    env = spark.sparkContext.environment
    if HOME not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (HOME, env.get("PYTHONPATH")) if x)


def planned_bytes(df: DataFrame) -> int:
    """The planner's guess at the bytes of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
