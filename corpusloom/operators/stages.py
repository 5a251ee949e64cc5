"""Tables that a plan computes once and several later steps read."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; only a local master may leave that unset and gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_corpusloom_stages", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark._corpusloom_stages = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df computed now, by checkpoint() into the shared folder: what reads it doesn't compute it again, and lost executors don't matter."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Spark's own setting: a query's shuffle files are removed when it ends; lost ones are made again by stage retries.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What is written or stored inside leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)
