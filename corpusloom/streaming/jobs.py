"""Structured Streaming: job events folded into current states, and documents indexed as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.relational import latest


def latest_states(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, key: str, at: str) -> None:
    """Read landed event files as a stream and keep each key's newest row in ``out``; runs until what is there is read.

    Each micro-batch first reduces itself, so a busy key costs one row a batch; batches are written under their own
    number, so a repeated batch replaces itself, and readers take the newest of the few rows a key has.
    """

    def fold(batch: DataFrame, number: int) -> None:
        latest(batch, [key], F.desc(at)).drop("rn").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(path)
    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_states(spark: SparkSession, out: str, key: str, at: str) -> DataFrame:
    return latest(spark.read.parquet(out), [key], F.desc(at)).drop("rn", "batch")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by time window and type; works on streams (with a watermark) and on tables."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
