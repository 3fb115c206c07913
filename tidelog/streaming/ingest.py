"""Streaming ingest of a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import DELETE
from tidelog.plans.store import Store


def snapshot_stream(log: DataFrame, value: str = "user_val") -> DataFrame:
    """The visible keys of a streaming log, for complete or update mode: the state holds one version of each key."""
    d = log.groupBy("user_key").agg(F.max("seq_num").alias("seq_num"), F.max_by(F.col("write_type") == DELETE, "seq_num").alias("deleted"), F.max_by(value, "seq_num").alias(value))
    return d.where("not deleted").drop("deleted")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs all that is available now into an in-memory table; for checks and small results."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def run_to_store(commands: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Streams (pos, op, a, b) into a store, one write-ahead batch for each micro-batch.

    A micro-batch's number is committed with its writes, in one manifest; one that is delivered again is skipped.
    checkpoint names the stream.
    """
    spark: SparkSession = commands.sparkSession

    def add(batch: DataFrame, epoch: int) -> None:
        Store.open(spark, path, **options).apply(batch, (checkpoint, epoch))

    q = commands.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
