"""Adapters: any table with a key and a unique order becomes a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import DELETE, PUT


def change_log(df: DataFrame, key: str, seq: str, deleted: Column, *values: str) -> DataFrame:
    """(user_key, seq_num, write_type, values...); one value column is called user_val."""
    named = [df[v].alias("user_val" if len(values) == 1 else v) for v in values]
    return df.select(df[key].alias("user_key"), df[seq].alias("seq_num"), F.when(deleted, DELETE).otherwise(PUT).alias("write_type"), *named)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    return change_log(d, "user_id", "event_id", d["event_type"].eqNullSafe("error"), "value")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return change_log(d, "o_custkey", "o_orderkey", d["o_orderstatus"].eqNullSafe("F"), "o_totalprice")


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as versions of their conversation: an empty text deletes it."""
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return change_log(d, "conv_id", "turn", F.coalesce(d["text"], F.lit("")) == "", "role", "text")
