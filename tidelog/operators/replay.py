"""Replay of a whole workload without running it in order.

A workload is (pos, op, a, b). What a get or delete at pos sees is the last write of its key before pos; a range
sees the versions whose validity interval holds pos. Both are joins over the log that the workload's own puts and
deletes make.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reads import in_ranges


def _seen(w: DataFrame) -> DataFrame:
    """Gets, deletes and puts with the last write of their key before them."""
    write = F.when(F.col("op").isin("p", "d"), F.struct("op", "b"))
    before = Window.partitionBy("a").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    d = w.where(F.col("op").isin("p", "g", "d")).withColumn("_last", F.last(write, ignorenulls=True).over(before))
    return d.withColumn("found", F.coalesce(F.col("_last.op") == "p", F.lit(False))).withColumn("val", F.when(F.col("found"), F.col("_last.b"))).drop("_last")


def replay_gets(w: DataFrame) -> DataFrame:
    """pos, key, found, val of every get."""
    return _seen(w).where("op = 'g'").select("pos", F.col("a").alias("key"), "found", "val")


def replay_deletes(w: DataFrame) -> DataFrame:
    """pos, key, succeeded of every delete: whether the key was there."""
    return _seen(w).where("op = 'd'").select("pos", F.col("a").alias("key"), F.col("found").alias("succeeded"))


def replay_ranges(w: DataFrame) -> DataFrame:
    """pos, a, b, n_entries and entries ("k:v k:v", ascending) of every range, empty ones too."""
    writes = w.where(F.col("op").isin("p", "d")).select(F.col("a").alias("key"), "pos", "op", F.col("b").alias("val"))
    spans = writes.select("key", "val", "op", F.col("pos").alias("vfrom"), F.lead("pos").over(Window.partitionBy("key").orderBy("pos")).alias("vto")).where("op = 'p'").drop("op")
    asked = w.where("op = 'r'").select("pos", "a", "b")
    met = in_ranges(spans, "key", asked, "a", "b", (F.col("vfrom") < F.col("pos")) & (F.col("vto").isNull() | (F.col("pos") < F.col("vto"))))
    hits = met.groupBy("pos").agg(F.count("*").alias("n_entries"), F.array_sort(F.collect_list(F.struct("key", "val"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["key"].cast("string"), x["val"].cast("string"))), " ")
    out = asked.join(hits.select("pos", "n_entries", text.alias("entries")), "pos", "left")
    return out.withColumn("n_entries", F.coalesce("n_entries", F.lit(0).cast("bigint"))).withColumn("entries", F.coalesce("entries", F.lit("")))


def workload_stats(w: DataFrame) -> DataFrame:
    """One row of counters; loaded pairs should stand in w as puts."""
    rest = w.where(F.col("op").isin("r", "l")).select("op", F.lit(None).cast("boolean").alias("found"))
    seen = _seen(w).select("op", "found").unionByName(rest)
    count = lambda op, *more: F.count_if((F.col("op") == op) if not more else (F.col("op") == op) & more[0])
    found = F.col("found")
    return seen.agg(
        count("p").alias("puts"),
        count("g", found).alias("successful_gets"),
        count("g", ~found).alias("failed_gets"),
        count("d", found).alias("successful_deletes"),
        count("d", ~found).alias("failed_deletes"),
        count("r").alias("ranges"),
        count("l").alias("loads"),
    )


def expand_loads(w: DataFrame, pairs: DataFrame) -> DataFrame:
    """w with each load followed by the puts of its file (file, pos, key, val), all positions dense again."""
    from tidelog.functions.ranks import with_rank

    base = w.select(F.col("pos").alias("_p"), F.lit(-1).cast("bigint").alias("_q"), "op", "a", "b", "file")
    name = F.element_at(F.split("file", "/"), -1)
    put = w.where("op = 'l'").select("pos", F.element_at(F.split("file", "/"), -1).alias("_name"))
    puts = pairs.withColumnRenamed("pos", "_q").withColumn("_name", name).drop("file").join(put, "_name").select(F.col("pos").alias("_p"), "_q", F.lit("p").alias("op"), F.col("key").alias("a"), F.col("val").alias("b"), F.lit(None).cast("string").alias("file"))
    return with_rank(base.unionByName(puts), [F.col("_p"), F.col("_q")], "pos").select("pos", "op", "a", "b", "file")
