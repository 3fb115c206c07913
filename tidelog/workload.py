"""Seeded workloads as relations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.ranks import with_rank, with_running_sum
from tidelog.sources.binary import pair_bytes

SIGMA = (2**31 - 1) / 3


@dataclass(frozen=True)
class Workload:
    puts: int
    gets: int = 0
    ranges: int = 0
    deletes: int = 0
    #: Share of gets for keys that were drawn anew, and share of gets that repeat an earlier one.
    misses: float = 0.5
    skew: float = 0.0
    seed: int = 13141
    gaussian_ranges: bool = False
    external_puts: bool = False

    def __post_init__(self):
        if self.puts < 1:
            raise ValueError("a workload needs puts")


def generate(spark: SparkSession, w: Workload) -> DataFrame:
    """(pos, op, a, b), a random mixture of the commands whose first is a put.

    Gets and deletes take the key of a put that stands before them, drawn uniformly; a miss draws a key of its own, and a
    repeated get takes the key of one before it. All numbers come from hashes of a command's kind and number, so the
    workload is the same whatever its partitions.
    """
    parts = [spark.range(n).select(F.lit(op).alias("op"), "id") for op, n in (("p", w.puts), ("g", w.gets), ("r", w.ranges), ("d", w.deletes))]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    drawn = lambda k: (F.pmod(F.xxhash64("op", "id", F.lit(w.seed), F.lit(k)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    key = lambda k: (F.floor(drawn(k) * (1 << 32)) - (1 << 31)).cast("int")
    lead = F.when((F.col("op") == "p") & (F.col("id") == 0), 0).otherwise(1)
    order = [lead, F.xxhash64("op", "id", F.lit(w.seed)), F.col("op"), F.col("id")]
    d = with_rank(all_, order, "pos")
    # How many puts and gets stand up to each command.
    counted = F.when(F.col("op") == "p", F.lit(1 << 32)).when(F.col("op") == "g", 1).otherwise(0).cast("bigint")
    d = with_running_sum(d.withColumn("_c", counted), [F.col("pos")], "_c", "_s")
    d = d.select("op", "id", "pos", F.expr("_s div 4294967296").alias("puts"), F.expr("_s % 4294967296").alias("gets"))
    puts = d.where("op = 'p'").select((F.col("puts") - 1).alias("n"), "pos", key(0).alias("a"), key(1).alias("b"))
    by_put = d.where("op in ('g', 'd')").withColumn("n", F.floor(drawn(2) * F.col("puts")).cast("bigint")).join(puts.select("n", F.col("a").alias("held")), "n")
    gets = by_put.where("op = 'g'").select("op", "id", "pos", "gets", F.when(drawn(3) < w.misses, key(4)).otherwise(F.col("held")).alias("a"))
    again = gets.withColumn("of", F.when((drawn(5) < w.skew) & (F.col("gets") > 1), F.floor(drawn(6) * (F.col("gets") - 1)).cast("bigint")))
    first = gets.select((F.col("gets") - 1).alias("of"), F.col("a").alias("old"))
    gets = again.join(first, "of", "left").select("pos", F.coalesce("old", "a").alias("a"))
    normal = lambda k: F.greatest(F.lit(-(2.0**31)), F.least(F.lit(2.0**31 - 1), F.sqrt(-2 * F.log(drawn(k))) * F.cos(2 * math.pi * drawn(k + 1)) * SIGMA)).cast("int")
    x, y = (normal(8), normal(10)) if w.gaussian_ranges else (key(8), key(10))
    none = F.lit(None).cast("int").alias("b")
    out = puts.select("pos", F.lit("p").alias("op"), "a", "b")
    out = out.unionByName(gets.select("pos", F.lit("g").alias("op"), "a", none))
    out = out.unionByName(d.where("op = 'r'").select("pos", "op", F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))
    return out.unionByName(by_put.where("op = 'd'").select("pos", "op", F.col("held").alias("a"), none))


def lines(w: DataFrame) -> DataFrame:
    """The commands as text."""
    file = [F.concat(F.lit('"'), F.col("file"), F.lit('"'))] if "file" in w.columns else []
    return w.select("pos", F.concat_ws(" ", "op", F.col("a").cast("string"), F.col("b").cast("string"), *file).alias("line"))


def put_blocks(w: DataFrame) -> DataFrame:
    """w (with dense positions) plus block: consecutive puts share a number, other commands have none; each block can
    be an external file."""
    puts = w.where("op = 'p'").select("pos")
    first = puts.join(puts.select((F.col("pos") + 1).alias("pos")), "pos", "left_anti").withColumn("_new", F.lit(1))
    d = w.join(first, "pos", "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    d = with_running_sum(d, [F.col("pos")], "_new", "_sum")
    return d.select(*w.columns, F.when(F.col("op") == "p", F.col("_sum") - 1).alias("block"))


def externalize(w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commands, files): each block of puts as one load, and the files (file, content) that the loads name."""
    d = put_blocks(w)
    name = F.concat(F.col("block").cast("string"), F.lit(".dat"))
    files = pair_bytes(d.where("op = 'p'"), "block", "pos", "a", "b").select(name.alias("file"), "content")
    none = F.lit(None)
    loads = d.where("op = 'p'").groupBy("block").agg(F.min("pos").alias("pos")).select("pos", F.lit("l").alias("op"), none.cast("int").alias("a"), none.cast("int").alias("b"), name.alias("file"))
    return d.where("op <> 'p'").select("pos", "op", "a", "b", none.cast("string").alias("file")).unionByName(loads), files


def describe(w: Workload) -> str:
    return "\n".join(f"{k:16} {v}" for k, v in vars(w).items())
