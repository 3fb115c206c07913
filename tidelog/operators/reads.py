"""Reads of a change log. All are one reduction: the newest version of each key before a sequence number, then
deleted keys dropped. Deletes are dropped after the reduction, never before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.keys import DELETE, key_order

META = ("user_key", "seq_num", "write_type")


def _values(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in META]


def newest(log: DataFrame, as_of: int | Column | None = None) -> DataFrame:
    """The newest version of each key, deletes included.

    An aggregate with a partial step before the exchange, whatever the values' types: a key with very many versions is
    reduced where they lie.
    """
    if as_of is not None:
        log = log.where(F.col("seq_num") < as_of)
    values = _values(log)
    plain = all(t not in ("string", "binary") and "<" not in t for c, t in log.dtypes if c in values)
    if len(values) <= 2 and plain:  # plain columns keep it a hash aggregation
        deleted = F.max_by(F.col("write_type") == DELETE, "seq_num").alias("_deleted")
        d = log.groupBy("user_key").agg(F.max("seq_num").alias("seq_num"), deleted, *[F.max_by(v, "seq_num").alias(v) for v in values])
        return d.withColumn("write_type", F.when(F.col("_deleted"), DELETE).otherwise("P")).select(*log.columns)
    last = F.max_by(F.struct("seq_num", "write_type", *values), "seq_num").alias("_last")
    return log.groupBy("user_key").agg(last).select("user_key", "_last.*").select(*log.columns)


def snapshot(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """user_key, seq_num and values of every visible key."""
    return newest(log, as_of).where(F.col("write_type") != DELETE).drop("write_type")


def get(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """The visible entry of one key: one row, or none."""
    return snapshot(log.where(F.col("user_key") == F.lit(key)), as_of)


def multi_get(log: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """Every row of probes with the values of its key, null where the key isn't visible.

    The log is cut to the asked keys before it is reduced; Spark picks a broadcast only under its size threshold.
    """
    asked = probes.select(F.col(key).alias("user_key")).distinct()
    seen = snapshot(log.join(asked, "user_key", "left_semi"))
    return probes.join(seen.withColumnRenamed("user_key", key), key, "left")


def range_scan(log: DataFrame, a, b=None, as_of: int | None = None) -> DataFrame:
    """Visible entries with a <= key < b in key order; without b there is no upper end."""
    inside = F.col("user_key") >= F.lit(a)
    if b is not None:
        inside &= F.col("user_key") < F.lit(b)
    return snapshot(log.where(inside), as_of).orderBy("user_key")


def versions(log: DataFrame) -> DataFrame:
    """log plus valid_to: the sequence number from which a newer version holds, null for the newest."""
    return log.withColumn("valid_to", F.lead("seq_num").over(Window.partitionBy("user_key").orderBy("seq_num")))


def ordered(log: DataFrame) -> DataFrame:
    return log.orderBy(*key_order())


LEVEL_BITS = 4
LEVELS = 8


def bucket_pieces(ranges: DataFrame, a: str, b: str) -> DataFrame:
    """ranges, once for each bucket that it touches at its level: at most 17 buckets whatever its width."""
    width = F.greatest(F.col(b).cast("bigint") - F.col(a).cast("bigint"), F.lit(1).cast("bigint"))
    level: Column = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        level = F.when(width <= 1 << (LEVEL_BITS * (k + 1)), k).otherwise(level)
    d = ranges.where(F.col(a) < F.col(b)).withColumn("_level", level)
    at = lambda c: F.floor(c.cast("bigint") / F.pow(F.lit(2.0), F.col("_level") * LEVEL_BITS)).cast("bigint")
    return d.withColumn("_bucket", F.explode(F.sequence(at(F.col(a)), at(F.col(b).cast("bigint") - 1))))


def in_ranges(rows: DataFrame, key: str, ranges: DataFrame, a: str, b: str, more: Column | None = None) -> DataFrame:
    """Inner join of rows with the half-open ranges that hold their key, by an equi-join on buckets."""
    pieces = bucket_pieces(ranges, a, b)
    at = lambda k: F.floor(F.col(key).cast("bigint") / (1 << (LEVEL_BITS * k))).cast("bigint")
    keyed = rows.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), at(k).alias("_bucket")) for k in range(LEVELS + 1)]))).select(*rows.columns, "_at.*")
    # Rows go only to the levels that ranges have pieces on; there are LEVELS + 1 at most.
    keyed = keyed.join(F.broadcast(pieces.select("_level").distinct()), "_level", "left_semi")
    met = keyed.join(pieces, ["_level", "_bucket"]).where((F.col(key) >= F.col(a)) & (F.col(key) < F.col(b)))
    return (met.where(more) if more is not None else met).drop("_level", "_bucket")


def multi_range(log: DataFrame, ranges: DataFrame, id_col: str = "range_id", a: str = "a", b: str = "b") -> DataFrame:
    """id, user_key and values of all visible entries inside each range."""
    met = in_ranges(snapshot(log), "user_key", ranges.select(id_col, a, b), a, b)
    return met.select(id_col, "user_key", *_values(log))
