"""Schemas, key order and scalar expressions of the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = "P", "D"
#: Codes of the write types on disk, and the layout of one 17-byte record.
WRITE_CODES = {PUT: 1, DELETE: 2}
RECORD = [("user_key", "<i4"), ("seq_num", "<u8"), ("write_type", "u1"), ("user_val", "<i4")]
RECORD_BYTES = 17

CHANGELOG = T.StructType(
    [
        T.StructField("user_key", T.IntegerType(), False),
        T.StructField("seq_num", T.LongType(), False),
        T.StructField("write_type", T.StringType(), False),
        T.StructField("user_val", T.IntegerType(), True),
    ]
)
ENTRY = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("val", T.IntegerType())])


def key_order(key: str = "user_key", seq: str = "seq_num") -> list[Column]:
    """The order of the log: smaller keys first, of one key the newest version first."""
    return [F.col(key).asc(), F.col(seq).desc()]


def parse_int32(token: Column) -> Column:
    """An int from decimal digits with an optional sign; null for anything else or out of range."""
    return F.when(token.rlike(r"^[+-]?[0-9]+$"), token.try_cast("int"))


def bloom_positions(key: Column, bits: int = 10_000, hashes: int = 7) -> Column:
    """Positions of a key in a Bloom filter, by double hashing."""
    a, b = F.xxhash64(key), F.hash(key).cast("bigint")
    return F.array(*[F.pmod(a % bits + F.lit(i) * (b % bits), F.lit(bits)).cast("int") for i in range(hashes)])


def overlaps(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """Whether two closed key intervals meet."""
    return (lo <= other_hi) & (hi >= other_lo)


def validate(log: DataFrame, key: str = "user_key", seq: str = "seq_num") -> DataFrame:
    """Rows that break the log's contract: null key or seq, unknown write type, or a seq that occurs twice."""
    twice = log.groupBy(seq).agg(F.count("*").alias("n")).where("n > 1").select(seq)
    named = log.where(F.col(key).isNull() | F.col(seq).isNull() | ~F.coalesce(F.col("write_type").isin(PUT, DELETE), F.lit(False)))
    return named.select(key, seq, F.lit("null or unknown").alias("problem")).unionByName(log.join(twice, seq, "left_semi").select(key, seq, F.lit("seq not unique").alias("problem")))
