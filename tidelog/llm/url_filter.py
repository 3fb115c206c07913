"""URL filters with dated lists.

A list says, for a host or a domain with all below it, what holds from a day on: `block`, `allow` or `drop` (the
entry ends). Each entry becomes a validity interval, up to the next entry of the same value. A capture asks for its
host and all domains above it; the as-of join keeps, for each, the interval that holds on the day of the fetch. Of
the entries that are active then, the longest value decides; without any the capture is kept.

Both sides are dealt by the value and the captures' side is the one that is large for a hot domain, so Spark's own
adaptive skew join can split it; neither side is broadcast unless its size is under Spark's threshold.

Defined results
---------------
- null, empty or malformed url: host null, no active entry, kept.
- null day of a capture: no entry is active, kept. null value or day in the list: the entry is ignored.
- ties in the list (same value and day): `allow` wins over `block`, and both over `drop`.
- repeated captures: one result for each row. Empty captures: no rows; empty list: all kept.
- very long urls and html: the html isn't read; the host is matched as a whole. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("allow", "block", "drop")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    raw = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)", 1))
    raw = F.regexp_replace(raw, r"\.$", "")
    return F.when(raw != "", raw)


def suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(value, action, valid_from, valid_to) from dated entries (value, action, day); valid_to is null for the last."""
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    clean = entries.select(F.lower("value").alias("value"), "action", F.col("day").alias("valid_from")).where(F.col("value").isNotNull() & F.col("valid_from").isNotNull() & F.col("action").isin(*ACTIONS))
    one = clean.groupBy("value", "valid_from").agg(F.min_by("action", rank).alias("action"))
    w = Window.partitionBy("value").orderBy("valid_from")
    return one.select("value", "action", "valid_from", F.lead("valid_from").over(w).alias("valid_to")).where("action <> 'drop'")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """id, host, day, n_active, entry, action, kept: every capture against the entries that held when it was fetched."""
    c = captures.select(F.monotonically_increasing_id().alias("row"), captures[id_col].alias(id_col), host_of(captures[url_col].cast("string")).alias("host"), captures[day_col].alias("day"))
    asked = c.select("*", F.explode_outer(suffixes(F.col("host"))).alias("ask"))
    lists = intervals(entries)
    held = (F.col("ask") == F.col("value")) & (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    met = asked.join(lists, held, "left")
    out = met.groupBy("row", id_col, "host", "day").agg(F.count("value").alias("n_active"), F.max_by("value", F.length("value")).alias("entry"), F.max_by("action", F.length("value")).alias("action"))
    return out.drop("row").withColumn("kept", F.coalesce(F.col("action") != "block", F.lit(True)))
