"""Exact duplicate removal in two Bloom passes, with DataFrame functions only.

Pass 1 turns each text's hash into a cell of a wide table of WIDE cells a row, which grows with the input and lives in
the exchange, as rows, and keeps the cells that two rows have hit. They and nothing else make the dense bit table of
pass 2, with HASHES bits for each. Pass 2 looks every row up in it: a row with a bit that is not set can have no copy
and goes straight through. Only the others are grouped, by the full SHA-256 of the normalised text; they carry their id
and hash, never the text.

The dense table is sized by the repeated texts, not by the rows, and has a bound as it is broadcast (`max_cells`, a
power of two; 2**26 cells are 8 MiB). Beyond about 4 million different repeated texts it fills up and lets more rows
through to the grouping, which stays exact.

Defined results
---------------
- null text: the empty text; all empty and null texts are one group.
- null doc_id: never the largest; a group with only null ids keeps the rows with a null id.
- repeated rows (the same doc_id and text): all of them are the row that stays, and count in group_size.
- empty table: no rows.
- the same doc_id (or none) with different texts: each row is judged by its own text.
- Columns of the input that clash with result names don't matter: the report has only its own columns, and
  `drop_copies` returns the input's columns as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, text_of

#: Cells of the wide table a row: about one row in WIDE that has no copy is taken for one that may.
WIDE = 256
#: Bits of the dense table that a repeated cell sets, and its cells for each.
HASHES = 2
CELLS_PER_REPEAT = 16
MAX_CELLS = 1 << 26


def _hash_of(docs: DataFrame, text_col: str) -> Column:
    return F.sha2(ascii_lower(text_of(docs, text_col)).cast("binary"), 256)


def _power(n: int) -> int:
    return 1 << max(12, math.ceil(math.log2(max(1, n))))


def _wide(key: Column, wide: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(wide))


def _bits(repeated: DataFrame, cells: int) -> DataFrame:
    """One row: the words of the dense table, 64 cells each, for the wide cells that two rows have hit."""
    places = F.array(*[F.pmod(F.xxhash64("cell", F.lit(i)), F.lit(cells)) for i in range(HASHES)])
    hit = repeated.select(F.explode(places).alias("cell"))
    words = hit.groupBy(F.expr("cell div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("m"))
    # Every 4096 words make one page, so that the last step joins few rows.
    spark = repeated.sparkSession
    full = words.unionByName(spark.range(cells // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("m")))
    full = full.groupBy("w").agg(F.expr("bit_or(m)").alias("m"))
    pages = full.groupBy(F.expr("w div 4096").alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("ms"))
    return pages.groupBy().agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "ms"))), lambda x: x["ms"])).alias("bits"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each input row."""
    rows = docs.select(docs[id_col].alias("doc_id"), _hash_of(docs, text_col).alias("key"))
    rows = stored(rows, "exact-keys")  # texts are read and hashed once; all that follows works on ids and hashes
    wide = _power(rows.count() * WIDE)
    hit = rows.groupBy(_wide(F.col("key"), wide).alias("cell")).agg(F.count("*").alias("n"))
    repeated = stored(hit.where("n > 1").select("cell"), "exact-repeated")
    cells = min(max_cells, _power(repeated.count() * CELLS_PER_REPEAT))
    bits = stored(_bits(repeated, cells), "exact-bits")
    spark = docs.sparkSession
    rows.createOrReplaceTempView(rv := f"_rows_{id(rows)}")
    bits.createOrReplaceTempView(bv := f"_bits_{id(bits)}")
    places = [f"pmod(xxhash64(cell, {i}), {cells})" for i in range(HASHES)]
    test = " and ".join(f"(shiftright(element_at((select bits from {bv}), cast({p} div 64 as int) + 1), cast({p} % 64 as int)) & 1) = 1" for p in places)
    marked = spark.sql(f"select doc_id, key, ({test}) as maybe from (select doc_id, key, pmod(xxhash64(key), {wide}) as cell from {rv})")
    spark.catalog.dropTempView(rv)
    spark.catalog.dropTempView(bv)
    alone = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("key").alias("text_sha256"))
    some = marked.where("maybe").select("doc_id", "key")
    # Stored, so that the join reads both sides from plain exchanges and a hot group's side can be split.
    groups = stored(some.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")
    shared = some.join(groups, "key").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("key").alias("text_sha256"))
    return alone.unionByName(shared)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs. Only ids and hashes of dropped rows meet the documents; an id
    alone doesn't tell a row, as it can be null or stand for several texts."""
    gone = report(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_hash")).distinct()
    own = "_own"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    hashed = docs.select(*[docs[c] for c in docs.columns], _hash_of(docs, text_col).alias(own))
    met = hashed.join(gone, hashed[id_col].eqNullSafe(gone["_gone"]) & (hashed[own] == gone["_hash"]), "left_anti")
    return met.select(*[hashed[c] for c in docs.columns])
