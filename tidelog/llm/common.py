"""Shared pieces of the training-data operators: scratch tables, Arrow text batches, word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.scratch import stored  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes of text that one numpy pass takes at once; a longer text is taken alone.
PASS_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts reach Python in batches of about this size, not of ten thousand rows whatever their length.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def small_batches(spark: SparkSession) -> None:
    """Bounds what an executor holds of a text column on its way to Python, unless the session has a smaller bound."""
    now = spark.conf.get(BATCH[0], None)
    if now is None or int(str(now).rstrip("b") if str(now).rstrip("b").isdigit() else 1 << 40) > 4 << 20:
        spark.conf.set(*BATCH)


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def text_of(df: DataFrame, col: str = "text") -> Column:
    """A text column without nulls."""
    small_batches(df.sparkSession)
    return F.coalesce(df[col].cast("string"), F.lit(""))


def map_texts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column without nulls."""
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if offs is not None else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o


def passes(column: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets from 0) of about `most` bytes."""
    if not len(column):
        return
    data, offs = string_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


_MULT = np.uint64(0x9E3779B97F4A7C55)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n).bit_length()
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for k, base in enumerate((_MULT, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ np.uint64(salt)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def lookup(chars: Iterable[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: Bytes that end a word: space, and tab to carriage return.
BLANK = lookup([0x20, *range(0x09, 0x0E)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Words:
    """Words of several texts: lower-cased A-Z, split at BLANK; any run of words can be hashed in one step.

    first: index of each text's first word, and the number of words at the end.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = BLANK):
        inside = ~breaks[data]
        n = len(data)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        before[heads] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[heads[heads > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(starts, offs)
        self.starts, self.ends = starts, ends
        lengths = ends - starts
        self.at = np.cumsum(lengths + 1) - (lengths + 1)
        self.lengths = lengths
        total = int((lengths + 1).sum())
        line = np.full(total, 32, np.uint8)
        keep = np.ones(total, bool)
        keep[self.at + lengths] = False
        line[keep] = FOLD[data[inside]]
        self.line = line
        up, self._down = _powers(total + 1)
        self._sums = np.zeros(total + 1, np.uint64)
        np.cumsum((line.astype(np.uint64) + np.uint64(1)) * up[:total], out=self._sums[1:])

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, first: np.ndarray, count: int | np.ndarray) -> np.ndarray:
        """Hash of `count` words from each index in `first`, joined by single spaces."""
        a = self.at[first]
        last = first + count - 1
        b = self.at[last] + self.lengths[last]
        return mix((self._sums[b] - self._sums[a]) * self._down[a], 0x51ED270B0A1B2C3D) + (b - a).astype(np.uint64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside a text, in order, and where each text's begin.

        A text with fewer words than k has one: all its words. Without words it has none.
        """
        words = np.diff(self.first)
        per = np.where(words >= k, words - k + 1, np.minimum(words, 1))
        heads = np.concatenate([[0], np.cumsum(per)])
        first = np.arange(heads[-1]) + np.repeat(self.first[:-1] - heads[:-1], per)
        count = np.repeat(np.minimum(words, k), per)
        return (self.hashes(first, count) if len(first) else np.zeros(0, np.uint64)), heads


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def binaries(data: bytes | np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column over one buffer, cut at offs (in bytes)."""
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int32)), pa.py_buffer(data)])


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, start[1] .. and so on, in a row."""
    if not length.all():
        start, length = start[length > 0], length[length > 0]
    step = np.ones(int(length.sum()), np.int64)
    if len(step):
        heads = np.cumsum(length) - length
        step[heads] = start
        step[heads[1:]] -= start[:-1] + length[:-1] - 1
    return np.cumsum(step)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of edges (a, b); a component's id is its smallest node.

    Each round every node points to its smallest neighbour, pointers are followed once more, and the edges are
    contracted to what they point to; the number of rounds grows with the logarithm of the longest path. All steps are
    joins and aggregates, so a node with very many links is never gathered in one place, and each round's tables are
    written to the shared folder.
    """
    now = edges.select("a", "b").where("a <> b")
    labels = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        second = first.select(F.col("a").alias("p"), F.col("p").alias("q"))
        point = stored(first.join(second, "p").select(F.col("a").alias("node"), F.col("q").alias("to")), name)
        if not point.take(1):
            break
        if labels is None:
            labels = point.select("node", F.col("to").alias("component"))
        else:
            moved = point.select(F.col("node").alias("component"), "to")
            labels = stored(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), name)
        x, y = (point.select(F.col("node").alias(c), F.col("to").alias(t)) for c, t in (("a", "x"), ("b", "y")))
        now = stored(now.join(x, "a").join(y, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), name)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
