"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target text (labelled good) and one of raw text (all
documents), give each document the logarithm of its importance weight: the sum, over its n-grams as often as they
occur, of the log ratio of their rates. The documents are sampled by Gumbel top-k: each gets its log weight plus
standard Gumbel noise drawn from its id, and the k largest stay. k is a share of all documents: `share`, or that of the
good ones among the labelled ones and SPARE more.

The rates are smoothed by SMOOTHING occurrences in both models. A document isn't judged by itself: what it has added to
the models is taken off before its ratios are formed, so an n-gram that nobody else has tells nothing, and being labelled
is no merit. Ratios within Z standard errors of chance count as even, so a long clean document doesn't sum up thousands
of small deviations.

The raw model counts every document; the target model counts at most `most_labels` labelled documents, taken in the
order of a hash of their id (a bound, so that their ids can be broadcast). A model is an array of 2**BUCKET_BITS
counts; tasks send theirs in compressed blocks, which are added up in two steps.

Defined results
---------------
- null or empty text: no n-grams, log weight 0, sampled like any other document.
- null doc_id: noise 0. A label with a null counts as not good.
- ties and repeated rows: the same id and text has the same key; all at or above the k-th key stay.
- very long texts: whole. No labels: every weight is 0 and all documents stay. Empty table: no rows. Extra columns are
  not looked at, and `keep_good` returns them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batch_of, mix, passes, small_batches, stored, text_of

BUCKET_BITS = 20
#: Word n-grams used: words and pairs.
ORDERS = (1, 2)
MOST_LABELS = 200_000
Z = 2.5
SMOOTHING = 1.0
SPARE = 0.015
#: Buckets of one block, and first steps in which a block's counts are added up.
BLOCK, STEPS = 1 << 14, 1024


def features(texts: pa.Array, orders: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, bucket, count): the buckets of each text and how often they occur, per pass."""
    for i, j, data, offs in passes(texts):
        w = Words(data, offs)
        of = np.repeat(np.arange(j - i), np.diff(w.first))
        keys = []
        for n in orders:
            at = np.arange(max(0, len(w) - n + 1))
            at = at[of[at] == of[at + n - 1]]
            h = mix(w.hashes(at, n), n) >> np.uint64(64 - BUCKET_BITS)
            keys.append((of[at].astype(np.uint64) << np.uint64(BUCKET_BITS)) | h)
        k, count = np.unique(np.concatenate(keys), return_counts=True)
        yield i, j, (k >> np.uint64(BUCKET_BITS)).astype(np.int64), (k & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64), count


def is_in(ids: pa.Array, known: np.ndarray) -> np.ndarray:
    """Which ids are among the known ones (ascending)."""
    x = ids.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
    return ids.is_valid().to_numpy(zero_copy_only=False) & (known[at] == x if len(known) else np.zeros(len(x), bool))


@dataclass
class Model:
    """Counts by bucket of raw and target text, the ids of the target documents, and the key from which rows stay."""

    raw: np.ndarray
    target: np.ndarray
    good: np.ndarray
    orders: tuple[int, ...]
    cut: float = -np.inf

    def log_weights(self, ids: pa.Array, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.good) or not self.target.any():
            return out
        own = is_in(ids, self.good)
        share = self.target.sum() / self.raw.sum()
        for i, j, row, bucket, count in features(texts, self.orders):
            target = self.target[bucket] - count * own[i:j][row]
            expected = share * (self.raw[bucket] - count)
            ratio = np.log((target + SMOOTHING) / (expected + SMOOTHING))
            ratio[np.abs(target - expected) <= Z * np.sqrt(expected + 1)] = 0
            out[i:j] = np.bincount(row, ratio * count, j - i)
        return out

    def keys(self, ids: pa.Array, weights: np.ndarray) -> np.ndarray:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        u = (mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64), 0x6A09E667) >> np.uint64(11)).astype(float)
        noise = -np.log(-np.log((u + 0.5) / 2.0**53))
        return weights + np.where(known, noise, 0.0)


COUNTS = "block int, step int, data binary"


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts, "<i8").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8").reshape(2, -1)


def counts(docs: DataFrame, good: np.ndarray, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all documents, and in the good ones (ids, ascending)."""
    known = docs.sparkSession.sparkContext.broadcast(good)
    schema = pa.schema([("block", pa.int32()), ("step", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        step = TaskContext.get().partitionId() % STEPS
        both = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for b in batches:
            own = is_in(b.column(0), known.value)
            for i, j, row, bucket, count in features(b.column(1), orders):
                both[0] += np.bincount(bucket, count, both.shape[1]).astype(np.int64)
                mine = own[i:j][row]
                if mine.any():
                    both[1] += np.bincount(bucket[mine], count[mine], both.shape[1]).astype(np.int64)
        for k in range(0, both.shape[1], BLOCK):
            if both[0, k : k + BLOCK].any():
                yield batch_of(schema, [k // BLOCK], [step], [_packed(both[:, k : k + BLOCK])])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros((2, min(BLOCK, 1 << BUCKET_BITS)), np.int64)
        for x in t.column("data"):
            total += _unpacked(x.as_py())
        return pa.Table.from_batches([batch_of(schema, [t.column("block")[0].as_py()], [0], [_packed(total)])])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    sums = rows.mapInArrow(run, COUNTS).groupBy("block", "step").applyInArrow(add, COUNTS).groupBy("block").applyInArrow(add, COUNTS)
    both = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    t = sums.toArrow()  # 2**BUCKET_BITS buckets at most, whatever the corpus
    for k, x in zip(t.column("block").to_pylist(), t.column("data"), strict=True):
        both[:, k * BLOCK : (k + 1) * BLOCK] = _unpacked(x.as_py())
    return both[0], both[1]


def fit(docs: DataFrame, labels: DataFrame, orders: tuple[int, ...] = ORDERS, most_labels: int = MOST_LABELS) -> Model:
    wanted = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    good = np.sort(wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).toArrow().column(0).to_numpy())
    return Model(*counts(docs, good, orders), good, orders)


def good_share(labels: DataFrame) -> float:
    """The share of good ones among the labelled documents, and SPARE more; 1 without labels."""
    good, n = labels.where("doc_id is not null").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)), F.count("*")).first()
    return min(1.0, good / n + SPARE) if good else 1.0


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, log_weight, sample_key."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("sample_key", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.log_weights(b.column(0), b.column(1))
            yield batch_of(schema, b.column(0), s, shared.value.keys(b.column(0), s))

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id bigint, log_weight double, sample_key double")


def kth_largest(keys: DataFrame, col: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, exactly, by counting in ever narrower bins; only counts and one small bin reach the driver."""
    lo, hi = keys.agg(F.min(col), F.max(col)).first()
    if lo is None or k <= 0:
        return float("inf")
    rest = keys.select(F.col(col).alias("x"))
    above = 0
    while True:
        inside = rest.where((F.col("x") >= lo) & (F.col("x") <= hi))
        if lo == hi:
            return lo
        step = (hi - lo) / bins
        n = dict(inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / step)).alias("b")).count().collect())
        for b in sorted(n, reverse=True):
            if above + n[b] >= k:
                break
            above += n[b]
        edge = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / step)) == b
        if n[b] <= 10_000:
            return sorted((r[0] for r in inside.where(edge).collect()), reverse=True)[k - above - 1]
        new = inside.where(edge).agg(F.min("x"), F.max("x")).first()
        if (new[0], new[1]) == (lo, hi):
            return lo
        lo, hi = new


def classify(docs: DataFrame, labels: DataFrame, share: float | None = None, orders: tuple[int, ...] = ORDERS) -> tuple[DataFrame, Model]:
    """Scores of all rows, stored, and the fitted model with the key from which rows stay."""
    model = fit(docs, labels, orders)
    s = stored(scores(docs, model), "quality-scores")
    k = math.ceil(s.count() * (good_share(labels) if share is None else share))
    model.cut = kth_largest(s, "sample_key", k)
    return s, model


def report(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, sample_key, kept: one row for each row of docs."""
    s, model = classify(docs, labels, share)
    return s.withColumn("kept", F.col("sample_key") >= F.lit(model.cut))


def keep_good(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The rows of docs that are sampled, with the columns of docs; scored again in passing, so no text is shuffled."""
    small_batches(docs.sparkSession)
    _, model = classify(docs, labels, share)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(at).cast(pa.int64())
            s = shared.value.log_weights(ids, b.column(text).cast(pa.string()).fill_null(""))
            yield b.filter(pa.array(shared.value.keys(ids, s) >= shared.value.cut))

    return docs.mapInArrow(run, docs.schema)
