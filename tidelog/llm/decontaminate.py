"""Benchmark decontamination by SimHash windows.

Each benchmark item has a 64-bit SimHash of its five-word shingles. A text is looked at through windows with as many
words as the item, at every word; a window's SimHash comes from prefix sums of the shingles' bits. The multi-index
cuts fingerprints into BLOCKS blocks of 8 bits and lists each item under all values within BLOCK_RADIUS of its own:
two fingerprints at most RADIUS apart have a block in which they are that near, so every item within the radius is
found. Candidates are verified by the exact similarity of the weighted shingles (sum of least over sum of greatest
counts), at THRESHOLD or more.

A window in which fewer shingles than the threshold needs occur in any item at all can't pass the verification, so
none is fingerprinted there; this loses nothing and leaves most text after one table lookup per word.

Items are broadcast in blocks of at most ITEM_WORDS words; a larger benchmark takes several passes over the texts.

Defined results
---------------
- Words are lower-cased (A-Z) and split at blank and tab to carriage return. An item or text with fewer than five
  words has one shingle, all its words. A text shorter than an item is one window.
- null or empty text or item: no words, matches nothing. null doc_id: reported as null; such rows stay unless
  they match.
- ties: of equal similarity the first window counts. repeated rows: one match each; repeated items: each reported.
- very long texts: whole. Empty tables: no matches. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batch_of, passes, small_batches, string_buffers, text_of

K = 5
THRESHOLD = 0.75
BITS, BLOCKS, BLOCK_RADIUS = 64, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
ITEM_WORDS = 1 << 20
#: A word, as `Words` splits them.
WORD = r"[^\x20\x09-\x0D]+"

MATCHES = "doc_id bigint, item_id bigint, similarity double, hamming int, first_word bigint, n_words int"


def _bits(h: np.ndarray) -> np.ndarray:
    """One row of 64 bits per hash."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(sums: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash from how many of `count` shingles have each bit."""
    return np.packbits(2 * sums > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of least over sum of greatest counts."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(n[i], m[j]).sum())
    return least / (len(a) + len(b) - least) if len(a) + len(b) else 0.0


class Items:
    """Benchmark items by their number of words, with the multi-index."""

    def __init__(self, ids: list, texts: list[str]):
        data, offs = string_buffers(pa.array(texts, pa.string()))
        w = Words(data, offs)
        shingles, heads = w.shingles(K)
        words = np.diff(w.first)
        keep = [i for i in range(len(ids)) if words[i]]
        self.ids = [ids[i] for i in keep]
        self.words = words[keep] if keep else np.zeros(0, np.int64)
        self.shingles = [shingles[heads[i] : heads[i + 1]] for i in keep]
        self.known = np.unique(shingles)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.known & np.uint64((1 << 20) - 1)] = True
        self.prints = np.array([fingerprints(_bits(s).sum(0, dtype=np.int64)[None], np.array([len(s)]))[0] for s in self.shingles], np.uint64)
        near = np.array([0, *(sum(1 << b for b in c) for r in range(1, BLOCK_RADIUS + 1) for c in combinations(range(BITS // BLOCKS), r))])
        #: By size of the item: a window only looks for items with as many words.
        self.index: dict[int, list[dict[int, list[int]]]] = {}
        for i, p in enumerate(self.prints):
            own = self.index.setdefault(int(self.words[i]), [{} for _ in range(BLOCKS)])
            for k in range(BLOCKS):
                for v in (int(p) >> (8 * k) & 255) ^ near:
                    own[k].setdefault(int(v), []).append(i)
        #: For a text with fewer words than an item the window is the whole text.
        self.sizes = np.unique(self.words)
        long = self.sizes[self.sizes >= K]
        #: Shingles that the smallest item needs in common with a window.
        self.least = THRESHOLD * (int(long[0]) - K + 1) if len(long) else np.inf

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Which hashes some item has."""
        out = self.table[h & np.uint64((1 << 20) - 1)]
        at = np.flatnonzero(out)
        if len(at):
            p = np.searchsorted(self.known, h[at])
            out[at] = self.known[np.minimum(p, len(self.known) - 1)] == h[at]
        return out

    def near(self, print_: int, size: int) -> list[tuple[int, int]]:
        """Items of a size within RADIUS of a fingerprint, with their distances."""
        found = {i for k, block in enumerate(self.index[size]) for i in block.get(print_ >> (8 * k) & 255, ())}
        return [(i, d) for i in sorted(found) if (d := (int(self.prints[i]) ^ print_).bit_count()) <= RADIUS]


def matches_in(h: np.ndarray, hit: np.ndarray, n_words: int, items: Items) -> list[tuple[int, float, int, int, int]]:
    """(item, similarity, distance, first word, words) for one text's shingles, the best window of each item.

    hit: which shingles some item has.
    """
    sums = np.concatenate([[0], np.cumsum(hit)])
    best: dict[int, tuple[float, int, int, int]] = {}
    bits = None
    for size in items.sizes[(items.sizes >= K) & (THRESHOLD * (items.sizes - K + 1) <= sums[-1])].tolist():
        width = min(size - K + 1, len(h))
        starts = np.flatnonzero(sums[width:] - sums[:-width] >= THRESHOLD * (size - K + 1))
        if not len(starts):
            continue
        if bits is None:
            bits = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_bits(h), axis=0, dtype=np.int32)])
        prints = fingerprints(bits[starts + width] - bits[starts], np.full(len(starts), width))
        for s, p in zip(starts.tolist(), prints.tolist(), strict=True):
            for i, d in items.near(p, size):
                x = similarity(h[s : s + width], items.shingles[i])
                if x >= THRESHOLD and (i not in best or x > best[i][0]):
                    best[i] = (x, d, s, min(size, n_words))
    return [(i, *v) for i, v in best.items()]


def short_matches(w: Words, doc: int, items: Items) -> list[tuple[int, float, int, int, int]]:
    """Items with fewer than K words: their words stand in the text, in a row."""
    out = []
    lo, hi = w.first[doc], w.first[doc + 1]
    for size in items.sizes[items.sizes < K]:
        if hi - lo >= size:
            h = w.hashes(np.arange(lo, hi - size + 1), int(size))
            hit = items.hits(h)
            if hit.any():
                for i in np.flatnonzero(items.words == size):
                    at = np.flatnonzero(h == items.shingles[i][0])
                    if len(at):
                        out.append((int(i), 1.0, 0, int(at[0]), int(size)))
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[list]:
    """The items in blocks with a bound of words, each ordered by id; read from the driver one after the other."""
    block, words = [], 0
    items = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), text_of(benchmark).alias("text"))
    for r in items.select("*", F.regexp_count("text", F.lit(WORD)).alias("words")).toLocalIterator():
        n = r["words"]
        if block and words + n > ITEM_WORDS:
            yield block
            block, words = [], 0
        block.append((r["item_id"], r["text"]))
        words += n
    if block:
        yield block


def _matches(own: Items, texts: pa.Array) -> Iterator[tuple[int, tuple]]:
    """(row, match) for every match of the texts."""
    short = bool((own.sizes < K).any())
    for i, _, data, offs in passes(texts):
        w = Words(data, offs)
        h, heads = w.shingles(K)
        n = np.diff(w.first)
        hit = own.hits(h)
        counts = np.concatenate([[0], np.cumsum(hit)])
        enough = (n >= K) & (counts[heads[1:]] - counts[heads[:-1]] >= own.least)
        for d in np.flatnonzero(enough | (short & (n > 0))).tolist():
            lo, hi = heads[d], heads[d + 1]
            got = matches_in(h[lo:hi], hit[lo:hi], int(n[d]), own) if enough[d] else []
            got += short_matches(w, d, own) if short else []
            for m in got:
                yield i + d, m


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, hamming, first_word, n_words: the best window of each text for each item it holds."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("hamming", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int32())])
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    out = None
    for block in item_blocks(benchmark):
        items = spark.sparkContext.broadcast(Items([b[0] for b in block], [b[1] for b in block]))

        def run(batches: Iterable[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            own: Items = items.value
            for b in batches:
                found = [(b.column(0)[row].as_py(), own.ids[m[0]], *m[1:]) for row, m in _matches(own, b.column(1))]
                if found:
                    yield batch_of(schema, *zip(*found, strict=True))

        part = rows.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item, with the columns of docs; rows are dropped in passing, without a join."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    out = docs
    for block in item_blocks(benchmark):
        items = docs.sparkSession.sparkContext.broadcast(Items([b[0] for b in block], [b[1] for b in block]))

        def run(batches: Iterable[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[row for row, _ in _matches(items.value, b.column(at).cast(pa.string()).fill_null(""))]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
