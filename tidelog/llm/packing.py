"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most `capacity` tokens; a whole piece fills a bin, the rest of each document is
placed best-fit decreasing. Bins stand in order of their residual room and carry two bitmaps, of the sources and of
the duplicate clusters that they hold. The search starts at the least residual that fits and goes on to the next
larger ones until the bitmaps allow it: the tightest compatible bin. Without one a new bin is opened. No bin holds
two pieces of one source or of one cluster.

The bins stand in a tree over the room that they have left; a node knows which sources and clusters all of its bins
hold, so the search passes over bins that hold a hot source without looking at each.

Documents are dealt to shards by a hash, as many as the corpus has `shard_tokens` tokens or `shard_docs` documents; a hot
source, a large cluster and rows that are repeated are spread over all shards like everything else, and a shard holds ids,
lengths and keys, never texts. A bin's id is its shard and its number there, so shards need nothing of each other.

Defined results
---------------
- length: number of words (runs of characters other than blank and tab to carriage return), plus one for the end
  mark; so a null or empty text has length 1.
- null source or cluster: in conflict with nothing. null doc_id: packed as any other.
- ties: pieces of equal length go by doc_id (null first), then source and cluster; repeated rows are packed each
  (and conflict with each other, as they share a cluster).
- very long texts: as many whole pieces as it takes, and a rest.
- empty table: no rows. Extra columns are not looked at.
- The shard of a document depends on how the rows are stored, too; its bin there on nothing else.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, text_of

CAPACITY = 2048
#: What one shard packs, in one task's memory: so many tokens (about 1,000 documents) and so many documents, about.
SHARD_TOKENS, SHARD_DOCS = 1 << 20, 1 << 14

PLACES = "doc_id bigint, piece int, bin_id string, bin_offset int, length int, doc_offset bigint, bin_used int"


def length_of(text: Column) -> Column:
    """Words and the end mark."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1


def cluster_of(text: Column) -> Column:
    """Texts with the same letters and digits, in either case, are one duplicate cluster."""
    plain = F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "")
    return F.when(plain != "", F.xxhash64(plain))


class Bins:
    """Open bins by the room that they have left: a tree whose nodes count their bins and hold the bits that all of them
    have. At a leaf the bins stand by their sources, each list ascending."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.sources = [-1] * (2 * self.leaves)
        self.clusters = [-1] * (2 * self.leaves)
        self.groups: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        #: The clusters that each bin holds.
        self.held: list[int] = []

    def _renew(self, room: int) -> None:
        groups, n = self.groups[room], self.leaves + room
        self.count[n] = sum(map(len, groups.values()))
        sources = clusters = -1
        for s, bins in groups.items():
            sources &= s
            for b in bins:
                if not clusters:
                    break
                clusters &= self.held[b]
        while True:
            self.sources[n], self.clusters[n] = sources, clusters
            n //= 2
            if not n:
                return
            one, two = 2 * n, 2 * n + 1
            self.count[n] = self.count[one] + self.count[two]
            sources, clusters = self.sources[one] & self.sources[two], self.clusters[one] & self.clusters[two]

    def add(self, b: int, room: int, source: int) -> None:
        insort(self.groups[room].setdefault(source, []), b)
        self._renew(room)

    def take(self, length: int, source: int, cluster: int) -> tuple[int, int, int] | None:
        """(room, bin, sources) of the tightest bin that holds neither, the oldest of equals; it is no longer open."""
        stack = [(1, 0, self.leaves)]
        while stack:
            n, lo, width = stack.pop()
            if lo + width <= length or not self.count[n] or self.sources[n] & source or self.clusters[n] & cluster:
                continue
            if width > 1:
                half = width // 2
                stack += [(2 * n + 1, lo + half, half), (2 * n, lo, half)]
                continue
            best = None
            for s, bins in self.groups[lo].items():
                if not s & source:
                    b = next((b for b in bins if not self.held[b] & cluster), None)
                    if b is not None and (best is None or b < best[0]):
                        best = b, s
            if best is not None:
                b, s = best
                self.groups[lo][s].remove(b)
                if not self.groups[lo][s]:
                    del self.groups[lo][s]
                self._renew(lo)
                return lo, b, s
        return None


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece (length, source bit, cluster bit), in the given order. A bit is 0 for none."""
    open_, bins, offsets = Bins(capacity), [], []
    for length, source, cluster in pieces:
        found = open_.take(length, source, cluster)
        if found is None:
            found = capacity, len(open_.held), 0
            open_.held.append(0)
        room, b, held = found
        bins.append(b)
        offsets.append(capacity - room)
        open_.held[b] |= cluster
        if room > length:
            open_.add(b, room - length, held | source)
    return bins, offsets


def pack_shard(t: pa.Table, capacity: int) -> pa.Table:
    ids, lengths = t.column("doc_id").to_pylist(), t.column("length").to_pylist()
    source, cluster = t.column("source").to_pylist(), t.column("cluster").to_pylist()
    shard = t.column("shard")[0].as_py()
    key = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, x or "")
    order = sorted(range(len(ids)), key=lambda i: (-(lengths[i] % capacity), key(ids[i]), text(source[i]), key(cluster[i]), lengths[i]))
    out: list[tuple] = []
    whole = 0
    for i in order:
        for p in range(lengths[i] // capacity):
            out.append((ids[i], p, f"{shard}-w{whole}", 0, capacity, p * capacity, capacity))
            whole += 1
    rest = [i for i in order if lengths[i] % capacity]
    bit: list[dict] = [{}, {}]
    number = lambda k, x: 0 if x is None else 1 << bit[k].setdefault(x, len(bit[k]))
    # A cluster that stands alone in the shard conflicts with nothing.
    often = Counter(cluster[i] for i in rest)
    cluster = [c if c is not None and often[c] > 1 else None for c in cluster]
    bins, offsets = best_fit([(lengths[i] % capacity, number(0, source[i]), number(1, cluster[i])) for i in rest], capacity)
    used = np.bincount(bins, weights=[lengths[i] % capacity for i in rest]).astype(int).tolist() if bins else []
    for i, b, at in zip(rest, bins, offsets, strict=True):
        p, n = divmod(lengths[i], capacity)
        out.append((ids[i], p, f"{shard}-{b}", at, n, p * capacity, used[b]))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("bin_id", pa.string()), ("bin_offset", pa.int32()), ("length", pa.int32()), ("doc_offset", pa.int64()), ("bin_used", pa.int32())])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else schema.empty_table()


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS, cluster: Column | None = None) -> DataFrame:
    """doc_id, piece, bin_id, bin_offset, length, doc_offset, bin_used: where each piece of each document lies.

    cluster: a column of docs that names duplicate clusters; otherwise texts that differ only in case, blanks and
    marks are a cluster.
    """
    text = text_of(docs)
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), length_of(text).cast("long").alias("length"), source.alias("source"), (cluster.cast("bigint") if cluster is not None else cluster_of(text)).alias("cluster"))
    rows = stored(rows, "packing-lengths")
    total, n = rows.agg(F.sum("length"), F.count("*")).first()
    shards = max(1, -(-int(total or 0) // shard_tokens), -(-n // shard_docs))
    # The rows are stored, so their numbers stay the same when a task is run again; they part repeated rows.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "cluster", F.monotonically_increasing_id()), F.lit(shards)))

    def run(t: pa.Table) -> pa.Table:
        return pack_shard(t, capacity)

    return dealt.groupBy("shard").applyInArrow(run, PLACES)

