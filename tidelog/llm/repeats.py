"""Repeated passages by enhanced suffix arrays.

Every MIN-byte string has an anchor: its q-gram with the least hash (rightmost or not, all that are least). Equal
strings have equal anchors, so the strings of a text fall into runs with one anchor, and all equal strings of the
corpus meet under their anchor. The bytes of a run are its context.

1. Anchors that occur in one text only are left out: of a wide table of cells, dealt in slices and growing with the
   texts, those that two texts have hit go into a bit table of bounded size.
2. The contexts of the others are dealt by anchor. Equal contexts are one, with its smallest text; a context of
   several texts is a repeat as a whole.
3. Where an anchor has different contexts, their suffixes make an enhanced suffix array: sorted, with the lengths of
   common prefixes. A stack scan yields the tree of common-prefix intervals; an interval of at least MIN bytes whose
   suffixes have different bytes on their left is a maximal repeat, given with all occurrences. Where a context ends
   it counts as different, and the neighbouring anchor's context goes on from there.

So the groups together cover every byte of every string that occurs in two texts, and by no more. `removals` takes
from them what a text shares with a text of a smaller id; texts and their ranges then meet in parts of about
BUCKET_BYTES.

The bit table has at most 2**MAX_CELL_BITS bits, set by shared anchors alone; when these fill it, more contexts are
dealt and the results stay exact. A bucket holds the contexts of about BUCKET_BYTES of text; under one anchor, equal
contexts of a task are sent once for each text, and only different ones are sorted.

Defined results
---------------
- null or empty text, or one shorter than MIN bytes: nothing is removed. null doc_id: shares nothing.
- ties and repeated rows: rows with the same doc_id share nothing with each other; each is reported.
- very long texts: whole. Empty table: no rows. Extra columns are not looked at.
- Bytes are those of the text in UTF-8; a removal can cut a character.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _MULT, _powers, batch_of, mix, passes, spans, stored, text_of

MIN, Q = 50, 16
MAX_CELL_BITS = 28
#: The wide table has 2**WIDE_BITS times the cells that the bit table would have without a bound: one anchor of a single
#: text in 300, or fewer, is taken for a shared one.
WIDE_BITS = 6
#: A cell and a text's place in its batch make one number of 64 bits.
MAX_WIDE_BITS = 46
#: Text, about, whose anchors one slice of the bit table gets; a slice is one task's work.
SLICE_BYTES = 32 << 20
BUCKET_BYTES = 4 << 20
FLUSH_BYTES = 32 << 20
#: Text that one numpy pass takes.
PASS = 1 << 16


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least(x[i : i + width]) for all i."""
    k = 1
    while 2 * k <= width:
        x = least(x[:-k], x[k:])
        k *= 2
    return least(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all Q-grams (Q a power of two)."""
    h, k = data.astype(np.uint64) + np.uint64(1), 1
    while k < Q:
        h = h[:-k] * np.uint64(pow(int(_MULT), k, 1 << 64)) + h[k:]
        k *= 2
    return mix(h)


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first string, strings) of the runs of MIN-byte strings that share an anchor."""
    n = len(data) - MIN + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    h = _grams(data)
    least = _sliding(h, MIN - Q + 1, np.minimum)
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    inside = doc[:n] == doc[MIN - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:n] != doc[: n - 1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    keep = inside[at]
    at, length = at[keep], length[keep]
    # A run goes at most MIN strings, so that a text of one letter makes contexts of bounded size.
    parts = -(-length // MIN)
    if (parts > 1).any():
        head = np.repeat(at, parts) + MIN * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
        length = np.minimum(MIN, np.repeat(at + length, parts) - head)
        at = head
    return doc[at].astype(np.int64), least[at], at, length


def _key_column(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the text that tells repeated ids apart, and the text."""
    d = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return d.select("doc_id", F.hash("text").alias("digest"), "text")


def shared_cells(rows: DataFrame, wide: int, bits: int, slices: int) -> np.ndarray:
    """A table of 2**bits bits: anchors whose cells, of 2**wide, two texts at least have hit. slices: a power of two."""
    per = (1 << wide) // slices
    schema = pa.schema([("slice", pa.int32()), ("cells", pa.binary()), ("again", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(cells, np.arange(slices + 1, dtype=np.int64) * per)
            own = [(k, (cells[a:b] - k * per).astype(np.uint32), n[a:b] > 1) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
            return batch_of(schema, [k for k, _, _ in own], [c.tobytes() for _, c, _ in own], [np.packbits(m).tobytes() for _, _, m in own])

        for b in batches:
            for i, _, data, offs in passes(b.column(2).filter(b.column(0).is_valid()), PASS):
                doc, anchor, _, _ = anchors(data, offs)
                one = np.unique((doc.astype(np.uint64) << np.uint64(wide)) | (anchor >> np.uint64(64 - wide)))
                held.append((one & np.uint64((1 << wide) - 1)).astype(np.int64))
                size += len(one)
                if size > 1 << 22:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def join(t: pa.Table) -> pa.Table:
        cells = np.concatenate([np.frombuffer(c, np.uint32) for c in t.column("cells").to_pylist()])
        again = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(c) // 4) for c, m in zip(t.column("cells").to_pylist(), t.column("again").to_pylist(), strict=True)])
        # Twice in one batch of texts, or in two batches. The lowest bit tells which.
        both = np.sort(cells.astype(np.int64) << 1 | again)
        cell = both >> 1
        shared = np.concatenate([cell[(both & 1).astype(bool)], cell[1:][cell[1:] == cell[:-1]]])
        out = np.zeros((1 << bits) // slices, bool)
        out[shared >> (wide - bits)] = True
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    t = rows.mapInArrow(run, "slice int, cells binary, again binary").groupBy("slice").applyInArrow(join, "slice int, bits binary").toArrow()
    table = np.zeros((slices, (1 << bits) // slices // 8), np.uint8)
    for k, x in zip(t.column("slice").to_pylist(), t.column("bits").to_pylist(), strict=True):
        table[k] = np.frombuffer(x, np.uint8)
    return table.ravel()


#: One row holds many contexts of one bucket, compressed: how many there are and of how many texts; the texts' doc_id
#: (differences), digest and number of contexts; first byte and length of each context; their bytes. An anchor follows from the bytes.
BLOBS = "bucket int, data binary"


def _sealed(doc: np.ndarray, digest: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray) -> bytes:
    """One blob; contexts of a text stand together."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])
    at = np.flatnonzero(new)
    parts = (np.array([len(doc), len(at)], "<u4"), np.diff(doc[at], prepend=0), digest[at].astype(np.int32), np.diff(np.append(at, len(doc))).astype("<u4"), start.astype("<u4"), length.astype(np.uint8), text)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))


def _opened(data: bytes) -> tuple[np.ndarray, ...]:
    """doc, digest, start, length and text of a blob's contexts."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    at = 8
    doc = np.cumsum(np.frombuffer(raw, np.int64, m, at))
    digest = np.frombuffer(raw, np.int32, m, at + 8 * m).astype(np.int64)
    at += 12 * m
    count = np.frombuffer(raw, "<u4", m, at)
    at += 4 * m
    start = np.frombuffer(raw, "<u4", n, at).astype(np.int64)
    length = np.frombuffer(raw, np.uint8, n, at + 4 * n).astype(np.int64)
    return np.repeat(doc, count), np.repeat(digest, count), start, length, np.frombuffer(raw, np.uint8, offset=at + 5 * n)


def contexts(rows: DataFrame, bits: int, table: np.ndarray, buckets: int) -> DataFrame:
    """The contexts of shared anchors, in blobs by bucket."""
    shift = np.uint64(64 - bits)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc, digest, start, length, anchor = (np.concatenate([h[k] for h in held]) for k in range(5))
            texts = np.concatenate([h[5] for h in held])
            bucket = (mix(anchor, 0xB0C) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.cumsum(length) - length
            own = np.flatnonzero(np.bincount(bucket, minlength=buckets))
            cut = np.searchsorted(bucket[order], np.append(own, buckets))
            sealed = [_sealed(doc[o], digest[o], start[o], length[o], texts[spans(at[o], length[o])]) for a, b in zip(cut[:-1], cut[1:], strict=True) for o in (order[a:b],)]
            return batch_of(schema, own.astype(np.int32), sealed)

        for b in batches:
            b = b.filter(b.column(0).is_valid())
            ids, digests = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for i, _, data, offs in passes(b.column(2), PASS):
                doc, anchor, at, n = anchors(data, offs)
                cell = (anchor >> shift).astype(np.int64)
                keep = (shared.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                if not keep.any():
                    continue
                doc, anchor, at, n = doc[keep], anchor[keep], at[keep], n[keep] + MIN - 1
                held.append((ids[i + doc], digests[i + doc], at - offs[doc], n, anchor, data[spans(at, n)]))
                size += int(n.sum())
                if size > FLUSH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(run, BLOBS)


def _words8(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one number that sorts like them; data is padded by zeros."""
    x, k = data.astype(np.uint64), 1
    while k < 8:
        y = np.zeros_like(x)
        y[:-k] = x[k:]
        x = (x << np.uint64(8 * k)) | y
        k *= 2
    return x


def suffix_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes data[start:end] sorted, and the common prefix of each with the one before (0 for the first)."""
    w8 = _words8(np.concatenate([data, np.zeros(8, np.uint8)]))
    most = int((end - start).max())
    keys = []
    for k in range(0, most, 8):
        left = np.clip(end - start - k, 0, 8)
        x = np.where(left > 0, w8[np.minimum(start + k, len(w8) - 1)], 0)
        keys.append(x >> (np.uint64(8) * (8 - left).astype(np.uint64) % np.uint64(64)) << (np.uint64(8) * (8 - left).astype(np.uint64) % np.uint64(64)))
        keys[-1][left == 0] = 0
    order = np.lexsort(keys[::-1])
    lcp = np.zeros(len(order), np.int64)
    alive = np.ones(len(order), bool)
    alive[:1] = False
    for x in keys:
        y = x[order]
        differ = np.zeros(len(order), np.uint64)
        differ[1:] = y[1:] ^ y[:-1]
        # Equal leading bytes of the word: 8 where it doesn't differ.
        same = sum((differ < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(8))
        lcp += np.where(alive, same, 0)
        alive &= differ == 0
    size = (end - start)[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(size[1:], size[:-1]))
    return order, lcp


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of all common-prefix intervals of at least `least`, children before their parents: the
    stack scan over the lengths of common prefixes."""
    stack: list[tuple[int, int]] = []  # (length, first)
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            if length >= least:
                yield length, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def _met_twice(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Whether another of the positions has the same `size` bytes (by hash, so now and then one too many)."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[start + size] - sums[start]) * down[start]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(start), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def maximal_repeats(data: np.ndarray, at: np.ndarray, length: np.ndarray, least: int = MIN) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(context, offset)...]): the maximal repeats among the contexts data[at:at+length], each with all its
    occurrences. A byte before or after a context counts as different from all others."""
    n = np.maximum(length - least + 1, 0)
    ctx = np.repeat(np.arange(len(at)), n)
    start = spans(at, n)
    # A suffix whose first `least` bytes nobody else has is in no interval; only the others are sorted.
    keep = _met_twice(data, start, least)
    ctx, start = ctx[keep], start[keep]
    if len(start) < 2:
        return
    order, lcp = suffix_array(data, start, (at + length)[ctx])
    offset = start - at[ctx]
    left = np.where(offset > 0, data[np.maximum(start - 1, 0)].astype(np.int64), -1 - np.arange(len(start)))[order]
    ctx, offset = ctx[order], offset[order]
    # changes[j]: how often the byte on the left differs from the one before, up to j; an interval is left-diverse if
    # it rises inside.
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    for size, a, b in intervals(lcp.tolist(), least):
        if changes[b] > changes[a]:
            yield size, list(zip(ctx[a : b + 1].tolist(), offset[a : b + 1].tolist(), strict=True))


def _slices(at: np.ndarray, length: np.ndarray, most: int = PASS) -> Iterator[tuple[slice, int, int]]:
    """Slices of contexts with about `most` bytes: (contexts, first byte, end)."""
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most)))
        yield slice(i, j), int(at[i]), int(at[j - 1] + length[j - 1])
        i = j


def _bucket_contexts(t: pa.Table) -> tuple[np.ndarray, ...]:
    """doc, digest, start, length, anchor and position in the text of one bucket's contexts, and the text."""
    doc, digest, start, length, text = (np.concatenate(x) for x in zip(*map(_opened, t.column("data").to_pylist()), strict=True))
    at = np.cumsum(length) - length
    anchor = np.concatenate([_sliding(_grams(text[a:b]), MIN - Q + 1, np.minimum)[at[x] - a] for x, a, b in _slices(at, length)])
    return doc, digest, start, length, anchor, at, text


def _same_contexts(anchor: np.ndarray, length: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class of each context: equal bytes under one anchor, by two 64-bit hashes."""
    hs, gs = [], []
    for x, a, b in _slices(at, length):
        w8, own, left = _words8(np.concatenate([text[a:b], np.zeros(8, np.uint8)])), at[x] - a, length[x]
        h, g = anchor[x] ^ mix(left.astype(np.uint64), 3), mix(anchor[x], 5)
        for k in range(0, int(left.max()), 8):
            n = np.clip(left - k, 0, 8)
            gap = (np.uint64(8) * (8 - n).astype(np.uint64)) % np.uint64(64)
            word = np.where(n > 0, w8[np.minimum(own + k, len(w8) - 1)] >> gap, 0)
            h = mix(h ^ word, k + 1)
            g = (g ^ word) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)
        hs.append(h)
        gs.append(g)
    h, g = np.concatenate(hs), np.concatenate(gs)
    order = np.lexsort((g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


#: One row holds, compressed, the ranges of all texts of one part that one bucket has found: how many texts; their doc_id
#: (differences), digest and number of ranges; first byte and end of each range.
RANGES = "part int, data binary"


def part_of(doc: np.ndarray, digest: np.ndarray, parts: int) -> np.ndarray:
    """The part where a text and its ranges meet; different texts with one doc_id part."""
    return (mix(doc.astype(np.uint64) ^ mix(digest.astype(np.int64).astype(np.uint64)), 0x9A27) % np.uint64(parts)).astype(np.int64)


def bucket_removals(t: pa.Table, parts: int) -> pa.Table:
    """(part, ranges): byte ranges of each text that a text with a smaller id shares, from one bucket's repeat groups."""
    schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])
    doc, digest, start, length, anchor, at, text = _bucket_contexts(t)
    cls = _same_contexts(anchor, length, text, at)
    n = int(cls.max()) + 1
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, cls, doc)
    # A class of contexts is a repeat as a whole: all but the smallest text lose it.
    late = doc > smallest[cls]
    lo, hi, who = [start[late]], [(start + length)[late]], [np.flatnonzero(late)]
    # Different contexts of one anchor: the smallest text of each class may share a part with a smaller one.
    one = np.empty(n, np.int64)
    one[cls] = np.arange(len(cls))
    by = np.argsort(anchor[one], kind="stable")
    a = anchor[one][by]
    several = np.zeros(n, bool)
    several[1:] |= a[1:] == a[:-1]
    several[:-1] |= a[1:] == a[:-1]
    some = by[several]
    if len(some):
        first = np.flatnonzero(~late)
        first = first[np.argsort(cls[first], kind="stable")]
        owners = np.searchsorted(cls[first], np.arange(n + 1))
        # Runs of anchors, so many that their suffixes are sorted at once.
        for part in _parts(anchor[one][some], length[one][some]):
            ids = some[part]
            size = length[one][ids]
            data = text[spans(at[one][ids], size)]
            rows, cuts, ends = [], [], []
            low = smallest[ids]
            for long, where in maximal_repeats(data, np.cumsum(size) - size, size):
                least = min(low[c] for c, _ in where)
                for c, o in where:
                    if low[c] > least:
                        rows.append(c)
                        cuts.append(o)
                        ends.append(o + long)
            if rows:
                k = ids[np.array(rows)]
                count = owners[k + 1] - owners[k]
                w = first[spans(owners[k], count)]
                lo.append(start[w] + np.repeat(np.array(cuts), count))
                hi.append(start[w] + np.repeat(np.array(ends), count))
                who.append(w)
    lo, hi, who = (np.concatenate(x) for x in (lo, hi, who))
    if not len(lo):
        return schema.empty_table()
    part = part_of(doc, digest, parts)[who]
    order = np.lexsort((lo, digest[who], doc[who], part))
    lo, hi, who, part = lo[order], hi[order], who[order], part[order]
    d, g = doc[who], digest[who]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    heads = np.flatnonzero(new)
    lo, hi, cut = _united(lo, hi, heads)
    pairs = np.stack([lo, hi], 1).astype("<u4")
    d, g, count = d[heads], g[heads].astype(np.int32), np.diff(cut).astype("<u4")
    edges = np.append(np.flatnonzero(np.append(True, np.diff(part[heads]) > 0)), len(heads))
    zip_ = zstandard.ZstdCompressor(level=3)
    rows = [zip_.compress(b"".join(x.tobytes() for x in (np.array([b - a], "<u4"), np.diff(d[a:b], prepend=0), g[a:b], count[a:b], pairs[cut[a] : cut[b]]))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.Table.from_arrays([pa.array(part[heads][edges[:-1]], pa.int32()), pa.array(rows, pa.binary())], schema=schema)


def opened_ranges(data: bytes) -> dict[tuple[int, int], np.ndarray]:
    """(doc_id, digest) -> ranges."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    doc = np.cumsum(np.frombuffer(raw, np.int64, n, 4))
    digest, count = np.frombuffer(raw, np.int32, n, 4 + 8 * n), np.frombuffer(raw, "<u4", n, 4 + 12 * n)
    pairs = np.frombuffer(raw, "<u4", offset=4 + 16 * n).reshape(-1, 2).astype(np.int64)
    return dict(zip(zip(doc.tolist(), digest.tolist(), strict=True), np.split(pairs, np.cumsum(count)[:-1]), strict=True))


def _parts(anchor: np.ndarray, length: np.ndarray, most: int = 4 << 20) -> Iterator[slice]:
    """Slices of whole anchors with about `most` bytes of contexts."""
    edges = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
    sums = np.concatenate([[0], np.cumsum(length)])[edges]
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + most, side="right")) - 1)
        yield slice(int(edges[a]), int(edges[b]))
        a = b


def _united(lo: np.ndarray, hi: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by lo within groups (that begin at heads), united where they touch, and where each group begins."""
    group = np.zeros(len(lo), np.int64)
    group[heads[1:]] = 1
    group = np.cumsum(group)
    far = int(hi.max()) + 2
    a, b = lo + group * far, np.maximum.accumulate(hi + group * far)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(a)) - 1
    g = group[at]
    return lo[at], b[last] - g * far, np.append(np.searchsorted(g, np.arange(len(heads))), len(at))


def removals(rows: DataFrame, total: int, parts: int) -> DataFrame:
    """(part, data): what each text shares with a text of a smaller id. rows: doc_id, digest, text; total: their bytes."""
    size = max(20, math.ceil(math.log2(total / 4 + 1)))
    bits = min(MAX_CELL_BITS, size)
    slices = 1 << max(5, min(bits - 10, math.ceil(math.log2(total / SLICE_BYTES + 1))))
    table = shared_cells(rows, min(size + WIDE_BITS, MAX_WIDE_BITS), bits, slices)
    blobs = contexts(rows, bits, table, max(32, -(-total // BUCKET_BYTES)))

    def run(t: pa.Table) -> pa.Table:
        return bucket_removals(t, parts)

    return stored(blobs.groupBy("bucket").applyInArrow(run, RANGES), "repeat-ranges")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    rows = _key_column(docs)
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = max(32, -(-total // BUCKET_BYTES))
    found = removals(rows, total, parts)

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.int32()), ("text", pa.string())])
        for b in batches:
            part = part_of(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), parts)
            yield batch_of(own, part.astype(np.int32), b.column(0), b.column(1), b.column(2))

    def run(texts: pa.Table, ranges: pa.Table) -> pa.Table:
        gone: dict[tuple[int, int], list[np.ndarray]] = {}
        for data in ranges.column("data").to_pylist():
            for k, r in opened_ranges(data).items():
                gone.setdefault(k, []).append(r)
        out = []
        for doc, mark, text in zip(texts.column("doc_id").to_pylist(), texts.column("digest").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist(), strict=True):
            removed = spans_ = at = 0
            digest = hashlib.sha256()
            if own := gone.get((doc, mark)):
                r = np.concatenate(own)
                r = r[np.argsort(r[:, 0], kind="stable")]
                lo, hi, _ = _united(r[:, 0], r[:, 1], np.zeros(1, np.int64))
                removed, spans_ = int((hi - lo).sum()), len(lo)
                for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                    digest.update(text[at:x])
                    at = y
            digest.update(text[at:])
            out.append((doc, len(text), removed, spans_, digest.hexdigest()))
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = rows.where("doc_id is not null").mapInArrow(numbered, "part int, doc_id bigint, digest int, text string")
    cut = dealt.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    # Rows without doc_id share nothing and needn't travel.
    none = F.lit(0).cast("bigint")
    whole = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return cut.unionByName(whole)
