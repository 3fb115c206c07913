"""MinHash near-duplicate removal with an inverted join on signature coordinates.

Every text has a set of five-word shingles and a signature of COORDINATES minima. Texts with the same set are one
class, represented by its smallest doc_id. The representatives are posted under each (coordinate, value) pair of the
first POSTED coordinates.

- Counting with prefixes: two texts that agree in MATCHES posted coordinates must share one of the POSTED - MATCHES + 1
  rarest postings of each, so only those are merged and the most frequent are skipped; a posting that nobody shares
  goes first. Agreement is then counted on the whole signatures, and AGREE coordinates are asked for.
- First each posting is merged as a star around its smallest member, so a posting of n texts makes n - 1 pairs. Pairs
  that agree are confirmed on the full sets (100 * intersection >= THRESHOLD * union), and the confirmed links make
  components.
- Then the postings that still hold several components, without their centres, are merged, but only across components
  and between sets of matching size. Sets of up to EXACT shingles are at hand there, with 32 bits of each shingle's hash,
  which tells every pair but those at the very threshold; of the links found in a posting only those that join two of its
  components are written. So no link between different texts is lost, neither the members of a large group of near copies
  nor texts that are just less alike than the threshold are written in pairs. Larger sets must agree by a finer sketch (the
  least shingle of each of SKETCH bins) and are confirmed on the full sets: the most alike partner of each text first.
- A posting of more than BLOCK texts is merged in pairs of blocks. All its pairs across components are compared by their
  signatures, so a posting of n such texts still costs n * n / 2 comparisons of 128 bytes.

A pair at the threshold passes three filters before it is confirmed, and is missed by one of them only if no chain of
other links joins the two: with a probability of about 3.3e-4 by the posted coordinates and 3.5e-5 by the agreement of
all (binomial tails), and, across components and between large sets, by the sketch (in none of 20,000 drawn pairs).

Defined results
---------------
- A text with one to four words has one shingle, all its words. null and empty texts and texts without words have
  none; they are linked with nothing, and each is its own component.
- null doc_id: such a row is reported with component null and kept, and isn't linked.
- ties and repeated rows: the same doc_id and text is one class; each row is reported, all of the smallest id kept.
  A doc_id that stands for different texts is outside the contract: its rows are reported, with the links of either.
- very long texts: whole. Empty table: no rows. Extra columns are not looked at, and `drop_near` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, batch_of, binaries, components, mix, passes, spans, stored, text_of

K = 5
THRESHOLD = 75
COORDINATES, AGREE = 128, 76
POSTED, MATCHES = 64, 36
PREFIX = POSTED - MATCHES + 1
#: Texts of one block of a hot posting: as many, or a SPREADth of the posting up to MOST_BLOCK.
BLOCK, SPREAD, MOST_BLOCK = 4096, 64, 16384
#: Sets that are compared where postings are merged, and by how many shared shingles a pair must pass to need no
#: confirmation: equal halves of different hashes can only add to what two sets share.
EXACT, SURE = 512, 2
#: Bins of the finer sketch, and the estimated similarity in percent from which a pair is confirmed. The estimate's
#: standard error is 1.4 points at most.
SKETCH, SKETCH_PERCENT = 1024, 68
#: The filter that keeps the sets of texts without candidates from being dealt has FILTER_PER_ID bits for each candidate, in
#: all MAX_FILTER_BITS at most (32 MiB are broadcast); beyond that, more sets are dealt and met by the join.
FILTER_PER_ID, MAX_FILTER_BITS = 16, 1 << 28

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distinct_shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, and where they begin."""
    h, heads = Words(data, offs).shingles(K)
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[heads[:-1][heads[:-1] < heads[1:]]] = True
    ends = np.concatenate([[0], np.cumsum(new)])[heads]
    return h[new], ends


SIGNATURES = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, posted binary, signature binary"


def signatures(docs: DataFrame) -> DataFrame:
    """n_shingles, two 64-bit digests of the set, the minima that are posted (32 bits each) and one byte of every
    minimum to count agreement."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("posted", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in passes(b.column(1)):
                h, heads = distinct_shingles(data, offs)
                n = np.diff(heads)
                some = np.flatnonzero(n)
                posted = np.zeros((j - i, POSTED), "<u4")
                sig = np.zeros((j - i, COORDINATES), np.uint8)
                f = np.zeros((2, j - i), np.uint64)
                if len(some):
                    at = heads[:-1][some]
                    product = np.empty_like(h)
                    for c in range(COORDINATES):
                        np.multiply(h, _FACTORS[c], out=product)
                        least = np.minimum.reduceat(product, at)
                        sig[some, c] = mix(least) >> np.uint64(56)
                        if c < POSTED:
                            posted[some, c] = least >> np.uint64(32)
                    f[0, some] = np.add.reduceat(mix(h, 1), at)
                    f[1, some] = np.bitwise_xor.reduceat(mix(h, 2), at)
                rows = np.arange(j - i + 1)
                yield batch_of(schema, b.column(0).slice(i, j - i), n, f[0].view(np.int64), f[1].view(np.int64), binaries(posted, rows * 4 * POSTED), binaries(sig, rows * COORDINATES))

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, SIGNATURES)


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _postings(reps: DataFrame) -> DataFrame:
    """(rep, token, place): the prefix of each representative's postings, without those that nobody shares. place is the
    coordinate and 32 bits of the token."""
    schema = pa.schema([("rep", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    salts = np.arange(POSTED, dtype=np.uint64) << np.uint64(32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = mix(_matrix(b.column(1), "<u4", POSTED).astype(np.uint64) | salts).view(np.int64)
            yield batch_of(schema, b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * POSTED), pa.array(t.ravel())))

    posts = reps.select("rep", "posted").mapInArrow(run, "rep bigint, tokens array<bigint>").select("rep", F.posexplode("tokens").alias("coordinate", "token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    met = posts.join(shared, "token")
    w = Window.partitionBy("rep")
    ranked = met.withColumn("k", F.row_number().over(w.orderBy("n", "token"))).withColumn("all", F.count("*").over(w))
    return ranked.where(F.col("k") + POSTED - F.col("all") <= PREFIX).select("rep", "token", F.expr("shiftleft(cast(coordinate as bigint), 32) | greatest(token & 4294967295L, 1L)").alias("place"))


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in AGREE coordinates at least and whose sets match in size."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = (_matrix(b.column(k), np.uint8, COORDINATES) for k in (2, 3))
            keep = pa.array((s == t).sum(1) >= AGREE)
            yield batch_of(schema, b.column(0).filter(keep), b.column(1).filter(keep))

    sig = reps.select("rep", "signature", "n_shingles")
    x, y = (sig.select(F.col("rep").alias(r), F.col("signature").alias(s), F.col("n_shingles").alias(n)) for r, s, n in (("a", "s", "m"), ("b", "t", "n")))
    both = pairs.join(x, "a").join(y, "b").where(f"100 * least(m, n) >= {THRESHOLD} * greatest(m, n)")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a bigint, b bigint")


def sketches(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Per text one byte for each bin: of its least shingle hash there, 0 if it has none. h has 32 bits of each hash and
    ascends within texts."""
    shift = np.uint32(32 - SKETCH.bit_length() + 1)
    text = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    cell = text * SKETCH + (h >> shift).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = cell[1:] != cell[:-1]
    out = np.zeros((len(heads) - 1) * SKETCH, np.uint8)
    out[cell[first]] = 1 + (mix(h[first].astype(np.uint64), 9) % np.uint64(255)).astype(np.uint8)
    return out.reshape(-1, SKETCH)


def contents(h: np.ndarray, heads: np.ndarray) -> pa.Array:
    """What is compared across components: 32 bits of each hash of a set of up to EXACT, or the sketch of a larger one."""
    h = (h >> np.uint64(32)).astype("<u4")
    n = np.diff(heads)
    size = np.where(n <= EXACT, 4 * n, SKETCH)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(ends[-1]), np.uint8)
    small, large = np.flatnonzero(n <= EXACT), np.flatnonzero(n > EXACT)
    out[spans(ends[small], size[small])] = h[spans(heads[small], n[small])].view(np.uint8)
    out[spans(ends[large], size[large])] = sketches(h[spans(heads[large], n[large])], np.concatenate([[0], np.cumsum(n[large])])).ravel()
    return binaries(out, ends)


class Contents:
    """The contents of several texts with n shingles each."""

    def __init__(self, column: pa.ChunkedArray, n: np.ndarray):
        data = column.to_pylist()
        self.small = n <= EXACT
        small = [x for x, k in zip(data, self.small.tolist(), strict=True) if k]
        self.h = np.frombuffer(b"".join(small), "<u4")
        self.n = np.where(self.small, n, 0)
        self.heads = np.concatenate([[0], np.cumsum(self.n)])
        self.row = np.cumsum(~self.small) - 1
        self.sketch = np.frombuffer(b"".join(x for x, k in zip(data, self.small.tolist(), strict=True) if not k), np.uint8).reshape(-1, SKETCH)

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many values the small sets x[k] and y[k] share."""
        out = np.zeros(len(x), np.int64)
        size = np.cumsum(self.n[x] + self.n[y])
        at = 0
        while at < len(x):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 20), side="right")))
            one, other = x[at:end], y[at:end]
            pair = np.concatenate([np.repeat(np.arange(end - at), self.n[one]), np.repeat(np.arange(end - at), self.n[other])])
            keys = (pair.astype(np.uint64) << np.uint64(32)) | np.concatenate([self.h[spans(self.heads[one], self.n[one])], self.h[spans(self.heads[other], self.n[other])]])
            keys.sort()
            out[at:end] = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(32)).astype(np.int64), minlength=end - at)
            at = end
        return out

    def _sketched(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), SKETCH), np.uint8)
        small = self.small[x]
        out[~small] = self.sketch[self.row[x[~small]]]
        own = x[small]
        out[small] = sketches(self.h[spans(self.heads[own], self.n[own])], np.concatenate([[0], np.cumsum(self.n[own])]))
        return out

    def likeness(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The similarity of x[k] and y[k] by their sketches, in percent."""
        out = np.zeros(len(x))
        for m in range(0, len(x), 1 << 12):
            u, v = self._sketched(x[m : m + (1 << 12)]), self._sketched(y[m : m + (1 << 12)])
            out[m : m + (1 << 12)] = 100 * ((u == v) & (u > 0)).sum(1) / ((u | v) > 0).sum(1)
        return out


def _best(i: np.ndarray, j: np.ndarray, likeness: np.ndarray) -> np.ndarray:
    """Which pairs are the best of one of their two ends."""
    ends, at = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((at, -likeness[at], ends))
    first = np.ones(len(order), bool)
    first[1:] = ends[order][1:] != ends[order][:-1]
    out = np.zeros(len(i), bool)
    out[at[order[first]]] = True
    return out


def _joining(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which links (i, j) join two components of comp, one after the other, and comp with those joined."""
    names, at = np.unique(comp, return_inverse=True)
    parent = list(range(len(names)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = np.zeros(len(i), bool)
    for k, (a, b) in enumerate(zip(at[i].tolist(), at[j].tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out[k] = True
    return out, names[[root(k) for k in range(len(names))]][at]


ACROSS = "a bigint, b bigint, sure boolean"


def _across(open_: DataFrame, best: bool) -> DataFrame:
    """(a, b, sure): pairs of one posting with different components that agree: links that join two components (sure), and
    pairs to be confirmed. A pair that shares several postings is told by the one with the least coordinate; where one of
    the two is that posting's centre, the star has told it. best: of the pairs to be confirmed only the most alike of
    each text, of those that are looked at together.

    open_ has (token, part, block, rep, comp, n_shingles, signature, content, places, place); a group is (token, part),
    sorted, and pairs within one block of a mixed part are left to the part of that block alone."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])
    most = 1 << 19

    def pairs_of(group: np.ndarray, coordinate, mixed, block, rep, comp, n, sig, content: Contents, own) -> Iterator[pa.RecordBatch]:
        size = np.bincount(group)
        place = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        after = size[group] - 1 - place
        edges = np.concatenate([[0], np.cumsum(after)])

        def told(i: np.ndarray, j: np.ndarray, sure: bool) -> pa.RecordBatch:
            return batch_of(schema, np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j]), pa.repeat(sure, len(i)))

        at = 0
        while at < len(group):
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + most, side="right")) - 1)
            cnt = after[at:end]
            a = np.repeat(np.arange(at, end), cnt)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            open_pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            fit = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= THRESHOLD * np.maximum(n[a], n[b])) & ~(mixed[a] & (block[a] == block[b]))
            a, b = a[fit], b[fit]
            for k in range(0, len(a), 1 << 15):
                x, y = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
                keep = comp[x] != comp[y]
                x, y = x[keep], y[keep]
                keep = (sig[x] == sig[y]).sum(1) >= AGREE
                x, y = x[keep], y[keep]
                keep = ((own[x] == own[y]) & (own[x] != 0)).argmax(1) == coordinate[x]
                x, y = x[keep], y[keep]
                exact = content.small[x] & content.small[y]
                i, j = x[exact], y[exact]
                same = content.shared(i, j)
                link = lambda s, i=i, j=j: 100 * s >= THRESHOLD * (n[i] + n[j] - s)
                sure = link(same - SURE)
                near = link(same) & ~sure
                open_pairs.append((i[near], j[near], np.full(int(near.sum()), 100.0)))
                i, j = i[sure], j[sure]
                if len(i):
                    joins, comp = _joining(comp, i, j)
                    yield told(i[joins], j[joins], True)
                i, j = x[~exact], y[~exact]
                if len(i):
                    likeness = content.likeness(i, j)
                    near = likeness >= SKETCH_PERCENT
                    open_pairs.append((i[near], j[near], likeness[near]))
            if open_pairs:
                i, j, likeness = (np.concatenate(t) for t in zip(*open_pairs, strict=True))
                keep = comp[i] != comp[j]
                i, j, likeness = i[keep], j[keep], likeness[keep]
                if best and len(i):
                    keep = _best(i, j, likeness)
                    i, j = i[keep], j[keep]
                if len(i):
                    yield told(i, j, False)
            at = end

    def by_coordinate(places: pa.ChunkedArray) -> np.ndarray:
        out = np.zeros((len(places), POSTED), np.uint32)
        length = np.concatenate([c.value_lengths().to_numpy() for c in places.chunks]).astype(np.int64)
        flat = np.concatenate([c.flatten().to_numpy() for c in places.chunks])
        out[np.repeat(np.arange(len(length)), length), flat >> 32] = flat & 0xFFFFFFFF
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows > 1:
                token, part, block, rep, comp, n = (t.column(k).to_numpy() for k in range(6))
                new = np.concatenate([[False], (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
                yield from pairs_of(np.cumsum(new), t.column(9).to_numpy() >> 32, part < 0, block, rep, comp, n, _matrix(t.column(6), np.uint8, COORDINATES), Contents(t.column(7), n), by_coordinate(t.column(8)))

        for b in batches:
            kept.append(b)
            token, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            whole = int(np.flatnonzero((token == token[-1]) & (part == part[-1]))[0])  # the last group may go on
            first = kept[0]
            if whole or (first.column(0)[0].as_py(), first.column(1)[0].as_py()) != (int(token[-1]), int(part[-1])):
                yield from work(pa.Table.from_batches([*kept[:-1], b.slice(0, whole)]))
                kept = [b.slice(whole)]
        if kept:
            yield from work(pa.Table.from_batches(kept))

    return open_.select("token", "part", "block", "rep", "comp", "n_shingles", "signature", "content", "places", "place").mapInArrow(run, ACROSS)


def _filter_words(ids: DataFrame) -> np.ndarray:
    """A bit table of the ids: only its words, a bounded number, reach the driver."""
    size = 1 << min(MAX_FILTER_BITS.bit_length() - 1, max(12, (FILTER_PER_ID * ids.count()).bit_length()))
    cell = ids.select(F.pmod(F.col("rep"), F.lit(size)).alias("c"))
    t = cell.groupBy(F.expr("c div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(c % 64 as int)))").alias("m")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[t.column("w").to_numpy()] = t.column("m").to_numpy()
    return out.view(np.uint64)


def _of(docs: DataFrame, ids: DataFrame, repeated: bool, name: str, make: Callable[[np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    """(rep, name): what make returns for the full sets of the given representatives."""
    schema = pa.schema([("rep", pa.int64()), (name, pa.binary())])
    table = docs.sparkSession.sparkContext.broadcast(_filter_words(ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for b in batches:
            cell = b.column(0).to_numpy(zero_copy_only=False) % (64 * len(bits))
            b = b.filter(pa.array((bits[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for i, j, data, offs in passes(b.column(1)):
                yield batch_of(schema, b.column(0).slice(i, j - i), make(*distinct_shingles(data, offs)))

    texts = docs.select(docs["doc_id"].cast("bigint").alias("rep"), text_of(docs).alias("text")).where("rep is not null")
    made = texts.mapInArrow(run, f"rep bigint, {name} binary").join(ids, "rep", "left_semi")
    return made.dropDuplicates(["rep"]) if repeated else made


def _sets(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """(rep, shingles): full sets, written once as both sides of a link read them."""
    return stored(_of(docs, ids, repeated, "shingles", lambda h, heads: binaries(h, heads * 8)), "near-sets", "none")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets meet the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= THRESHOLD * (len(both) - same))
            keep = pa.array(keep, pa.bool_())
            yield batch_of(schema, b.column(0).filter(keep), b.column(1).filter(keep))

    one = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("t")), "b")
    both = one.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s")), "a")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a bigint, b bigint")


def _links(pairs: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    return stored(_confirmed(pairs, _sets(docs, ids, repeated)), "near-links")


def _open_postings(posts: DataFrame, comps: DataFrame, reps: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """What `_across` reads: the postings with several components, without their centres, dealt and sorted."""
    held = posts.join(comps, F.col("rep") == F.col("node"), "left").select("token", "place", "rep", F.coalesce("component", "rep").alias("comp"))
    lists = held.groupBy("token").agg(F.min("rep").alias("centre"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    block_size = F.least(F.greatest(F.lit(BLOCK), F.col("n") / SPREAD), F.lit(max(BLOCK, MOST_BLOCK)))
    lists = lists.where("lo < hi and n > 2").select("token", "centre", F.ceil((F.col("n") - 1) / block_size).cast("int").alias("blocks"))
    rest = stored(held.join(lists, "token").where("rep <> centre").select("token", "place", "rep", "comp", "blocks"), "near-open")
    ids = rest.select("rep").distinct()
    finer = _of(docs, ids, repeated, "content", contents)
    own = posts.join(ids, "rep", "left_semi").groupBy("rep").agg(F.collect_list("place").alias("places"))
    rest = rest.join(reps.select("rep", "n_shingles", "signature"), "rep").join(finer, "rep").join(own, "rep")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # Parts 0, 1, ... hold one block each; a negative part holds two, whose own pairs are skipped there.
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.when(k == F.col("block"), k).otherwise(-1 - (F.least(k, F.col("block")) * F.col("blocks") + F.greatest(k, F.col("block")))))
    return rest.withColumn("block", block).withColumn("part", F.explode(other)).repartition("token", "part").sortWithinPartitions("token", "part")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    sigs = stored(signatures(docs), "near-signatures")
    full = sigs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    key = ["n_shingles", "f1", "f2"]
    repeated = bool(full.groupBy("doc_id").count().where("count > 1").take(1))
    reps = stored(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("posted").alias("posted"), F.first("signature").alias("signature")), "near-classes")
    posts = stored(_postings(reps), "near-postings")

    centres = posts.groupBy("token").agg(F.min("rep").alias("centre"))
    star = posts.join(centres, "token").where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = _links(stored(_agreeing(star, reps), "near-stars"), docs, repeated)
    comps = components(links)

    # Each text's most alike partner first: that joins most of a family, and leaves few pairs across components.
    for best in (True, False):
        again = stored(_across(_open_postings(posts, comps, reps, docs, repeated), best).distinct(), "near-across")
        if not again.take(1):
            break
        links = links.unionByName(again.where("sure").select("a", "b"))
        if (open_ := again.where("not sure").select("a", "b").distinct()).take(1):
            links = links.unionByName(_links(open_, docs, repeated))
        comps = components(links)

    named = reps.select(*key, "rep").join(comps, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("component", "rep").alias("comp"))
    alone = sigs.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    own = full.select("doc_id", *key).join(named, key).select("doc_id", "n_shingles", F.col("comp").alias("component_id"))
    return own.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one text of each component, with the columns of docs."""
    gone = report(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*[docs[c] for c in docs.columns])
