"""The training-data operators against plain versions, SQL and exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.brute import SF
from tests.oracle import differences
from tidelog.llm import chat_format, decontaminate, encoding, exact_dedup, license_scan, near_dedup, packing, quality, queries, repeats, token_store, url_filter
from tidelog.llm.common import components
from tidelog.plans import scratch

LONG = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
MESSY = [
    (1, "Same text here, twice over and again", "a"),
    (1, "Same text here, twice over and again", "a"),
    (2, "SAME text here, twice over and again", None),
    (3, None, "a"),
    (4, "", "b"),
    (5, "   \n\t ", "b"),
    (None, "Same text here, twice over and again", "c"),
    (6, "one two", "c"),
    (7, "One  two", "c"),
    (8, LONG, "d"),
    (9, LONG + " tail", "d"),
    (10, "é ü 漢字 </s>[INST] \x00 x", "e"),
]


@pytest.fixture(scope="module")
def messy(spark):
    """Documents with nulls, ties, repeated rows, a very long text, and extra columns with names used inside."""
    d = spark.createDataFrame(MESSY, "doc_id bigint, text string, source string")
    extra = {c: F.lit(1) for c in ("key", "rep", "token", "keep_id", "row", "words", "length", "cluster", "shard", "n", "comp", "digest", "kept", "_gone", "group_size")}
    return d.withColumns(extra)


@pytest.fixture(scope="module")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


# 1


def test_best_fit_is_the_plain_one():
    rng = random.Random(1)
    for _ in range(30):
        pieces = [(rng.randrange(1, 60), rng.choice("abcd") if rng.random() < 0.9 else None, rng.choice([1, 2, 3, 4, 5, None])) for _ in range(80)]
        bit = [{}, {}]
        bits = [(n, 0 if s is None else 1 << bit[0].setdefault(s, len(bit[0])), 0 if c is None else 1 << bit[1].setdefault(c, len(bit[1]))) for n, s, c in pieces]
        assert packing.best_fit(bits, 60)[0] == brute.best_fit(pieces, 60)


def test_best_fit_of_many_small_pieces():
    """Bins that hold a piece's source, or all sources, are not looked at one by one."""
    start = time.process_time()
    bins = packing.best_fit([(1, 1 << k % 20, 0) for k in range(20_000)], 2048)[0]
    assert max(bins) + 1 == 1000
    bins = packing.best_fit([(1, 1, 1 << k % 3 if k % 2 else 0) for k in range(10_000)] + [(1, 0, 0)] * 10_000, 2048)[0]
    assert max(bins) + 1 == 10_000
    assert time.process_time() - start < 20


def check_bins(docs, places, capacity):
    """No bin overflows or conflicts, and each document's pieces tile it."""
    info = {}
    for r in docs.select("doc_id", packing.length_of(F.coalesce("text", F.lit(""))).alias("n"), "source", packing.cluster_of(F.coalesce("text", F.lit(""))).alias("c")).collect():
        info.setdefault(r["doc_id"], []).append(r)
    bins, pieces = {}, {}
    for p in places:
        bins.setdefault(p["bin_id"], []).append(p)
        pieces.setdefault(p["doc_id"], []).append(p)
    for b in bins.values():
        b.sort(key=lambda p: p["bin_offset"])
        at = 0
        for p in b:
            assert p["bin_offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity and all(p["bin_used"] == at for p in b)
        if len(b) > 1:
            for f in ("source", "c"):
                got = [info[p["doc_id"]][0][f] for p in b if info[p["doc_id"]][0][f] is not None]
                assert len(got) == len(set(got))
    for i, own in info.items():
        assert sum(p["length"] for p in pieces[i]) == sum(r["n"] for r in own)
    return bins


def test_packing(docs, messy, empty):
    bins = check_bins(docs, packing.pack(docs).collect(), packing.CAPACITY)
    assert len(bins) < docs.count()
    small = packing.pack(docs, capacity=300, shard_tokens=20_000).collect()
    check_bins(docs, small, 300)
    few = packing.pack(docs, shard_docs=30).collect()
    check_bins(docs, few, packing.CAPACITY)
    assert len({p["bin_id"].split("-")[0] for p in few}) > 4
    check_bins(messy, packing.pack(messy).collect(), packing.CAPACITY)
    assert packing.pack(empty).count() == 0


# 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "<", "[", "s>", "/s>", "|>", "a", " ", "INST]", "<\\s>", "[\\\\INST]"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    inside = chat_format.escape(text)
    assert chat_format.unescape(inside) == text
    assert not any(c in inside for c in chat_format.CONTROL)


def chat_want(turns):
    out = {}
    for c, _, role, text in turns:
        out.setdefault(c, []).append((role or "", text or ""))
    want = {}
    for c, t in out.items():
        loss = "".join(x for r, x in t if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(loss), sha(loss))
    return want


def test_chat(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn").collect()]
    turns += [(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op2_chat_format(spark, SF).collect()}
    assert got == chat_want(turns)


def test_chat_in_sql(spark):
    assert differences(spark, queries.op2_chat_format, queries.OP2) == []


def test_decoder():
    rng = np.random.default_rng(7)
    for path in (queries.vocabulary(), queries.vocabulary().replace("byte_bpe_50k", "word_bpe_49k")):
        ids, cuts = rng.integers(0, 49_000, 300), np.array([0, 0, 100, 250, 300])
        want = encoding.tokenizer(path).decode_batch([ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], skip_special_tokens=False)
        assert encoding.decoder(path).texts(ids, cuts) == want


def test_chat_edges(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, None, "x"), (None, 0, "assistant", "<|end|>"), (2, None, "assistant", LONG), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (3, 0, "<|text|>", "<|turn|>\\<|tu\\rn|>")]
    d = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit(1)).withColumn("start", F.lit(2))
    out = {r["conv_id"]: r for r in chat_format.chat_digests(d, queries.vocabulary()).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in out.items()} == chat_want(turns)
    a = chat_format.assemble(chat_format.format_turns(d, queries.vocabulary()))
    spans = sorted((r["start"], r["start"] + len(r["ids"])) for r in a.where("conv_id = 2").collect())
    assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    text = {(r["conv_id"], r["turn"]): r for r in a.where("conv_id in (1, 3)").collect()}
    assert text[1, 2]["formatted"] == "<|turn|><|text|>x<|end|>" and all(len(r["formatted"]) == r["formatted_chars"] for r in text.values())
    assert sum(r["formatted_chars"] for r in text.values() if r["conv_id"] == 3) == out[3]["formatted_chars"]
    assert chat_format.chat_digests(d.limit(0), queries.vocabulary()).count() == 0


# 3


def held_out(spark, sf):
    """Kept shares of the labelled documents with odd ids, trained on the labels of the even ones."""
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.report(d, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    shares = [F.avg(F.when(c, F.col("kept").cast("int"))) for c in (F.expr("quality = 1 and toxic = 0"), F.expr("toxic = 1"), F.expr("quality = 0"))]
    return tuple(got.agg(*shares).first())


def test_quality_on_held_out_labels(spark):
    good, toxic, low = held_out(spark, "/root/testdata/sf0.1")
    assert good > 0.96 and toxic < 0.4 and low < 0.1
    good, toxic, low = held_out(spark, "/root/testdata/sf0.01")  # 200 labels
    assert good > low + 0.3


def bucket_of(gram):
    from tidelog.llm.common import Words, mix, string_buffers

    w = Words(*string_buffers(pa.array([" ".join(gram)])))
    return int(mix(w.hashes(np.zeros(1, np.int64), len(gram)), len(gram))[0] >> np.uint64(64 - quality.BUCKET_BITS))


def test_quality_is_the_plain_one(spark, rows):
    """Weights, keys and the sampled set; the sample is that of no threshold on the weights."""
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    good = {i for i, q, t in labels if q == 1 and t == 0}
    want = brute.importance(rows, good, bucket_of, quality.SMOOTHING, quality.Z)
    got = {r["doc_id"]: r for r in queries.op3_quality_classifier(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i]["log_weight"] - w) < 1e-6 for i, w in want.items())
    assert sum(w != 0 for w in want.values()) > 0.75 * len(want)
    noise = {i: quality.Model(None, None, None, ()).keys(pa.array([i]), np.zeros(1))[0] for i in want}
    k = math.ceil(len(want) * (len(good) / len(labels) + quality.SPARE))
    top = sorted(want, key=lambda i: -(want[i] + noise[i]))[:k]
    assert {i for i, r in got.items() if r["kept"]} == set(top)
    assert max(want[i] for i in want if i not in top) > min(want[i] for i in top)
    x = np.array(sorted(noise.values()))
    assert abs(x.mean() - 0.5772) < 0.3 and abs(x.std() - 1.2825) < 0.3


def test_quality_edges(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0), (8, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    r = quality.report(messy, labels)
    assert r.count() == len(MESSY) and r.where("kept is null").count() == 0
    kept = quality.keep_good(messy, labels)
    assert kept.columns == messy.columns and kept.count() == r.where("kept").count() < len(MESSY)
    assert quality.report(empty, labels).count() == 0
    assert quality.report(messy, labels.limit(0)).where("kept").count() == len(MESSY)
    assert quality.report(messy, labels, share=0.0).where("kept").count() == 0


def test_kth_largest(spark):
    rng = random.Random(2)
    x = [round(rng.gauss(0, 1), 2) for _ in range(30_000)] + [5.0] * 50
    d = spark.createDataFrame([(v,) for v in x], "x double")
    for k in (1, 40, 60, 15_000, len(x)):
        assert quality.kth_largest(d, "x", k) == sorted(x, reverse=True)[k - 1]


# 4


def test_licenses(spark, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in queries.op4_license_scan(spark, SF).collect()}
    assert got == {i: brute.licenses(t, license_scan.PHRASES) for i, t in rows}


def test_license_labels(spark, rows):
    """Labels and score of whole texts and of damaged templates, against a plain version; also by a plain join."""
    rng = random.Random(12)
    made = [(i, t) for i, t in rows]
    for i in range(150):
        w = rng.choice(list(license_scan.TEMPLATES.values())).split()
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(0, 2)] = rng.choice([[], ["more"], ["x", "y"], w[:5]])
        made.append((10**6 + i, " ".join([*w, "mit", *w[: rng.randrange(1, 9)], "license"])))
    d = spark.createDataFrame(made, "doc_id bigint, text string")
    want = {i: brute.scan(t, license_scan.PHRASES, license_scan.TEMPLATES, license_scan.MIN_COVER, license_scan.NEIGHBOURS) for i, t in made}
    assert len({w[0] for w in want.values()}) > 8 and len({w[1] for w in want.values()}) > 15
    for most in (license_scan.BROADCAST_WORDS, 0):
        license_scan.BROADCAST_WORDS, before = most, license_scan.BROADCAST_WORDS
        try:
            got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(d).collect()}
        finally:
            license_scan.BROADCAST_WORDS = before
        assert got == want


def test_license_spans(spark, messy, empty):
    mit, gpl = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["gpl"]
    texts = [f"Before. {mit} after", mit.replace("free of charge", "quite free of any charge"), " ".join(gpl.split()[:8]), "Apache License MIT license, mit LICENSE", "the GNU general public license"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    r = {x["doc_id"]: x for x in license_scan.scan(d).collect()}
    assert r[0]["labels"] == "mit" and r[0]["base_labels"] == "" and r[0]["spans"][0]["first_word"] == 1 and r[0]["score"] == 1.0
    assert r[1]["labels"] == "" and r[1]["score"] == brute.scan(texts[1], {}, {"mit": mit}, 0.75, 4)[1] < 0.75
    assert r[2]["labels"] == "" and 0 < r[2]["score"] < 0.75
    assert (r[3]["n_base"], r[3]["first_word"], r[3]["last_word"], r[3]["base_labels"]) == (3, 0, 4, "apache,mit")
    assert (r[4]["n_base"], r[4]["first_word"], r[4]["score"]) == (1, 2, 1.0)
    m = license_scan.scan(messy)
    assert m.count() == len(MESSY) and m.where("score is null or labels is null").count() == 0
    assert license_scan.scan(empty).count() == 0


# 5


def test_urls(spark):
    assert differences(spark, queries.op5_url_filter, queries.OP5) == []


def test_url_edges(spark):
    day = lambda k: f"2024-01-{k:02d}"
    captures = [(1, "http://a.b.example.com/x", day(5)), (1, "http://a.b.example.com/x", day(5)), (2, "https://u:p@B.Example.com.:8080/", day(5)), (3, None, day(5)), (4, "no url", day(5)), (5, "http://b.example.com", None), (6, "http://b.example.com", day(20)), (7, "http://other.org", day(5)), (8, "http://" + "x." * 500 + "example.com/" + "y" * 100_000, day(5))]
    entries = [("example.com", "block", day(1)), ("b.example.com", "allow", day(3)), ("b.example.com", "block", day(3)), ("b.example.com", "drop", day(10)), (None, "block", day(1)), ("other.org", "block", None), ("other.org", "odd", day(1))]
    c = spark.createDataFrame(captures, "page_id bigint, url string, day string").withColumn("day", F.col("day").cast("date")).withColumn("action", F.lit("x")).withColumn("value", F.lit("y"))
    e = spark.createDataFrame(entries, "value string, action string, day string").withColumn("day", F.col("day").cast("date"))
    got = sorted((r["page_id"], r["n_active"], r["entry"], r["kept"]) for r in url_filter.judge(c, e).collect())
    assert got == [(1, 2, "b.example.com", True)] * 2 + [(2, 2, "b.example.com", True), (3, 0, None, True), (4, 0, None, True), (5, 0, None, True), (6, 1, "example.com", False), (7, 0, None, True), (8, 1, "example.com", False)]
    assert url_filter.judge(c.limit(0), e).count() == 0 and url_filter.judge(c, e.limit(0)).where("not kept").count() == 0


# 6


def near_got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_near_in_sql(spark):
    assert differences(spark, queries.op6_minhash_dedup, queries.OP6) == []


def test_near(docs, rows):
    assert near_got(near_dedup.report(docs)) == brute.near(rows)


def test_near_family(spark, monkeypatch):
    """A large family of near copies and a passage that many texts share, in small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    made = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        made.append((i, " ".join(w)))
    for i in range(150, 300):
        made.append((i, " ".join(base[:60] + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))])))
    d = spark.createDataFrame(made, "doc_id bigint, text string").repartition(5)
    assert near_got(near_dedup.report(d)) == brute.near(made)


def test_near_at_the_threshold(spark):
    """Pairs at 0.75 exactly, whose signatures agree in 78 or 79 of 128 coordinates."""
    made = []
    for i, seed in enumerate((204, 630, 1180)):
        r = random.Random(seed)
        head, *ends = ([f"w{r.randrange(10**6)}" for _ in range(n)] for n in (604, 100, 100))
        made += [(2 * i + k, " ".join(head + end)) for k, end in enumerate(ends)]
    want = brute.near(made)
    assert [v[1] for _, v in sorted(want.items())] == [0, 0, 2, 2, 4, 4]
    assert near_got(near_dedup.report(spark.createDataFrame(made, "doc_id bigint, text string"))) == want


def test_near_sketch_at_the_threshold(spark):
    """Large sets at 0.75 exactly, whose sketches come out below 71 %, are still told across components."""
    made = []
    for i, seed in enumerate((1262, 4744, 8655)):
        h = np.random.default_rng(seed).integers(0, 1 << 64, 10_000, dtype=np.uint64)
        one, two = (np.sort(np.concatenate([h[:7500], h[a : a + 1250]])) for a in (7500, 8750))
        s = near_dedup.contents(np.concatenate([one, two]), np.array([0, 8750, 17500])).to_pylist()
        made += [(i + 1, 0, 0, 2 * i + k, 2 * i + k, 8750, bytes(near_dedup.COORDINATES), s[k], [7 << 32 | i + 1], 7 << 32 | i + 1) for k in range(2)]
    open_ = spark.createDataFrame(made, "token bigint, part int, block int, rep bigint, comp bigint, n_shingles bigint, signature binary, content binary, places array<bigint>, place bigint")
    got = near_dedup._across(open_.coalesce(1).sortWithinPartitions("token", "part"), False)
    assert sorted(map(tuple, got.collect())) == [(0, 1, False), (2, 3, False), (4, 5, False)]


def test_near_contents():
    """What sets share by 32 bits of their hashes, and sketches of small sets next to large ones."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, k, replace=False)) for k in (0, 1, 100, 300, 511, 512, 513, 900)]
    heads = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    column = near_dedup.contents(np.concatenate(sets), heads)
    c = near_dedup.Contents(pa.chunked_array([column]), np.diff(heads))
    x, y = np.array([(i, j) for i in range(6) for j in range(6)]).T
    assert c.shared(x, y).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)]
    for i, j in ((5, 6), (4, 7), (6, 7)):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert abs(c.likeness(np.array([i]), np.array([j]))[0] - 100 * both / (len(sets[i]) + len(sets[j]) - both)) < 8


def test_near_pairs_stay_few(spark):
    """Of a family whose members are just more or just less alike than the threshold, only joining links are told."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    made = []
    for i in range(260):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        made.append((i, " ".join(w)))
    d = spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)
    sigs = near_dedup.signatures(d)
    reps = sigs.withColumn("rep", F.col("doc_id"))
    posts = near_dedup._postings(reps)
    open_ = near_dedup._open_postings(posts, spark.createDataFrame([], "node bigint, component bigint"), reps, d, False)
    told = near_dedup._across(open_.coalesce(1).sortWithinPartitions("token", "part"), False).collect()
    assert 100 < len({(r["a"], r["b"]) for r in told if r["sure"]}) < 2600


def test_near_edges(messy, empty):
    got = near_dedup.report(messy)
    assert got.count() == len(MESSY)
    g = near_got(got.where("doc_id is not null"))
    assert g[1][1:] == (1, True) and g[2][1:] == (1, False) and g[6][:2] == (1, 6) and g[7] == (1, 6, False)
    assert all(g[i] == (0, i, True) for i in (3, 4, 5)) and g[9][1] == 8
    assert got.where("doc_id is null and kept and component_id is null").count() == 1
    kept = near_dedup.drop_near(messy)
    assert kept.columns == messy.columns and sorted((r[0] is None, r[0]) for r in kept.select("doc_id").collect() if r[0] is not None) == [(False, i) for i in (1, 1, 3, 4, 5, 6, 8, 10)]
    assert near_dedup.report(empty).count() == 0


def test_components(spark):
    chain = [(k + 1, k) for k in range(100, 160)] + [(500, 400), (500, 450), (450, 7), (9, 9)] + [(1000 + k, 1000) for k in range(1, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and {got[k] for k in (7, 400, 450, 500)} == {7} and all(got[1000 + k] == 1000 for k in range(300))


# 7


def test_tokens(spark, rows):
    t = encoding.tokenizer(queries.vocabulary())
    want, at = [], 0
    for i, x in sorted(rows):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids[len(ids) // 2]))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op7_token_store(spark, SF).collect()) == want


def test_token_positions(spark, docs, rows):
    """Ids by their position over the whole store, in small segments."""
    t = encoding.tokenizer(queries.vocabulary())
    ids = [i for _, x in sorted(rows) for i in [*t.encode(x, add_special_tokens=False).ids, 2]]
    segments = token_store.write_segments(docs, queries.vocabulary(), segment_ids=700)
    assert segments.count() > 50 and all(r["n_tokens"] <= 700 or len(r["doc_ids"]) == 1 for r in segments.select("n_tokens", "doc_ids").collect())
    rng = random.Random(8)
    at = sorted({0, len(ids) - 1, *(rng.randrange(len(ids)) for _ in range(3000))})
    asked = spark.createDataFrame([(k,) for k in [*at, -1, len(ids), 10**12, None]], "position bigint")
    for stride in (500, 1 << 18):
        assert sorted(map(tuple, token_store.ids_at(segments, asked, stride).collect())) == [(k, ids[k]) for k in at]


def test_other_vocabularies(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello  World, it's", "", "a\nB 12"]
    ids, n = encoding.encoder(path).encode(pa.array(texts))
    want = [encoding.tokenizer(path).encode(x, add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == list(map(len, want))


PIECES = ["a", "the", "$$$", "12", "'ll", "aZ9", "-a", "antidisestablishmentarianisms", "ñandú", "É", " ", "  ", "\n", ",", ".", "_", "'s", "$", "é", "3", ".5", "\t", "\x00", " ", "<|endoftext|>", "漢", "́", "-", " ,", "\r\n", "b,c", "x.", "\n\n"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=10).map("".join), min_size=1, max_size=4))
def test_pieces_encode_like_the_whole(texts):
    ids, n = encoding.encoder(queries.vocabulary()).encode(pa.array(texts, pa.string()))
    whole = [encoding.tokenizer(queries.vocabulary()).encode(x, add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == [i for w in whole for i in w] and n.tolist() == list(map(len, whole))


def test_pieces_number_each_key_once():
    rng = np.random.default_rng(9)
    pieces, seen = encoding.Pieces(16), {}
    for _ in range(40):
        keys = rng.integers(0, 4, (rng.integers(0, 60), 3)).astype(np.uint64)
        got, new = pieces.find(keys, len(seen))
        for k in new.tolist():
            seen[tuple(keys[k].tolist())] = len(seen)
        assert len(set(seen.values())) == len(seen) and got.tolist() == [seen[tuple(x)] for x in keys.tolist()]


def test_codes():
    rng = np.random.default_rng(5)
    for n in (0, 1, 511, 512, 513, 4000):
        x = rng.integers(0, 1 << 32, n).astype(np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        c = token_store.Codes(token_store.pack(x))
        assert len(c) == n and (c.all() == x).all() and [c[i] for i in range(n)] == x.tolist()
        some = rng.integers(0, n, 2 * n) if n else np.zeros(0, np.int64)
        assert (c.at(some) == x[some]).all()
    with pytest.raises(IndexError):
        c.at(np.array([4000]))
    with pytest.raises(IndexError):
        c[4000]
    with pytest.raises(ValueError):
        token_store.Codes(b"DAC2xxxxxxxxxxxxxxxx")


def test_token_edges(messy, empty):
    got = token_store.token_table(messy, queries.vocabulary())
    r = sorted(got.collect(), key=lambda r: r["start"])
    assert len(r) == len(MESSY) and r[0]["doc_id"] is None and [x["doc_id"] for x in r[1:]] == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert all(x["start"] + x["n_tokens"] == y["start"] for x, y in zip(r, r[1:], strict=False))
    assert {x["doc_id"]: x["n_tokens"] for x in r}[3] == 1
    assert token_store.token_table(empty, queries.vocabulary()).count() == 0


# 8


def test_exact(spark):
    assert differences(spark, queries.op8_exact_dedup, queries.OP8) == []


def test_exact_edges(messy, empty):
    for most in (exact_dedup.MAX_CELLS, 1 << 12):
        r = exact_dedup.report(messy, max_cells=most)
        got = sorted(((x["doc_id"], x["keep_id"], x["group_size"], x["kept"]) for x in r.collect()), key=repr)
        assert (None, 2, 4, False) in got and got.count((1, 2, 4, False)) == 2 and (2, 2, 4, True) in got
        assert (3, 4, 2, False) in got and (4, 4, 2, True) in got and (5, 5, 1, True) in got and len(got) == len(MESSY)
    kept = exact_dedup.drop_copies(messy)
    assert kept.columns == messy.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == [2, 4, 5, 6, 7, 8, 9, 10]
    assert exact_dedup.report(empty).count() == 0


def test_exact_groups_only_what_may_repeat(spark, monkeypatch):
    """Rows of a kind that occurs once stay out of the grouping, also where the rows are many times the dense cells."""
    rows = spark.range(40_000).select("id", F.when(F.col("id") < 300, F.col("id") % 100).otherwise(F.col("id")).cast("string").alias("text"))
    seen = {}

    def watch(df, name, *rest):
        out = scratch.stored(df, name, *rest)
        seen[name] = out
        return out

    monkeypatch.setattr(exact_dedup, "stored", watch)
    r = exact_dedup.report(rows.withColumnRenamed("id", "doc_id"), max_cells=1 << 12)
    assert r.where("not kept").count() == 200 and r.where("group_size = 3").count() == 300
    assert seen["exact-repeated"].count() < 350
    assert 100 <= seen["exact-groups"].count() < 1000


def test_exact_drops_rows_not_ids(spark):
    made = [(7, "A", 1), (7, "B", 1), (9, "a", 1), (None, "A", 1), (None, "C", 1), (None, "D", 1), (None, "d", 1), (None, None, 1), (3, "", 1), (7, "A", 2)]
    d = spark.createDataFrame(made, "doc_id bigint, text string, _own int")
    kept = exact_dedup.drop_copies(d)
    assert kept.columns == d.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(7, "B", 1), (9, "a", 1), (None, "C", 1), (None, "D", 1), (None, "d", 1), (3, "", 1)], key=repr)


# 9


def repeat_got(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_repeats(docs, rows):
    assert repeat_got(repeats.report(docs)) == brute.repeats(rows)


def test_repeats_generated(spark):
    rng = random.Random(6)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(20, 140))) for _ in range(12)]
    made = [(i, "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(8)))) for i in range(200)]
    made += [(200, "q" * 500), (201, "q" * 120), (202, "zq" * 90), (203, "q" * 49)]
    d = spark.createDataFrame(made, "doc_id bigint, text string").repartition(6)
    assert repeat_got(repeats.report(d)) == brute.repeats(made)


def test_repeats_bits_are_of_shared_anchors(spark, monkeypatch, docs, rows):
    """A bit table far smaller than the anchors are many stays nearly empty, and a full one changes no result."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(33, 127, 20_000).astype(np.uint8).tobytes().decode() for _ in range(60)]
    made = [(i, t + texts[0][:5000]) for i, t in enumerate(texts)]
    table = repeats.shared_cells(repeats._key_column(spark.createDataFrame(made, "doc_id bigint, text string").repartition(6)), 32, 17, 32)
    data = np.frombuffer(texts[0][:5000].encode(), np.uint8)
    shared = np.unique(repeats.anchors(data, np.array([0, len(data)]))[1] >> np.uint64(47)).astype(np.int64)
    assert (table[shared >> 3] >> (shared & 7).astype(np.uint8) & 1).all()
    assert np.unpackbits(table).sum() < len(shared) + 200
    monkeypatch.setattr(repeats, "MAX_CELL_BITS", 16)
    assert repeat_got(repeats.report(docs)) == brute.repeats(rows)


def test_maximal_repeats():
    rng = np.random.default_rng(0)
    for _ in range(100):
        size = rng.integers(3, 12, rng.integers(2, 6))
        data = rng.integers(97, 99, int(size.sum())).astype(np.uint8)
        at = np.cumsum(size) - size
        got = {(n, tuple(sorted(w))) for n, w in repeats.maximal_repeats(data, at, size, 3)}
        texts = [data[a : a + n].tobytes() for a, n in zip(at, size, strict=True)]
        where = {}
        for c, s in enumerate(texts):
            for i in range(len(s)):
                for j in range(i + 3, len(s) + 1):
                    where.setdefault(s[i:j], []).append((c, i))
        want = set()
        for w, o in where.items():
            left = {texts[c][i - 1] if i else (c, i) for c, i in o}
            right = {texts[c][i + len(w)] if i + len(w) < len(texts[c]) else (c, i) for c, i in o}
            if len(o) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(w), tuple(sorted(o))))
        assert got == want


def test_repeat_edges(messy, empty):
    got = repeats.report(messy)
    r = {x["doc_id"]: x for x in got.collect()}
    assert got.count() == len(MESSY) and r[9]["n_removed"] == len(LONG) and r[8]["n_removed"] == 0
    nulls = [x for x in got.collect() if x["doc_id"] is None]
    own = [t or "" for i, t, *_ in MESSY if i is None]
    assert sorted((x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in nulls) == sorted((len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for t in own)
    assert r[3]["n_bytes"] == 0 and r[1]["n_removed"] == 0
    assert repeats.report(empty).count() == 0


# 10


def test_leaks(spark, docs, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in queries.op10_decontamination(spark, SF).collect()}
    assert got == {k: round(v, 9) for k, v in brute.leaks(rows, items).items()}
    clean = decontaminate.clean(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert clean.count() == docs.count() - len({i for i, _ in got}) and clean.columns == docs.columns


def test_item_blocks_count_words_on_lines(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 10)
    made = [(i, sep.join(f"w{i}x{k}" for k in range(6))) for i, sep in enumerate(["\n", "\t", " ", "\r\n", "  "])] + [(5, ""), (6, None)]
    items = spark.createDataFrame(made, "item_id bigint, text string").coalesce(1)
    assert [[i for i, _ in b] for b in decontaminate.item_blocks(items)] == [[0], [1], [2], [3], [4, 5, 6]]


def test_leaks_generated(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 5, 9, 20, 40, 60])] + [(100, None), (101, "  ")]
    made = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(0, 80))]
        k, x = rng.choice(items[:7])
        x = x.split()
        for _ in range(rng.randrange(0, 4)):
            x[rng.randrange(len(x))] = word()
        at = rng.randrange(len(w) + 1)
        made.append((i, " ".join(w[:at] + x + w[at:])))
    d = spark.createDataFrame(made, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    want = {k: round(v, 9) for k, v in brute.leaks(made, [(k, x or "") for k, x in items]).items()}
    for most in (decontaminate.ITEM_WORDS, 30):
        monkeypatch.setattr(decontaminate, "ITEM_WORDS", most)
        assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.find(d, b).collect()} == want


def test_leak_edges(spark, messy, empty):
    b = spark.createDataFrame([(1, LONG[:300]), (2, "one two")], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find(messy, b).collect())
    assert got == [(6, 2), (7, 2), (8, 1), (9, 1)]
    kept = decontaminate.clean(messy, b)
    assert kept.columns == messy.columns and kept.count() == len(MESSY) - 4
    assert decontaminate.find(empty, b).count() == 0 and decontaminate.find(messy, b.limit(0)).count() == 0


# The pipeline


def test_pipeline_on_messy_documents(messy, empty, spark):
    """Nulls, repeated ids and rows, empty and very long texts, extra columns: every stage keeps rows and columns in shape."""
    import corpus_pipeline

    d = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0
        out = stage(spark, d, SF)
        assert out.columns == messy.columns
        out.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/messy-{name}")
        kept = spark.read.schema(messy.schema).parquet(path)
        assert kept.exceptAll(d).count() == 0
        d = kept if name != "quality" else messy  # 12 documents teach the classifier nothing
    assert sorted((r[0] is not None, r[0] or 0) for r in d.select("doc_id").collect()) == [(True, i) for i in (2, 4, 5, 6, 8, 10)]
    places = corpus_pipeline.STAGES[-1][1](spark, d, SF).collect()
    check_bins(d, places, packing.CAPACITY)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    d, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == docs.columns
        d.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
        d = spark.read.parquet(path)
        kept.append({r["doc_id"]: r["text"] for r in d.collect()})
    quality_, exact, near_, clean = kept
    largest = {}
    for i, t in quality_.items():
        k = (t or "").translate(brute.FOLD)
        largest[k] = max(i, largest.get(k, -1))
    assert set(exact) == set(largest.values())
    assert set(near_) == {i for i, v in brute.near([(i, t or "") for i, t in exact.items()]).items() if v[2]}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == set(near_) - {i for i, _ in brute.leaks([(i, t or "") for i, t in near_.items()], items)}
    places = corpus_pipeline.run(spark, SF).collect()
    assert {p["doc_id"] for p in places} == set(clean)
    check_bins(d, places, packing.CAPACITY)
