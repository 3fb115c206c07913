"""Scenarios of the key-value engine."""

from __future__ import annotations

import random
import struct

import pytest

from tidelog import cli, workload
from tidelog.functions import keys
from tidelog.functions.ranks import with_rank
from tidelog.operators import compaction as C
from tidelog.operators import layout, reads, replay
from tidelog.plans.store import Store
from tidelog.sources import binary, commands
from tidelog.streaming import ingest

LOG = "user_key int, seq_num bigint, write_type string, user_val int"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def visible(df):
    return {r["user_key"]: r["user_val"] for r in df.collect()}


def identity(lo, hi, seq=0, kind="P"):
    return [(i, seq + i, kind, i if kind == "P" else None) for i in range(lo, hi)]


def test_key_order(spark):
    d = log(spark, [(1, 1, "P", 0), (0, 100, "P", 0), (0, 1000, "P", 0)])
    assert [(r[0], r[1]) for r in reads.ordered(d).collect()] == [(0, 1000), (0, 100), (1, 1)]


def test_newest_delete_hides_and_a_later_put_shows(spark):
    d = log(spark, [(1, 0, "P", 5), (1, 1, "D", None), (2, 2, "D", None), (3, 3, "P", 1), (3, 4, "D", None), (3, 5, "P", 9), (4, 6, "P", None)])
    assert visible(reads.snapshot(d)) == {3: 9, 4: None}
    assert visible(reads.snapshot(d, 1)) == {1: 5}
    assert visible(reads.get(d, 1)) == {} and visible(reads.get(d, 99)) == {}


def test_strings_as_values(spark):
    d = spark.createDataFrame([(1, 0, "P", "a"), (1, 1, "P", "b"), (2, 2, "D", None)], "user_key int, seq_num bigint, write_type string, user_val string")
    assert visible(reads.snapshot(d)) == {1: "b"}


def test_range_ends(spark):
    d = log(spark, [(k, i, "P", k) for i, k in enumerate([-(2**31), -5, 0, 7, 2**31 - 1])])
    assert list(visible(reads.range_scan(d, -5, 7))) == [-5, 0]
    assert visible(reads.range_scan(d, 7, 7)) == {}
    assert list(visible(reads.range_scan(d, 7))) == [7, 2**31 - 1]
    r = spark.createDataFrame([(1, -(2**31), 2**31 - 1), (2, 0, 1), (3, 5, 5)], "range_id int, a int, b int")
    got = sorted((x["range_id"], x["user_key"]) for x in reads.multi_range(d, r).collect())
    assert got == [(1, -(2**31)), (1, -5), (1, 0), (1, 7), (2, 0)]


def test_two_sources_merge(spark):
    d = log(spark, identity(0, 963) + identity(0, 200, 963, "D") + identity(1163, 1926, 963))
    assert reads.snapshot(d).count() == 763 + 763
    counts = C.merge_counts(d).first()
    assert counts["rows_in"] == counts["rows_out"] + counts["rows_merged"]


def test_validate(spark):
    bad = keys.validate(log(spark, [(1, 1, "P", 1), (2, 1, "P", 1), (3, 2, "X", 1)]))
    assert sorted(r["problem"] for r in bad.collect()) == ["null or unknown", "seq not unique", "seq not unique"]


def test_rank_is_dense(spark):
    d = spark.range(1000).selectExpr("id * 7 % 1000 as x").repartition(7)
    got = with_rank(d, [d["x"]], "r", 5).collect()
    assert all(r["r"] == r["x"] + 5 for r in got)


def test_bloom(spark):
    rows = spark.range(1000).selectExpr("0 as g", "cast(id as int) as user_key")
    f = layout.bloom_filters(rows, "g")
    inside = layout.bloom_probe(f, rows.selectExpr("g", "user_key as key"), "g")
    assert inside.where("not maybe").count() == 0
    outside = layout.bloom_probe(f, spark.range(1000, 6000).selectExpr("0 as g", "cast(id as int) as key"), "g")
    assert outside.where("maybe").count() / 5000 < 0.02


def test_record_codec(spark):
    rows = [(1, 2, "P", 3), (-7, 2**40, "D", 0), (2**31 - 1, 0, "P", -(2**31)), (300, 255, "P", 256)]
    encoded = binary.encode_log(log(spark, rows))
    assert encoded.first()["record"] == bytearray(struct.pack("<iQBi", 1, 2, 1, 3))
    assert sorted(tuple(r) for r in binary.decode_log(encoded).collect()) == sorted(rows)


def test_pair_files(spark, tmp_path):
    pairs = [(i * 1000 - 5, -i * 300) for i in range(500)]
    (tmp_path / "0.dat").write_bytes(b"".join(struct.pack("<ii", *p) for p in pairs))
    d = binary.read_pairs(spark, str(tmp_path / "0.dat"))
    assert [(r["key"], r["val"]) for r in d.orderBy("pos").collect()] == pairs
    g = binary.pair_bytes(d.selectExpr("0 as g", "pos", "key", "val"), "g", "pos", "key", "val").first()
    assert bytes(g["content"]) == (tmp_path / "0.dat").read_bytes()
    (tmp_path / "bad.dat").write_bytes(b"123")
    with pytest.raises(Exception, match="multiple of 8"):
        binary.read_pairs(spark, str(tmp_path / "bad.dat")).count()


def test_parser(spark):
    lines = ["p 1 2", "put  +3\t-4", "", "   ", "g 5", "r 3 1", "r 1 1", "d 2147483648", "x 1", "p 1", 'l "0.dat"', "load 1.dat", "s", "q", "get 1.5", "g  -2147483648"]
    d = commands.parse(spark.createDataFrame(list(enumerate(lines)), "pos bigint, line string"))
    got = {r["pos"]: (r["op"], r["a"], r["b"], r["file"], r["error"]) for r in d.collect()}
    assert got[0] == ("p", 1, 2, None, None) and got[1] == ("p", 3, -4, None, None) and 2 not in got and 3 not in got
    assert got[5][4] == "Range ends before it begins" and got[6][:3] == ("r", 1, 1) and got[7][4] == "Not a 32-bit integer"
    assert got[8][4] == got[9][4] == "Unrecognized command" and got[10][3] == "0.dat" and got[11][3] == "1.dat"
    assert got[12][0] == "s" and got[13][0] == "q" and got[14][4] == "Not a 32-bit integer" and got[15][1] == -(2**31)
    for k, line in enumerate(lines):
        one = cli.parse_line(line)
        assert (one is None) == (k not in got)
        if one is not None:
            assert (one if isinstance(one, str) else one[0]) == (got[k][4] or got[k][0])


def run_dict(w):
    state, out = {}, {}
    for pos, op, a, b in w:
        if op == "p":
            state[a] = b
        elif op == "g":
            out[pos] = state.get(a)
        elif op == "d":
            out[pos] = a in state
            state.pop(a, None)
        elif op == "r":
            out[pos] = " ".join(f"{k}:{state[k]}" for k in sorted(state) if a <= k < b)
    return state, out


def random_workload(seed, n=1500):
    rng = random.Random(seed)
    rows = []
    for pos in range(n):
        op = rng.choice("pppggdr")
        a = rng.randrange(-60, 60)
        rows.append((pos, op, a, rng.randrange(1000) if op == "p" else a + rng.randrange(50) if op == "r" else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_a_dict(spark, seed):
    rows = random_workload(seed)
    _, want = run_dict(rows)
    w = spark.createDataFrame(rows, "pos bigint, op string, a int, b int")
    got = {r["pos"]: r["val"] for r in replay.replay_gets(w).collect()}
    got |= {r["pos"]: r["succeeded"] for r in replay.replay_deletes(w).collect()}
    got |= {r["pos"]: r["entries"] for r in replay.replay_ranges(w).collect()}
    assert got == want
    s = replay.workload_stats(w).first()
    assert s["successful_gets"] == sum(want[p] is not None for p, op, *_ in rows if op == "g")
    assert s["failed_deletes"] == sum(not want[p] for p, op, *_ in rows if op == "d")


def test_loads_in_a_replay(spark):
    w = spark.createDataFrame([(0, "p", 1, 1, None), (1, "l", None, None, "x/0.dat"), (2, "g", 7, None, None)], "pos bigint, op string, a int, b int, file string")
    pairs = spark.createDataFrame([("f/0.dat", 0, 7, 70), ("f/0.dat", 1, 7, 71)], "file string, pos bigint, key int, val int")
    d = replay.expand_loads(w, pairs)
    assert [(r["op"], r["a"], r["b"]) for r in d.orderBy("pos").collect()] == [("p", 1, 1), ("l", None, None), ("p", 7, 70), ("p", 7, 71), ("g", 7, None)]
    assert [r["val"] for r in replay.replay_gets(d).collect()] == [71]


def meta(num, run, level, lo, hi, seq=None, size=10):
    return C.FileMeta(level, run, num, f"f{num}", size, 1, lo, seq or num, hi, seq or num)


def test_overlap_closure_is_transitive():
    files = [meta(1, 1, 0, 0, 10), meta(2, 2, 0, 8, 20), meta(3, 3, 1, 18, 30), meta(4, 4, 1, 40, 50)]
    assert [f.file_num for f in C.closure(files[0], files)] == [1, 2, 3]


def test_policy():
    c = C.Config.small()
    assert c.flush_rows() == 963 and C.Config().flush_rows() == 246_723 and c.level_bytes(0) == 114_688
    assert C.next_plan([meta(i, i, 0, 0, 9) for i in range(4)], c) is None
    assert C.level_state([meta(i, i, 0, 0, 9) for i in range(5)], 0, c) == C.TOO_MANY_RUNS
    plan = C.next_plan([meta(1, 1, 0, 0, 9, size=200_000), meta(2, 2, 1, 5, 15)], c)
    assert plan.level == 1 and len(plan.inputs) == 2 and plan.purge
    assert not C.plan_vertical([meta(1, 1, 0, 0, 9, size=200_000), meta(5, 5, 2, 5, 6)], 0, c).purge


def test_store_against_a_dict(spark, tmp_path):
    config = C.Config(fanout=2, memtable_bytes=17 * 60, file_bytes=17 * 40, run_capacity=2)
    rng, state = random.Random(3), {}
    store = Store.open(spark, str(tmp_path / "s"), config)
    for batch in range(6):
        rows = [(i, "p" if rng.random() < 0.7 else "d", rng.randrange(50), rng.randrange(1000)) for i in range(40)]
        for _, op, a, b in rows:
            state.update({a: b}) if op == "p" else state.pop(a, None)
        store.apply(spark.createDataFrame(rows, "pos bigint, op string, a int, b int"))
        if batch in (2, 4):  # twice, with writes in between
            store = Store.open(spark, str(tmp_path / "s"), config)
        assert {r["key"]: r["val"] for r in store.snapshot().collect()} == state
        assert store.overlapping().count() == 0
    assert store.manifest.next_seq == 240 and max(f.level for f in store.manifest.files) < config.max_levels
    store.compact()
    assert store.log().where("write_type = 'D'").count() == 0
    assert {r["key"]: r["val"] for r in store.range(10, 30).collect()} == {k: v for k, v in sorted(state.items()) if 10 <= k < 30}
    some = next(iter(state))
    assert [r["val"] for r in store.get(some).collect()] == [state[some]]
    assert store.vacuum() > 0 and {r["key"]: r["val"] for r in store.snapshot().collect()} == state
    with pytest.raises(ValueError):
        store.snapshot(as_of=0)


def test_last_level_comes_to_rest(spark, tmp_path):
    """Disjoint runs beyond any bound of size stay where they are; too many of them become one run."""
    c = C.Config(fanout=2, memtable_bytes=17 * 60, file_bytes=17 * 40, run_capacity=2, max_levels=2)
    files = [meta(i, i, 1, 10 * i, 10 * i + 5, size=10**9) for i in range(2)]
    assert C.level_state(files, 1, c) == C.NORMAL and C.next_plan(files, c) is None
    plan = C.next_plan([*files, meta(5, 5, 1, 90, 95, size=10**9)], c)
    assert plan.level == 1 and len({f.run for f in plan.inputs}) == 2
    store = Store.open(spark, str(tmp_path / "s"), c)
    for k in range(5):
        store.put_many(spark.range(1000 * k, 1000 * k + 200).selectExpr("cast(id as int) as key", "1 as val"))
    assert C.next_plan(store.manifest.files, c) is None and store.maintain() == 0
    assert store.snapshot().count() == 1000


def test_two_writers(spark, tmp_path):
    """A commit that meets another one is refused as a whole, and the store goes on from the other's."""
    from tidelog.plans.manifest import Conflict

    a, b = (Store.open(spark, str(tmp_path / "s")) for _ in range(2))
    a.put(1, 10)
    with pytest.raises(Conflict):
        b.put(2, 20)
    b.put(3, 30)
    again = Store.open(spark, str(tmp_path / "s"))
    assert {r["key"]: r["val"] for r in again.snapshot().collect()} == {1: 10, 3: 30} == {r["key"]: r["val"] for r in b.snapshot().collect()}
    with pytest.raises(Conflict):
        a.flush()
    assert a.manifest == again.manifest
    a.flush()
    assert {r["key"] for r in Store.open(spark, str(tmp_path / "s")).snapshot().collect()} == {1, 3}


def test_a_batch_comes_in_once(spark, tmp_path):
    rows = spark.createDataFrame([(0, "p", 1, 1), (1, "p", 1, 2)], "pos bigint, op string, a int, b int")
    store = Store.open(spark, str(tmp_path / "s"))
    assert store.apply(rows, ("in", 4)) == 2
    for s in (store, Store.open(spark, str(tmp_path / "s"))):
        assert s.apply(rows, ("in", 4)) == 0 and s.apply(rows, ("in", 3)) == 0
    assert store.apply(rows.limit(0), ("in", 5)) == 0 and store.apply(rows, ("in", 5)) == 0 and store.apply(rows, ("other", 0)) == 2
    assert store.manifest.next_seq == 4


def test_scopes(spark):
    import os

    from tidelog.plans.scratch import scope, scratch_root, stored

    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with scope(spark):
        with scope(spark):
            stored(spark.range(3), "inner")
            kept = stored(spark.range(4), "outer", outlive=True)
        assert [x for x in set(os.listdir(root)) - before if x.startswith("inner")] == [] and kept.count() == 4
    assert set(os.listdir(root)) == before


def test_manifest_round_trip():
    from tidelog.plans.manifest import Manifest

    m = Manifest(version=3, next_seq=9, files=[meta(1, 1, 0, -5, 5)], wal=[("b", 4, 5)])
    assert Manifest.decode(m.encode()) == m and Manifest.decode(Manifest().encode()) == Manifest()
    assert m.tree()["levels"][0]["runs"][0]["files"][0]["min_key"] == -5


def test_command_line(spark, tmp_path):
    (tmp_path / "x.dat").write_bytes(struct.pack("<iiii", 500, 70_000, -1, -300))
    store = Store.open(spark, str(tmp_path / "c"))
    script = ["p 1 10", "p 2 20", "g 1", "d 1", "g 1", "r 0 5", "r 7 9", "what", f'l "{tmp_path}/x.dat"', "g 500", "r -5 600", "h", "q", "g 2"]
    out = list(cli.run(store, script))
    assert out[:6] == ["10", "2:20", "", "Unrecognized command", "70000", "-1:-300"] and out[6:8] == ["2:20", "500:70000"] and "range" in out[8] and len(out) == 9


def test_stats_lines(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "t"))
    store.apply(spark.createDataFrame([(0, "p", 5, 1), (1, "p", -3, 2)], "pos bigint, op string, a int, b int"))
    store.flush()
    out = list(cli.stats_lines(store))
    assert out[0].startswith("level 0: Min = [-3 | 1]    Max = [5 | 0]") and out[1].startswith("  run") and out[2].startswith("    file")
    assert out[3:] == ["level 1: NaN", "level 2: NaN", "level 3: NaN"]


def test_generator_and_evaluator(spark, tmp_path):
    own = ["generate", "--puts", "300", "--gets", "80", "--ranges", "5", "--deletes", "20", "--gets-misses-ratio", "0.3", "--gaussian-ranges"]
    said = []
    for name, more in (("plain", []), ("files", ["--external-puts"])):
        args = cli.arguments().parse_args([*own, *more, "--out", str(tmp_path / name)])
        cli.generate(spark, args)
        said.append(dict(x.split(": ") for x in cli.evaluate(spark, str(tmp_path / name))))
        assert float(said[-1].pop("TIME_ELAPSED")) > 0
    assert int(said[1].pop("LOADS")) > 0 == int(said[0].pop("LOADS"))
    assert said[0] == said[1] and said[0]["PUTS"] == "300" and said[0]["RANGES"] == "5"
    assert int(said[0]["SUCCESSFUL_GETS"]) + int(said[0]["FAILED_GETS"]) == 80 and int(said[0]["SUCCESSFUL_GETS"]) > 40


def test_ephemeral_store(spark):
    import os

    store = Store.open(spark)
    store.put(1, 2)
    path = store.folder.path
    store.close()
    assert not os.path.exists(path)


def test_workload(spark):
    w = workload.Workload(puts=400, gets=200, ranges=20, deletes=30, misses=0.3, skew=0.2)
    d = workload.generate(spark, w)
    rows = [tuple(r) for r in d.orderBy("pos").collect()]
    assert [r[0] for r in rows] == list(range(650)) and rows[0][1] == "p"
    assert rows == [tuple(r) for r in workload.generate(spark, w).orderBy("pos").collect()]
    assert all(r[2] <= r[3] for r in rows if r[1] == "r")
    put, gets = {}, []
    for r in rows:
        if r[1] == "p":
            put.setdefault(r[2], r[0])
    assert all(put[r[2]] < r[0] for r in rows if r[1] == "d")
    gets = [r[2] for r in rows if r[1] == "g"]
    assert all(put[r[2]] < r[0] for r in rows if r[1] == "g" and r[2] in put) and 0.15 < sum(k not in put for k in gets) / 200 < 0.45
    assert 15 < len(gets) - len(set(gets)) < 120
    parsed = commands.parse(workload.lines(d))
    assert parsed.where("error is not null").count() == 0
    assert [tuple(r) for r in parsed.select("pos", "op", "a", "b").orderBy("pos").collect()] == rows
    blocks = {}
    for r in workload.put_blocks(d).orderBy("pos").collect():
        if r["op"] == "p":
            blocks.setdefault(r["block"], []).append(r["pos"])
    assert all(p == list(range(p[0], p[0] + len(p))) for p in blocks.values())
    with pytest.raises(ValueError):
        workload.Workload(puts=0)
    # Puts moved into files and loaded again make the same workload.
    moved, files = workload.externalize(d)
    content = {r["file"]: bytes(r["content"]) for r in files.collect()}
    assert sum(map(len, content.values())) == 8 * 400
    pairs = [(f, i, *p) for f, c in content.items() for i, p in enumerate(struct.iter_unpack("<ii", c))]
    back = replay.expand_loads(moved, spark.createDataFrame(pairs, "file string, pos bigint, key int, val int"))
    assert [tuple(r) for r in back.where("op <> 'l'").select("op", "a", "b").orderBy("pos").collect()] == [r[1:] for r in rows]


def test_streaming_into_a_store(spark, tmp_path):
    rows = [(i, "p" if i % 3 else "d", i % 10, i) for i in range(30)]
    spark.createDataFrame(rows, "pos bigint, op string, a int, b int").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("pos bigint, op string, a int, b int").parquet(str(tmp_path / "in"))
    ingest.run_to_store(s, str(tmp_path / "s"), str(tmp_path / "cp"))
    want, _ = run_dict([(p, o, a, b) for p, o, a, b in rows])
    assert {r["key"]: r["val"] for r in Store.open(spark, str(tmp_path / "s")).snapshot().collect()} == want


def test_get_reads_only_files_that_can_hold_the_key(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "p"), C.Config(file_bytes=17 * 100))
    store.put_many(spark.range(1000).selectExpr("cast(id as int) as key", "cast(id as int) as val"), "key")
    store.flush()
    assert len(store.manifest.files) > 5
    assert len(store.log(5, 5).inputFiles()) <= 2
    plan = store.get(5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_key), EqualTo(user_key,5)]" in plan


SF = "/root/testdata/sf0.001"


def test_fence_lookup_of_every_customer(spark):
    from tidelog import queries
    from tidelog.sources.changelog import orders_log

    fences = {}
    for b in layout.blocks(orders_log(spark, SF)).collect():
        fences.setdefault(b["run"], []).append((b["fence_key"], b["block"], b["min_key"]))
    want = []
    for (k,) in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect():
        for run, own in fences.items():
            if met := [(block, k >= low) for fence, block, low in sorted(own) if fence >= k]:
                want.append((k, run, *met[0]))
    got = [tuple(r) for r in queries.kv_fence_lookup(spark, SF).collect()]
    assert sorted(got) == sorted(want) and any(k % 10 for k, *_ in got)


def test_fence_lookup_edges(spark):
    """Keys of any size, repeated and null ones, runs of very many blocks."""
    big = 1 << 40
    runs = {0: [(0, 5, 9), (1, 10, 10), (2, 40, big)], 1: [(0, -big, -big)], 2: [(b, 7 * b - 3000, 7 * b - 2996) for b in range(700)], 3: [(0, 3, 3)]}
    fences = spark.createDataFrame([(run, *b) for run, own in runs.items() for b in own], "run bigint, block bigint, min_key bigint, fence_key bigint")
    asked = [*range(-3100, 2000, 3), 9, 10, 11, 11, big, big + 1, -big, -big - 1, -(1 << 31) - 1, None]
    want = []
    for k in asked:
        for run, own in runs.items():
            if k is not None and (met := [(block, k >= low) for block, low, fence in own if fence >= k]):
                want.append((k, run, *met[0]))
    got = layout.fence_lookup(fences, spark.createDataFrame([(k,) for k in asked], "id bigint"), "id")
    assert got.columns == ["key", "run", "block", "may_hold"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert layout.fence_lookup(fences.where("run < 0"), spark.range(5), "id").count() == layout.fence_lookup(fences, spark.range(0), "id").count() == 0


def test_key_order_of_the_whole_log(spark):
    from tidelog import queries
    from tidelog.sources.changelog import orders_log

    rows = [(r["user_key"], r["seq_num"], r["write_type"]) for r in orders_log(spark, SF).collect()]
    want = [(*r, i) for i, r in enumerate(sorted(rows, key=lambda r: (r[0], -r[1])))]
    assert len(want) > 100 and [tuple(r) for r in queries.kv_key_order(spark, SF).collect()] == want


def test_lines_of_many_files_keep_their_order(spark, tmp_path):
    from tests.oracle import differences
    from tidelog import queries

    folder = tmp_path / "many [1] {x}"
    folder.mkdir()
    numbers = [*range(30), 99999, 100000]
    for n in reversed(numbers):
        (folder / f"part-{n:05}").write_text(f"g {n}\n\nd {n}\n")
    (folder / "_SUCCESS").write_text("p 1 1\n")
    want = [(3 * i + j, line) for i, n in enumerate(numbers) for j, line in enumerate((f"g {n}", "", f"d {n}"))]
    escaped = str(folder).replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}")
    assert [tuple(r) for r in commands.read_lines(spark, escaped).orderBy("pos").collect()] == want
    (tmp_path / "empty").mkdir()
    assert commands.read_lines(spark, str(tmp_path / "empty")).count() == 0
    # The query, with a text of many files.
    query, sql = next((q, sql) for name, q, sql in queries.ALL if name == "kv_text_workload")
    held = {"spark.sql.shuffle.partitions": "25", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert differences(spark, query, sql) == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
