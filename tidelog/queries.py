"""Queries over the driver's tables, with the same in SQL.

EV is events keyed by user, where an error deletes; ORD is orders keyed by customer, where status F deletes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import key_order
from tidelog.functions.ranks import with_rank
from tidelog.operators import compaction, layout, reads, replay
from tidelog.plans.scratch import scratch_path
from tidelog.plans.store import Store
from tidelog.sources import binary, commands
from tidelog.sources.changelog import events_log, orders_log
from tidelog.streaming import ingest
from tidelog.workload import Workload, generate

Query = Callable[[SparkSession, str], DataFrame]

EV = "ev as (select user_id as k, event_id as seq, event_type = 'error' as del, value as v from events)"
ORD = "ord as (select o_custkey as k, o_orderkey as seq, o_orderstatus = 'F' as del, o_totalprice as v from orders)"


def _visible(log: str, where: str = "true") -> str:
    return f"(select k, seq, v from (select *, row_number() over (partition by k order by seq desc) as n from {log} where {where}) where n = 1 and not del)"


def _as_entries(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_key").alias("key"), F.col("user_val").alias("val"))


# Reads


def kv_snapshot_events(spark, sf):
    return reads.snapshot(events_log(spark, sf)).select(F.col("user_key").alias("key"), "seq_num", F.col("user_val").alias("val"))


def kv_snapshot_orders(spark, sf):
    return reads.snapshot(orders_log(spark, sf)).select(F.col("user_key").alias("key"), "seq_num", F.col("user_val").alias("val"))


def kv_get_hit(spark, sf):
    return _as_entries(reads.get(orders_log(spark, sf), 10))


def kv_get_deleted(spark, sf):
    """Every key whose newest version is a delete, asked for: none is visible."""
    log = orders_log(spark, sf)
    gone = reads.newest(log).where("write_type = 'D'").select(F.col("user_key").alias("key"))
    return reads.multi_get(log, gone).select("key", F.col("user_val").alias("val"))


def kv_get_missing(spark, sf):
    return _as_entries(reads.get(orders_log(spark, sf), -1))


def kv_multi_get(spark, sf):
    probes = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("key"))
    return reads.multi_get(orders_log(spark, sf), probes).select("key", F.col("user_val").alias("val"))


def kv_range(spark, sf):
    return _as_entries(reads.range_scan(orders_log(spark, sf), 20, 80))


def kv_range_empty(spark, sf):
    return _as_entries(reads.range_scan(orders_log(spark, sf), 50, 50))


def kv_range_unbounded(spark, sf):
    return _as_entries(reads.range_scan(orders_log(spark, sf), 60))


def kv_multi_range(spark, sf):
    ranges = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("range_id"), F.col("c_custkey").alias("a"), (F.col("c_custkey") + F.col("c_custkey") % 40).alias("b"))
    return reads.multi_range(orders_log(spark, sf), ranges).select("range_id", F.col("user_key").alias("key"), F.col("user_val").alias("val"))


def kv_as_of(spark, sf):
    return reads.snapshot(orders_log(spark, sf), 1000).select(F.col("user_key").alias("key"), "seq_num", F.col("user_val").alias("val"))


def kv_versions(spark, sf):
    return reads.versions(events_log(spark, sf)).select(F.col("user_key").alias("key"), "seq_num", "write_type", "valid_to", F.col("user_val").alias("val"))


def kv_key_order(spark, sf):
    """The whole log in its order, each row with its place in it."""
    return reads.ordered(with_rank(orders_log(spark, sf), key_order())).select("user_key", "seq_num", "write_type", "rank")


# Commands


def command_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A workload of one line per order: half puts, then gets, ranges, deletes, blank and broken lines."""
    d = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey") % 12
    c, v = F.col("o_custkey").cast("string"), F.floor("o_totalprice").cast("bigint").cast("string")
    line = (
        F.when(k < 5, F.concat(F.lit("p "), c, F.lit(" "), v))
        .when(k == 5, F.concat(F.lit("put  "), c, F.lit("\t-"), v))
        .when(k < 8, F.concat(F.lit("g "), c))
        .when(k == 8, F.concat(F.lit("r "), c, F.lit(" "), (F.col("o_custkey") + 30).cast("string")))
        .when(k == 9, F.concat(F.lit("delete "), c))
        .when(k == 10, F.when(F.col("o_custkey") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit("p "), c)))
        .otherwise(F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("r "), c, F.lit(" -1"))).otherwise(F.concat(F.lit("g "), c, F.lit("00000000000"))))
    )
    return d.select(F.col("o_orderkey").alias("pos"), line.alias("line"))


LINES = """cmd as (
  select o_orderkey as pos, o_orderkey % 12 as k, cast(o_custkey as int) as c, cast(floor(o_totalprice) as int) as v from orders),
w as (
  select pos,
         case when k < 6 then 'p' when k < 8 then 'g' when k = 8 then 'r' when k = 9 then 'd' end as op,
         c as a,
         case when k < 5 then v when k = 5 then -v when k = 8 then c + 30 end as b
  from cmd where k < 10)"""


def kv_parse(spark, sf):
    return commands.parse(command_lines(spark, sf)).select("pos", "op", "a", "b", "error")


def kv_text_workload(spark, sf):
    """The same lines, blank ones included, written as text and read again: their places in the text and what they say."""
    path = scratch_path(spark, "lines")
    command_lines(spark, sf).repartitionByRange("pos").sortWithinPartitions("pos").select("line").write.text(path)
    return commands.parse(commands.read_lines(spark, path)).select("pos", "op", "a", "b", "error")


def _workload(spark, sf) -> DataFrame:
    return commands.parse(command_lines(spark, sf)).where("error is null")


def kv_replay_get(spark, sf):
    return replay.replay_gets(_workload(spark, sf))


def kv_replay_range(spark, sf):
    return replay.replay_ranges(_workload(spark, sf))


def kv_replay_delete(spark, sf):
    return replay.replay_deletes(_workload(spark, sf))


def kv_workload_stats(spark, sf):
    return replay.workload_stats(_workload(spark, sf))


# Layout


def kv_flush_runs(spark, sf):
    return layout.run_metadata(orders_log(spark, sf))


def kv_blocks_fences(spark, sf):
    return layout.blocks(orders_log(spark, sf))


def kv_sst_files(spark, sf):
    return layout.files(reads.newest(orders_log(spark, sf)))


def kv_fence_lookup(spark, sf):
    """Every customer, looked up in every run."""
    probes = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("key"))
    return layout.fence_lookup(layout.blocks(orders_log(spark, sf)), probes)


def kv_visible_counts(spark, sf):
    return layout.key_counts(orders_log(spark, sf))


def kv_merge_counts(spark, sf):
    return compaction.merge_counts(layout.flush_runs(orders_log(spark, sf)))


def kv_overlap_pairs(spark, sf):
    return compaction.overlap_pairs(layout.run_metadata(orders_log(spark, sf)))


def kv_level_state(spark, sf):
    """Level 0 after all flushes, against the small configuration's bounds."""
    c = compaction.Config.small()
    d = layout.run_metadata(orders_log(spark, sf)).agg(F.count("*").alias("runs"), F.sum("bytes").alias("bytes"))
    state = F.when(F.col("bytes") > c.level_bytes(0), compaction.TOO_LARGE).when(F.col("runs") > c.run_capacity, compaction.TOO_MANY_RUNS).otherwise(compaction.NORMAL)
    return d.withColumn("state", state)


def kv_after_compaction(spark, sf):
    """Flushed runs, merged in two steps with deletes kept, then once more without: the snapshot."""
    runs = layout.flush_runs(orders_log(spark, sf))
    first = compaction.merge(runs.where("run % 2 = 0").drop("run")).unionByName(compaction.merge(runs.where("run % 2 = 1").drop("run")))
    return compaction.merge(first, purge=True).select(F.col("user_key").alias("key"), "seq_num", F.col("user_val").alias("val"))


def kv_bloom_false_negatives(spark, sf):
    """Members of each run that its Bloom filter denies, and how many were asked."""
    rows = layout.flush_runs(orders_log(spark, sf))
    asked = layout.bloom_probe(layout.bloom_filters(rows, "run"), rows.select("run", F.col("user_key").alias("key")), "run")
    return asked.agg(F.count("*").alias("asked"), F.count_if(~F.col("maybe")).alias("false_negatives"))


# Store


def _commands_of(log: DataFrame) -> DataFrame:
    return log.select(F.col("seq_num").alias("pos"), F.when(F.col("write_type") == "P", "p").otherwise("d").alias("op"), F.col("user_key").cast("int").alias("a"), F.floor("user_val").cast("int").alias("b"))


def _filled(spark, sf, **config) -> Store:
    """A store with all orders, in two batches."""
    store = Store.open(spark, scratch_path(spark, "store"), compaction.Config(**config))
    w = _commands_of(orders_log(spark, sf))
    store.apply(w.where("pos % 2 = 0"))
    store.apply(w.where("pos % 2 = 1"))
    return store


def kv_store_snapshot(spark, sf):
    """A store that flushes and merges on the way, read at the end."""
    return _filled(spark, sf, fanout=2, memtable_bytes=16 << 10, file_bytes=64 << 10).snapshot()


def kv_recover(spark, sf):
    """The same after it is opened again, with one batch still in the write-ahead log."""
    store = _filled(spark, sf, memtable_bytes=1 << 40)
    again = Store.open(spark, store.folder.path, store.config)
    again.put(-5, 7)
    third = Store.open(spark, store.folder.path, store.config)
    return third.snapshot()


def kv_stats(spark, sf):
    store = _filled(spark, sf, memtable_bytes=1 << 40)
    store.compact()
    d = store.stats().where("run is null").select("level", "rows", "min_key", "max_key")
    return d.withColumn("deletes_left", F.lit(store.log().where("write_type = 'D'").count()))


def kv_load_roundtrip(spark, sf):
    """Pairs written as binary records and decoded again, values over 255 and negative ones included."""
    d = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") % 7).alias("g"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("int").alias("user_key"), F.lit("P").alias("write_type"), (F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1)).cast("int").alias("user_val"), F.col("o_orderkey").alias("seq_num"))
    return binary.decode_log(binary.encode_log(d))


def kv_stream_snapshot(spark, sf):
    """The events as a stream of files, reduced with streaming state."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    log = s.select(F.col("user_id").alias("user_key"), F.col("event_id").alias("seq_num"), F.when(F.col("event_type") == "error", "D").otherwise("P").alias("write_type"), F.col("value").alias("user_val"))
    out = ingest.run_to_table(ingest.snapshot_stream(log), f"stream_{uuid.uuid4().hex}", scratch_path(spark, "stream"))
    return out.select(F.col("user_key").alias("key"), "seq_num", F.col("user_val").alias("val"))


def kv_generate(spark, sf):
    """A generated workload of as many puts as there are orders: how many commands of each kind, and how many break its
    rules (a first command that isn't a put, places that aren't dense, a range that ends before it begins, a value where
    none belongs, a delete of a key that no put before it has)."""
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    w = generate(spark, Workload(puts=n, gets=n // 10, ranges=n // 100, deletes=n // 50, misses=0.3, skew=0.2))
    first = w.where("op = 'p'").groupBy("a").agg(F.min("pos").alias("since"))
    d = w.join(first, "a", "left")
    bad = F.expr("(pos = 0 and op <> 'p') or (op = 'r' and a > b) or (op in ('p', 'r')) <> (b is not null) or (op = 'd' and not coalesce(since < pos, false))")
    counts = d.groupBy("op").agg(F.count("*").alias("count"), F.count_if(bad).alias("broken"))
    holes = w.agg(F.max("pos") + 1 - F.countDistinct("pos")).first()[0]
    return counts.withColumn("broken", F.col("broken") + F.lit(holes))


_OUT = "select k as key, seq as seq_num, v as val from "
_ENTRY = "select k as key, v as val from "
_RUNS = "runs as (select * from (select *, seq // 963 as run, row_number() over (partition by seq // 963, k order by seq desc) as n from ord) where n = 1)"
_META = """came as (select seq // 963 as run, count(*) as rows_in from ord group by 1),
meta as (select run, rows_in, count(*) as rows_out, count(*) filter (where del) as deletes, min(k) as min_key, max(k) as max_key,
                ((count(*) + 239) // 240 + 3) * 4096 as bytes from runs join came using (run) group by run, rows_in)"""
_BLOCKS = """ranked as (select *, (row_number() over (partition by run order by k, seq desc) - 1) // 240 as block from runs),
blocks as (select run, block, count(*) as block_rows, min(k) as min_key, max(k) as fence_key, max_by(seq, k) as fence_seq from ranked group by run, block)"""
_SEEN = f"""{LINES},
keyed as (select *, last_value(case when op in ('p', 'd') then struct_pack(o := op, b := b) end ignore nulls) over (partition by a order by pos rows between unbounded preceding and 1 preceding) as l from w where op in ('p', 'g', 'd')),
seen as (select pos, op, a, coalesce(l.o = 'p', false) as found, case when l.o = 'p' then l.b end as val from keyed)"""

#: Name, query, SQL (None where there is none).
ALL: list[tuple[str, Query, str | None]] = [
    ("kv_snapshot_events", kv_snapshot_events, f"with {EV} {_OUT}{_visible('ev')}"),
    ("kv_snapshot_orders", kv_snapshot_orders, f"with {ORD} {_OUT}{_visible('ord')}"),
    ("kv_get_hit", kv_get_hit, f"with {ORD} {_ENTRY}{_visible('ord', 'k = 10')}"),
    ("kv_get_deleted", kv_get_deleted, f"with {ORD} select k as key, cast(null as double) as val from (select k, max_by(del, seq) as d from ord group by k) where d"),
    ("kv_get_missing", kv_get_missing, f"with {ORD} {_ENTRY}{_visible('ord', 'k = -1')}"),
    ("kv_multi_get", kv_multi_get, f"with {ORD} select c_custkey as key, v as val from customer left join {_visible('ord')} on k = c_custkey"),
    ("kv_range", kv_range, f"with {ORD} {_ENTRY}{_visible('ord', 'k >= 20 and k < 80')}"),
    ("kv_range_empty", kv_range_empty, f"with {ORD} {_ENTRY}{_visible('ord', 'k >= 50 and k < 50')}"),
    ("kv_range_unbounded", kv_range_unbounded, f"with {ORD} {_ENTRY}{_visible('ord', 'k >= 60')}"),
    ("kv_multi_range", kv_multi_range, f"with {ORD} select c_custkey as range_id, k as key, v as val from customer join {_visible('ord')} on k >= c_custkey and k < c_custkey + c_custkey % 40"),
    ("kv_as_of", kv_as_of, f"with {ORD} {_OUT}{_visible('ord', 'seq < 1000')}"),
    ("kv_versions", kv_versions, f"with {EV} select k as key, seq as seq_num, case when del then 'D' else 'P' end as write_type, lead(seq) over (partition by k order by seq) as valid_to, v as val from ev"),
    ("kv_key_order", kv_key_order, f"with {ORD} select k as user_key, seq as seq_num, case when del then 'D' else 'P' end as write_type, row_number() over (order by k, seq desc) - 1 as rank from ord"),
    (
        "kv_parse",
        kv_parse,
        """with cmd as (select o_orderkey as pos, o_orderkey % 12 as k, cast(o_custkey as int) as c, cast(floor(o_totalprice) as int) as v from orders)
select pos, case when k < 6 then 'p' when k < 8 then 'g' when k = 8 then 'r' when k = 9 then 'd' end as op,
       case when k < 10 then c end as a,
       case when k < 5 then v when k = 5 then -v when k = 8 then c + 30 end as b,
       case when k = 10 then 'Unrecognized command' when k = 11 and c % 2 = 0 then 'Range ends before it begins' when k = 11 then 'Not a 32-bit integer' end as error
from cmd where not (k = 10 and c % 2 = 0)""",
    ),
    (
        "kv_text_workload",
        kv_text_workload,
        """with cmd as (select row_number() over (order by o_orderkey) - 1 as pos, o_orderkey % 12 as k, cast(o_custkey as int) as c, cast(floor(o_totalprice) as int) as v from orders)
select pos, case when k < 6 then 'p' when k < 8 then 'g' when k = 8 then 'r' when k = 9 then 'd' end as op,
       case when k < 10 then c end as a,
       case when k < 5 then v when k = 5 then -v when k = 8 then c + 30 end as b,
       case when k = 10 then 'Unrecognized command' when k = 11 and c % 2 = 0 then 'Range ends before it begins' when k = 11 then 'Not a 32-bit integer' end as error
from cmd where not (k = 10 and c % 2 = 0)""",
    ),
    ("kv_replay_get", kv_replay_get, f"with {_SEEN} select pos, a as key, found, val from seen where op = 'g'"),
    (
        "kv_replay_range",
        kv_replay_range,
        f"""with {LINES},
spans as (select * from (select a as key, b as val, op, pos as vfrom, lead(pos) over (partition by a order by pos) as vto from w where op in ('p', 'd')) where op = 'p'),
met as (select r.pos, s.key, s.val from w r join spans s on r.op = 'r' and s.key >= r.a and s.key < r.b and s.vfrom < r.pos and (s.vto is null or r.pos < s.vto)),
hits as (select pos, count(*) as n, string_agg(cast(key as varchar) || ':' || cast(val as varchar), ' ' order by key) as e from met group by pos)
select pos, a, b, coalesce(n, 0) as n_entries, coalesce(e, '') as entries from w left join hits using (pos) where op = 'r'""",
    ),
    ("kv_replay_delete", kv_replay_delete, f"with {_SEEN} select pos, a as key, found as succeeded from seen where op = 'd'"),
    (
        "kv_workload_stats",
        kv_workload_stats,
        f"""with {_SEEN}
select count(*) filter (where op = 'p') as puts,
       count(*) filter (where op = 'g' and found) as successful_gets, count(*) filter (where op = 'g' and not found) as failed_gets,
       count(*) filter (where op = 'd' and found) as successful_deletes, count(*) filter (where op = 'd' and not found) as failed_deletes,
       (select count(*) from w where op = 'r') as ranges, (select count(*) from w where op = 'l') as loads from seen""",
    ),
    ("kv_flush_runs", kv_flush_runs, f"with {ORD}, {_RUNS}, {_META} select * from meta"),
    ("kv_blocks_fences", kv_blocks_fences, f"with {ORD}, {_RUNS}, {_BLOCKS} select * from blocks"),
    ("kv_sst_files", kv_sst_files, f"with {ORD}, newest as (select k, max(seq) as seq from ord group by k), ranked as (select *, (row_number() over (order by k) - 1) // 2881 as file from newest) select file, count(*) as file_rows, min(k) as min_key, max(k) as max_key from ranked group by file"),
    (
        "kv_fence_lookup",
        kv_fence_lookup,
        f"""with {ORD}, {_RUNS}, {_BLOCKS},
hits as (select c_custkey as key, run, min(block) as block from customer join blocks on fence_key >= c_custkey group by 1, 2)
select key, h.run, h.block, key >= min_key as may_hold from hits h join blocks b on h.run = b.run and h.block = b.block""",
    ),
    ("kv_visible_counts", kv_visible_counts, f"with {ORD}, d as (select k, count(*) as n, max_by(del, seq) as gone from ord group by k) select cast(sum(n) as bigint) as versions, count(*) as all_keys, count(*) filter (where not gone) as visible_keys from d"),
    ("kv_merge_counts", kv_merge_counts, f"with {ORD}, {_RUNS} select count(*) as rows_in, count(distinct k) as rows_out, count(*) - count(distinct k) as rows_merged from runs"),
    ("kv_overlap_pairs", kv_overlap_pairs, f"with {ORD}, {_RUNS}, {_META} select a.run as run_a, b.run as run_b from meta a join meta b on a.run < b.run and a.min_key <= b.max_key and a.max_key >= b.min_key"),
    ("kv_level_state", kv_level_state, f"with {ORD}, {_RUNS}, {_META} select count(*) as runs, cast(sum(bytes) as bigint) as bytes, case when sum(bytes) > 114688 then 'size exceeded' when count(*) > 4 then 'run count exceeded' else 'normal' end as state from meta"),
    ("kv_after_compaction", kv_after_compaction, f"with {ORD} {_OUT}{_visible('ord')}"),
    ("kv_bloom_false_negatives", kv_bloom_false_negatives, f"with {ORD}, {_RUNS} select count(*) as asked, cast(0 as bigint) as false_negatives from runs"),
    ("kv_store_snapshot", kv_store_snapshot, f"with ord as (select o_custkey as k, (o_orderkey % 2) * 1000000000 + o_orderkey as seq, o_orderstatus = 'F' as del, o_totalprice as v from orders) select cast(k as int) as key, cast(floor(v) as int) as val from {_visible('ord')}"),
    ("kv_recover", kv_recover, f"with ord as (select o_custkey as k, (o_orderkey % 2) * 1000000000 + o_orderkey as seq, o_orderstatus = 'F' as del, o_totalprice as v from orders) select cast(k as int) as key, cast(floor(v) as int) as val from {_visible('ord')} union all select -5, 7"),
    (
        "kv_stats",
        kv_stats,
        f"with ord as (select o_custkey as k, (o_orderkey % 2) * 1000000000 + o_orderkey as seq, o_orderstatus = 'F' as del, o_totalprice as v from orders) select cast(3 as int) as level, count(*) as rows, cast(min(k) as int) as min_key, cast(max(k) as int) as max_key, cast(0 as bigint) as deletes_left from {_visible('ord')}",
    ),
    ("kv_load_roundtrip", kv_load_roundtrip, "select cast(o_custkey as int) as user_key, o_orderkey as seq_num, 'P' as write_type, cast(floor(o_totalprice) * case when o_orderkey % 2 = 0 then -1 else 1 end as int) as user_val from orders"),
    ("kv_stream_snapshot", kv_stream_snapshot, f"with {EV} {_OUT}{_visible('ev')}"),
    ("kv_generate", kv_generate, "with n as (select count(*) as n from orders) select 'p' as op, n as count, 0::bigint as broken from n union all select 'g', n // 10, 0 from n union all select 'r', n // 100, 0 from n union all select 'd', n // 50, 0 from n"),
]


def queries() -> dict[str, Query]:
    return {name: q for name, q, _ in ALL}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in ALL if sql}
