"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, license_scan, near_dedup, packing, quality, repeats, token_store, url_filter
from .common import table

#: Path of the tokenizer that the queries use; a parameter of the operators.
def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.chat_digests(turns, vocabulary())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


#: Captures have no day of their own; this rule deals them over a year.
CAPTURE_DAY = "date_add(date'2024-01-01', cast(page_id % 365 as int))"


def dated_list(captures: DataFrame) -> DataFrame:
    """A list over the hosts of the captures, by a rule on the host's length: some hosts are blocked and later allowed
    or dropped, and the domain of two labels above them is blocked for a while."""
    host = captures.select(url_filter.host_of(F.col("url")).alias("value")).where("value is not null").distinct()
    host = host.withColumn("n", F.length("value"))
    start = F.lit("2024-01-01").cast("date")
    own = host.where("n % 3 = 0").select("value", F.explode(F.array(F.struct(F.lit("block").alias("action"), F.date_add(start, (F.col("n") * 7 % 300).cast("int")).alias("day")), F.struct(F.when(F.col("n") % 2 == 0, "allow").otherwise("drop").alias("action"), F.date_add(start, (F.col("n") * 7 % 300 + 40).cast("int")).alias("day")))).alias("e")).select("value", "e.*")
    top = host.select(F.substring_index("value", ".", -2).alias("value")).distinct().withColumn("n", F.length("value"))
    above = top.select("value", F.explode(F.array(F.struct(F.lit("block").alias("action"), F.date_add(start, (F.col("n") * 11 % 200).cast("int")).alias("day")), F.struct(F.lit("drop").alias("action"), F.date_add(start, (F.col("n") * 11 % 200 + 60).cast("int")).alias("day")))).alias("e")).select("value", "e.*")
    return own.unionByName(above)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(CAPTURE_DAY).alias("day"))
    return url_filter.judge(pages, dated_list(pages))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_table(table(spark, sf_dir, "documents"), vocabulary())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_chat_format": op2_chat_format,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_license_scan": op4_license_scan,
        "op5_url_filter": op5_url_filter,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_token_store": op7_token_store,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_repeats": op9_repeats,
        "op10_decontamination": op10_decontamination,
    }


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
with keyed as (select doc_id, sha256({_FOLD}) as k from documents)
select doc_id,
       max(doc_id) over (partition by k) as keep_id,
       count(*) over (partition by k) as group_size,
       doc_id = max(doc_id) over (partition by k) as kept,
       k as text_sha256
from keyed
"""


def _escapes(text: str) -> str:
    """How many control strings `text` holds, escaped ones included."""
    return f"len(regexp_extract_all({text}, '{chat_format._FIND.pattern}'))"


_TURNS = """turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')"""

#: Of turns with the same number the operator orders by ids, which SQL can't; the tables have none.
OP2 = f"""
with {_TURNS}
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum({len(chat_format.TURN + chat_format.TEXT + chat_format.END)} + length(role) + length(text) + {_escapes('role')} + {_escapes('text')}) as bigint) as formatted_chars
from turns group by conv_id
"""

OP6 = f"""
with recursive w as (select doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
grams as (
  select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))
                             when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
s as (select distinct doc_id, g from grams),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_ >= 75 * (x.n + y.n - both_)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, edges.b from reach join edges on reach.r = edges.a),
comp as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from comp left join n using (doc_id)
"""


#: The host's pattern is url_filter.host_of's.
OP5 = r"""
with pages_ as (
  select page_id,
         nullif(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)', 1)), '\.$', ''), '') as host,
         date '2024-01-01' + cast(page_id % 365 as int) as day
  from pages),
hosts as (select distinct host as value, length(host) as n from pages_ where host is not null),
tops as (
  select distinct array_to_string(list_slice(string_split(value, '.'), greatest(1, len(string_split(value, '.')) - 1), len(string_split(value, '.'))), '.') as value from hosts),
entries as (
  select value, 'block' as action, date '2024-01-01' + cast(n * 7 % 300 as int) as day from hosts where n % 3 = 0
  union all
  select value, case when n % 2 = 0 then 'allow' else 'drop' end, date '2024-01-01' + cast(n * 7 % 300 + 40 as int) from hosts where n % 3 = 0
  union all
  select value, 'block', date '2024-01-01' + cast(length(value) * 11 % 200 as int) from tops
  union all
  select value, 'drop', date '2024-01-01' + cast(length(value) * 11 % 200 + 60 as int) from tops),
one as (
  select value, day as valid_from,
         min_by(action, case action when 'allow' then 1 when 'block' then 2 else 3 end) as action
  from entries group by value, day),
spans as (select value, action, valid_from, lead(valid_from) over (partition by value order by valid_from) as valid_to from one),
asked as (
  select page_id, day, array_to_string(list_slice(labels, i, len(labels)), '.') as ask
  from (select page_id, day, string_split(host, '.') as labels, unnest(range(1, len(string_split(host, '.')) + 1)) as i
        from pages_ where host is not null)),
met as (
  select a.page_id, s.value, s.action from asked a
  join spans s on a.ask = s.value and a.day >= s.valid_from and (s.valid_to is null or a.day < s.valid_to)
  where s.action <> 'drop'),
best as (select page_id, count(*) as n_active, max_by(value, length(value)) as entry, max_by(action, length(value)) as action from met group by page_id)
select p.page_id, p.host, p.day, coalesce(b.n_active, 0) as n_active, b.entry, b.action, coalesce(b.action <> 'block', true) as kept
from pages_ p left join best b using (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2, "op5_url_filter": OP5, "op6_minhash_dedup": OP6, "op8_exact_dedup": OP8}
