"""Queries of state over time, event logs, stories and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality, questions, state, stories
from ..streaming import live
from .common import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("select user_id, event_id, event_type, round(value, 4) as value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"), "ts")
    return state.latest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("select event_id, user_id from events where ts >= (select max(ts) from events) - interval 1 day")
def ttl_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return state.younger(e, "ts", e.agg(F.max("ts").alias("now")), 86_400).select("event_id", "user_id")


@query("""with e as (select event_id as id, event_id % 3 <> 0 as asks, user_id as question_hash, event_type as revision, epoch_us(ts) as us from events),
a as (select * from e where not asks),
q as (select e.id, e.question_hash, e.revision, e.us, max(struct_pack(us := a.us, id := a.id, revision := a.revision)) as s
  from e left join a on a.question_hash = e.question_hash and a.us <= e.us where e.asks group by all)
select id as ask_id, coalesce(revision = s.revision and q.us - s.us < 86400000000 and not exists (select 1 from q as b
  where b.question_hash = q.question_hash and b.s = q.s and b.revision <> b.s.revision and (b.us < q.us or b.us = q.us and b.id < q.id)), false) as hit from q""")
def answer_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("event_id").alias("ask_id"), F.col("user_id").alias("question_hash"), F.col("event_type").alias("revision"), F.col("ts").cast("timestamp").alias("ts"))
    return state.cache_hits(e.filter("ask_id % 3 <> 0"), e.filter("ask_id % 3 = 0").withColumnRenamed("ask_id", "answer_id"), 86400)


@query("""with l as (select user_id as key, max(ts) as last_access, max(event_id) as seq from events group by user_id)
select key, row_number() over (order by last_access desc, seq desc) as place from l qualify place <= 50""")
def lru_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.lru(_events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq")), 50).select("key", "place")


@query("""with e as (select user_id as trace_id, event_id as seq, event_type as type, cast(json_extract(props, '$.k') as integer) % 10 as id, props as payload from events)
select trace_id, seq, type, id, payload from e where type in ('signup', 'error') union all
select trace_id, min(seq), type, id, arg_max(payload, seq) from e where type in ('click', 'view') group by trace_id, type, id""")
def event_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("id"), F.col("props").alias("payload"))
    return state.compact(e, ["signup", "error"], ["click", "view"])


@query("""with s as (select conv_id as trace_id, turn as seq, list(md5(text)) over (partition by conv_id order by turn) as items, lead(turn) over (partition by conv_id order by turn) is null as final from conversations),
v as (select *, case when final then items else items[1:greatest(0, len(items) - 1)] end as shown from s),
b as (select *, coalesce(len(lag(shown) over (partition by trace_id order by seq)), 0) as n_before from v)
select trace_id, seq, n_before, array_to_string(shown[n_before + 1 :], ',') as added, final from b""")
def snapshot_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("seq"), F.collect_list(F.md5("text")).over(w).alias("items"))
    return state.deltas(s).withColumn("added", F.array_join("added", ","))


@query("select event_id, round(sum(value) over (partition by user_id order by epoch_us(ts) range between 60000000 preceding and current row), 4) as used from events")
def token_window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.window_sum(_events(spark, sf_dir), "user_id", "ts", "value", 60).select("event_id", "used")


@query("""with g as (select event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by epoch_us(ts)) as gap from events) select event_id, user_id from g where gap is null or gap >= 60000000""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.throttle(_events(spark, sf_dir), "user_id", "ts", 60_000).select("event_id", "user_id")


@query("""select event_id, epoch_us(ts) // 1000 - first_value(epoch_us(ts) // 1000) over w as since_start_ms, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over w as since_last_ms from events window w as (partition by user_id order by ts, event_id)""")
def timer_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.timer_marks(_events(spark, sf_dir), "user_id", "ts", ["event_id"]).select("event_id", "since_start_ms", "since_last_ms")


@query("""with u as (select user_id as key, case when event_id % 2 = 0 then value::bigint end as a, case when event_id % 3 = 0 then 2 end as b, case when event_id % 5 = 0 then 7 end as c, case when event_id % 7 = 0 then 1 end as d from events)
select key, sum(coalesce(a, b, 0))::bigint as input, sum(coalesce(c, d, 0))::bigint as output, sum(coalesce(a, b, 0) + coalesce(c, d, 0))::bigint as total from u group by key""".replace("value::bigint", "floor(value)::bigint"))
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.when(i % 2 == 0, F.floor("value")).alias("inputTokens"), F.when(i % 3 == 0, 2).alias("promptTokens"), F.when(i % 5 == 0, 7).alias("outputTokens"), F.when(i % 7 == 0, 1).alias("completionTokens"))
    return state.usage(rows)


@query("select event_type as area, count(*) as n, max(event_id) as last_id from events where event_type in ('error', 'view') group by 1")
def degraded_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).filter(F.col("event_type").isin("error", "view")).select(F.col("event_type").alias("area"), F.col("event_id").alias("ts"))
    return state.degraded(rows).withColumnRenamed("last_at", "last_id")


@query("""with d as (select doc_id, concat(case when doc_id % 4 = 0 then concat(': note', chr(10)) else '' end, case when doc_id % 3 = 0 then '' else concat('event: ', lang, chr(10)) end, 'data: ', case when doc_id % 7 = 0 then '{bad' else concat('{"k":', doc_id, '}') end, chr(10)) as raw, lang from documents)
select doc_id as id, case when doc_id % 3 = 0 then 'message' else lang end as event, concat('{"k":', doc_id, '}') as data from d where doc_id % 7 <> 0""")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, nl = F.col("doc_id"), F.lit("\n")
    raw = F.concat(F.when(d % 4 == 0, ": note\n").otherwise(""), F.when(d % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("event: "), "lang", nl)), F.lit("data: "), F.when(d % 7 == 0, F.lit("{bad")).otherwise(F.concat(F.lit('{"k":'), d.cast("string"), F.lit("}"))), nl)
    return state.parse_sse(table(spark, sf_dir, "documents").select(d.alias("id"), raw.alias("raw")))


@query("""select conv_id as story_id, count(*) as chapter_count, arg_min(md5(text), turn) as title, arg_max(md5(text), turn) as last_question, max(turn) as updated from conversations group by conv_id order by updated desc, story_id limit 50""")
def story_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.summaries(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("story_id"), F.col("turn").alias("seq"), F.md5("text").alias("question")))


@query("""with c as (select conv_id as story_id, turn as seq, text, row_number() over (partition by conv_id order by turn desc) as back from conversations where trim(text) <> ''),
k as (select *, row_number() over (partition by story_id order by seq) as place from c where back <= 4)
select story_id, place, case when length(text) <= 200 then text when regexp_extract(text[:200], '(?s)^(.*) ', 1) <> '' then regexp_extract(text[:200], '(?s)^(.*) ', 1) else text[:200] end as narrative from k""")
def story_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("story_id"), F.col("turn").alias("seq"), F.col("text").alias("question"), F.col("text").alias("narrative"))
    return stories.context(c).select("story_id", "place", "narrative")


@query("""with s as (select o_custkey as story_id, o_orderkey % 100 as path, case when min(o_orderkey) % 3 = 0 then 'old' else md5((o_orderkey % 100)::varchar) end as hash from orders group by o_custkey, o_orderkey % 100),
c as (select i as path, md5(i::varchar) as now from range(0, 90) t(i)), j as (select s.*, now from s left join c using (path))
select story_id, count(*) filter (hash is distinct from now) = 0 as fresh, coalesce(string_agg(path::varchar, ',' order by path) filter (hash is distinct from now), '') as changed_paths from j group by story_id""")
def story_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("o_orderkey") % 100
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("story_id"), path.alias("path")).agg(F.min("o_orderkey").alias("m"))
    s = s.select("story_id", "path", F.when(F.col("m") % 3 == 0, "old").otherwise(F.md5(F.col("path").cast("string"))).alias("hash"))
    current = spark.range(90).select(F.col("id").alias("path"), F.md5(F.col("id").cast("string")).alias("hash"))
    return stories.freshness(s, current).withColumn("changed_paths", F.array_join("changed_paths", ","))


@query("select l_partkey as path, count(distinct l_orderkey) as chapters, min(l_orderkey) as first_chapter, max(l_orderkey) as last_chapter from lineitem group by l_partkey")
def path_reuse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.reuse(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("chapter")))


@query("""with r as (select l_suppkey as story_id, concat(case when l_partkey % 6 = 0 then '__dependencies__/' else '' end, l_partkey % 12) as path, count(*) as n from lineitem group by all)
select story_id, path, n, row_number() over (partition by story_id order by starts_with(path, '__dependencies__/'), n desc, path) as place from r qualify place <= 8""")
def story_context_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("l_partkey") % 6 == 0, "__dependencies__/").otherwise(""), (F.col("l_partkey") % 12).cast("string"))
    return stories.context_paths(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("story_id"), path.alias("path")))


@query("""with i as (select l_orderkey as q, min(l_linenumber) as ord, concat(case when l_partkey % 3 = 0 then '__dependencies__/' else '' end, l_partkey) as path, l_suppkey as ls, l_suppkey + 5 as le from lineitem group by q, path, ls, le),
d as (select *, starts_with(path, '__dependencies__/') as dep from i), k as (select *, row_number() over (partition by q, dep order by ord, path, ls) as k from d)
select q, path, ls as line_start, le as line_end, row_number() over (partition by q order by dep, ord, path, ls) as place from k where not dep or k <= 1 qualify place <= 12""")
def source_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("l_partkey") % 3 == 0, "__dependencies__/").otherwise(""), F.col("l_partkey").cast("string"))
    return stories.source_items(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("ord"), path.alias("path"), F.col("l_suppkey").alias("line_start"), (F.col("l_suppkey") + 5).alias("line_end")))


@query("select md5(coalesce(text, '')) as fingerprint, min(doc_id) as seq, first(source order by doc_id) as chapter from documents group by 1")
def block_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.block_owners(table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"), F.col("source").alias("chapter"), F.col("doc_id").alias("seq")))


@query("""with s as (select *, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events)
select event_type, max(n) as n, max(value) filter (i = floor((n - 1) * 0.5) + 1) as p50, max(value) filter (i = floor((n - 1) * 0.75) + 1) as p75, max(value) filter (i = floor((n - 1) * 0.9) + 1) as p90, max(value) as most from s group by event_type""")
def percentile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.percentiles(_events(spark, sf_dir).select("event_type", "value"), ["event_type"], "value")


CHANGED = """cur as (select doc_id as path, md5(coalesce(text, '')) as now from documents where doc_id % 7 <> 1), old as (select doc_id as path, case when doc_id % 5 = 0 then 'stale' else md5(coalesce(text, '')) end as was from documents where doc_id % 7 <> 0)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    return d.filter("path % 7 <> 1"), d.filter("path % 7 <> 0").withColumn("hash", F.when(F.col("path") % 5 == 0, "stale").otherwise(F.col("hash")))


@query(f"with {CHANGED} select path, case when was is null then 'write_new' when now is null then 'remove' when now = was then 'skip' else 'write_changed' end as action from cur full join old using (path)")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.changes(*_snapshots(spark, sf_dir))


@query(f"with {CHANGED} select path, now as hash from cur")
def incremental_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applying the detected changes to the old snapshot gives the new one."""
    now, old = _snapshots(spark, sf_dir)
    return state.apply_changes(old, now, state.changes(now, old))


@query(f"with {CHANGED} select path from old where path not in (select path from cur)")
def anti_join_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, old = _snapshots(spark, sf_dir)
    return state.stale(old, now).select("path")


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_join_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "lang")


@query("""with e as (select user_id, event_id, concat('f', user_id, case when user_id % 25 = 0 then '/.gitignore' else '.py' end) as path, event_type from events)
select path, case when path like '%/.gitignore' then 'policy' else arg_max(event_type, event_id) end as kind from e group by path""")
def watch_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("f"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 25 == 0, "/.gitignore").otherwise(".py"))
    return live.coalesce_events(_events(spark, sf_dir).select(F.col("event_id").alias("seq"), path.alias("path"), F.col("event_type").alias("kind")))


@query("""with q as (select lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) as n, min(doc_id) as first_id, count(*) as copies from documents group by 1) select md5(n) as query_md5, first_id, copies from q where first_id is not null order by first_id limit 6""")
def merge_stage_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six distinct questions, whatever their case and white space: six is what a stage may ask."""
    return questions.merge_texts(table(spark, sf_dir, "documents"), "doc_id", "text", 6).select(F.md5("key").alias("query_md5"), F.col("first").alias("first_id"), "copies")


@query("""with c as (select doc_id, text, regexp_extract(text[:100], '(?s)^(.*) ', 1) as word from documents)
select doc_id, case when length(text) <= 100 then text when word <> '' then word else text[:100] end as head, (trim(regexp_replace(text, '\\s+', ' ', 'g')))[:500] as squashed from c""")
def text_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole text of every document: null, short and blank ones too."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.clamp_at_word(F.col("text"), 100).alias("head"), T.squash(F.col("text"), 500).alias("squashed"))
