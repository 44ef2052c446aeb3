"""Queries of evidence, citations, excerpts, answers and intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import quality
from .common import FILES, files, query, table

TOK = ["the", "licenses", "transaction", "stories", "and"]
#: Each document is evidence of the question of its language.
ITEMS = f"""{FILES}, items as (select lang as q, doc_id as ord, path, content, case when doc_id % 3 = 0 then null else round((doc_id % 11) / 10.0, 2)::double end as similarity, case when doc_id % 5 = 0 then 'read_file' else 'search' end as tool from files join documents using (doc_id)),
hay as (select *, lower(path) as p, lower(concat(path, chr(10), content[:8000])) as h from items)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    d = F.col("doc_id")
    return files(spark, sf_dir).join(langs, "doc_id").select(
        F.col("lang").alias("q"), d.alias("ord"), "path", "content", F.when(d % 3 != 0, F.round((d % 11) / 10.0, 2)).alias("similarity"), F.when(d % 5 == 0, "read_file").otherwise("search").alias("tool"), F.array(*map(F.lit, TOK)).alias("tokens")
    )


def _hit(col: str) -> str:
    forms = {"the": ["the"], "licenses": ["licenses", "license"], "transaction": ["transaction", "transact"], "stories": ["stories", "story", "storie"], "and": ["and"]}
    return " + ".join("(" + " or ".join(f"contains({col}, '{v}')" for v in vs) + ")::int" for vs in forms.values())


RANKED = f"""{ITEMS}, scored as (select *, round(coalesce(similarity * 5, 0) + case when tool = 'read_file' then 3 else 0 end + 2.5 * ({_hit('p')}) + 0.75 * ({_hit('h')})
 + case when split_part(path, '.', 2) in ('json', 'md') then 0.25 else 0 end + case when regexp_matches(content, '\\b(export|function|class|const|async|def|fn|struct|impl|app\\.(get|post|use)|create[A-Z]\\w+)\\b') then 0.75 else 0 end, 6) as score from hay),
ranked as (select *, row_number() over (partition by q order by score desc, ord) as rank from scored)"""


@query(f"with {RANKED} select q, ord, score, rank from ranked")
def evidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rank_evidence(_items(spark, sf_dir)).select("q", "ord", "score", "rank")


@query(f"""with {RANKED} select q, case when path is null then 'gap' else 'callout' end as type, path, 1 as line_start, case when similarity is null then 0.75 else least(greatest(similarity, 0.55), 0.95) end as confidence from ranked where rank = 1""")
def lean_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = E.rank_evidence(_items(spark, sf_dir)).withColumn("line_start", F.lit(1)).withColumn("line_end", F.lit(1))
    return E.lean_answers(ranked).select("q", "type", "path", "line_start", "confidence")


@query(f"""with {RANKED}, l as (select q, rank, path, case split_part(path, '.', 2) when 'json' then 'configuration' when 'md' then 'supporting' else 'core' end as layer from ranked),
t as (select *, case when row_number() over (partition by q, layer order by rank) = 1 then 0 when row_number() over (partition by q, path order by rank) = 1 then 1 else 2 end as turn from l)
select q, path, layer, row_number() over (partition by q order by turn, rank) as place from t qualify place <= 8""")
def layer_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each layer, then of each path, then the rest."""
    ranked = E.rank_evidence(_items(spark, sf_dir)).select("q", "rank", "path")
    return E.layer_diverse(ranked, 8).select("q", "path", "layer", "place")


@query("""with e as (select distinct l_partkey as path, l_orderkey % 1000 as s, l_orderkey % 1000 + l_quantity::int as e from lineitem where l_linenumber > 1),
r as (select l_orderkey as ref_id, l_partkey as path, l_suppkey % 1000 as ls, l_suppkey % 1000 + 10 as le from lineitem where l_linenumber = 1),
j as (select *, greatest(0, least(le, e) - greatest(ls, s) + 1) as shared, greatest(0, greatest(ls, s) - least(le, e)) as far from r join e using (path)),
b as (select *, row_number() over (partition by ref_id order by shared desc, far, s, e) as k from j)
select ref_id, path, case when shared > 0 then least(greatest(ls, s), e) else s end as line_start, case when shared > 0 then greatest(least(le, e), s) else e end as line_end from b where k = 1""")
def nearest_range_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = F.col("l_orderkey") % 1000
    evidence = li.filter("l_linenumber > 1").select(F.col("l_partkey").alias("path"), s.alias("s"), (s + F.col("l_quantity").cast("int")).alias("e")).distinct()
    at = F.col("l_suppkey") % 1000
    refs = li.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("ref_id"), F.col("l_partkey").alias("path"), at.alias("line_start"), (at + 10).alias("line_end"))
    return E.reconcile_refs(refs, evidence)


@query("""select o_orderkey, case when o_orderkey % 9 = 0 then 'gap' when o_custkey % 4 = 0 then 'uncited' when o_orderkey % 2 = 0 then 'verified' when o_custkey % 3 = 0 then 'located' else 'inferred' end as state from orders""")
def evidence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", E.evidence_state(c % 4 != 0, c % 3 == 0, o % 2 == 0, F.when(o % 9 == 0, "gap").otherwise("code")).alias("state"))


@query("""with l as (select user_id as key, event_id, round(value, 4) as score, event_type = 'click' as boundary, row_number() over (partition by user_id order by event_id) as line_no from events),
w as (select key, line_no, boundary, list(score) over win as scores, last_value(boundary) over win as b2 from l window win as (partition by key order by line_no rows between current row and 9 following))
select key, line_no as line_start, round(list_sum(list_reverse_sort(scores)[1:8]) + list_max(scores) + case when boundary and b2 then 8 when boundary then 4 else 0 end, 6) as score from w""")
def excerpt_window_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), line.alias("line_no"), F.round("value", 4).alias("score"), (F.col("event_type") == "click").alias("boundary"))
    return E.excerpt_windows(rows, 10)


@query()
def excerpt_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best windows of a user's events that overlap little: greedy, checked against its definition in tests."""
    scored = excerpt_window_score(spark, sf_dir)
    return E.suppress_overlaps(scored.select("key", F.col("line_start").cast("int").alias("s"), (F.col("line_start") + 9).cast("int").alias("e"), "score"))


CALL = """c as (select l_orderkey as key, l_linenumber % 4 as line_no, concat('Ships ', l_returnflag, '-', l_linestatus) as note, l_quantity as score from lineitem)"""


@query(f"""with {CALL}, k as (select *, lower(regexp_replace(note, '[^A-Za-z0-9]+', ' ', 'g')) as note_key from c),
a as (select * from k qualify row_number() over (partition by key, line_no order by score desc, line_no, note) = 1),
b as (select * from a qualify row_number() over (partition by key, note_key order by score desc, line_no, note) = 1)
select key, line_no, note, score from b qualify row_number() over (partition by key order by score desc, line_no) <= 3""")
def callout_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") % 4).alias("line_no"), F.concat(F.lit("Ships "), "l_returnflag", F.lit("-"), "l_linestatus").alias("note"), F.col("l_quantity").alias("score"))
    return E.select_callouts(c, 3)


@query("""with p as (select l_orderkey as key, l_linenumber * 5 as line_no from lineitem where l_linenumber <= 2), t as (select l_orderkey as key, l_linenumber + l_quantity::int as target from lineitem group by all),
n as (select *, row_number() over (partition by p.key, line_no order by abs(target - line_no), target < line_no) as k from p join t on p.key = t.key where abs(target - line_no) <= 12)
select key, line_no, target from n where k = 1""")
def nearest_callout_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    points = li.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 5).alias("line_no"))
    targets = li.select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("target")).distinct()
    return E.nearest_line(points, targets, 12)


COMP = """c as (select l_orderkey as q, l_linenumber as ord, concat(l_returnflag, ':', l_suppkey % 3) as signature, round(l_discount * 10, 2) as confidence, l_partkey as id from lineitem)"""


@query(f"""with {COMP}, b as (select q, signature, first(id order by confidence desc, ord, id) as id, max(confidence) as confidence, min(ord) as ord from c group by q, signature)
select q, id, confidence, signature, row_number() over (partition by q order by ord, signature) as place from b""")
def component_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", F.lit(":"), (F.col("l_suppkey") % 3).cast("string")).alias("signature"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), F.col("l_partkey").alias("id"))
    return E.dedupe_components(c)


@query("""with c as (select l_orderkey as q, case when l_linenumber = 5 then 'gap' else 'code' end as kind, l_discount * 10 as confidence, case when l_partkey % 4 <> 0 then concat('p', l_partkey % 9) end as path from lineitem),
a as (select q, avg(confidence) as m, count(*) filter (kind = 'gap') as n_gaps, count(path) as n_refs, list_sort(list(distinct path) filter (path is not null))[1:6] as paths from c group by q)
select q, floor(round(case when n_refs = 0 then 0 when n_gaps > 0 then least(m, 0.6) else m end, 6) * 100 + 0.5) / 100 as confidence, n_gaps, n_refs, coalesce(array_to_string(paths, ','), '') as paths from a""")
def feature_trace_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.when(F.col("l_linenumber") == 5, "gap").otherwise("code").alias("kind"), (F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("p"), (F.col("l_partkey") % 9).cast("string"))).alias("path"))
    return E.feature_trace(c).withColumn("paths", F.array_join("paths", ","))


@query("""with e as (select l_orderkey as q, l_linenumber as ord, l_suppkey % 4 as path, l_returnflag as reason, case when l_quantity < 15 then 1 when l_quantity < 35 then 2 else 3 end as level, l_partkey as s, l_quantity as t from lineitem),
a as (select q, path, first(reason order by ord, reason) as reason, (['low','medium','high'])[max(level)] as confidence, count(distinct (s, t)) as n_refs, min(ord) as ord from e group by q, path)
select q, path, reason, confidence, n_refs, row_number() over (partition by q order by ord, path) as place from a qualify place <= 3""")
def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("ord"), (F.col("l_suppkey") % 4).alias("path"), F.col("l_returnflag").alias("reason"), F.when(n < 15, "low").when(n < 35, "medium").otherwise("high").alias("level"), F.col("l_partkey").alias("line_start"), n.alias("line_end"))
    return E.candidate_files(e, 3)


@query()
def plan_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy removal of overlapping plan items, checked against its definition in tests."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("ord"), (F.col("l_suppkey") % 3).alias("path"), (F.col("l_partkey") % 60).alias("s"), (F.col("l_partkey") % 60 + F.col("l_quantity").cast("int")).alias("e"))
    return E.drop_overlapping(li)


@query("""with d as (select conv_id as id, case when conv_id % 4 = 3 then 'plain' when conv_id % 2 = 0 then 'sequenceDiagram' else 'flowchart TD' end as head, list(case when role = 'user' then 'alt x' else 'end' end order by turn) as body, list(role order by turn) as roles from conversations group by conv_id),
s as (select id, head, list_sum(list_transform(roles, lambda r: case when r = 'user' then 1 else -1 end)) as last, list_min(list_transform(range(1, len(roles) + 1), lambda i: list_sum(list_transform(roles[1:i], lambda r: case when r = 'user' then 1 else -1 end)))) as low from d),
p as (select id, case when head = 'plain' then 'header' when low < 0 then 'end_without_block' when last <> 0 then 'open_block' end as problem from s) select id, problem is null as ok, problem from p""")
def diagram_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stand for diagrams: a user's turn opens a block, any other closes one."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.when(x["role"] == "user", "alt x").otherwise("end")).alias("body"))
    i = F.col("conv_id")
    head = F.when(i % 4 == 3, "plain").when(i % 2 == 0, "sequenceDiagram").otherwise("flowchart TD")
    return E.lint_diagrams(c.select(i.alias("id"), F.concat(head, F.lit("\n"), F.array_join("body", "\n")).alias("source")))


@query("""with n as (select conv_id, turn, lower(trim(regexp_replace(text, '[0-9]+', '#', 'g'))) as note, text from conversations), c as (select *, count(*) over (partition by note) as k from n)
select round(avg((k > 1)::int), 4) as dup_share, count(*) as n from c""")
def dup_note_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dup_share(table(spark, sf_dir, "conversations").select(F.col("text").alias("note")))


NOTES = """n as (select l_orderkey as key, l_linenumber as ord, l_linenumber % 4 as line_no, case l_suppkey % 5 when 0 then concat('Stores  x', l_partkey, ' for later') when 1 then 'Highlights the row' when 2 then concat('Part "', l_returnflag, '" decides') when 3 then concat('part ', l_returnflag, ' Decides') end as note from lineitem)"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, flag = F.col("l_suppkey") % 5, F.col("l_returnflag")
    note = F.when(s == 0, F.concat(F.lit("Stores  x"), F.col("l_partkey").cast("string"), F.lit(" for later"))).when(s == 1, "Highlights the row").when(s == 2, F.concat(F.lit('Part "'), flag, F.lit('" decides'))).when(s == 3, F.concat(F.lit("part "), flag, F.lit(" Decides")))
    # some orders repeat a number: of equal ones the row that the table holds first is first, as in SQL
    at = F.struct("l_linenumber", "_metadata.file_path", "_metadata.row_index")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("ord"), at.alias("at"), (F.col("l_linenumber") % 4).alias("line_no"), note.alias("note"))


@query(f"with {NOTES} select key, ord, note is null or not starts_with(lower(note), 'part') as weak from n")
def weak_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("key", "ord", E.is_weak_note(F.col("note")).alias("weak"))


@query(f"""with {NOTES}, a as (select * from n where starts_with(lower(note), 'part') and line_no <> 3),
l as (select * from a qualify row_number() over (partition by key, line_no order by ord) = 1),
k as (select * from l qualify row_number() over (partition by key, lower(replace(note, '"', '')) order by ord) = 1)
select key, line_no, note, row_number() over (partition by key order by ord) as place from k qualify place <= 5""")
def model_callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _notes(spark, sf_dir).drop("ord").withColumnRenamed("at", "ord")
    return E.sanitize_callouts(notes, notes.filter("line_no <> 3"))


@query("""with a as (select o_orderkey as id, concat(o_orderpriority, ' order ', o_custkey) as name from orders)
select id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, row_number() over (partition by regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') order by id) as suffix from a""")
def plan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("o_orderpriority", F.lit(" order "), F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.slug(name).alias("slug"))
    return rows.withColumn("suffix", F.row_number().over(Window.partitionBy("slug").orderBy("id")))
