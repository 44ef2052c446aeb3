"""Queries of routing, evidence packets, plans, code in answers and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..operators import graph as G
from ..operators import planning as P
from ..operators import retrieval as R
from ..operators import search as S
from .common import FILES, files, query, table
from .retrieval_queries import FUSED, _fused, questions


@query(f"""{FUSED}, r as (select q, key, similarity, row_number() over (partition by q order by rrf desc, key) as rank from fused qualify rank <= 3),
t as (select q, count(*) as n_results, arg_min(coalesce(similarity, -9), rank) as first, max(similarity) as top from r group by q)
select item_id as q, coalesce(n_results, 0) as n_results, top as top_similarity, coalesce(n_results, 0) between 1 and 3 and length(text) <= 120 and coalesce(top, 0) >= 0.55 as fast, coalesce(first, -9) < 0.3 as weak from benchmark left join t on q = item_id""")
def route_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.ranked(_fused(spark, sf_dir), ["q"], [F.desc("rrf"), F.asc("key")], 3)
    return P.route(questions(spark, sf_dir), found).drop("overview")


@query("""with t as (select vec_id, embedding::double[] as v from embeddings where vec_id >= 100 and label in (1, 2, 3, 4)), q as (select vec_id as q, embedding::double[] as v from embeddings where vec_id % 50 = 0),
c as (select q, vec_id, round(list_cosine_similarity(q.v, t.v), 6) as score from q, t where q <> vec_id) select q, vec_id, score, row_number() over (partition by q order by score desc, vec_id) as rank from c where score >= 0.3 qualify rank <= 3""")
def similar_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all rows, those that are questions too; only a question's own row is left out."""
    e = table(spark, sf_dir, "embeddings")
    traces = e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), F.col("vec_id").alias("ts"), F.col("label").alias("revision"))
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec"))
    current = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "revision int")
    return P.similar_traces(traces, asked, F.lit(100), current, floor=0.3, others=True).withColumnRenamed("key", "vec_id")


PLAN = """plan as (select l_orderkey as q, l_linenumber as item, l_suppkey % 5 as path, case when l_partkey % 3 > 0 then l_partkey % 50 end as s, l_partkey % 50 + 10 as e from lineitem where l_linenumber <= 2),
ev as (select l_orderkey as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as ord, l_suppkey % 5 as path, l_partkey % 60 as ls, l_partkey % 60 + l_quantity::int as le from lineitem)"""


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    plan = li.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("item"), (F.col("l_suppkey") % 5).alias("path"), F.when(part % 3 > 0, part % 50).alias("s"), (part % 50 + 10).alias("e"))
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    ev = li.select(F.col("l_orderkey").alias("q"), ord_.alias("ord"), (F.col("l_suppkey") % 5).alias("path"), (part % 60).alias("line_start"), (part % 60 + F.col("l_quantity").cast("int")).alias("line_end"))
    return plan, ev.withColumn("rank", F.col("ord"))


@query(f"""with {PLAN}, sc as (select q, item, ord, sum(case when s is null then 3 when ls <= e and le >= s then 5 else 2 end) as points from plan join ev using (q, path) group by all),
b as (select q, item, ord, row_number() over (partition by q, item order by points desc, ord) as at_ from sc qualify at_ <= 3),
r as (select i.q, i.item, ev.ord, ev.ord + 100 as at_ from (select distinct q, item from plan) i join ev on ev.q = i.q and ev.ord <= 4 where not exists (select 1 from b where b.q = i.q and b.item = i.item and b.ord = ev.ord)),
u as (select * from b union all select * from r) select q, item, ord, row_number() over (partition by q, item order by at_) as place from u qualify place <= 4""")
def plan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.evidence_for_plan(*_plan(spark, sf_dir))


@query(f"with {PLAN} select q, ord from ev where not exists (select 1 from plan where plan.q = ev.q and plan.path = ev.path and ls <= e and le >= s)")
def uncovered_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, ev = _plan(spark, sf_dir)
    return P.uncovered(ev, plan.filter("s is not null")).select("q", "ord")


@query(f"""with {FILES}, l as (select path, string_split_regex(content, '\\r?\\n') as l from files) select path, case when len(l) >= 3 then 3 end as first, case when len(l) >= 3 then least(7, len(l)) end as last, case when len(l) >= 3 then 1 end as from_line, case when len(l) >= 3 then least(7, len(l)) + 170 end as to_line from l""")
def visible_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.lines(F.col("content"))
    rows = files(spark, sf_dir).select("path", P.visible_range(T.gutter(F.slice(parts, 3, 5), F.lit(3))).alias("v"))
    r = rows.withColumn("r", P.read_range(F.col("v.first"), F.col("v.last")))
    return r.select("path", "v.first", "v.last", F.col("r.first").alias("from_line"), F.col("r.last").alias("to_line"))


@query(f"""with {FILES}, l as (select doc_id, path, string_split_regex(regexp_replace(content, '[ \\t]+(\\r?\\n|$)', '\\1', 'g'), '\\r?\\n') as l from files), c as (select *, case when doc_id % 5 = 0 then 'not there at all' else array_to_string(l[2:3], chr(10)) end as code from l)
select path, case when doc_id % 5 = 0 or trim(code, ' ' || chr(10) || chr(9)) = '' then 'gap' else 'verified' end as state from c""")
def grounded_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir)
    code = F.when(F.col("doc_id") % 5 == 0, "not there at all").otherwise(T.join_lines(F.slice(T.lines(F.col("content")), 2, 2)))
    components = own.select(F.lit(1).alias("q"), F.col("doc_id").alias("id"), "path", code.alias("code"))
    return P.ground_code(components, own.select(F.lit(1).alias("q"), "path", F.lit(1).alias("line_start"), "content")).select("path", "state")


@query("""with l as (select page_id, unnest(string_split_regex(coalesce(html, ''), '\\r?\\n')) as line, generate_subscripts(string_split_regex(coalesce(html, ''), '\\r?\\n'), 1) as line_no from pages),
c as (select *, regexp_matches(line, '^\\s*<!--') as comment_only, trim(line) <> '' and (regexp_matches(trim(line), '^[\\[\\](){};,]*$') or regexp_matches(trim(line), '^(else|end|fi|done|begin|try|do)[:{]?$')) as structural_only from l)
select page_id, count(*) as n, count(*) filter (comment_only) as comments, count(*) filter (structural_only) as structural, count(*) filter (not comment_only and not structural_only and trim(line) <> '') as substantive from c group by page_id""")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit("site/p.html").alias("path"), F.posexplode(T.lines(F.coalesce("html", F.lit("")))).alias("line_no", "line"))
    return P.classify_lines(rows).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("comment_only").alias("comments"), F.count_if("structural_only").alias("structural"), F.count_if("substantive").alias("substantive"))


@query("""with l as (select l_orderkey as key, l_linenumber as line_no, max(l_returnflag = 'A') as clean, max(l_quantity > 40) as callout from lineitem group by all), k as (select key, coalesce(max(line_no) filter (callout), 0) as low from l group by key),
m as (select l.key, max(line_no) as m from l join k on k.key = l.key where clean and line_no <= 4 and line_no >= greatest(low, 1) group by l.key) select k.key, coalesce(m, 4) as cut from k left join m using (key)""")
def cut_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line_no")).agg(F.max(F.col("l_returnflag") == "A").alias("clean"), F.max(F.col("l_quantity") > 40).alias("callout"))
    return P.cut_line(li.withColumn("line", F.when(F.col("clean"), "}").otherwise("x = 1")), 4, 3)


@query("""with l as (select l_orderkey as key, l_linenumber as line_no, max(l_returnflag <> 'N') as quiet from lineitem group by all), w as (select *, coalesce(lag(quiet, 1) over w, false) as a, coalesce(lag(quiet, 2) over w, false) as b, coalesce(lag(quiet, 3) over w, false) as c, coalesce(lag(quiet, 4) over w, false) as d from l window w as (partition by key order by line_no))
select key, line_no, line_no - case when not a then 0 when not b then 1 when not c then 2 when not d then 3 else 4 end as start from w where not quiet""")
def leading_comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line_no")).agg(F.max(F.col("l_returnflag") != "N").alias("quiet"))
    return P.leading_comments(li.withColumn("definition", ~F.col("quiet")))


@query("""with r as (select l_returnflag as type, l_linenumber % 2 as cited, 1 as expected, l_suppkey % 3 as faithful, case when l_returnflag = 'N' then 0 else 2 end as callouts, l_partkey % 4 as grounded, 4 as refs from lineitem)
select type, round(sum(cited) / nullif(sum(expected), 0), 4) as cite, round(sum(faithful) / nullif(sum(callouts), 0), 4) as faith, round(sum(grounded) / nullif(sum(refs), 0), 4) as ground, count(*) as n from r group by type""")
def generation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1)
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), (F.col("l_linenumber") % 2).alias("cited"), one.alias("expected"), (F.col("l_suppkey") % 3).alias("faithful"), F.when(F.col("l_returnflag") == "N", 0).otherwise(2).alias("callouts"), (F.col("l_partkey") % 4).alias("grounded"), F.lit(4).alias("refs"))
    return P.generation_metrics(r)


@query("""with e as (select user_id, event_type as k, count(*) as v from events group by all) select user_id, string_agg(concat(k, '=', v), ',' order by k) as counts from e group by user_id""")
def merged_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.create_map(F.col("event_type"), F.lit(1).cast("long")).alias("counts"))
    merged = P.merge_maps(rows, "user_id", "counts")
    return merged.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("counts"))


@query("""with d as (select o_custkey as q, min(o_orderkey) as ord, o_orderkey % 12 as path from orders where o_orderkey % 2 = 0 group by q, path), c as (select o_custkey as q, min(o_orderkey) as ord, o_orderkey % 9 as path from orders group by q, path),
u as (select d.q, d.path, d.ord as at_ from d where exists (select 1 from c where c.q = d.q and c.path = d.path) union all select c.q, c.path, c.ord + 1000000 from c where not exists (select 1 from d where c.q = d.q and c.path = d.path))
select q, path, row_number() over (partition by q order by at_, path) as place from u qualify place <= 8""")
def reconcile_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pick = lambda df, n: df.groupBy(F.col("o_custkey").alias("q"), (F.col("o_orderkey") % n).alias("path")).agg(F.min("o_orderkey").alias("ord"))
    return P.reconcile_draft(pick(o.filter("o_orderkey % 2 = 0"), 12), pick(o, 9))


@query(f"""with {FILES}, r as (select split_part(path, '/', 1) as q, path, doc_id as rank, case split_part(path, '.', 2) when 'html' then 'markup' when 'md' then 'markup' when 'css' then 'style' end as family from files),
m as (select *, family in ('markup', 'style') and row_number() over (partition by q, family order by rank) = 1 as lead from r)
select q, path, row_number() over (partition by q order by coalesce(lead, false) desc, rank) as place from m qualify place <= 4""")
def surface_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("q"), "path", F.col("doc_id").alias("rank"))
    return P.surface_diverse(rows, F.array(F.lit("markup"), F.lit("style")), 4)


@query("""with r as (select l_orderkey as q, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey, l_suppkey) as rank, l_quantity as score, l_suppkey % 2 = 0 as shares from lineitem), c as (select *, score >= 0.5 * max(score) over (partition by q) and shares and rank > 1 as close from r)
select q, least(1 + count(*) filter (close), 4) as n from c group by q""")
def code_component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), rank.alias("rank"), F.col("l_quantity").alias("score"), (F.col("l_suppkey") % 2 == 0).alias("shares_term"))
    return P.code_component_count(rows)


@query("""with b as (select o_custkey as brief_id, concat('Orders of ', o_custkey) as title, list(distinct o_orderpriority order by o_orderpriority) as files from orders group by o_custkey)
select brief_id, concat('Implement: ', title, chr(10), chr(10), 'Check them.', chr(10), chr(10), 'Start from these files:', chr(10), array_to_string(list_transform(files, lambda x: concat('- ', x)), chr(10))) as text from b""")
def change_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("brief_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("files"))
    b = b.select("brief_id", F.concat(F.lit("Orders of "), F.col("brief_id").cast("string")).alias("title"), F.lit("Check them.").alias("goal"), "files", F.array().cast("array<string>").alias("risks"))
    return P.change_prompt(b)


@query(f"""with {FILES}, i as (select split_part(path, '/', 1) as q, row_number() over (partition by split_part(path, '/', 1) order by doc_id) as ord, path, md5(content) as content from files qualify ord <= 8)
select q, string_agg(concat('[', ord, '] ', path, ':1-9', chr(10), content), chr(10) || chr(10) order by ord) as message from i group by q""")
def evidence_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the eight items that an outline shows."""
    rows = files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("q"), "doc_id", "path", F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), F.md5("content").alias("content"))
    return P.evidence_message(R.ranked(rows, ["q"], [F.asc("doc_id")], 8).withColumnRenamed("rank", "ord"))


@query("select o_orderkey, round(0.14 + 0.8 * least(greatest(o_orderkey / 20000.0::double, 0), 1), 4) as ratio from orders")
def progress_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", P.progress(F.col("o_orderkey").cast("double"), F.lit(20_000.0)).alias("ratio"))


@query()
def hybrid_search_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship with the graph and support legs: line facts of the files and the imports between them."""
    from .graph_queries import _imports

    own = files(spark, sf_dir).select("path", "content")
    edges = G.resolve_imports(_imports(spark, sf_dir), own.select("path")).select("path", "target")
    facts = G.line_facts(own, languages=("python", "javascript", "json", "css", "html", "go"))
    found = S.search(chunking.windows(own), questions(spark, sf_dir), facts=facts, edges=edges, support=S.SUPPORT_SLOTS)
    return found.select("q", "rank", "path", "line_start", "similarity", "score", "support", F.array_join("origins", ",").alias("origins"))
