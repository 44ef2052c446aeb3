"""Queries of what questions ask for: sentences made for orders, so that every rule is met, with the questions of benchmark and of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import questions as Q
from .common import query, table

#: Questions made of a subject and a request, so that rules of all kinds meet each other.
OPENINGS = ("How does", "Where is", "Show me the code of", "What if the", "Compare the", "Give me an overview of the", "Implement a fix without breaking", "Explain it, draw")
SUBJECTS = (
    "api route handler", "search index and store", "page layout css", "whole system", "checkout flow end to end", "package.json dependencies", "user model schema", "error fallback in this file",
    "planner tools cache", "login form component",
)


def _list(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


ASKED = f"""asked as (select o_orderkey as q, concat(({_list(OPENINGS)})[o_orderkey % {len(OPENINGS)} + 1], ' ', ({_list(SUBJECTS)})[o_custkey % {len(SUBJECTS)} + 1], case when o_orderkey % 3 = 0 then ' work?' else '' end) as text, o_orderkey % 7 = 0 as has_story from orders
 union all select 1000000000 + item_id, coalesce(text, ''), false from benchmark union all select 2000000000 + conv_id * 1000 + turn, coalesce(text, ''), turn > 0 from conversations where role = 'user')"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences made for orders, the questions of benchmark, and what users say in conversations."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    o, c, none = F.col("o_orderkey"), F.col("o_custkey"), F.coalesce("text", F.lit(""))
    text = F.concat(pick(OPENINGS, o), F.lit(" "), pick(SUBJECTS, c), F.when(o % 3 == 0, " work?").otherwise(""))
    made = table(spark, sf_dir, "orders").select(o.alias("q"), text.alias("text"), (o % 7 == 0).alias("has_story"))
    items = table(spark, sf_dir, "benchmark").select((F.lit(1_000_000_000) + F.col("item_id")).alias("q"), none.alias("text"), F.lit(False).alias("has_story"))
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.lit(2_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("q"), none.alias("text"), (F.col("turn") > 0).alias("has_story"))
    return made.unionByName(items).unionByName(turns)


def _m(pattern: str) -> str:
    return "regexp_matches(low, '" + pattern.replace("'", "''") + "')"


def _any(words: tuple[str, ...]) -> str:
    return f"list_has_any(w, {_list(words)})"


_OVERVIEW = "(" + " or ".join(map(_m, V.OVERVIEW)) + f" or {_m(V.END_TO_END)} and {_m(V.WALK)})"


def _points(intent: str) -> str:
    rules = [f"case when {_m(p)} then {n} else 0 end" for i, n, p in V.INTENT_PATTERNS if i == intent] + [f"case when {_any(ws)} then {n} else 0 end" for i, n, ws in V.INTENT_TERMS if i == intent]
    if intent == "locate_source":
        rules.append(f"case when list_contains(w, 'find') or {_m(V.FIND_PATTERN)} then 2 else 0 end")
    if intent == "explain_behavior":
        rules.append(f"case when {_OVERVIEW} then 5 else 0 end")
    if intent in ("explain_behavior", "explain_role"):
        rules.append("case when has_story and len(t) between 1 and 6 then 1 else 0 end")
    return " + ".join(rules)


CLASSIFIED = f"""{ASKED}, lw as (select *, lower(trim(text)) as low, regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{{1,}}') as w from asked),
tk as (select *, list_filter(w, lambda x: not list_contains({_list(V.QUESTION_STOPWORDS)}, x)) as t from lw),
pt as (select *, [{', '.join(map(_points, V.INTENTS))}] as s from tk),
bs as (select *, list_max(s) as best, list_reverse_sort(s)[2] as next from pt),
classified as (select q, text, low, has_story, case when best > 0 then ({_list(V.INTENTS)})[list_position(s, best)] else 'explain_behavior' end as intent,
 case when {_OVERVIEW} then 'system' when {_m(V.FILE_SCOPE)} then 'file' when has_story or {_m(V.FEATURE_SCOPE)} then 'feature' when {_m(V.SYSTEM_SCOPE)} then 'system' when len(list_distinct(t)) <= 4 then 'prior_story' else 'feature' end as scope,
 round(case when best <= 0 then 0.35 else least(0.95, 0.45 + best * 0.08 + greatest(0, best - next) * 0.04) end, 2)::double as confidence,
 list_filter([{', '.join(f"case when {_m(p)} then '{n}' end" for n, p, _ in V.DOMAINS)}], lambda x: x is not null) as domains from bs)"""

_FIG = f"case when {_m(V.SEQUENCE)} then 'sequence_diagram' else 'mermaid_figure' end"
SHAPES = f"""case when intent = 'locate_source' then 'annotated_code_excerpt,evidence_callout'
 when {_m(V.SHOWS_FIGURE)} and {_m(V.SHOWS_CODE)} then concat({_FIG}, ',annotated_code_excerpt,evidence_callout') when {_m(V.SHOWS_FIGURE)} then concat({_FIG}, ',evidence_callout,annotated_code_excerpt')
 when intent = 'show_code' then 'annotated_code_excerpt,evidence_callout,mermaid_figure' when intent = 'simulate_change' then 'mermaid_figure,evidence_callout' when intent = 'verify_understanding' then 'evidence_callout'
 when intent = 'compare' then 'evidence_callout,mermaid_figure' when intent = 'plan_change' then 'evidence_callout,annotated_code_excerpt' when {_m(V.UI_ANSWER)} then 'mermaid_figure,annotated_code_excerpt,evidence_callout'
 when {_m(V.API_ANSWER)} then 'sequence_diagram,annotated_code_excerpt,evidence_callout' when {_m(V.FLOW_ANSWER)} then 'mermaid_figure,evidence_callout,annotated_code_excerpt' else 'evidence_callout,annotated_code_excerpt,mermaid_figure' end"""


@query(f"""with {CLASSIFIED} select q, intent, scope, confidence, {SHAPES} as shapes, array_to_string(domains, ',') as domains from classified""")
def intent_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.classify(asked(spark, sf_dir)).select("q", "intent", "scope", "confidence", F.array_join("shapes", ",").alias("shapes"), F.array_join("domains", ",").alias("domains"))


@query(f"""with {CLASSIFIED}, h as (select *, {SHAPES} as shapes from classified)
select q, contains(shapes, 'sequence_diagram') or intent = 'explain_behavior' and scope in ('feature', 'system') as coverage,
 case when q % 4 = 0 then 'lean' when intent = 'locate_source' then 'full' else 'full' end as mode from h""")
def answer_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Q.classify(asked(spark, sf_dir))
    mode = Q.synthesis_mode(F.col("intent"), F.col("shapes"), F.col("q") % 4, F.lit(True), F.col("text"))
    return c.select("q", Q.wants_coverage(F.col("intent"), F.col("scope"), F.col("shapes")).alias("coverage"), mode.alias("mode"))


@query(f"""with {CLASSIFIED}, h as (select *, {SHAPES} as shapes from classified),
s as (select q, list_concat(case when api then {_list(V.API_SEEDS)} else [] end, case when api and {_m(V.FAILURE)} then ['{V.FAILURE_SEED}'] else [] end, case when scope = 'system' and {_OVERVIEW} then {_list(V.OVERVIEW_SEEDS)} else [] end, ['  Data Storage  persistence read write']) as l from (select *, list_contains(domains, 'api') or {_m(V.API_QUESTION)} as api from h)),
n as (select q, unnest(l) as text, generate_subscripts(l, 1) as i from s), f as (select q, min(i) as i, arg_min(trim(text), i) as text from n group by q, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')))
select q, text, row_number() over (partition by q order by i) as place from f qualify place <= 6""")
def stage_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's own sub-query, here the same for all, repeats a seed in other case and blanks."""
    c = Q.classify(asked(spark, sf_dir))
    own = c.select("q", F.lit(0).alias("ord"), F.lit("  Data Storage  persistence read write").alias("text"))
    return Q.stage_queries(c, own)


@query(f"""with {ASKED}, lw as (select q, lower(trim(text)) as low from asked),
e as (select q, list_concat(['Fs', 'widget'], {', '.join(f"case when {_m(p)} then {_list(ts)} else [] end" for p, ts in V.GRAPH_TERMS)}, ['css', 'profile']) as t from lw),
u as (select q, unnest(t) as t, generate_subscripts(t, 1) as i from e), f as (select q, lower(t) as t, min(i) as i from u where length(t) >= 3 group by q, lower(t)),
k as (select *, row_number() over (partition by q order by i) as k from f qualify k <= 18) select q, string_agg(t, ' ' order by k) as terms from k group by q""")
def graph_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = lambda *xs: F.array(*map(F.lit, xs))
    return asked(spark, sf_dir).select("q", F.array_join(Q.graph_terms(extra("Fs", "widget"), F.col("text"), extra("css", "profile")), " ").alias("terms"))


@query(f"""with {CLASSIFIED}, ch as (select conv_id as c, turn, concat('topic ', turn) as question, concat('src/', role, turn, '.js') as path from conversations),
st as (select c, list(path order by turn) as paths, last(question order by turn) as lastq, array_to_string((list(question order by turn))[-3:], ' ') as backq from ch group by c),
j as (select k.*, list_slice(paths, 1, 12) as ps, lastq, backq, list_contains(domains, 'api') as api,
  regexp_matches(low, '{V.VISUAL}|{V.CHILD}') or regexp_matches(low, '{V.RETELLING.replace("'", "''")}') as again from classified k left join st on st.c = k.q),
p as (select *, array_to_string((case when api then [] else ps end)[1:8], ' ') as cited from j)
select q, case when lastq is null then text when again then concat_ws(chr(10), lastq, lastq, concat('Previously cited paths: ', array_to_string(ps, ' ')), backq, backq, nullif(cited, '')) else concat_ws(chr(10), text, nullif(cited, '')) end as retrieval,
 case when again and lastq is not null then concat_ws(chr(10), lastq, lastq, concat('Previously cited paths: ', array_to_string(ps, ' '))) else concat_ws(chr(10), text, {', '.join(f"case when {_m(p)} then '" + h.replace("'", "''") + "' end" for _, p, h in V.DOMAINS)}) end as exploration from p""")
def question_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stand for stories; none of their paths is an interface's."""
    turns = table(spark, sf_dir, "conversations")
    topic = F.concat(F.lit("topic "), F.col("turn").cast("string"))
    chapters = turns.select(F.col("conv_id").alias("q"), F.col("turn").alias("ord"), topic.alias("question"), topic.alias("title"), F.array(F.concat(F.lit("src/"), "role", F.col("turn").cast("string"), F.lit(".js"))).alias("paths"))
    return Q.question_context(Q.classify(asked(spark, sf_dir)), chapters).select("q", "retrieval", "exploration")
