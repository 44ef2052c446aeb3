"""Queries of the lexer, annotations, anchors and rewrites of plans. Sources are derived from orders: a file for each order, with a
function for each of its lines, in Python, Go and JavaScript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors as A
from ..operators import annotations as N
from ..operators import questions as Q
from ..operators import retrieval as R
from ..operators import rewrites as W
from ..operators import syntax as S
from .common import files, query, table
from .retrieval_queries import questions


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content). Strings and comments hold braces and definitions that are none."""
    rows = table(spark, sf_dir, "lineitem")
    ending = F.element_at(F.array(*map(F.lit, (".py", ".go", ".js"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    # numbers are grouped, texts are made of them afterwards
    own = rows.select(F.concat(F.lit("src/"), F.col("l_orderkey").cast("string"), ending).alias("path"), F.struct("l_linenumber", (F.floor("l_quantity") % 5).cast("int").alias("k")).alias("p"))

    def part(p: Column) -> Column:
        k, n = p["k"], p["l_linenumber"].cast("string")
        python = F.concat(F.lit("def item_"), n, F.lit("(a):\n"), F.repeat(F.lit('    x = "def no():" # def neither(){\n'), k), F.lit('    """ def quoted():\ndef still():\n"""\n\n'))
        go = F.concat(F.lit("func Item_"), n, F.lit("(a int) {\n"), F.repeat(F.lit("\tcall(\"}\", '}', `{`) // }{\n"), k), F.lit("\tif a {\n\t}\n}\n\n"))
        script = F.concat(F.lit("function item_"), n, F.lit("(a) {\n"), F.repeat(F.lit("  call('}', `${'{'}`); /* }\n} */\n"), k), F.lit("}\n// function none() {\n\n"))
        return F.when(F.endswith("path", F.lit(".py")), python).when(F.endswith("path", F.lit(".go")), go).otherwise(script)

    return own.groupBy("path").agg(F.sort_array(F.collect_list("p")).alias("parts")).select("path", F.array_join(F.transform("parts", part), "").alias("content"))


#: Items of each file with their first line and number of lines.
ITEMS = """i as (select l_orderkey, l_linenumber, floor(l_quantity)::int % 5 as k, l_orderkey % 3 as t, concat('src/', l_orderkey, (['.py', '.go', '.js'])[l_orderkey % 3 + 1]) as path from lineitem),
z as (select *, case when t = 2 then 2 * k + 4 else k + 5 end as size from i),
s as (select *, 1 + coalesce(sum(size) over (partition by l_orderkey order by l_linenumber, k rows between unbounded preceding and 1 preceding), 0) as first from z)"""


@query(f"""with {ITEMS} select path, 'function' as kind, case when t = 1 then concat('Item_', l_linenumber) else concat('item_', l_linenumber) end as name, first::int as line_start,
(first + case t when 0 then k + 1 when 1 then k + 3 else 2 * k + 1 end)::int as line_end from s""")
def definition_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.definitions(sources(spark, sf_dir), ("python", "go", "javascript"))


@query(f"""with {ITEMS}, d as (select path, first, case t when 0 then [0 for x in range(k + 5)] when 1 then [1] || [1 for x in range(k)] || [2, 1, 0, 0] else [1] || [1 for x in range(2 * k)] || [0, 0, 0] end as depths from s),
l as (select path, unnest(depths) as depth, first + generate_subscripts(depths, 1) - 1 as line_no from d), last as (select path, max(line_no) + 1 as line_no, 0 as depth from l group by path)
select path, line_no::int as line_no, depth::bigint as depth from l union all select path, line_no::int, depth from last""")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nesting(S.code_lines(sources(spark, sf_dir))).select("path", "line_no", F.col("depth").cast("long").alias("depth"))


@query(f"""with {ITEMS}, n as (select *, case t when 1 then concat('Item_', l_linenumber) else concat('item_', l_linenumber) end as name, concat('inside: ', case t when 1 then 'Item_' else 'item_' end, l_linenumber) as inside from s where t < 2),
r as (select path, first, case t when 0 then
  [{{'role': 'function boundary', 'facts': concat('definition: ', name, '|calls: ', name), 'note': concat('Introduces ', name, ', the function this excerpt is explaining.'), 'score': 55, 'worthy': true}}]
  || [{{'role': 'state/data', 'facts': concat('assigns: x|calls: no|', inside), 'note': 'Stores x so later Python logic in this scope can use it.', 'score': 50, 'worthy': true}} for x in range(k)]
  || [{{'role': 'call boundary', 'facts': concat('calls: quoted|', inside), 'note': '', 'score': 30, 'worthy': true}},
      {{'role': 'function boundary', 'facts': 'definition: still|calls: still', 'note': 'Introduces still, the function this excerpt is explaining.', 'score': 55, 'worthy': true}},
      {{'role': 'supporting statement', 'facts': 'inside: still', 'note': '', 'score': 0, 'worthy': true}}, {{'role': '', 'facts': '', 'note': '', 'score': 0, 'worthy': false}}]
 else
  [{{'role': 'function boundary', 'facts': concat('definition: ', name, '|calls: ', name), 'note': concat('Introduces ', name, ', the function this Go excerpt is explaining.'), 'score': 55, 'worthy': true}}]
  || [{{'role': 'call boundary', 'facts': concat('calls: call|', inside), 'note': '', 'score': 30, 'worthy': true}} for x in range(k)]
  || [{{'role': 'branch', 'facts': inside, 'note': '', 'score': 20, 'worthy': true}}, {{'role': 'supporting statement', 'facts': inside, 'note': '', 'score': 0, 'worthy': false}},
      {{'role': 'supporting statement', 'facts': inside, 'note': '', 'score': 0, 'worthy': false}}, {{'role': '', 'facts': '', 'note': '', 'score': 0, 'worthy': false}}] end as rows from n),
u as (select path, unnest(rows) as x, (first + generate_subscripts(rows, 1) - 1)::int as line_no from r)
select path, line_no, x.role as role, x.facts as facts, x.note as note, x.score as score, x.worthy as worthy from u
union all select path, max(line_no) + 1, '', '', '', 0, false from u group by path""")
def line_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.annotate(S.plain_lines(sources(spark, sf_dir)), languages=("python", "go")).select("path", "line_no", "role", F.array_join("facts", "|").alias("facts"), "note", "score", "worthy")


LINES = (
    "  await send(event);", "return cache.get(key)", "if (req.body) {", "router.on('close', handler)", "import x from 'y'", "for await (const e of stream(y)) {", "list.push(history)", "",
)
ABOUT = ("How does the stream cancel when a client leaves?", "Where is the history saved in the cache?", "Which page shows the layout?")
ROLES = ("call boundary", "output boundary", "branch", "event bridge", "iteration")
_L, _A, _R = (", ".join("'" + x.replace("'", "''") + "'" for x in xs) for xs in (LINES, ABOUT, ROLES))


@query(f"""with r as (select l_orderkey, l_linenumber, ([{_L}])[l_partkey % 8 + 1] as line, lower(([{_A}])[l_suppkey % 3 + 1]) as about, ([{_R}])[l_partkey % 5 + 1] as role from lineitem),
t as (select *, trim(line) as x from r),
b as (select *, case when x = '' then 0 else 30 * regexp_matches(x, '\\b(await|return|throw|yield)\\b')::int + 35 * regexp_matches(x, '(?i)\\b(stream|send|emit|publish|subscribe|listen|event)\\w*\\s*\\(')::int
  + 40 * regexp_matches(x, '(?i)\\b(abort|cancel|timeout|disconnect|close)\\b')::int + 45 * regexp_matches(x, '\\.\\s*on\\s*\\(')::int
  + 35 * regexp_matches(x, '\\.(upsert|insert|delete|add|write|save|query|watch|close|emit|send|read|open|connect)\\s*\\(')::int + 25 * regexp_matches(x, '\\b(onEvent|callback|handler|listener)\\b')::int
  + 8 * regexp_matches(x, '\\b(if|try|catch|switch|case)\\b')::int - 25 * regexp_matches(x, '^import\\b')::int end as behaviour,
  case role when 'call boundary' then 25 when 'output boundary' then 22 when 'branch' then case when regexp_matches(about, '\\b(branch|condition|case|choose|if|when|error)\\b') then 35 else 8 end
   when 'event bridge' then case when contains(about, 'stream') then 75 else 35 end else case when contains(about, 'stream') then 42 else 12 end end
  + 35 * regexp_matches(x, '\\bfor await\\b')::int + 30 * regexp_matches(x, '\\b(stream|send)\\w*\\s*\\(')::int as teaching,
  case when regexp_matches(x, '\\b(stream|send)\\s*\\(') then case when contains(about, 'stream') then 80 else 45 end else 0 end
  + case when regexp_matches(x, '\\b(cache|history)\\b|\\.get\\(') then case when contains(about, 'cache') then 55 else 10 end else 0 end
  + case when contains(x, '.push(') then case when contains(about, 'stream') or contains(about, 'cache') then 40 else 12 end else 0 end
  + case when regexp_matches(x, '\\b(req|body)\\b') then 24 else 0 end as concept from t)
select l_orderkey, l_linenumber, behaviour::int as behaviour, teaching::int as teaching, concept::int as concept from b""")
def line_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for lines of code under three questions."""
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.trim(pick(LINES, "l_partkey")).alias("line"), F.lower(pick(ABOUT, "l_suppkey")).alias("about"), pick(ROLES, "l_partkey").alias("role"))
    return rows.select("l_orderkey", "l_linenumber", A.behaviour_score(F.col("line")).alias("behaviour"), A.teaching_score(F.col("line"), F.col("role"), F.col("about")).alias("teaching"), A.concept_score(F.col("line"), F.col("about"), F.col("role")).alias("concept"))


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions, up to six of their lines as slots of a plan."""
    kind = F.element_at(F.array(*map(F.lit, (W.CODE, W.CALLOUT, W.FIGURE))), (F.col("l_partkey") % 3 + 1).cast("int"))
    ref = F.array(F.struct(F.concat(F.lit("f"), (F.col("l_suppkey") % 4).cast("string")).alias("path"), (F.col("l_quantity") * 2).cast("int").alias("line_start"), (F.col("l_quantity") * 2 + 20).cast("int").alias("line_end")))
    one = W.slot(F.concat(F.lit("s"), F.col("l_linenumber").cast("string")), kind, F.lit("x"), ref)
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 6").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    rows = lines.select(F.col("l_orderkey").alias("q"), F.struct("l_linenumber", one.alias("s")).alias("x"))
    return rows.groupBy("q").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("plan"))


#: A row for each number of a line: some orders repeat one.
SLOT_LINES = "lineitem1 as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity from lineitem where l_linenumber <= 6 group by all)"
PLAN = SLOT_LINES + """, p as (select l_orderkey as q, l_linenumber as n, (['annotated_code_excerpt', 'evidence_callout', 'mermaid_figure'])[l_partkey % 3 + 1] as kind, l_suppkey % 4 as f, (l_quantity * 2)::int as a, (l_quantity * 2)::int + 20 as z from lineitem1),
g as (select q, list(concat('s', n) order by n) as ids, list(kind order by n) as kinds, count(*) as size from p group by q),
ends as (select *, list_max([i for i in range(1, size + 1) if kinds[i] = 'evidence_callout']) as callout, list_max([i for i in range(1, size + 1) if kinds[i] <> 'mermaid_figure']) as other from g)"""


@query(f"""with {PLAN}, w as (select *, coalesce(callout, other) as gone, coalesce(callout, size) as any_gone from ends)
select q, array_to_string(case when size < 6 then ids || ['new'] when gone is null then ids else [case when i = gone then 'new' else ids[i] end for i in range(1, size + 1)] end, ',') as behind,
 array_to_string(case when size < 6 then ['new'] || ids else ['new'] || [ids[i] for i in range(1, size + 1) if i <> any_gone] end, ',') as in_front from w""")
def plan_slot_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot put behind each plan, with what is drawn protected, and in front."""
    new = W.slot(F.lit("new"), W.CODE, F.lit("x"), F.array().cast(f"array<{W.REF}>"))
    ids = lambda plan: F.array_join(F.transform(plan, lambda x: x["id"]), ",")
    return _slots(spark, sf_dir).select("q", ids(W.add(F.col("plan"), new, protect=True)).alias("behind"), ids(W.add(F.col("plan"), new, front=True)).alias("in_front"))


@query(f"with {SLOT_LINES}, " + """p as (select l_orderkey as q, l_linenumber as n, l_partkey % 3 as kind, l_suppkey % 4 as f, (l_quantity * 2)::int as a from lineitem1),
k1 as (select *, true as kept from p where n = 1),
""" + ",\n".join(f"k{n} as (select * from k{n - 1} union all select p.*, not (kind = 0 and exists (select 1 from k{n - 1} b where b.q = p.q and b.kept and b.kind = 0 and b.f = p.f and 21 - abs(b.a - p.a) >= 0.6 * 21)) from p where n = {n})" for n in range(2, 7)) + """
select q, string_agg(concat('s', n), ',' order by n) as ids from k6 where kept group by q""")
def plan_overlaps_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans without excerpts that an earlier one covers: ranges of 21 lines."""
    return W.drop_overlaps(_slots(spark, sf_dir)).select("q", F.array_join(F.transform("plan", lambda x: x["id"]), ",").alias("ids"))


def evidence_for(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions of benchmark with an opening that asks for something, and the twelve best documents of each as its evidence."""
    openings = F.array(*map(F.lit, ("Show me the code of ", "Draw the request flow of ", "Give me an overview of the whole system: ", "Which API routes are called for ", "Which dependencies and config files shape ")))
    asked = questions(spark, sf_dir).withColumn("text", F.concat(F.element_at(openings, (F.col("q") % 5 + 1).cast("int")), F.coalesce("text", F.lit(""))))
    own = files(spark, sf_dir).select(F.col("doc_id").alias("key"), "path", "content")
    found = R.bm25(own.select("key", F.col("content").alias("text")), asked, 12).join(own, "key")
    tool = F.when(F.col("key") % 3 == 0, "read_file").otherwise("search")
    return asked, found.select("q", F.col("rank").alias("ord"), tool.alias("tool"), "path", F.lit(1).alias("line_start"), F.size(T.lines(F.col("content"))).alias("line_end"), F.round(F.col("score") / (1 + F.col("score")), 6).alias("similarity"), "content")


@query()
def plan_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty plans after all rewrites; the tests hold them against a plain version."""
    asked, items = evidence_for(spark, sf_dir)
    none = asked.select("q", F.array().cast(f"array<{W.SLOT}>").alias("plan"))
    out = W.rewrite(none, Q.classify(asked), items, [])
    return out.select("q", F.posexplode("plan").alias("place", "s")).select("q", "place", "s.id", "s.kind", "s.intent", F.array_join(F.transform("s.hints", lambda h: h["path"]), ",").alias("paths"))
