"""Queries of profiles, evidence scores, selections, and traces of behaviour."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import planning as P
from ..operators import profiles as PR
from ..operators import questions as Q
from .common import query, table
from .evidence_queries import ITEMS, _items
from .question_queries import _OVERVIEW, ASKED, _list, _m, asked

PROFILE_ROWS = ", ".join(
    f"('{r['id']}', '{r['family']}', '{r['category']}', {_list(r['direct'])}, {_list(r['evidence']) if r['evidence'] else '[]::varchar[]'})"
    for name in PR.places.LANGUAGES
    for r in [{"id": name, "family": PR.FAMILIES.get(name, name), "category": PR.category(name), "direct": PR.direct_terms(name), "evidence": PR.evidence_terms(name)}]
)
_HIT = "list_filter({0}, lambda t: case when regexp_matches(t, '[^a-z0-9]') then contains(low, t) else contains(padded, concat(' ', t, ' ')) end)"


@query(f"""with {ASKED}, p(id, family, category, direct, evidence) as (values {PROFILE_ROWS}),
lw as (select q, lower(text) as low, concat(' ', regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' ') as padded from asked),
h as (select q, id, family, category, {_HIT.format('direct')} as own, {_HIT.format('evidence')} as more, list_distinct(list_concat(direct, evidence)) as terms from lw, p),
s as (select q, id, family, category, len(own) * 3 + len(more) as score, array_to_string(list_sort(terms), ',') as terms from h where len(own) > 0)
select *, row_number() over (partition by q order by score desc, id) as rank from s""")
def profile_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = PR.match(asked(spark, sf_dir), PR.default_profiles(spark))
    return found.withColumn("terms", F.array_join(F.array_sort("terms"), ","))


#: A question for each language of documents.
QUESTIONS = {"en": "How does the search index store licenses?", "de": "Where is the page layout markup of the product stylesheet?", "es": "Which package dependencies do the api handlers use?", "fr": "Give me an overview of the system, and its json configuration"}


def _subject(col: str, words: str, weight: float, text: str) -> str:
    """The score of a question's tokens in SQL, made without the operator."""
    names = [re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", n) for n in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", text)]
    tokens = [t for t in dict.fromkeys(p.lower() for n in names for p in re.split(r"[^A-Za-z0-9]+", n)) if len(t) >= 3 and t not in V.EVIDENCE_STOPWORDS]
    out = []
    for t in tokens:
        forms = {t} | ({t[:-3] + "y"} if len(t) > 4 and t.endswith("ies") else set()) | ({t[:-1]} if len(t) > 3 and re.search("[^s]s$", t) else set()) | ({t[:-3]} if len(t) > 5 and t.endswith("ion") else set())
        tests = [f"contains({col}, '{f}')" for f in sorted(forms)] + ([f"list_has_any({words}, {_list(tuple(t[:i] for i in range(4, len(t))))})"] if len(t) >= 6 else [])
        out.append(f"({' or '.join(tests)})::int * {weight}")
    return " + ".join(out)


def _architecture(text: str) -> str:
    low, out = text.lower(), ["0"]
    if re.search(E.SURFACE_QUESTION, low):
        out += ["case when ext in ('html', 'md') then 5 else 0 end"] * bool(re.search(E.MARKUP_QUESTION, low)) + ["case when ext = 'css' then 5 else 0 end"] * bool(re.search(E.STYLE_QUESTION, low))
        out += [f"case when ext in ('html', 'md') and regexp_matches(c, '{E.MARKUP_CONTENT}') then 2 else 0 end", f"case when ext = 'css' and regexp_matches(c, '{E.STYLE_CONTENT}') then 2 else 0 end"]
    for col, (words, where, a, what, b) in zip(("c", "c", "regexp_replace(c, '[^a-z0-9]+', '', 'g')"), E.ARCHITECTURE, strict=True):
        if re.search(words, low):
            quoted = what.replace("'", "''")
            out += [f"case when regexp_matches(p, '{where}') then {a} else 0 end", f"case when regexp_matches({col}, '{quoted}') then {b} else 0 end"]
    if re.search(E.PACKAGE_QUESTION, low):
        out.append("case when supporting then 3 else 0 end")
    support = 2 if re.search(V.SUPPORTING, low) else 0.25
    out.append(f"case when supporting then {support} else 0 end")
    if text.startswith("Give me an overview"):
        out.append("case when ext = 'md' then 5 else 0 end")
    return " + ".join(out)


_BY = lambda f: "case q " + " ".join(f"when '{q}' then {f(t)}" for q, t in QUESTIONS.items()) + " end"


@query(f"""with {ITEMS}, w as (select *, lower(content) as c, split_part(path, '.', 2) as ext, split_part(path, '.', 2) in ('json', 'md') as supporting, regexp_extract_all(p, '[a-z][a-z0-9]{{3,}}') as pw, regexp_extract_all(h, '[a-z][a-z0-9]{{3,}}') as hw from hay where q in {tuple(QUESTIONS)}),
s as (select q, ord, round(coalesce(similarity * 5, 0) + case when tool = 'read_file' then 3 else 0 end + {_BY(lambda t: _subject('p', 'pw', 2.5, t))} + {_BY(lambda t: _subject('h', 'hw', 0.75, t))} + {_BY(_architecture)}
 + case when regexp_matches(content, '\\b(export|function|class|const|async|def|fn|struct|impl|app\\.(get|post|use)|create[A-Z]\\w+)\\b') then 0.75 else 0 end, 6)::double as score from w)
select *, row_number() over (partition by q order by score desc, ord) as rank from s""")
def evidence_full_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole score but profiles, for a question of each language."""
    asked_ = spark.createDataFrame(list(QUESTIONS.items()), "q string, text string")
    return E.full_score(_items(spark, sf_dir).drop("tokens"), asked_).select("q", "ord", "score", "rank")


@query(f"""with {ITEMS}, b as (select q, ord, path, lower(concat(path, chr(10), content[:2000])) as a, lower(concat(path, chr(10), content[:8000])) as e, split_part(path, '.', 2) = 'json' as own from hay where q = 'fr')
select ord, case when own then 1.75 else 0 end::double + least(1, 0.2 * (contains(a, 'json')::int + contains(a, 'configuration')::int + contains(a, 'manifest')::int + contains(a, 'field')::int + contains(a, 'schema')::int))::double as search,
 case when own then 6.25 else 0 end::double + least(3, 0.5 * (contains(e, 'json')::int + contains(e, 'configuration')::int + contains(e, 'manifest')::int + contains(e, 'field')::int + contains(e, 'schema')::int))::double as evidence from b""")
def profile_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the question that names a configuration in JSON."""
    asked_ = spark.createDataFrame([("fr", "its json manifest")], "q string, text string")
    ctx = PR.context(PR.match(asked_, PR.default_profiles(spark))).select("q", F.struct("ids", "families", "categories", "terms").alias("ctx"))
    rows = _items(spark, sf_dir).join(F.broadcast(ctx), "q")
    own = lambda f: F.round(f(F.col("ctx"), F.col("path"), F.col("content")), 6)
    return rows.select("ord", own(PR.profile_score).alias("search"), own(PR.evidence_boost).alias("evidence"))


PATHS = {
    "src/server/app.py": ("boundary", 0), "README.md": ("supporting", 1), "src/store/rows.py": ("data", 0), "__dependencies__/npm/left-pad.md": ("supporting", 1), "src/ui/page.tsx": ("presentation", 0),
    "config.json": ("configuration", 1), "src/core/run.py": ("core", 0), "tests/test_run.py": ("verification", 0), "src/server/auth.py": ("boundary", 0),
}
_PICK = f"({_list(tuple(PATHS))})[(l_partkey + l_linenumber) % {len(PATHS)} + 1]"
_LAYER = "case path " + " ".join(f"when '{p}' then '{layer}'" for p, (layer, _) in PATHS.items()) + " end"
SELECT = f"""{ASKED}, rk as (select l_orderkey as q, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey, l_suppkey) as rank, {_PICK} as path, l_suppkey % 6 = 0 as hubby from lineitem),
fl as (select q, {_m(V.SUPPORTING)} as wants, {_m(V.SUPPORTING)} or {_OVERVIEW} as allow, regexp_matches(low, '\\b(dependency|dependencies|devdependencies|manifest|version|versions|installed|install|package\\.json|package manager|npm|pnpm|yarn)\\b') as packages from (select q, lower(text) as low from asked)),
rf as (select rk.*, wants, allow, packages, ends_with(path, '.md') or ends_with(path, '.json') as supporting, starts_with(path, '__dependencies__/') as dependency, {_LAYER} as layer from rk join fl using (q))"""
_TURNS = "case when row_number() over (partition by q, cand, layer order by rank) = 1 then 0 when row_number() over (partition by q, cand, path order by rank) = 1 then 1 else 2 end"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    path = F.element_at(F.array(*map(F.lit, PATHS)), ((F.col("l_partkey") + F.col("l_linenumber")) % len(PATHS) + 1).cast("int"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey"))
    return li.select(F.col("l_orderkey").alias("q"), rank.alias("rank"), path.alias("path"), (F.col("l_suppkey") % 6 == 0).alias("hubby"))


OUTLINE = f"""{SELECT}, hb as (select distinct q, path from rk where hubby),
a as (select rf.*, hb.path is not null as hub from rf left join hb using (q, path)),
b as (select *, case when hub then row_number() over (partition by q, hub order by rank) end as hub_n from a),
c as (select *, coalesce(hub_n <= 5, false) as is_hub, not coalesce(hub_n <= 5, false) and supporting and (packages or not dependency) as able from b),
d as (select *, case when able then row_number() over (partition by q, able order by rank) end as sup_n, not hub and not supporting as cand from c),
e as (select *, coalesce(sup_n <= case when allow then 3 else 1 end, false) as is_sup, {_TURNS} as t from d),
f as (select *, case when cand then row_number() over (partition by q, cand order by t, rank) end as div_n, greatest(0, 4 - count(*) filter (is_hub) over (partition by q) - count(*) filter (is_sup) over (partition by q)) as room from e),
g as (select *, case when is_hub then 0 when div_n <= room then 1 when is_sup then 2 end as turn from f),
outline as (select q, rank, path, row_number() over (partition by q order by turn is null, turn, case turn when 0 then hub_n when 1 then div_n when 2 then sup_n end, rank) as place from g
 where turn is not null or (allow or not supporting) and (packages or not dependency) qualify place <= 4)"""


@query(f"with {OUTLINE} select * from outline")
def outline_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir)
    return E.outline_evidence(ranked.drop("hubby"), asked(spark, sf_dir), ranked.filter("hubby"), 4)


@query(f"""with {OUTLINE} select rf.q, rf.rank, rf.path, row_number() over (partition by rf.q order by o.place is null, o.place, rf.rank) as place from rf left join outline o on o.q = rf.q and o.rank = rf.rank where o.place is not null or packages or not dependency""")
def visible_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, own = _ranked(spark, sf_dir).drop("hubby"), asked(spark, sf_dir)
    return E.visible_evidence(ranked, own, outline_evidence(spark, sf_dir))


@query(f"""with {SELECT}, d as (select *, supporting and (packages or not dependency) as able, not supporting as cand from rf),
e as (select *, case when able then row_number() over (partition by q, able order by rank) end as sup_n, {_TURNS} as t from d),
f as (select *, coalesce(sup_n <= 1 and wants, false) as is_sup, case when cand then row_number() over (partition by q, cand order by t, rank) end as div_n from e),
g as (select *, case when div_n <= 4 - count(*) filter (is_sup) over (partition by q) then 0 when is_sup then 1 end as turn from f),
o as (select q, rank, path, row_number() over (partition by q order by turn is null, turn, coalesce(case when turn = 0 then div_n end, sup_n), rank) as place from g where turn is not null or packages or not dependency qualify place <= 4),
k as (select q, rank, path, row_number() over (partition by q order by again, rank) as place from (select *, row_number() over (partition by q, path order by rank) > 1 as again from rf) qualify place <= 4)
select 'mermaid_figure' as kind, * from o union all select 'annotated_code_excerpt', * from k""")
def component_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, own = _ranked(spark, sf_dir).drop("hubby"), asked(spark, sf_dir)
    parts = [E.component_evidence(ranked, own, kind).select(F.lit(kind).alias("kind"), "q", "rank", "path", "place") for kind in ("mermaid_figure", "annotated_code_excerpt")]
    return parts[0].unionByName(parts[1])


REFS = f"""refs as (select l_orderkey as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as ord, l_suppkey % 3 as component, case when l_suppkey % 2 = 0 then 'evidence_callout' else 'code' end as type, case l_partkey % 3 when 0 then 'gap' when 1 then 'inferred' else 'fact' end as kind,
 case when l_partkey % 7 = 0 then '' else {_PICK} end as path, l_partkey % 4 as line_start, l_partkey % 4 + 9 as line_end, concat('claim of ', l_returnflag) as claim from lineitem)"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    path = F.element_at(F.array(*map(F.lit, PATHS)), ((p + F.col("l_linenumber")) % len(PATHS) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("q"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("ord"), (s % 3).alias("component"), F.when(s % 2 == 0, "evidence_callout").otherwise("code").alias("type"),
        F.when(p % 3 == 0, "gap").when(p % 3 == 1, "inferred").otherwise("fact").alias("kind"), F.when(p % 7 == 0, "").otherwise(path).alias("path"), (p % 4).alias("line_start"), (p % 4 + 9).alias("line_end"),
        F.concat(F.lit("claim of "), "l_returnflag").alias("claim"),
    )


COLLECTED = f"{REFS}, ev as (select * from refs where path <> '' qualify row_number() over (partition by q, path, line_start, line_end, component order by ord) = 1)"
_ROLE = "case when regexp_matches(path, '/ui/') then 'user-facing' when contains(path, 'server') then 'request handling' when contains(path, 'store') then 'data/state' when contains(path, 'core/') then 'service logic' else 'implementation' end"


@query(f"""with {COLLECTED}, e as (select * from ev where not (type = 'evidence_callout' and kind = 'gap') qualify row_number() over (partition by q, path, line_start, line_end order by ord) = 1)
select q, path, line_start, line_end, {_ROLE} as role, row_number() over (partition by q order by ord) as place from e qualify place <= 5""")
def trace_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.entrypoints(E.collect_evidence(_refs(spark, sf_dir)))


@query(f"""with {COLLECTED}, t as (select q, coalesce(list(concat('s', ord) order by ord) filter (type = 'evidence_callout' and kind = 'inferred'), [])[1:5] as alternates, coalesce(list(concat('s', ord) order by ord) filter (type = 'evidence_callout' and kind = 'gap'), [])[1:5] as gaps from refs group by q),
k as (select q, list(concat('Changing ', path, ' lines ', line_start, '-', line_end, ' may affect ', {_ROLE}, ' behavior.') order by ord)[1:4] as risks from ev group by q)
select t.q, array_to_string(alternates, '|') as alternates, case when len(gaps) > 0 then array_to_string(gaps, '|') when risks is null then 'No source evidence was captured for this trace.' else 'Which alternate failure paths should be traced before modifying this behavior?' end as questions,
 coalesce(array_to_string(risks, '|'), 'Changing this behavior without source evidence is high risk.') as risks from t left join k using (q)""")
def trace_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark, sf_dir)
    components = refs.select("q", "ord", "type", "kind", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("summary"), F.lit("").alias("detail"))
    out = E.trace_texts(components, E.collect_evidence(refs))
    return out.select("q", *[F.array_join(c, "|").alias(c) for c in ("alternates", "questions", "risks")])


@query(f"""with {COLLECTED}, h as (select q, ord, lower(concat_ws(' ', path, claim, component::varchar, type)) as hay from ev),
s as (select q, ord, contains(hay, 'store')::int + contains(hay, 'claim')::int + contains(hay, 'code')::int + contains(hay, 'server')::int as score from h)
select q, ord, score, row_number() over (partition by q order by score desc, ord) as place from s where score > 0 qualify place <= 4""")
def condition_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = E.collect_evidence(_refs(spark, sf_dir)).withColumn("component", F.col("component").cast("string"))
    conditions = ev.select("q").distinct().withColumn("condition", F.lit("If the STORE claim, or code of a server"))
    return E.condition_evidence(ev.drop("place"), conditions.withColumn("condition", F.regexp_replace("condition", "If the|, or|of a", "")))


@query(f"""with {REFS}, e as (select * from refs qualify row_number() over (partition by q, path, line_start, line_end, claim order by ord) = 1)
select q, ord, case when regexp_matches(path, '^tests/') then 'test' when contains(path, '/ui/') then 'ui' when path = 'config.json' then 'config' when contains(path, 'store') then 'data' when contains(path, 'core/') then 'service' else 'source' end as role, row_number() over (partition by q order by ord) as place from e qualify place <= 12""")
def brief_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.brief_evidence(_refs(spark, sf_dir).withColumnRenamed("claim", "reason")).select("q", "ord", "role", "place")


@query(f"""with {ASKED} select q, array_to_string(case when len(a) > 0 then a else ['system'] end, ',') as actors from (select q, list_filter([{', '.join(f"case when {_m(p)} then '{n}' end" for n, p in E.ACTORS)}], lambda x: x is not null) as a from (select q, lower(text) as low from asked))""")
def trace_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("q", F.array_join(E.actors(F.col("text")), ",").alias("actors"))


@query("""with l as (select page_id as key, unnest(string_split_regex(coalesce(html, ''), '\\r?\\n')) as line from pages), b as (select key, trim(line) as b from l)
select key, count(*) filter (b <> '' and not regexp_matches(b, '^(#|//|/\\*|\\*|--|<!--)') and not regexp_matches(b, '^[\\[\\](){};,]*$')) >= 3 as substantive from b group by key""")
def substantive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a gutter, as evidence shows them."""
    lines = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.posexplode(F.split(F.coalesce("html", F.lit("")), "\r?\n", -1)).alias("i", "line"))
    return E.substantive(lines.select("key", F.concat((F.col("i") + 1).cast("string"), F.lit("  "), "line").alias("line")))


@query(f"""with {ASKED}, r as (select l_orderkey as q, l_linenumber % 2 as leg, row_number() over (partition by l_orderkey, l_linenumber % 2 order by l_linenumber, l_partkey, l_suppkey, l_quantity) as rank, {_PICK} as path, l_partkey % 3 as ls, case when l_suppkey % 4 > 0 then l_discount end as sim from lineitem),
o as (select *, ends_with(path, '.md') or ends_with(path, '.json') as helps from r qualify row_number() over (partition by q, path, ls order by leg, rank) = 1),
n as (select *, helps and row_number() over (partition by q, helps order by coalesce(sim, 0) desc, leg, rank) <= 3 as last from o),
a as (select *, row_number() over (partition by q, last order by coalesce(sim, 0) desc, leg, rank) as at_, count(*) filter (last) over (partition by q) as taken from n)
select q, path, ls as line_start, ls + 5 as line_end, sim as similarity, row_number() over (partition by q order by last, at_) as place from a where last or at_ <= greatest(0, 5 - taken) qualify place <= 5""")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    path = F.element_at(F.array(*map(F.lit, PATHS)), ((F.col("l_partkey") + F.col("l_linenumber")) % len(PATHS) + 1).cast("int"))
    leg = F.col("l_linenumber") % 2
    rank = F.row_number().over(Window.partitionBy("l_orderkey", leg).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = li.select(F.col("l_orderkey").alias("q"), leg.alias("l"), rank.alias("rank"), path.alias("path"), (F.col("l_partkey") % 3).alias("line_start"), (F.col("l_partkey") % 3 + 5).alias("line_end"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_discount")).alias("similarity"))
    return P.merge_results(rows.filter("l = 0").drop("l"), rows.filter("l = 1").drop("l"), 5)


FACTS = """fx as (select l_orderkey as path, case when l_partkey % 2 = 0 then 'definition' else 'import' end as kind, concat('Sym', l_suppkey % 5) as name, l_linenumber * 2 as ls, l_linenumber * 2 + l_quantity::int as le from lineitem)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") * 2
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.when(F.col("l_partkey") % 2 == 0, "definition").otherwise("import").alias("kind"), F.concat(F.lit("Sym"), (F.col("l_suppkey") % 5).cast("string")).alias("name"), n.alias("line_start"), (n + F.col("l_quantity").cast("int")).alias("line_end"))


@query(f"""with {FACTS}, s as (select distinct path, name, ls, le from fx where kind = 'definition'), r as (select *, row_number() over (partition by path order by ls, le, name) as place from s),
t as (select path, name, ls, le, place, row_number() over (partition by path order by place) as k from r where name in ('Sym1', 'Sym3'))
select path, name, ls as line_start, le as line_end from t where k = 1""")
def named_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(1, "sym1"), (1, "SYM3")], "q int, term string")
    return G.named_symbol(G.symbol_ranges(_facts(spark, sf_dir)), terms).drop("q")


@query("""select dep_group, not contains(lower(coalesce(dep_group, '')), 'dev') as runtime, count(*) as n from (select case l_partkey % 4 when 0 then 'devDependencies' when 1 then 'require-dev' when 2 then 'dependencies' end as dep_group from lineitem) group by 1, 2""")
def runtime_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey") % 4
    rows = table(spark, sf_dir, "lineitem").select(F.when(part == 0, "devDependencies").when(part == 1, "require-dev").when(part == 2, "dependencies").alias("dep_group"))
    return rows.groupBy("dep_group", P.runtime_group(F.col("dep_group")).alias("runtime")).agg(F.count(F.lit(1)).alias("n"))
