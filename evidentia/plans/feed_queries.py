"""Queries of tables that follow others, of manifests, contracts and healed diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions import text as T
from ..operators import chunking
from ..operators import evidence as E
from ..operators import stories
from ..sources import corpus, feed
from ..sources.shared import shared_dir
from ..sources.store import Catalog
from .common import files, query, table


def _refreshed(spark: SparkSession, sf_dir: str) -> Catalog:
    """Files and what is derived from them, after a batch that changes a fifth of the files and removes a seventh of the rest."""
    store = Catalog(spark, shared_dir(spark), buckets=16)
    own = files(spark, sf_dir).select("doc_id", "path", "content")
    store.apply_batch("files", own)
    derive = {
        "chunks": lambda rows: chunking.windows(rows.select("path", "content")).select("path", "line_start", "line_end", F.length("content").alias("n_chars")),
        "sizes": lambda rows: rows.select("path", F.length("content").alias("n_chars"), F.md5("content").alias("hash")),
    }
    tables = feed.Dependents(store, "files", derive)
    tables.refresh()
    changed = own.filter("doc_id % 5 = 1").withColumn("content", F.concat("content", F.lit("\nlast line")))
    store.apply_batch("files", changed, "path", own.filter("doc_id % 7 = 3 and doc_id % 5 <> 1").select("path"))
    tables.refresh()
    return store


FINAL = """files as (select doc_id, concat(source, '/', lang, '/', doc_id, '.', (['py','js','md','json','css','html','go','txt'])[doc_id % 8 + 1]) as path,
  coalesce(text, '') || case when doc_id % 5 = 1 then chr(10) || 'last line' else '' end as content from documents where doc_id % 7 <> 3 or doc_id % 5 = 1)"""


@query(f"""with {FINAL}, x as (select path, string_split_regex(content, '\\r?\\n') as l from files),
w as (select path, l, len(l) as n, unnest(range(0, case when len(l) <= 80 then 1 else (ceil((len(l) - 80) / 70.0) * 70 + 1)::bigint end, 70)) as a0 from x)
select path, (a0 + 1)::int as line_start, least(a0 + 80, n)::int as line_end, length(array_to_string(l[a0 + 1 : a0 + 80], chr(10)))::int as n_chars from w""")
def refreshed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir).read("chunks").select("path", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), "n_chars")


@query(f"with {FINAL} select path, length(content)::int as n_chars, md5(content) as hash from files")
def refreshed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir).read("sizes")


@query("""with f as (select user_id, event_id, event_type, case when event_id % 3 = 1 then 'late' else event_type end as now from events),
old as (select user_id, event_type as k, count(*) as n from f group by all), new as (select user_id, now as k, count(*) as n from f where user_id % 10 <> 4 group by all),
a as (select user_id, md5(string_agg(k || n, ',' order by k)) as h from old where user_id % 10 <> 5 group by user_id), b as (select user_id, md5(string_agg(k || n, ',' order by k)) as h from new group by user_id)
select coalesce(a.user_id, b.user_id) as user_id, case when a.h is null then 'added' when b.h is null then 'removed' else 'changed' end as action from a full join b on a.user_id = b.user_id where a.h is distinct from b.h""")
def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two versions of the counts of each user's events."""
    store = Catalog(spark, shared_dir(spark), buckets=16)
    e = table(spark, sf_dir, "events").withColumn("now", F.when(F.col("event_id") % 3 == 1, "late").otherwise(F.col("event_type")))
    old = e.filter("user_id % 10 <> 5").groupBy("user_id", F.col("event_type").alias("k")).count()
    new = e.filter("user_id % 10 <> 4").groupBy("user_id", F.col("now").alias("k")).count()
    first = store.apply_batch("counts", old, "user_id")
    feed.refresh_whole(store, "counts", new, "user_id")
    return feed.changes(store, "counts", first)


@query("""with c as (select * from conversations where conv_id % 6 <> 2)
select conv_id, count(*) as chapter_count, md5(arg_min(text, turn)) as title, md5(arg_max(text, turn)) as last_question, max(turn) as updated from (select conv_id, turn, case when conv_id % 5 = 0 then text || '!' else text end as text from c) group by conv_id""")
def sidecar_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of conversations kept beside them, after changes and removals, and a drift."""
    store = Catalog(spark, shared_dir(spark), buckets=16)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")

    def summarise(rows: DataFrame) -> DataFrame:
        return stories.summaries(rows.select(F.col("conv_id").alias("story_id"), F.col("turn").alias("seq"), F.col("text").alias("question")), None).withColumnRenamed("story_id", "conv_id")

    beside = feed.Sidecar(store, "conversations", "summaries", summarise)
    store.apply_batch("conversations", c, "conv_id")
    beside.summaries([F.asc("conv_id")])
    changed = c.filter("conv_id % 5 = 0").withColumn("text", F.concat("text", F.lit("!")))
    store.apply_batch("conversations", changed, "conv_id", c.filter("conv_id % 6 = 2").select("conv_id").distinct())
    store.apply_batch("conversations", c.limit(0), "conv_id", c.filter("conv_id % 6 = 2").select("conv_id").distinct())
    store.apply_batch("summaries", store.read("summaries").limit(0), "conv_id", c.filter("conv_id % 11 = 0").select("conv_id").distinct())
    return beside.summaries([F.asc("conv_id")], 2**31 - 1).select("conv_id", "chapter_count", F.md5("title").alias("title"), F.md5("last_question").alias("last_question"), "updated")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a manifest for each supplier, of the parts that it delivers, in one of five formats."""
    parts = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 20).cast("string").alias("n")).distinct().groupBy("l_suppkey").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    each = lambda f, sep="\n": F.array_join(F.transform("ns", f), sep)
    s = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    pom = s('<?xml version="1.0"?>\n<project xmlns="http://maven.apache.org/POM/4.0.0">\n<!-- <dependency> --><dependencies>\n', each(lambda n: s("<dependency><groupId>g", n, "</groupId>\n<artifactId>dep", n, "</artifactId><version>", n, ".0</version></dependency>")), "\n</dependencies></project>")
    lock = s("version = 3\n", each(lambda n: s('[[package]]\nname = "dep', n, '"\nversion = "', n, '.0"\ndependencies = [\n "x",\n]\n')), '[metadata]\nname = "no"\n')
    vcpkg = s('{"name": "x", "dependencies": [', each(lambda n: F.when(n.cast("int") % 2 == 0, s('"dep', n, '"')).otherwise(s('{"name": "dep', n, '", "version>=": "', n, '.0"}')), ", "), "]}")
    conan = s("[generators]\ncmake\n[requires]\n", each(lambda n: s("dep", n, "/", n, ".0@user/stable # c")), "\n[options]\nx/1.0\n")
    tsconfig = s("{\n// a comment\n\"compilerOptions\": {", each(lambda n: s('"dep', n, '": "', n, '.0"'), ","), "}}")
    kind = F.col("l_suppkey") % 5
    name = F.element_at(F.array(*map(F.lit, ("pom.xml", "Cargo.lock", "vcpkg.json", "conanfile.txt", "tsconfig.json"))), (kind + 1).cast("int"))
    return parts.select(F.concat(F.lit("r"), F.col("l_suppkey").cast("string"), F.lit("/"), name).alias("path"), F.when(kind == 0, pom).when(kind == 1, lock).when(kind == 2, vcpkg).when(kind == 3, conan).otherwise(tsconfig).alias("content"))


@query("""with p as (select distinct l_suppkey as s, l_partkey % 20 as n from lineitem)
select concat('r', s, '/', (['pom.xml', 'Cargo.lock', 'vcpkg.json', 'conanfile.txt', 'tsconfig.json'])[s % 5 + 1]) as path, (['compile', 'lock', 'dependencies', 'requires', 'compilerOptions'])[s % 5 + 1] as "group",
 case when s % 5 = 0 then concat('g', n, ':dep', n) else concat('dep', n) end as name, case when s % 5 = 2 and n % 2 = 0 then '' else concat(n, '.0') end as spec from p""")
def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = manifests(spark, sf_dir)
    of = lambda name: own.filter(T.basename(F.col("path")) == name)
    out = corpus.pom_dependencies(of("pom.xml")).unionByName(corpus.toml_tables(of("Cargo.lock"), "package"))
    return out.unionByName(corpus.vcpkg_dependencies(of("vcpkg.json"))).unionByName(corpus.conan_dependencies(of("conanfile.txt"))).unionByName(corpus.tsconfig_options(of("tsconfig.json")))


@query("""with p as (select distinct l_suppkey as s, l_partkey % 20 as n from lineitem),
d as (select (['jvm', 'rust', 'native', 'native', 'typescript'])[s % 5 + 1] as eco, case when s % 5 = 0 then concat('g', n, '_dep', n) else concat('dep', n) end as name, s from p)
select concat('__dependencies__/', eco, '/', name, '.md') as path, count(*) as n_manifests from d group by all""")
def dependency_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.dependency_docs(manifests(spark, sf_dir))
    return docs.select("path", F.size(F.regexp_extract_all("content", F.lit(r"(?m)^- manifest: (.*)$"), F.lit(1))).cast("long").alias("n_manifests"))


REQUEST = [C.Rule("question", "string", True, 1, 12), C.Rule("limit", "integer", least=1, most=50), C.Rule("mode", "string", values=("O",)), C.Rule("paths", "array", longest=2)]


@query("""with r as (select l_orderkey, l_linenumber, l_partkey % 8 as v, l_linestatus as m, floor(l_quantity)::int as n from lineitem)
select l_orderkey, l_linenumber, case v when 0 then case when m = 'O' then '' else 'mode: value' end when 1 then 'question: missing' when 2 then 'question: type' when 3 then 'extra: unknown,question: length'
 when 4 then case when n > 50 then 'limit: range' else '' end when 5 then 'not_json' when 6 then 'not_object' else 'limit: type,paths: length' end as violations from r""")
def request_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = F.col("l_partkey") % 8, lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    n = F.floor("l_quantity").cast("string")
    body = F.when(v == 0, s('{"question": " a b ", "mode": "', F.col("l_linestatus"), '"}')).when(v == 1, '{"limit": 1, "question": null}').when(v == 2, '{"question": 5, "limit": 50}')
    body = body.when(v == 3, '{"question": "  ", "limit": 1, "extra": true}').when(v == 4, s('{"question": "ok", "limit": ', n, ', "paths": ["a", "b"]}')).when(v == 5, '{"question": ').when(v == 6, "[1]").otherwise('{"question": "ok", "limit": "1", "paths": [1, 2, 3]}')
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(C.violations(body, REQUEST), ",").alias("violations"))


@query("""with d as (select conv_id as id, case when conv_id % 2 = 0 then 'sequenceDiagram' else 'flowchart TD' end as head, list(role = 'user' order by turn) as opens from conversations group by conv_id),
s as (select *, [list_sum([case when o then 1 else -1 end for o in opens[1:i]]) for i in range(1, len(opens) + 1)] as sums from d),
m as (select *, [least(0, list_min(sums[1:i])) for i in range(1, len(sums) + 1)] as lows from s),
k as (select *, [i for i in range(1, len(opens) + 1) if opens[i] or lows[i] >= case when i = 1 then 0 else lows[i - 1] end] as kept, (sums[len(sums)] - lows[len(lows)])::int as closed from m)
select id, array_to_string([head] || [case when opens[i] then 'alt x' else 'end' end for i in kept] || ['end' for x in range(closed)], chr(10)) as source, (len(opens) - len(kept))::bigint as dropped, closed from k""")
def diagrams_healed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stand for diagrams: a user's turn opens a block, any other closes one."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.when(x["role"] == "user", "alt x").otherwise("end")).alias("body"))
    head = F.when(F.col("conv_id") % 2 == 0, "sequenceDiagram").otherwise("flowchart TD")
    return E.heal_diagrams(c.select(F.col("conv_id").alias("id"), F.concat(head, F.lit("\n"), F.array_join("body", "\n")).alias("source")), close=True)
