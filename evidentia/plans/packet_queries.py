"""Queries of what a question's evidence is put together from, and of stored paths and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..operators import graph as G
from ..operators import planning as P
from .common import FILES, files, query, table


def _legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of orders as search results, reads and line hits, numbered inside their leg."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").distinct()
    rank = F.row_number().over(Window.partitionBy("l_orderkey", F.col("l_partkey") % 3).orderBy("l_partkey", "l_suppkey", "l_quantity"))
    rows = own.withColumn("n", rank).select(F.col("l_orderkey").alias("q"), "n", (F.col("l_partkey") % 3).alias("leg"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("path"), F.repeat(F.lit("x"), (F.col("l_quantity") * 60).cast("int")).alias("content"), F.col("l_partkey").alias("line_no"))
    results = rows.filter("leg = 0").select("q", "path", F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), (F.col("n") / 10).alias("similarity"), "content", F.col("n").alias("rank"))
    reads = rows.filter("leg = 1").select("q", "path", F.lit(2).alias("line_start"), F.lit(8).alias("line_end"), F.repeat("content", 3).alias("content"), F.col("n").alias("ord"))
    return results, reads, rows.filter("leg = 2").select("q", "path", "line_no", F.col("content").alias("line"))


LEGS = """own as (select distinct l_orderkey as q, l_partkey, l_suppkey, l_quantity from lineitem),
legs as (select q, l_partkey % 3 as leg, concat('f', l_suppkey) as path, (l_quantity * 60)::int as size, l_partkey as line_no, row_number() over (partition by q, l_partkey % 3 order by l_partkey, l_suppkey, l_quantity) as n from own),
hits as (select *, row_number() over (partition by q order by path, line_no) as k from legs where leg = 2 qualify k <= 8),
items as (select q, 'search' as tool, path, 1 as line_start, n / 10.0 as score, least(size, 2200) as n_chars, 1 as t, n as o from legs where leg = 0
 union all select q, 'read_file', path, 2, null, least(size * 3, 6000), 2, n from legs where leg = 1 union all select q, 'grep', path, line_no, null, least(size, 160), 3, k from hits)"""


@query(f"with {LEGS} select q, row_number() over (partition by q order by t, o, path) as ord, tool, path, line_start::bigint as line_start, score, n_chars::int as n_chars from items")
def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = P.items_from_results(*_legs(spark, sf_dir))
    return items.select("q", "ord", "tool", "path", F.col("line_start").cast("long").alias("line_start"), "score", F.length("content").alias("n_chars"))


@query("""with i as (select l_orderkey as q, l_partkey as ord, l_suppkey % 3 as path, l_linenumber % 2 as s, l_linestatus as content from lineitem)
select q, path, s, content, min(ord) as ord from i group by all""")
def deduped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one path, range and content once, in the place of the first."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("ord"), (F.col("l_suppkey") % 3).alias("path"), (F.col("l_linenumber") % 2).alias("line_start"), (F.col("l_linenumber") % 2 + 5).alias("line_end"), F.col("l_linestatus").alias("content"))
    return P.dedupe_items(rows).select("q", "path", F.col("line_start").alias("s"), "content", "ord")


@query("""with e as (select distinct l_suppkey as path, l_partkey % 50 as target from lineitem), h as (select path, row_number() over (order by count(*) desc, path) as hub_rank from e group by path qualify hub_rank <= 5),
r as (select l_orderkey as q, l_suppkey as path, min(l_linenumber) as rank from lineitem group by all) select path, hub_rank, q, rank from r join h using (path)""")
def hub_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's best line of the suppliers that most parts come from."""
    li = table(spark, sf_dir, "lineitem")
    hubs = G.import_hubs(li.select(F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 50).alias("target")).distinct())
    return P.hub_evidence(hubs, li.select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("rank"))).select("path", "hub_rank", "q", "rank")


@query("""with l as (select page_id as key, unnest(string_split_regex(coalesce(html, ''), '\\r?\\n')) as line from pages)
select distinct concat('site/', key, '.html') as path, unnest(regexp_extract_all(line, '<(?:script|link|img|a)\\b[^>]*?(?:src|href)="([^"]+)', 1)) as specifier from l""")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages link to and load, once each."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    return G.import_edges(G.line_facts(pages, 1_000_000, ("html",))).distinct()


@query(f"with {FILES} select distinct path from files")
def stored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.known_paths(chunking.windows(files(spark, sf_dir).select("path", "content"), 10, 2))


@query(f"""with {FILES}, n as (select path, content, len(string_split_regex(content, '\\r?\\n')) as n, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, split_part(path, '/', -1) as base from files)
select path, md5(concat('File: ', path, ':1-', n, chr(10), 'Directory: ', dir, chr(10), 'Name terms: ', array_to_string(list_filter(string_split_regex(lower(base), '[^a-z0-9]+'), lambda x: x <> ''), ' '))) as head from n""")
def embedding_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of each file's embedded text, before the terms of its code."""
    own = files(spark, sf_dir).select("path", F.size(T.lines(F.col("content"))).alias("n"))
    return own.select("path", F.md5(T.embedding_head(F.col("path"), F.lit(1), F.col("n"), F.lit(None).cast("string"))).alias("head"))
