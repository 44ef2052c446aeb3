"""Queries of the retrieval legs, fusion, boosts, selection and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, quality
from ..operators import retrieval as R
from ..operators import search as S
from .common import FILES, files, query, table


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"


def bm25_sql(docs: str, name: str = "bm25", limit: int = 20) -> str:
    """Expressions that end in name (q, key, score, rank) for docs (key, text) and the questions of benchmark."""
    return f"""own as (select key, {TOKENS.format("text")} as t from {docs}), sized as (select key, t, len(t) as dl from own),
size as (select count(*) as n, avg(dl) as avgdl from sized),
asked as (select distinct item_id as q, unnest({TOKENS.format("text")}) as term from benchmark),
tf as (select key, dl, term, count(*) as tf from (select key, dl, unnest(t) as term from sized) group by all),
df as (select term, count(*) as df from tf group by term),
bm as (select q, tf.key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
  from tf join df using (term) join asked using (term), size group by q, tf.key),
{name} as (select q, key, score, row_number() over (partition by q order by score desc, key) as rank from bm qualify rank <= {limit})"""


@query(f"with d as (select doc_id as key, coalesce(text, '') as text from documents), {bm25_sql('d')} select q, key as doc_id, score, rank from bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(_docs(spark, sf_dir), questions(spark, sf_dir), 20).withColumnRenamed("key", "doc_id")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label")


COSINE = """with c as (select a.vec_id as q, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id % 50 = 0 {0})
select q, vec_id, score, row_number() over (partition by q order by score desc, vec_id) as rank from c {1} qualify rank <= 6"""


@query(COSINE.format("", ""))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions are the vectors whose id is divisible by 50, against all vectors."""
    v = _vectors(spark, sf_dir)
    return R.cosine_topk(v, v.filter("key % 50 = 0").select(F.col("key").alias("q"), "vec"), 6).withColumnRenamed("key", "vec_id")


@query(COSINE.format("and b.label <> 3", "where score >= 0.2"))
def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return R.cosine_topk(v.filter("label <> 3"), v.filter("key % 50 = 0").select(F.col("key").alias("q"), "vec"), 6, R.THRESHOLD).withColumnRenamed("key", "vec_id")


def vector_sql(docs: str, name: str = "vec", limit: int = 20) -> str:
    """Expressions that end in name (q, key, score, rank): cosines of hashed counts."""
    one = lambda src, key, text: f"""select key, dim, sum(tf) as x from (select key, ('0x' || substr(md5(term), 1, 4))::bigint % 64 as dim, count(*) as tf
  from (select {key} as key, unnest({TOKENS.format(text)}) as term from {src}) group by key, term) group by key, dim"""  # noqa: E731
    return f"""dv as ({one(docs, 'key', 'text')}), qv as ({one('benchmark', 'item_id', 'text')}),
dn as (select key, sqrt(sum(x * x)) as norm from dv group by key), qn as (select key, sqrt(sum(x * x)) as norm from qv group by key),
dots as (select qv.key as q, dv.key, sum(qv.x * dv.x) as dot from qv join dv using (dim) group by 1, 2),
cos as (select q, dots.key, round(dot / (qn.norm * dn.norm), 6) as score from dots join dn on dn.key = dots.key join qn on qn.key = q),
{name} as (select q, key, score, row_number() over (partition by q order by score desc, key) as rank from cos where score >= 0.2 qualify rank <= {limit})"""


@query(f"with d as (select doc_id as key, coalesce(text, '') as text from documents), {vector_sql('d')} select q, key as doc_id, score, rank from vec")
def hashed_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = R.hashed_vectors(questions(spark, sf_dir).select(F.col("q").alias("key"), "text")).withColumnRenamed("key", "q")
    return R.cosine_topk(R.hashed_vectors(_docs(spark, sf_dir)), asked, 20, R.THRESHOLD).withColumnRenamed("key", "doc_id")


FUSED = f"""with d as (select doc_id as key, coalesce(text, '') as text from documents), {bm25_sql('d')}, {vector_sql('d')},
legs as (select q, key, rank, null::double as similarity, 'lexical' as origin from bm25 union all select q, key, rank, score, 'vector' from vec),
fused as (select q, key, round(sum(1 / (60.0::double + rank)), 9) as rrf, max(similarity) as similarity, list_sort(list(distinct origin)) as origins from legs group by q, key)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, docs = questions(spark, sf_dir), _docs(spark, sf_dir)
    asked = R.hashed_vectors(q.select(F.col("q").alias("key"), "text")).withColumnRenamed("key", "q")
    return R.fuse([("vector", R.cosine_topk(R.hashed_vectors(docs), asked, 20, R.THRESHOLD)), ("lexical", R.bm25(docs, q, 20))])


@query(f"{FUSED} select q, key as doc_id, rrf, similarity, array_to_string(origins, ',') as origins from fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("q", F.col("key").alias("doc_id"), "rrf", "similarity", F.array_join("origins", ",").alias("origins"))


@query("""with t as (select item_id as q, text, regexp_matches(text, '\\b[a-z][a-z0-9]*[A-Z]\\w*\\b|\\b[A-Z][a-z0-9]+[A-Z]\\w*\\b|\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b|\\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\\b|\\b\\w+(?:\\.\\w+)+\\(|\\b[\\w.-]+/[\\w./-]+\\b|\\b[\\w-]+\\.[a-z]{1,4}\\b|`[^`\\s]+`') as code,
  regexp_matches(text, '(?i)\\b(?:work(?:s|ing)? together|works? with|integrat\\w*|connect\\w*|wire[ds]?|wiring|talks? to|interacts? with|flow (?:from|between|through)|powered by|powers|uses? [\\w-]+ to\\b)') as verb from benchmark)
select q, case when code then 'identifier' when verb then 'relational' else 'product' end as shape, not (code) as use_graph, code or verb as use_boost from t""")
def policy_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.policy(questions(spark, sf_dir)).select("q", "shape", "use_graph", "use_boost")


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
CORE = ", ".join(f"'{w}'" for w in T.CORE)
TOKEN_CTE = f"""raw as (select item_id as q, regexp_extract_all(text, '[A-Za-z0-9_$@./-]{{2,}}') as r from benchmark),
every as (select q, flatten(list_transform(r, lambda t: list_concat([t], list_filter(string_split_regex(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> '')))) as ts from raw),
pos as (select q, unnest(ts) as token, generate_subscripts(ts, 1) as i from every),
normed as (select q, token, i, regexp_replace(regexp_replace(lower(token), '^@', ''), '[^a-z0-9]+', '', 'g') as norm from pos),
firsts as (select q, norm, min(i) as i, arg_min(token, i) as token from normed where norm not in ({STOP}) group by q, norm),
prio as (select *, case when norm = '' then 0 when regexp_matches(token, '[./@$-]') or regexp_matches(token, '[a-z0-9][A-Z]') or regexp_matches(token, '^[A-Z0-9_]{{2,}}$') then 5
  when norm in ({CORE}) then 4 when regexp_matches(norm, '{T.CORE_PATTERN}') then 2 else 0 end as p from firsts),
toks as (select q, token, row_number() over (partition by q order by p desc, i) as k from prio qualify k <= 8)"""


@query(f"with {TOKEN_CTE} select q, string_agg(token, ' ' order by k) as tokens from toks group by q")
def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_tokens(questions(spark, sf_dir)).select("q", F.array_join("tokens", " ").alias("tokens"))


BOOST = f"""{FUSED}, {TOKEN_CTE}, {FILES},
parts as (select q, list_distinct(list_filter(list(regexp_replace(regexp_replace(lower(token), '^@', ''), '[^a-z0-9]+', '', 'g')), lambda t: length(t) >= 2)) as parts from toks group by q),
ft as (select doc_id, path, list_filter(string_split_regex(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') as pt,
  list_filter(list_transform(string_split_regex(regexp_replace(content[:4000], '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x <> '') as ct from files),
boosted as (select fused.*, path, (len(list_intersect(parts, pt)) * 40 + len(list_filter(list_intersect(parts, ct), lambda x: not list_contains(pt, x))) * 3)::double as boost
  from fused join ft on ft.doc_id = fused.key join parts using (q)),
placed as (select *, row_number() over (partition by q order by rrf desc, key) as fused_rank, count(*) over (partition by q) as n_rows from boosted),
scored as (select *, round((n_rows - fused_rank + 1) * 2 + boost, 6) as score from placed)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, own = questions(spark, sf_dir), files(spark, sf_dir)
    fused = R.ranked(_fused(spark, sf_dir), ["q"], [F.desc("rrf"), F.asc("key")])
    features = R.lexical_tokens(q).withColumn("families", F.array().cast("array<string>")).withColumn("manifest_seeking", F.lit(True))
    rows = fused.join(own.withColumnRenamed("doc_id", "key"), "key").join(features, "q").withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy("q")))
    return R.domain_boost(rows).withColumn("score", F.round((F.col("n_rows") - F.col("rank") + 1) * 2 + F.col("boost"), 6)).withColumnRenamed("rank", "fused_rank")


@query(f"{BOOST} select q, key as doc_id, boost, score, case when boost > 0 then least(boost / 100, 1.9) else boost end as tiebreak, row_number() over (partition by q order by score desc, fused_rank) as rank from scored")
def domain_boost_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.ranked(_scored(spark, sf_dir), ["q"], [F.desc("score"), F.asc("fused_rank")])
    return rows.select("q", F.col("key").alias("doc_id"), "boost", "score", R.tiebreak(F.col("boost")).alias("tiebreak"), "rank")


#: Repositories stand for paths here, so that several rows share one.
DIVERSE = f"""{BOOST}, rep as (select *, split_part(path, '/', 1) as repo from scored),
again as (select *, row_number() over (partition by q, repo order by score desc, fused_rank) > 1 as again from rep)
select q, key as doc_id, repo as path, row_number() over (partition by q order by again, score desc, fused_rank) as rank from again qualify rank <= 6"""


@query(DIVERSE)
def path_diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("path", F.substring_index("path", "/", 1))
    return R.path_diverse(rows, 6, [F.desc("score"), F.asc("fused_rank")]).select("q", F.col("key").alias("doc_id"), "path", "rank")


@query(f"""{BOOST}, marked as (select *, split_part(path, '.', 2) in ('json', 'md') as sup from scored),
s as (select *, row_number() over (partition by q order by score desc, fused_rank) as own from marked where sup qualify own <= 2),
t as (select q, count(*) as taken from s group by q),
m as (select *, row_number() over (partition by q order by score desc, fused_rank) as own from marked where not sup qualify own <= 6),
u as (select q, key, own, false as support from m left join t using (q) where own <= 6 - coalesce(taken, 0) union all select q, key, own, true from s)
select q, key as doc_id, support, row_number() over (partition by q order by support, own) as rank from u qualify rank <= 6""")
def support_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import places

    rows = _scored(spark, sf_dir).withColumn("line_start", F.lit(1)).withColumn("line_end", F.lit(1)).withColumn("sup", places.is_supporting(F.col("path")))
    out = R.with_support(rows.filter("not sup"), rows.filter("sup"), 6, 2, [F.desc("score"), F.asc("fused_rank")])
    return out.select("q", F.col("key").alias("doc_id"), "support", "rank")


@query("""with r as (select l_orderkey as q, l_partkey % 7 as key, case when l_linenumber % 2 = 0 then 'lexical' else 'vector' end as origin, case when l_linenumber % 2 = 1 then round(l_discount, 4) end as similarity, l_quantity as score from lineitem)
select q, key, array_to_string(list_sort(list(distinct origin)), ',') as origins, max(similarity) as similarity, max(score) as score from r group by q, key""")
def merge_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("l_linenumber") % 2 == 1
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_partkey") % 7).alias("key"), F.array(F.when(odd, "vector").otherwise("lexical")).alias("origins"), F.when(odd, F.round("l_discount", 4)).alias("similarity"), F.col("l_quantity").alias("score"))
    return R.merge_signals(rows, ["q", "key"]).withColumn("origins", F.array_join("origins", ","))


SEARCH = f"""with {FILES}, x as (select path, string_split_regex(content, '\\r?\\n') as l from files),
w as (select path, l, len(l) as n, unnest(range(0, case when len(l) <= 80 then 1 else (ceil((len(l) - 80) / 70.0) * 70 + 1)::bigint end, 70)) as a0 from x),
chunks as (select path, a0 + 1 as line_start, least(a0 + 80, n) as line_end, array_to_string(l[a0 + 1 : a0 + 80], chr(10)) as content from w),
keyed as (select {{{{'path': path, 'line_start': line_start, 'line_end': line_end}}}} as key, * from chunks),
pt as (select *, array_to_string(list_filter(string_split_regex(path, '[^A-Za-z0-9]+'), lambda x: x <> ''), ' ') as p from keyed),
fts as (select key, concat_ws(chr(10), path, p, p, p, content) as text from pt), bodies as (select key, content as text from keyed),
{{0}}, {{1}},
legs as (select q, key, rank, null::double as similarity, 'lexical' as origin from bm25 union all select q, key, rank, score, 'vector' from vec),
fused as (select q, key, round(sum(1 / (60.0::double + rank)), 9) as rrf, max(similarity) as similarity, list_sort(list(distinct origin)) as origins from legs group by q, key),
placed as (select *, row_number() over (partition by q order by rrf desc, key) as fused_rank from fused qualify fused_rank <= 36),
{TOKEN_CTE.replace("{", "{{").replace("}", "}}")},
parts as (select q, list_distinct(list_filter(list(regexp_replace(regexp_replace(lower(token), '^@', ''), '[^a-z0-9]+', '', 'g')), lambda t: length(t) >= 2)) as parts from toks group by q),
shape as (select item_id as q, regexp_matches(text, '\\b[a-z][a-z0-9]*[A-Z]\\w*\\b|\\b[A-Z][a-z0-9]+[A-Z]\\w*\\b|\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b|\\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\\b|\\b\\w+(?:\\.\\w+)+\\(|\\b[\\w.-]+/[\\w./-]+\\b|\\b[\\w-]+\\.[a-z]{{{{1,4}}}}\\b|`[^`\\s]+`')
  or regexp_matches(text, '(?i)\\b(?:work(?:s|ing)? together|works? with|integrat\\w*|connect\\w*|wire[ds]?|wiring|talks? to|interacts? with|powered by|powers)\\b') as use_boost from benchmark),
b as (select placed.*, k.path, k.line_start, k.content, use_boost, count(*) over (partition by q) as n_rows, parts,
  list_filter(string_split_regex(lower(regexp_replace(k.path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') as pt,
  list_filter(list_transform(string_split_regex(regexp_replace(k.content[:4000], '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x <> '') as ct
  from placed join keyed k using (key) join shape using (q) join parts using (q)),
scored as (select *, round((n_rows - fused_rank + 1) * 2 + case when use_boost then len(list_intersect(parts, pt)) * 40 + len(list_filter(list_intersect(parts, ct), lambda x: not list_contains(pt, x))) * 3 else 0 end, 6) as score from b),
again as (select *, row_number() over (partition by q, path order by score desc, fused_rank) > 1 as again from scored),
best as (select *, row_number() over (partition by q order by again, score desc, fused_rank) as rank from again qualify rank <= 6)
select q, rank, path, line_start, round(similarity, 4) as similarity, rrf, score, array_to_string(origins, ',') as origins from best""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")


def _search_sql() -> str:
    head, rest = SEARCH.split("{0}, {1},")
    return f"{head}{bm25_sql('fts', 'bm25', 18)}, {vector_sql('bodies', 'vec', 18)},{rest}"


@query(_search_sql())
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all questions of benchmark against all documents, cut to chunks."""
    chunks = chunking.windows(files(spark, sf_dir).select("path", "content"))
    found = S.search(chunks, questions(spark, sf_dir))
    return found.select("q", "rank", "path", "line_start", "similarity", "rrf", "score", F.array_join("origins", ",").alias("origins"))


@query()
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranking by the default scorer: a model's place, checked against its definition in tests."""
    rows = R.ranked(_scored(spark, sf_dir), ["q"], [F.desc("score"), F.asc("fused_rank")], 30).join(questions(spark, sf_dir), "q")
    return R.rerank(rows, R.word_overlap).select("q", F.col("key").alias("doc_id"), "rank")


EXPECT = """expect as (select item_id as q, case item_id % 4 when 0 then 'product' when 1 then 'identifier' when 2 then 'leaky' else 'integration' end as type,
  doc_id from benchmark left join documents on contains(documents.text, benchmark.text))"""


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a question word for word are its answers. Found through the questions' rarest word, not by pairs."""
    q, docs = questions(spark, sf_dir), _docs(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("product", "identifier", "leaky", "integration"))), (F.col("q") % 4 + 1).cast("int"))
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    inner = q.select("q", F.explode(F.array_distinct(F.slice(words(F.col("text")), 2, F.greatest(F.lit(0), F.size(words(F.col("text"))) - 2)))).alias("w"))
    own = docs.select("key", F.explode(F.array_distinct(words(F.col("text")))).alias("w")).join(inner.select("w").distinct(), "w", "left_semi")
    rare = inner.join(own.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "w", "left").groupBy("q").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("w"))
    pairs = rare.join(own, "w").select("q", "key").join(q, "q").join(docs.withColumnRenamed("text", "body"), "key").filter(F.col("body").contains(F.col("text")))
    found = pairs.groupBy("q").agg(F.collect_list(F.col("key").cast("string")).alias("expect"))
    return q.select("q", kind.alias("type")).join(found, "q", "left").withColumn("expect", F.coalesce("expect", F.array().cast("array<string>")))


def steps(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    q, docs = questions(spark, sf_dir), _docs(spark, sf_dir)
    asked = R.hashed_vectors(q.select(F.col("q").alias("key"), "text")).withColumnRenamed("key", "q")
    vector, lexical = R.cosine_topk(R.hashed_vectors(docs), asked, 20, R.THRESHOLD), R.bm25(docs, q, 20)
    fused = R.ranked(R.fuse([("vector", vector), ("lexical", lexical)]), ["q"], [F.desc("rrf"), F.asc("key")], 6)
    return {"vector": vector.filter("rank <= 6"), "lexical": lexical.filter("rank <= 6"), "+lexical": fused}


LADDER = f"""{FUSED}, {EXPECT}, steps as (select 'vector' as step, q, key, rank from vec where rank <= 6 union all select 'lexical', q, key, rank from bm25 where rank <= 6
  union all select '+lexical', q, key, row_number() over (partition by q order by rrf desc, key) as rank from fused qualify rank <= 6),
s as (select distinct step from steps), cases as (select distinct step, q, type from expect, s),
hits as (select step, steps.q, min(rank) as rank from steps join expect on expect.q = steps.q and expect.doc_id = steps.key group by all),
h as (select cases.step, type, rank from cases left join hits using (step, q)),
m as (select step, coalesce(type, 'all') as type, round(avg((rank is not null)::int), 4) as recall, round(avg(coalesce(1.0 / rank, 0)), 4) as mrr, count(*) as n from h group by grouping sets ((step, type), (step)))"""


@query(f"{LADDER} select type, recall, mrr, n from m where step = '+lexical'")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = quality.first_hits(steps(spark, sf_dir)["+lexical"].select("q", "rank", F.col("key").cast("string").alias("path")), expected(spark, sf_dir))
    return quality.recall_mrr(hits)


@query(f"""{LADDER}, o as (select *, case step when 'vector' then 1 when 'lexical' then 2 else 3 end as place from m)
select step, type, recall, mrr, round(recall - lag(recall) over w, 4) as recall_delta, round(mrr - lag(mrr) over w, 4) as mrr_delta from o window w as (partition by type order by place)""")
def ladder_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = expected(spark, sf_dir)
    rows = None
    for step, found in steps(spark, sf_dir).items():
        one = quality.recall_mrr(quality.first_hits(found.select("q", "rank", F.col("key").cast("string").alias("path")), cases)).withColumn("step", F.lit(step))
        rows = one if rows is None else rows.unionByName(one)
    return quality.ladder(rows, ["vector", "lexical", "+lexical"])


@query("""with l as (select case toxic when 1 then 'gap' else 'cite' end as metric, lang, quality from labels join documents using (doc_id)),
c as (select concat(lang, '.', metric) as key, round(avg(quality), 4) as value, count(*) as n from l group by all),
b as (select concat(lang, '.', metric) as key, round(avg(quality), 4) as baseline from (select * from l where true) x where lang <> 'es' group by all),
s as (select key, case when key like 'd%' then baseline - 0.4 when key like 'f%' then baseline + 0.4 else baseline end as baseline from b),
j as (select key, baseline, value as current, n, round(value - baseline, 6) as delta from c full join s using (key)),
g as (select *, case when split_part(key, '.', 2) in ('gap', 'err', 'weakCallouts') then -delta else delta end as gain, greatest(0.05, 1.25 / n) as room from j)
select key, baseline, current, delta, case when current is null or baseline is null then 'missing' when n < 5 then 'small' when gain < -room then 'regressed' when gain > room then 'improved' else 'ok' end as verdict from g""")
def baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    key = F.concat("lang", F.lit("."), F.when(F.col("toxic") == 1, "gap").otherwise("cite")).alias("key")
    current = rows.groupBy(key).agg(F.round(F.avg("quality"), 4).alias("value"), F.count(F.lit(1)).alias("n"))
    shift = F.when(F.col("key").startswith("d"), -0.4).when(F.col("key").startswith("f"), 0.4).otherwise(0.0)
    baseline = current.filter(~F.col("key").startswith("es")).select("key", (F.col("value") + shift).alias("value"))
    return quality.gate(current, baseline)
