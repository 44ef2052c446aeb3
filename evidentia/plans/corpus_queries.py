"""Queries of scans, policies, line work, chunks and derived texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, places
from ..functions import text as T
from ..operators import chunking
from ..sources import corpus
from .common import FILES, files, query, table

FINGERPRINT = "v1"


@query("""with t as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as size_bytes from pages)
select page_id, size_bytes, case when size_bytes > 60000 then 'too_large' when length(regexp_replace(html[:4096], '[^\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) > 0.08 * length(html[:4096]) then 'binary' end as skip_reason from t""")
def scan_text_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("bytes"))
    return corpus.text_policy(pages.withColumn("size_bytes", F.octet_length("bytes").cast("long")), 60_000).select("page_id", "size_bytes", "skip_reason")


EXCLUDE = ["src1/**", "**/es/**", "*.css", "src2/en/*.js"]


@query(f"""with {FILES} select path, case
  when regexp_matches(path, '^(src1/.*|(.*/)?es/.*|.*[.]css|src2/en/[^/]*[.]js)$') then 'path_excluded'
  when regexp_matches(path, '^src3/.*$') and not regexp_matches(path, '^src3/(.*/)?[^/]*[.]go$') then 'repo_ignored' end as reason from files""")
def path_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = globs.ignore_rules([(".gitignore", "# comment\n/src3/\n"), ("src3/.gitignore", "!*.go\n")])
    return corpus.path_policy(files(spark, sf_dir).select("path"), EXCLUDE, rules).select("path", "reason")


@query(f"""with {FILES}, t as (select path, string_split_regex(content, '\\r?\\n') as l from files), s as (select path, l, len(l) as total_lines, least(6, 2 + 3 - 1, len(l)) as line_end from t)
select path, 2 as line_start, line_end, total_lines, line_end < total_lines as truncated,
  array_to_string(list_transform(range(2, line_end + 1), lambda i: concat(lpad(i::varchar, length((2 + greatest(0, line_end - 1) - 1)::varchar)::integer, ' '), '  ', l[i])), chr(10)) as excerpt from s""")
def line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.line_slice(files(spark, sf_dir).select("path", "content"), F.lit(2), F.lit(6), 3)


@query(f"""with {FILES}, l as (select path, unnest(string_split_regex(content, '\\r?\\n')) as line, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) as line_no from files)
select path, line_no, case when length(line) > 220 then concat(line[:220], '…') else line end as line from l where contains(line, 'License') order by path, line_no limit 30""")
def grep_fixed_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.grep(files(spark, sf_dir), "License")


@query(f"""with {FILES}, r as (select substr(path, length('src4/') + 1) as rest from files where starts_with(path, 'src4/')),
d as (select distinct split_part(rest, '/', 1) as name, case when contains(rest, '/') then 'dir' else 'file' end as kind from r)
select name, kind, (select count(*) from d) > 100 as truncated from d order by name, kind limit 100""")
def list_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.list_dir(files(spark, sf_dir), "src4")


@query(f"""with {FILES} select path, substr(sha256(concat('chunk', chr(10), 'v1', chr(10), content)), 1, 16) as content_hash from files""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", T.content_hash(F.col("content"), FINGERPRINT).alias("content_hash"))


@query(f"""with {FILES}, h as (select split_part(path, '/', 1) as repo, substr(sha256(path), 1, 3) as block, concat(path, ':', substr(sha256(content), 1, 16)) as line from files),
b as (select repo, block, substr(sha256(string_agg(line, chr(10) order by line)), 1, 16) as d, count(*) as n from h group by all)
select repo, substr(sha256(string_agg(concat(block, ':', d), chr(10) order by block)), 1, 16) as revision, sum(n)::bigint as n_files from b group by repo""")
def source_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.revisions(files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("repo"), "path", "content"))


CHUNK_CTE = f"""{FILES}, w as (select doc_id, path, string_split_regex(content, '\\r?\\n') as l from files),
c as (select doc_id, path, l, len(l) as n, unnest(range(0, case when len(l) <= 4 then 1 else (ceil((len(l) - 4) / 3.0) * 3 + 1)::bigint end, 3)) as a0 from w),
chunks as (select doc_id, path, a0 + 1 as line_start, least(a0 + 4, n) as line_end, array_to_string(l[a0 + 1 : a0 + 4], chr(10)) as content from c)"""


@query(f"with {CHUNK_CTE} select path, line_start, line_end, md5(content) as content_md5 from chunks")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.windows(files(spark, sf_dir).select("path", "content"), 4, 1)
    return cut.select("path", "line_start", "line_end", F.md5("content").alias("content_md5"))


@query(f"""with {FILES}, p as (select path, list_filter(string_split_regex(lower(regexp_replace(content, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') as parts from files)
select path, len(parts) as n_parts, len(list_distinct(parts)) as n_distinct, md5(array_to_string(parts, ' ')) as parts_md5 from p""")
def split_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole contents."""
    own = files(spark, sf_dir).select("path", T.split_identifier(F.col("content")).alias("parts"))
    return own.select("path", F.size("parts").alias("n_parts"), F.size(F.array_distinct("parts")).alias("n_distinct"), F.md5(F.array_join("parts", " ")).alias("parts_md5"))


@query(f"""with {FILES}, x as (select path, flatten(list_transform(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda n: list_transform(list_filter(string_split_regex(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda q: q <> ''), lambda q: lower(q)))) as t from files),
e as (select path, unnest(t) as w, generate_subscripts(t, 1) as i from x),
f as (select path, w, min(i) as i from e where length(w) >= 3 and w not in ({", ".join(f"'{w}'" for w in T.STOPWORDS)}) group by path, w),
r as (select path, w, row_number() over (partition by path order by i) as k from f),
g as (select path, string_agg(w, ' ' order by k) as terms from r where k <= 80 group by path)
select files.path, coalesce(terms, '') as terms from files left join g using (path)""")
def code_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.array_join(T.code_terms(F.col("content")), " ").alias("terms"))


@query(f"""with {FILES}, t as (select path, content, array_to_string(list_filter(string_split_regex(path, '[^A-Za-z0-9]+'), lambda x: x <> ''), ' ') as p from files)
select path, md5(concat_ws(chr(10), 'about ' || path, 'about ' || path, path, p, p, p, content)) as fts_md5 from t""")
def fts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.fts_text(F.col("path"), F.col("content"), F.concat(F.lit("about "), F.col("path")))
    return files(spark, sf_dir).select("path", F.md5(text).alias("fts_md5"))


@query(f"""with {FILES}, l as (select path, string_split_regex(content, '\\r?\\n') as l from files),
u as (select path, l, list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x))) + i - 1) as used from l),
k as (select path, l, len(list_filter(used, lambda x: x <= 500)) as n from u)
select path, greatest(1, n) as n_lines, n = 0 or n < len(l) as truncated, md5(case when n > 0 then array_to_string(l[1:n], chr(10)) else concat(l[1][:499], '…') end) as text_md5 from k""")
def clip_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = T.clip_lines(F.col("content"), 500)
    return files(spark, sf_dir).select("path", clip.alias("c")).select("path", F.col("c.n_lines").alias("n_lines"), F.col("c.truncated").alias("truncated"), F.md5("c.text").alias("text_md5"))


@query(f"""with {FILES} select split_part(path, '.', 2) as ext, case when split_part(path, '.', 2) = 'json' then 'configuration' when split_part(path, '.', 2) = 'md' then 'supporting' else 'core' end as layer,
 case split_part(path, '.', 2) when 'html' then 'markup' when 'md' then 'markup' when 'css' then 'style' end as family, split_part(path, '.', 2) in ('json', 'md') as supporting, count(*) as n_files
from files group by all""")
def path_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    d = files(spark, sf_dir).select(F.substring_index("path", ".", -1).alias("ext"), places.layer(p).alias("layer"), places.family(p).alias("family"), places.is_supporting(p).alias("supporting"))
    return d.groupBy("ext", "layer", "family", "supporting").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"""with {FILES}, s as (select path, case when length(content) > 20000 then 'too_large' when regexp_matches(path, '[.]css$') then 'path_excluded' end as reason from files)
select coalesce(reason, 'indexed') as reason, count(*) as n, round(count(*) / (select count(*) from s)::double, 4) as share from s group by 1""")
def skip_reason_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.coverage(files(spark, sf_dir).select(F.when(F.length("content") > 20_000, "too_large").when(F.col("path").rlike(r"\.css$"), "path_excluded").alias("reason")))


@query(f"""with {FILES} select path from files where regexp_matches(path, '^(.*/)?[^/]*[.]json$|^src1/.*') and not regexp_matches(path, '^src2/.*') order by path limit 80""")
def find_repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.find_files(files(spark, sf_dir), ["*.json", "src1/**"], exclude=["src2/**"])


@query(f"""with {FILES}, a as (select concat(case when doc_id % 9 = 0 then 'gone/' else '' end, path) as path from files)
select a.path, case when f.path is null then 'not_found' when regexp_matches(f.path, '[.]css$') then 'excluded' when strlen(content) > 20000 then 'too_large' else 'ok' end as status,
 case when f.path is not null and not regexp_matches(f.path, '[.]css$') and strlen(content) <= 20000 then md5(content) end as content_md5 from a left join files f using (path)""")
def read_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir)
    asked = own.select(F.concat(F.when(F.col("doc_id") % 9 == 0, "gone/").otherwise(""), F.col("path")).alias("path"))
    stored = own.withColumn("size_bytes", F.octet_length("content").cast("long")).withColumn("skip_reason", F.lit(None).cast("string")).withColumn("reason", F.when(F.col("path").rlike(r"\.css$"), "path_excluded"))
    return corpus.read_source(stored, asked, 20_000).select("path", "status", F.md5("content").alias("content_md5"))


@query("""with d as (select concat('__dependencies__/', source, '/', lang, '/', doc_id // 3, '.md') as path, doc_id as seq, md5(coalesce(text, '')) as content from documents)
select path, string_agg(content, chr(10) || chr(10) order by seq) as content from d group by path""")
def dedupe_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few documents share a path, as a dependency that several manifests name."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("__dependencies__/"), "source", F.lit("/"), "lang", F.lit("/"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit(".md"))
    return corpus.dedupe_docs(d.select(path.alias("path"), F.col("doc_id").alias("seq"), F.md5(F.coalesce("text", F.lit(""))).alias("content")))


@query()
def chunk_files_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the cut at 20,000 characters: sequential packing of lines, checked against the Python model in tests."""
    return chunking.chunk_files(files(spark, sf_dir).select("path", "content")).select("path", "line_start", "line_end", F.md5("content").alias("content_md5"))
