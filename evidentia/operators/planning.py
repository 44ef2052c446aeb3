"""Routing of questions, evidence packets, plan items and answers: what surrounds a language model, without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import places
from ..functions import text as T
from . import questions as Q
from . import retrieval as R
from .evidence import dealt

FAST_CHARS, FAST_SIMILARITY, WEAK_SIMILARITY, TRACE_FLOOR = 120, 0.55, 0.3, 0.55
#: Characters of a search result, of a file that was read and of a line hit that an evidence item keeps.
SEARCH_CHARS, READ_CHARS, HIT_CHARS = 2200, 6000, 160


def is_overview(text: Column) -> Column:
    return Q.is_overview(Q.lowered(text))


def route(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(q, n_results, top_similarity, overview, fast, weak): fast for short, plain questions with one to three results of which the best is
    near; weak, which asks for another query, when the best has no similarity or a small one."""
    top = results.groupBy("q").agg(F.count(F.lit(1)).alias("n_results"), F.min_by("similarity", "rank").alias("first"), F.max("similarity").alias("top_similarity"))
    s = questions.join(top, "q", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0))).withColumn("overview", is_overview(F.col("text")))
    fast = ~F.col("overview") & F.col("n_results").between(1, 3) & (F.length("text") <= FAST_CHARS) & (F.coalesce("top_similarity", F.lit(0.0)) >= FAST_SIMILARITY)
    weak = F.col("first").isNull() | (F.col("first") < WEAK_SIMILARITY)
    return s.select("q", "n_results", "top_similarity", "overview", fast.alias("fast"), weak.alias("weak"))


def similar_traces(traces: DataFrame, questions: DataFrame, cutoff: Column, revision: DataFrame | None = None, limit: int = 3, floor: float = TRACE_FLOOR, others: bool = False) -> DataFrame:
    """(q, key, score, rank) of the nearest prior questions, traces (key, vec, ts, revision), that are not older than cutoff, of the current
    revision if one is given, and at least floor near; with others, none is its own trace (key = q). The filters come before the vectors are compared."""
    fresh = traces.filter(F.col("ts") >= cutoff)
    if revision is not None:
        fresh = fresh.join(F.broadcast(revision), "revision", "left_semi")
    if not others:
        return R.cosine_topk(fresh.select("key", "vec"), questions, limit, floor)
    # one more than asked for, as the own one may be among them
    near = R.cosine_topk(fresh.select("key", "vec"), questions, limit + 1, floor).filter("q <> key").drop("rank")
    return R.ranked(near, ["q"], [F.desc("score"), F.asc("key")], limit)


def seed_queries(questions: DataFrame, templates: list[tuple[str, str]], limit: int = 6) -> DataFrame:
    """(q, place, text): for overview questions the fixed sub-queries (kind, text), once each whatever their case and white space."""
    table = questions.sparkSession.createDataFrame([(i, k, t) for i, (k, t) in enumerate(templates)], "i int, kind string, seed string")
    rows = questions.filter(is_overview(F.col("text"))).select("q", F.lit("overview").alias("kind")).join(F.broadcast(table), "kind")
    one = rows.withColumn("n", F.lower(F.regexp_replace(F.trim("seed"), r"\s+", " "))).groupBy("q", "n").agg(F.min(F.struct("i", "seed")).alias("f"))
    return R.ranked(one, ["q"], [F.asc("f.i")], limit).select("q", F.col("rank").alias("place"), F.col("f.seed").alias("text"))


# ---- evidence items


def items_from_results(results: DataFrame, reads: DataFrame, hits: DataFrame) -> DataFrame:
    """(q, ord, tool, path, line_start, line_end, score, content) of search results, file reads and line hits: texts cut at 2200, 6000 and 160
    characters, at most eight line hits of a question."""
    a = results.select("q", F.lit("search").alias("tool"), "path", "line_start", "line_end", F.col("similarity").alias("score"), F.substring("content", 1, SEARCH_CHARS).alias("content"), F.col("rank").alias("o"))
    b = reads.select("q", F.lit("read_file").alias("tool"), "path", "line_start", "line_end", F.lit(None).cast("double").alias("score"), F.substring("content", 1, READ_CHARS).alias("content"), F.col("ord").alias("o"))
    c = R.ranked(hits, ["q"], [F.asc("path"), F.asc("line_no")], 8).select("q", F.lit("grep").alias("tool"), "path", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.lit(None).cast("double").alias("score"), F.substring("line", 1, HIT_CHARS).alias("content"), F.col("rank").alias("o"))
    rows = a.unionByName(b).unionByName(c).repartition("q")
    tool = F.array_position(F.array(*map(F.lit, ("search", "read_file", "grep"))), F.col("tool"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy(tool, "o", "path"))).drop("o")


def dedupe_items(items: DataFrame) -> DataFrame:
    """Items once per path, range and content, in the place of the first."""
    return R.ranked(items, ["q", "path", "line_start", "line_end", F.md5(F.coalesce("content", F.lit("")))], [F.asc("ord")], 1).drop("rank")


def evidence_message(items: DataFrame) -> DataFrame:
    """(q, message): the items of a question as one numbered text."""
    line = F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("] "), "path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("\n"), "content")
    parts = F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), line.alias("t"))))
    return items.groupBy("q").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("message"))


def visible_range(excerpt: Column) -> Column:
    """(first, last) line number that the gutter of an excerpt still shows."""
    numbers = F.transform(F.regexp_extract_all(excerpt, F.lit(r"(?m)^ *(\d+)  "), F.lit(1)), lambda x: x.cast("int"))
    return F.struct(F.array_min(numbers).alias("first"), F.array_max(numbers).alias("last"))


def read_range(first: Column, last: Column) -> Column:
    """The lines to read around a reference: ten before it and 170 behind its end; none around none."""
    return F.struct(F.when(first.isNotNull(), F.greatest(F.lit(1), first - 10)).alias("first"), (last + 170).alias("last"))


def evidence_for_plan(plan: DataFrame, evidence: DataFrame, limit: int = 4, hinted: int = 3) -> DataFrame:
    """(q, item, ord, place) of plan hints (q, item, path, s, e) and evidence (q, ord, path, line_start, line_end, rank): two points for the
    path, three for shared lines or one for a hint without lines; at most hinted by points, filled from the top."""
    points = F.when(F.col("s").isNull(), 3).when((F.col("line_start") <= F.col("e")) & (F.col("line_end") >= F.col("s")), 5).otherwise(2)
    scored = plan.join(evidence, ["q", "path"]).groupBy("q", "item", "ord").agg(F.sum(points).alias("points"), F.min("rank").alias("rank_"))
    best = R.ranked(scored, ["q", "item"], [F.desc("points"), F.asc("rank_")], hinted).select("q", "item", "ord", F.col("rank").alias("at"))
    items = plan.select("q", "item").distinct()
    rest = items.join(evidence.filter(F.col("rank") <= limit).select("q", "ord", "rank"), "q").join(best.select("q", "item", "ord"), ["q", "item", "ord"], "left_anti").select("q", "item", "ord", (F.col("rank") + 100).alias("at"))
    return R.ranked(best.unionByName(rest).repartition("q", "item"), ["q", "item"], [F.asc("at")], limit).select("q", "item", "ord", F.col("rank").alias("place"))


def uncovered(evidence: DataFrame, hints: DataFrame) -> DataFrame:
    """Evidence (q, path, line_start, line_end) that shares no line with a hint (q, path, s, e)."""
    e, h = evidence.alias("e"), hints.alias("h")
    meets = (F.col("e.q") == F.col("h.q")) & (F.col("e.path") == F.col("h.path")) & (F.col("e.line_start") <= F.col("h.e")) & (F.col("e.line_end") >= F.col("h.s"))
    return e.join(h, meets, "left_anti")


def code_component_count(ranked: DataFrame, limit: int = 6) -> DataFrame:
    """(q, n) of ranked evidence (q, rank, score, shares_term): one, and one for each other item with half of the best score that shares a term with
    the question; at most four or one less than limit."""
    w = Window.partitionBy("q")
    close = (F.col("score") >= 0.5 * F.max("score").over(w)) & F.col("shares_term") & (F.col("rank") > 1)
    return ranked.withColumn("close", close).groupBy("q").agg(F.least(1 + F.count_if("close"), F.lit(min(4, limit - 1))).alias("n"))


def surface_diverse(rows: DataFrame, wanted: Column, limit: int) -> DataFrame:
    """(q, path, place) of rows (q, rank, path): one of each wanted surface family first, then by rank."""
    family = places.family(F.col("path"))
    first = F.row_number().over(Window.partitionBy("q", "family").orderBy("rank")) == 1
    marked = rows.withColumn("family", family).withColumn("lead", first & F.coalesce(F.array_contains(wanted, F.col("family")), F.lit(False)))
    return R.ranked(marked.withColumnRenamed("rank", "r"), ["q"], [F.desc("lead"), F.asc("r")], limit).select("q", "path", F.col("rank").alias("place"))


def reconcile_draft(draft: DataFrame, candidates: DataFrame, limit: int = 8) -> DataFrame:
    """(q, path, place) of draft files (q, ord, path) that are candidates (q, ord, path), then other candidates in their order."""
    kept = draft.join(candidates.select("q", "path"), ["q", "path"], "left_semi").select("q", "path", F.col("ord").alias("at"))
    rest = candidates.join(draft.select("q", "path"), ["q", "path"], "left_anti").select("q", "path", (F.col("ord") + 1_000_000).alias("at"))
    return R.ranked(kept.unionByName(rest).repartition("q"), ["q"], [F.asc("at"), F.asc("path")], limit).select("q", "path", F.col("rank").alias("place"))


def merge_results(primary: DataFrame, secondary: DataFrame, limit: int, support: int = 3) -> DataFrame:
    """(q, path, line_start, line_end, similarity, place) of two searches' results (q, rank, path, line_start, line_end, similarity): once
    each, by similarity (none counts as 0), the supporting files among them last and no more than support; limit in all."""
    rows = primary.withColumn("leg", F.lit(0)).unionByName(secondary.withColumn("leg", F.lit(1))).withColumn("ord", F.struct("leg", "rank"))
    one = Q.first_by(dealt(rows, "q"), ["q"], F.struct("path", "line_start", "line_end"), "ord", 2**31 - 1).drop("place")
    w = lambda *by: Window.partitionBy("q", *by).orderBy(F.desc(F.coalesce("similarity", F.lit(0.0))), "ord")
    own = one.withColumn("helps", places.is_supporting(F.col("path"))).withColumn("nth", F.row_number().over(w("helps")))
    own = own.withColumn("last", F.col("helps") & (F.col("nth") <= support)).withColumn("at", F.row_number().over(w("last")))
    taken = F.count_if("last").over(Window.partitionBy("q"))
    kept = own.withColumn("taken", taken).filter(F.col("last") | (F.col("at") <= F.greatest(F.lit(0), limit - F.col("taken"))))
    place = F.row_number().over(Window.partitionBy("q").orderBy("last", "at"))
    return kept.withColumn("place", place).filter(F.col("place") <= limit).select("q", "path", "line_start", "line_end", "similarity", "place")


def hub_evidence(hubs: DataFrame, ranked: DataFrame) -> DataFrame:
    """(path, hub_rank, q, rank): the best of a question's ranked evidence (q, rank, path) in each hub (path, rank)."""
    best = ranked.groupBy("q", "path").agg(F.min("rank").alias("rank"))
    return best.join(F.broadcast(hubs.select("path", F.col("rank").alias("hub_rank"))), "path")


def runtime_group(group: Column) -> Column:
    """Whether a group of dependencies is needed when a system runs."""
    return ~F.contains(F.lower(F.coalesce(group, F.lit(""))), F.lit("dev"))


# ---- code in answers


def find_lines(content: Column, code: Column) -> Column:
    """The first line at which code stands in content line by line, white space at line ends and blank lines at its end ignored; null without."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"[ \t]+(\n|$)", "$1"), r"\n+$", "")
    at = F.instr(F.concat(F.lit("\n"), clean(content), F.lit("\n")), F.concat(F.lit("\n"), clean(code), F.lit("\n")))
    before = F.substring(F.concat(F.lit("\n"), clean(content)), F.lit(1), at)
    return F.when((at > 0) & (F.trim(code) != ""), F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))


def ground_code(components: DataFrame, evidence: DataFrame) -> DataFrame:
    """(q, id, path, line_start, line_end, state) of code components (q, id, path, code) against evidence (q, path, line_start, content): code that
    stands there word for word gets its real lines; else it is a gap."""
    n = F.size(T.lines(F.regexp_replace("code", r"\s+$", "")))
    rows = components.join(evidence, ["q", "path"], "left").withColumn("at", find_lines(F.col("content"), F.col("code")))
    best = rows.groupBy("q", "id", "path", "code").agg(F.min(F.when(F.col("at").isNotNull(), F.col("line_start") + F.col("at") - 1)).alias("first"))
    return best.select("q", "id", "path", F.col("first").alias("line_start"), (F.col("first") + n - 1).alias("line_end"), F.when(F.col("first").isNotNull(), "verified").otherwise("gap").alias("state"))


COMMENT = {"hash": r"^\s*#", "slash": r"^\s*(//|/\*|\*)", "dash": r"^\s*--", "markup": r"^\s*<!--"}


def comment_family(language: Column) -> Column:
    return F.when(language.isin("python", "bash", "yaml", "toml", "elixir"), "hash").when(language.isin("lua"), "dash").when(language.isin("html", "markdown"), "markup").otherwise("slash")


def classify_lines(lines: DataFrame) -> DataFrame:
    """lines (path, line_no, line) with (comment_only, structural_only, substantive)."""
    family = comment_family(F.coalesce(places.language(F.col("path")), F.lit("")))
    comment = F.lit(False)
    for name, pattern in COMMENT.items():
        comment = F.when(family == name, F.col("line").rlike(pattern)).otherwise(comment)
    bare = F.trim("line")
    structural = bare.rlike(r"^[\[\](){};,]*$") | bare.rlike(r"^(else|end|fi|done|begin|try|do)[:{]?$")
    return lines.withColumn("comment_only", comment).withColumn("structural_only", structural & (bare != "")).withColumn("substantive", ~comment & ~structural & (bare != ""))


def cut_line(lines: DataFrame, target: int, room: int) -> DataFrame:
    """(key, cut) of lines (key, line_no, line, callout): the last clean stop in the room lines up to target, not before the last callout, else target."""
    clean = F.trim("line").rlike(r"^$|^[})\]];?$|;$")
    last = F.coalesce(F.max(F.when(F.col("callout"), F.col("line_no"))), F.lit(0))
    k = lines.groupBy("key").agg(last.alias("low"))
    inside = lines.join(k, "key").filter(clean & (F.col("line_no") <= target) & (F.col("line_no") >= F.greatest(F.col("low"), F.lit(target - room))))
    return k.join(inside.groupBy("key").agg(F.max("line_no").alias("m")), "key", "left").select("key", F.coalesce("m", F.lit(target)).alias("cut"))


def leading_comments(lines: DataFrame, most: int = 4) -> DataFrame:
    """(key, line_no, start) of lines (key, line_no, quiet, definition): each definition with the quiet lines above it, at most four."""
    w = Window.partitionBy("key").orderBy("line_no")
    start, open_ = F.col("line_no"), F.lit(True)
    for i in range(1, most + 1):
        open_ = open_ & F.coalesce(F.lag("quiet", i).over(w), F.lit(False))
        start = F.when(open_, F.col("line_no") - i).otherwise(start)
    return lines.withColumn("start", start).filter("definition").select("key", "line_no", "start")


# ---- metrics and texts


def generation_metrics(rows: DataFrame) -> DataFrame:
    """Ratios of sums by type of case rows (type, cited, expected, faithful, callouts, grounded, refs): null where nothing was counted."""
    ratio = lambda a, b: F.round(F.try_divide(F.sum(a), F.sum(b)), 4)
    return rows.groupBy("type").agg(ratio("cited", "expected").alias("cite"), ratio("faithful", "callouts").alias("faith"), ratio("grounded", "refs").alias("ground"), F.count(F.lit(1)).alias("n"))


def merge_maps(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column): maps of numbers summed by their keys."""
    parts = rows.select(key, F.explode(column).alias("k", "v")).groupBy(key, "k").agg(F.sum("v").alias("v"))
    return parts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column))


def progress(done: Column, total: Column) -> Column:
    """0.14 to 0.94: what a bar shows while files are indexed."""
    share = F.when(total > 0, F.least(F.greatest(done / total, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.round(0.14 + 0.8 * share, 4)


def change_prompt(briefs: DataFrame, form: str = "llm_prompt") -> DataFrame:
    """(brief_id, text) of briefs (brief_id, title, goal, files, risks) as llm_prompt, repository_issue or ticket."""
    items = lambda c, mark: F.array_join(F.transform(F.col(c), lambda x: F.concat(F.lit(mark), x)), "\n")
    part = lambda head, body: F.when(body != "", F.concat(F.lit(head + "\n"), body))
    if form == "llm_prompt":
        text = F.concat_ws("\n\n", F.concat(F.lit("Implement: "), "title"), F.col("goal"), part("Start from these files:", items("files", "- ")), part("Mind these risks:", items("risks", "- ")))
    elif form == "repository_issue":
        text = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.col("goal"), part("## Files", items("files", "- [ ] ")), part("## Risks", items("risks", "- ")))
    else:
        text = F.concat_ws("\n", F.concat(F.lit("Summary: "), "title"), F.concat(F.lit("Description: "), "goal"), F.concat(F.lit("Files: "), F.array_join("files", ", ")), F.concat(F.lit("Risks: "), F.array_join("risks", ", ")))
    return briefs.select("brief_id", text.alias("text"))
