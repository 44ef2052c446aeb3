"""Evidence of questions: ranking, diverse selection, citations, excerpts and callouts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import places
from ..functions import text as T
from ..functions import vocabulary as V
from .questions import first_by, is_overview, wants_support
from .retrieval import wants_manifest

#: What looks like a definition.
DEFINITION = r"\b(export|function|class|const|async|def|fn|struct|impl|app\.(get|post|use)|create[A-Z]\w+)\b"


def in_groups(df: DataFrame, part: str, order: list[str], pick: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """The rows that pick makes of each group's rows in order. Groups stream through the sorted partitions, so that a task
    holds one group at a time, and thousands of small ones cost no more than their rows."""
    columns = [f.split()[0].strip("`") for f in schema.split(", ")]

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                if held and getattr(held[0], part) != getattr(row, part):
                    out += pick(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(pick(held) if held else [], columns=columns)

    return df.repartition(part).sortWithinPartitions(part, *order).mapInPandas(apply, schema)


#: Rows that a task sorts at once in a chain of windows.
ROWS_OF_A_TASK = 1 << 18


def dealt(rows: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """rows dealt by a column into so many partitions that a task has most of them on average: a chain of windows holds several sorts at
    once, and a fixed number of partitions would let these grow with the table."""
    n = -(-rows.count() // (most or ROWS_OF_A_TASK))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, by) if n > least else rows


def token_variants(token: Column) -> Column:
    """A token, and its forms without plural or -ion endings."""
    forms = F.array(
        token,
        F.when(token.rlike("ies$") & (F.length(token) > 4), F.regexp_replace(token, "ies$", "y")),
        F.when(token.rlike("[^s]s$") & (F.length(token) > 3), F.regexp_replace(token, "s$", "")),
        F.when(token.rlike("ion$") & (F.length(token) > 5), F.regexp_replace(token, "ion$", "")),
    )
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))


def token_matches(haystack: Column, token: Column) -> Column:
    return F.exists(token_variants(token), lambda v: F.contains(haystack, v))


def evidence_score(path: Column, content: Column, similarity: Column, tool: Column, tokens: Column) -> Column:
    """Five times the similarity, 3 for a file that was read, 2.5 and 0.75 for each token in the path and in the whole, 0.25
    for supporting files, 0.75 for what looks like a definition."""
    low = F.lower(path)
    hay = F.lower(F.concat(path, F.lit("\n"), F.substring(content, 1, 8000)))
    add = lambda n: (lambda acc, t: acc + F.lit(n))
    hits = F.aggregate(F.filter(tokens, lambda t: token_matches(low, t)), F.lit(0.0), add(2.5)) + F.aggregate(F.filter(tokens, lambda t: token_matches(hay, t)), F.lit(0.0), add(0.75))
    return F.coalesce(similarity * 5, F.lit(0.0)) + F.when(tool == "read_file", 3.0).otherwise(0.0) + hits + F.when(places.is_supporting(path), 0.25).otherwise(0.0) + F.when(content.rlike(DEFINITION), 0.75).otherwise(0.0)


def rank_evidence(items: DataFrame) -> DataFrame:
    """items (q, ord, path, content, similarity, tool, tokens) with (score, rank); ties keep the incoming order."""
    score = F.round(evidence_score(F.col("path"), F.col("content"), F.col("similarity"), F.col("tool"), F.col("tokens")), 6)
    return items.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "ord")))


def layer_diverse(items: DataFrame, limit: int) -> DataFrame:
    """items (q, rank, path) with (place): first those of a new path and a new layer, then of a new path, then the rest.

    A layer is a function of the path, so the first pass takes the best item of each layer and the second that of each path.
    """
    first = lambda by: F.row_number().over(Window.partitionBy("q", by).orderBy("rank")) == 1
    rows = items.withColumn("layer", places.layer(F.col("path")))
    turn = rows.withColumn("_turn", F.when(first("layer"), 0).when(first("path"), 1).otherwise(2))
    # a path whose best item a layer took has had its turn: its other items are among the rest
    place = F.row_number().over(Window.partitionBy("q").orderBy("_turn", "rank"))
    return turn.withColumn("place", place).filter(F.col("place") <= limit).drop("_turn")


def reconcile_refs(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(ref_id, path, line_start, line_end) of refs (ref_id, path, line_start, line_end) held against evidence (path, s, e):
    references to other paths go; the range with most overlap, then the nearest, then the first, clamps the rest."""
    rows = refs.join(evidence, "path")
    shared = T.overlap(F.col("line_start"), F.col("line_end"), F.col("s"), F.col("e"))
    best = F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("shared"), "far", "s", "e"))
    one = rows.withColumn("shared", shared).withColumn("far", T.distance(F.col("line_start"), F.col("line_end"), F.col("s"), F.col("e"))).withColumn("_k", best).filter("_k = 1")
    low, high = F.least(F.greatest("line_start", "s"), F.col("e")), F.greatest(F.least("line_end", "e"), F.col("s"))
    meets = F.col("shared") > 0
    return one.select("ref_id", "path", F.when(meets, low).otherwise(F.col("s")).alias("line_start"), F.when(meets, high).otherwise(F.col("e")).alias("line_end"))


def evidence_state(cited: Column, in_evidence: Column, verbatim: Column, kind: Column) -> Column:
    """verified, located, inferred, uncited or gap."""
    return F.when(kind == "gap", "gap").when(~cited, "uncited").when(verbatim, "verified").when(in_evidence, "located").otherwise("inferred")


def excerpt_windows(lines: DataFrame, size: int, top: int = 8) -> DataFrame:
    """(key, line_start, score) of lines (key, line_no, score, boundary): for each window of size lines the sum of its top
    line scores, its best line, and 4 or 8 points when it begins or also ends at a boundary."""
    w = Window.partitionBy("key").orderBy("line_no").rowsBetween(0, size - 1)
    scores = F.slice(F.sort_array(F.collect_list("score").over(w), asc=False), 1, top)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)
    edges = F.when(F.col("boundary") & F.last("boundary").over(w), 8.0).when(F.col("boundary"), 4.0).otherwise(0.0)
    return lines.select("key", F.col("line_no").alias("line_start"), F.round(total + F.max("score").over(w) + edges, 6).alias("score"))


def suppress_overlaps(ranges: DataFrame, most: int = 8, ratio: float = 0.6) -> DataFrame:
    """(key, s, e, score, place) of ranges (key, s, e, score): the best first, dropping those of which more than ratio of the
    smaller is shared with a kept one. A key is one group: a file's candidate windows."""

    def pick(rows: list) -> list[tuple]:
        kept: list = []
        for r in sorted(rows, key=lambda r: (-r.score, r.s, r.e)):
            if len(kept) < most and all(max(0, min(k.e, r.e) - max(k.s, r.s) + 1) <= ratio * min(k.e - k.s + 1, r.e - r.s + 1) for k in kept):
                kept.append(r)
        return [(*r, i + 1) for i, r in enumerate(kept)]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema.fields)
    return in_groups(ranges, "key", ["s"], pick, f"{kinds}, place int")


def select_callouts(candidates: DataFrame, limit: int) -> DataFrame:
    """(key, line_no, note, score) of candidates: the best of each line, of those the best of each note, the best limit, by line."""
    one = lambda df, part: df.withColumn("_k", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("score"), "line_no", "note"))).filter("_k = 1").drop("_k")
    note_key = F.lower(F.regexp_replace("note", "[^A-Za-z0-9]+", " ")).alias("note_key")
    picked = one(one(candidates.select("*", note_key), ["key", "line_no"]), ["key", "note_key"])
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "line_no"))
    return picked.withColumn("_k", best).filter(F.col("_k") <= limit).select("key", "line_no", "note", "score")


def nearest_line(points: DataFrame, lines: DataFrame, reach: int) -> DataFrame:
    """(key, line_no, target) of points (key, line_no): the nearest of lines (key, target) within reach, below before above."""
    near = points.join(lines, "key").filter(F.abs(F.col("target") - F.col("line_no")) <= reach)
    first = F.row_number().over(Window.partitionBy("key", "line_no").orderBy(F.abs(F.col("target") - F.col("line_no")), F.col("target") < F.col("line_no")))
    return near.withColumn("_k", first).filter("_k = 1").select("key", "line_no", "target")


def dedupe_components(components: DataFrame) -> DataFrame:
    """components (q, ord, signature, confidence, id) once per signature: the most confident, in the place of the first."""
    best = components.groupBy("q", "signature").agg(F.min_by("id", F.struct(-F.col("confidence"), F.col("ord"), F.col("id"))).alias("id"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord"))
    return best.select("q", "id", "confidence", "signature", F.row_number().over(Window.partitionBy("q").orderBy("ord", "signature")).alias("place"))


def drop_overlapping(items: DataFrame, ratio: float = 0.6) -> DataFrame:
    """items (q, ord, path, s, e) without those that share at least ratio of the smaller range with a kept earlier one."""

    def pick(rows: list) -> list[tuple]:
        kept: list = []
        for r in rows:
            if all(k.path != r.path or max(0, min(k.e, r.e) - max(k.s, r.s) + 1) < ratio * min(k.e - k.s + 1, r.e - r.s + 1) for k in kept):
                kept.append(r)
        return [tuple(r) for r in kept]

    return in_groups(items, "q", ["ord", "path", "s"], pick, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields))


def lean_answers(ranked: DataFrame) -> DataFrame:
    """(q, type, path, line_start, line_end, confidence) of ranked evidence (q, rank, path, line_start, line_end, similarity): one
    callout from the best item, its confidence between 0.55 and 0.95, or a gap where a question has none."""
    top = ranked.filter("rank = 1")
    confidence = F.when(F.col("similarity").isNull(), 0.75).otherwise(F.least(F.greatest(F.col("similarity"), F.lit(0.55)), F.lit(0.95)))
    return top.select("q", F.when(F.col("path").isNull(), "gap").otherwise("callout").alias("type"), "path", "line_start", "line_end", F.when(F.col("path").isNotNull(), F.round(confidence, 4)).otherwise(0.0).alias("confidence"))


def feature_trace(components: DataFrame) -> DataFrame:
    """(q, confidence, n_gaps, n_refs, paths) of components (q, kind, confidence, path): the mean confidence, at most 0.6 with a
    gap and 0 without evidence, and the first six distinct paths."""
    gap = F.col("kind") == "gap"
    agg = components.groupBy("q").agg(
        F.avg("confidence").alias("mean"), F.count_if(gap).alias("n_gaps"), F.count("path").alias("n_refs"), F.slice(F.array_sort(F.collect_set("path")), 1, 6).alias("paths")
    )
    value = F.when(F.col("n_refs") == 0, 0.0).when(F.col("n_gaps") > 0, F.least(F.col("mean"), F.lit(0.6))).otherwise(F.col("mean"))
    return agg.select("q", (F.floor(F.round(value, 6) * 100 + 0.5) / 100).alias("confidence"), "n_gaps", "n_refs", "paths")


def candidate_files(evidence: DataFrame, limit: int = 8) -> DataFrame:
    """(q, path, reason, confidence, n_refs, place) of evidence (q, ord, path, reason, level): by path the first reason, the highest
    of low, medium and high, and the number of distinct references."""
    order = F.array(*map(F.lit, ("low", "medium", "high")))
    agg = evidence.groupBy("q", "path").agg(F.min_by("reason", F.struct("ord", "reason")).alias("reason"), F.element_at(order, F.max(F.array_position(order, F.col("level"))).cast("int")).alias("confidence"), F.countDistinct("line_start", "line_end").alias("n_refs"), F.min("ord").alias("ord"))
    return agg.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("ord", "path"))).filter(F.col("place") <= limit).drop("ord")


def lint_diagrams(diagrams: DataFrame) -> DataFrame:
    """(id, ok, problem) of diagrams (id, source): a known header, blocks that end and never close too early, branches inside
    blocks only, and balanced brackets in flow charts."""
    rows = diagrams.select("id", F.posexplode(T.lines(F.col("source"))).alias("i", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    word = F.regexp_extract("line", r"^(\w+)", 1)
    opens = word.isin(*OPENERS).cast("int") - (word == "end").cast("int")
    w = Window.partitionBy("id").orderBy("i")
    deep = rows.withColumn("word", word).withColumn("depth", F.sum(opens).over(w)).withColumn("first", F.row_number().over(w) == 1)
    brackets = F.length(F.regexp_replace("line", r"[^\[\](){}]", ""))
    stray = F.col("word").isin("else", "and", "option") & (F.col("depth") < 1)
    s = deep.groupBy("id").agg(
        F.max(F.when(F.col("first"), F.col("line"))).alias("head"), F.min("depth").alias("low"), F.max_by("depth", "i").alias("last"), F.max(stray.cast("int")).alias("stray"), F.sum(brackets % 2).alias("odd")
    )
    known = F.col("head").rlike(r"^(sequenceDiagram|flowchart|graph|stateDiagram(-v2)?|classDiagram|erDiagram)\b")
    problem = F.when(~known, "header").when(F.col("low") < 0, "end_without_block").when(F.col("last") != 0, "open_block").when(F.col("stray") == 1, "branch_outside").when(F.col("head").rlike("^(flowchart|graph)") & (F.col("odd") > 0), "brackets")
    return s.select("id", problem.isNull().alias("ok"), problem.alias("problem"))


#: Words that open a block of a diagram.
OPENERS = ("alt", "opt", "loop", "par", "critical", "rect", "subgraph")


def heal_diagrams(diagrams: DataFrame, close: bool = False) -> DataFrame:
    """(id, source, dropped, closed) of diagrams (id, source): without the lines `end` that close no block, and with close with as many of
    them behind the last line as blocks are open. Comments open and close nothing; a sound diagram stays as it is.

    The depth never falls below 0, so it is the running sum of openers and ends less its own running minimum, where that is negative.
    """
    rows = diagrams.select("id", F.posexplode(F.split("source", "\r?\n", -1)).alias("i", "line"))
    bare = F.trim("line")
    mark = F.when(bare.startswith("%%"), 0).when(F.regexp_extract(bare, r"^(\w+)", 1).isin(*OPENERS), 1).when(bare == "end", -1).otherwise(0)
    w = Window.partitionBy("id").orderBy("i")
    summed = rows.withColumn("mark", mark).withColumn("sum", F.sum("mark").over(w))
    low = summed.withColumn("low", F.least(F.lit(0), F.min("sum").over(w))).withColumn("before", F.least(F.lit(0), F.coalesce(F.min("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    stray = low.withColumn("stray", (F.col("mark") == -1) & (F.col("low") < F.col("before")))
    kept = F.array_sort(F.collect_list(F.when(~F.col("stray"), F.struct("i", "line"))))
    one = stray.groupBy("id").agg(kept.alias("kept"), F.count_if("stray").alias("dropped"), (F.max_by("sum", "i") - F.min("low")).alias("open"))
    lines = F.transform("kept", lambda x: x["line"])
    ends = F.array_repeat(F.lit("end"), F.col("open").cast("int")) if close else F.array().cast("array<string>")
    changed = F.when((F.col("dropped") > 0) | (F.size(ends) > 0), F.array_join(F.concat(lines, ends), "\n"))
    healed = one.select("id", changed.alias("healed"), "dropped", F.size(ends).alias("closed"))
    return diagrams.select("id", "source").join(healed, "id", "left").select("id", F.coalesce("healed", "source").alias("source"), F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce("closed", F.lit(0)).alias("closed"))


def is_weak_note(note: Column) -> Column:
    """Whether a note only restates the syntax, or is blank."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(note, F.lit("")), r"\s+", " ")))
    return reduce(lambda a, p: a | low.rlike(p), V.WEAK_NOTES, low == "")


def is_non_teaching(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(*V.NON_TEACHING)


def sanitize_callouts(callouts: DataFrame, allowed: DataFrame, limit: int = 5) -> DataFrame:
    """(key, line_no, note, place) of callouts (key, ord, line_no, note) on allowed (key, line_no) lines: no weak notes, the first
    of each line, of those the first of each note whatever its case, quotes and blanks, and the first limit."""
    clean = F.substring(F.trim(F.regexp_replace("note", r"\s+", " ")), 1, 280)
    rows = callouts.withColumn("note", clean).filter(~is_weak_note(F.col("note"))).join(allowed.select("key", "line_no").distinct(), ["key", "line_no"], "left_semi")
    lines = first_by(rows, ["key"], F.col("line_no"), "ord", 2**31 - 1).drop("place")
    return first_by(lines, ["key"], F.lower(F.regexp_replace("note", "[`'\"]", "")), "ord", limit).select("key", "line_no", "note", "place")


# ---- boosts by what a question is about

#: Fixed values: (words of the question, pattern of the path, points, pattern of the content, points); the last content without
#: other characters than letters and digits.
ARCHITECTURE = (
    (
        r"\b(apis?|endpoints?|routes?|webhooks?|sse|streaming|handlers?|controllers?)\b", r"(^|/)(server|servers|routes?|controllers?|handlers?|apis?|endpoints?|middleware)\b", 4.0,
        r"\b(app|router|server|api)\s*\.\s*(get|post|put|patch|delete|del|head|options|all|use)\s*\(|@(app|router)\.(get|post|put|patch|delete)\b|@(get|post|put|patch|delete|request)mapping\b|['\"`]/api/", 3.0,
    ),
    (
        r"\b(db|database|datastore|store|storage|orm|schema|model|migration|repository|dao|sql|query|queries)\b", r"(^|/)(db|database|data|store|storage|model|schema|repository|repositories|dao|migration|prisma)", 3.0,
        r"\b(table|schema|query|upsert|insert|select|where|migration|model|repository|prisma|sequelize|typeorm|mongoose)\b", 2.0,
    ),
    (
        r"\b(index|indexing|indexed|retrieval|search|vector|embedding|embeddings|chunk|chunking)\b", r"(^|/)(index|indexes|search|retrieval|embed|embedding|chunk|vector|store|db|database|watch|dependency)", 4.0,
        r"index|embed|embedding|vector|search|upsert|dependency|watcher|chunk", 3.0,
    ),
)
#: Questions about what is seen, of which markup and of which style; and their content.
SURFACE_QUESTION = r"\b(ui|browser|frontend|page|screen|layout|html|markup|dom|css|style|styles|stylesheet|selector|theme|visual|appearance)\b"
MARKUP_QUESTION = r"\b(ui|browser|frontend|page|screen|layout|html|markup|dom|visible)\b"
STYLE_QUESTION = r"\b(layout|css|style|styles|stylesheet|selector|theme|visual|appearance|color|spacing|responsive)\b"
MARKUP_CONTENT = r"</?(html|head|body|main|section|form|button|input|nav|header|footer|div|span)\b"
STYLE_CONTENT = r"[{;}]\s*(\n|$)|--[\w-]+\s*:"
#: Questions about packages.
PACKAGE_QUESTION = r"\b(dependencies|dependency|install|installs|package|packages|npm|pnpm|yarn|python|pip|rust|cargo|crate|typescript|tsconfig|config|configuration)\b"


def architecture_boost(question: Column, path: Column, content: Column) -> Column:
    """Points for items of the part of a system that a question is about: what is seen, interfaces, search, storage, packages."""
    q, p, c = (F.lower(F.coalesce(x, F.lit(""))) for x in (question, path, content))
    family = places.family(path)
    when = lambda condition, n: F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0.0)
    seen = q.rlike(SURFACE_QUESTION)
    markup, style = seen & (family == "markup"), seen & (family == "style")
    score = when(markup & q.rlike(MARKUP_QUESTION), 5.0) + when(style & q.rlike(STYLE_QUESTION), 5.0) + when(markup & c.rlike(MARKUP_CONTENT), 2.0) + when(style & c.rlike(STYLE_CONTENT), 2.0)
    bare = F.regexp_replace(c, "[^a-z0-9]+", "")
    for text, (words, where, a, what, b) in zip((c, c, bare), ARCHITECTURE, strict=True):
        score = score + when(q.rlike(words) & p.rlike(where), a) + when(q.rlike(words) & text.rlike(what), b)
    return score + when(q.rlike(PACKAGE_QUESTION) & places.is_supporting(path), 3.0)


def evidence_tokens(question: Column, limit: int = 40) -> Column:
    """The words of a question that tell its subject, parts of identifiers by themselves, once each."""
    names = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
    parts = F.flatten(F.transform(names, lambda n: T.split_identifier(n)))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= 3) & ~p.isin(*V.EVIDENCE_STOPWORDS))), 1, limit)


def token_forms(tokens: Column) -> Column:
    """What tokens are found by, a struct: for each its variants and the heads, of four letters at least, that a token of six at least
    begins with; and all heads. It should be a column of questions, as it is the same for all items of one."""
    heads = lambda t: F.when(F.length(t) >= 6, F.transform(F.sequence(F.lit(4), F.length(t) - 1), lambda n: F.substring(t, F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.transform(tokens, lambda t: F.struct(token_variants(t).alias("variants"), heads(t).alias("heads"))).alias("tokens"),
        F.array_distinct(F.flatten(F.transform(tokens, heads))).alias("heads"),
    )


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z][a-z0-9]{3,}"), F.lit(0)))


def _hay(path: Column, content: Column) -> Column:
    return F.lower(F.concat(path, F.lit("\n"), F.substring(F.coalesce(content, F.lit("")), 1, 8000)))


def subject_points(low: Column, low_words: Column, hay: Column, hay_words: Column, similarity: Column, forms: Column) -> Column:
    """Five times the similarity, and 2.5 and 0.75 for each token, of token_forms, that the path and the whole name, fully or in short. A lambda
    computes anew for each token what is no variable of its own, even a column, whose expression the optimizer moves there: so texts
    and words are bound."""

    def hits(text: Column, words: Column) -> Column:
        seen = F.struct(text.alias("text"), F.array_intersect(words, forms["heads"]).alias("heads"), forms["tokens"].alias("tokens"))
        found = lambda s: F.filter(s["tokens"], lambda t: F.exists(t["variants"], lambda v: F.contains(s["text"], v)) | F.arrays_overlap(s["heads"], t["heads"]))
        return T.bound(seen, lambda s: F.size(found(s)))

    return F.coalesce(similarity * 5, F.lit(0.0)) + hits(low, low_words) * 2.5 + hits(hay, hay_words) * 0.75


def subject_score(path: Column, content: Column, similarity: Column, tokens: Column) -> Column:
    """subject_points of a path and content."""
    low, hay = F.lower(path), _hay(path, content)
    return subject_points(low, _words(low), hay, _words(hay), similarity, token_forms(tokens))


def full_score(items: DataFrame, questions: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """items (q, ord, path, content, similarity, tool) with (score, rank) for questions (q, text): the subject, a file that was read,
    the part of the system, profiles (contexts of profiles.context), supporting files, definitions and, for overviews, documentation and files near the root."""
    from . import profiles

    ctx = F.lit(None)
    rows = items.join(questions.select("q", "text", token_forms(evidence_tokens(F.col("text"))).alias("_forms")), "q")
    # texts and words are made once for each item, not for each token, and the forms of tokens once for each question
    rows = rows.withColumn("_low", F.lower("path")).withColumn("_hay", _hay(F.col("path"), F.col("content")))
    rows = rows.withColumn("_low_words", _words(F.col("_low"))).withColumn("_hay_words", _words(F.col("_hay")))
    if contexts is not None:
        rows = rows.join(contexts.select("q", F.struct("ids", "families", "categories", "terms").alias("ctx")), "q", "left")
        ctx = F.col("ctx")
    path, content, low = F.col("path"), F.coalesce("content", F.lit("")), F.lower(F.coalesce("text", F.lit("")))
    over = is_overview(low)
    score = subject_points(*[F.col(c) for c in ("_low", "_low_words", "_hay", "_hay_words", "similarity", "_forms")]) + F.when(F.col("tool") == "read_file", 3.0).otherwise(0.0)
    score = score + architecture_boost(F.col("text"), path, content)
    if contexts is not None:
        score = score + profiles.evidence_boost(ctx, path, content)
    score = score + F.when(places.is_supporting(path), F.when(wants_support(low), 2.0).otherwise(0.25)).otherwise(0.0) + F.when(content.rlike(DEFINITION), 0.75).otherwise(0.0)
    score = score + F.when(over & (places.supporting_role(path) == "documentation"), 5.0).otherwise(0.0) + F.when(over & (F.size(F.split(path, "/")) <= 2), 1.5).otherwise(0.0)
    scored = rows.withColumn("score", F.round(score, 6)).drop("text", "ctx", "_forms", "_low", "_hay", "_low_words", "_hay_words")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "ord")))


# ---- selection


def _flags(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    asked = questions.select("q", (wants_support(low) | is_overview(low)).alias("allow"), wants_support(low).alias("wants"), wants_manifest(low).alias("packages"))
    path = F.col("path")
    return dealt(ranked, "q").join(asked, "q").withColumn("supporting", places.is_supporting(path)).withColumn("dependency", F.startswith(path, F.lit(places.DEPENDENCY_DOCS)))


def _fill(taken: DataFrame, rest: Column, limit: int | None) -> DataFrame:
    """The rows that have a turn and place, then those for which rest holds, by rank; (place) from 1."""
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.col("turn").isNull(), "turn", "nth", "rank"))
    out = taken.filter(F.col("turn").isNotNull() | rest).withColumn("place", order)
    return out.filter(F.col("place") <= limit) if limit else out


def _diverse(rows: DataFrame, limit: Column, candidates: Column) -> DataFrame:
    """rows with (nth): the place of candidates by layer_diverse's turns, null beyond limit and for others."""
    first = lambda by: F.row_number().over(Window.partitionBy("q", "cand", by).orderBy("rank")) == 1
    marked = rows.withColumn("cand", candidates).withColumn("layer", places.layer(F.col("path")))
    marked = marked.withColumn("t", F.when(first("layer"), 0).when(first("path"), 1).otherwise(2))
    nth = F.row_number().over(Window.partitionBy("q", "cand").orderBy("t", "rank"))
    return marked.withColumn("nth_", F.when(F.col("cand"), nth)).withColumn("diverse", F.when(F.col("nth_") <= limit, F.col("nth_"))).drop("cand", "t", "nth_")


def outline_evidence(ranked: DataFrame, questions: DataFrame, hubs: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """(q, rank, path, place) of ranked (q, rank, path): at most five items of hub paths (q, path), then layer-diverse sources, then three
    supporting ones (one, unless the question wants them), filled by rank; without dependency documents unless packages are asked for."""
    rows = _flags(ranked, questions)
    rows = rows.join(hubs.select("q", "path", F.lit(True).alias("hub")).distinct(), ["q", "path"], "left") if hubs is not None else rows.withColumn("hub", F.lit(None).cast("boolean"))
    w = Window.partitionBy("q")
    hub = F.coalesce("hub", F.lit(False))
    rows = rows.withColumn("hub_n", F.when(hub, F.row_number().over(Window.partitionBy("q", hub).orderBy("rank")))).withColumn("is_hub", F.coalesce(F.col("hub_n") <= 5, F.lit(False)))
    able = ~F.col("is_hub") & F.col("supporting") & (F.col("packages") | ~F.col("dependency"))
    rows = rows.withColumn("able", able).withColumn("sup_n", F.when(F.col("able"), F.row_number().over(Window.partitionBy("q", "able").orderBy("rank"))))
    rows = rows.withColumn("is_sup", F.coalesce(F.col("sup_n") <= F.when(F.col("allow"), 3).otherwise(1), F.lit(False)))
    room = F.greatest(F.lit(0), limit - F.count_if("is_hub").over(w) - F.count_if("is_sup").over(w))
    rows = _diverse(rows.withColumn("room", room), F.col("room"), ~hub & ~F.col("supporting"))
    turn = F.when(F.col("is_hub"), 0).when(F.col("diverse").isNotNull(), 1).when(F.col("is_sup"), 2)
    rows = rows.withColumn("turn", turn).withColumn("nth", F.when(F.col("turn") == 0, F.col("hub_n")).when(F.col("turn") == 1, F.col("diverse")).otherwise(F.col("sup_n")))
    rest = (F.col("allow") | ~F.col("supporting")) & (F.col("packages") | ~F.col("dependency"))
    return _fill(rows, rest, limit).select("q", "rank", "path", "place")


def visible_evidence(ranked: DataFrame, questions: DataFrame, outline: DataFrame) -> DataFrame:
    """(q, rank, path, place): the outline's items in their order, then all other ranked ones but dependency documents."""
    rows = _flags(ranked, questions).join(outline.select("q", "rank", F.col("place").alias("nth")), ["q", "rank"], "left").withColumn("turn", F.when(F.col("nth").isNotNull(), 0))
    return _fill(rows, F.col("packages") | ~F.col("dependency"), None).select("q", "rank", "path", "place")


def component_evidence(ranked: DataFrame, questions: DataFrame, kind: str, limit: int = 4) -> DataFrame:
    """(q, rank, path, place): for code the best item of each path, then the rest; for other kinds layer-diverse sources and, where
    the question wants it, one supporting item, filled by rank."""
    rows = _flags(ranked, questions)
    if kind == "annotated_code_excerpt":
        again = F.row_number().over(Window.partitionBy("q", "path").orderBy("rank")) > 1
        return _fill(rows.withColumn("turn", F.when(again, 1).otherwise(0)).withColumn("nth", F.col("rank")), F.lit(False), limit).select("q", "rank", "path", "place")
    able = F.col("supporting") & (F.col("packages") | ~F.col("dependency"))
    rows = rows.withColumn("able", able).withColumn("sup_n", F.when(F.col("able"), F.row_number().over(Window.partitionBy("q", "able").orderBy("rank"))))
    rows = rows.withColumn("is_sup", F.coalesce((F.col("sup_n") <= 1) & F.col("wants"), F.lit(False)))
    rows = _diverse(rows.withColumn("room", limit - F.count_if("is_sup").over(Window.partitionBy("q"))), F.col("room"), ~F.col("supporting"))
    rows = rows.withColumn("turn", F.when(F.col("diverse").isNotNull(), 0).when(F.col("is_sup"), 1)).withColumn("nth", F.coalesce("diverse", "sup_n"))
    return _fill(rows, F.col("packages") | ~F.col("dependency"), limit).select("q", "rank", "path", "place")


# ---- traces of behaviour


def collect_evidence(refs: DataFrame) -> DataFrame:
    """refs (q, ord, component, type, kind, path, line_start, line_end, claim) once per range and component, in the place of the first, without those that have no path."""
    return first_by(refs.filter(F.coalesce("path", F.lit("")) != ""), ["q"], F.struct("path", "line_start", "line_end", "component"), "ord", 2**31 - 1)


def entrypoints(evidence: DataFrame, limit: int = 5) -> DataFrame:
    """(q, path, line_start, line_end, role, place): the first distinct ranges of evidence that no gap cites."""
    gap = F.coalesce((F.col("type") == "evidence_callout") & (F.col("kind") == "gap"), F.lit(False))
    rows = first_by(evidence.filter(~gap).drop("place"), ["q"], F.struct("path", "line_start", "line_end"), "ord", limit)
    return rows.select("q", "path", "line_start", "line_end", places.trace_role(F.col("path")).alias("role"), "place")


#: Actors of a behaviour, by what its texts mention.
ACTORS = (
    ("user/client", r"\b(user|browser|client|form|ui)\b"), ("server", r"\b(api|server|route|handler|hono|endpoint)\b"), ("llm/planner", r"\b(llm|model|provider|planner|synthesis|exploration|ai sdk)\b"),
    ("data store", r"\bdb|database|store|lance|index|cache|trace\b"),
)


def actors(text: Column) -> Column:
    """Who takes part in a behaviour; the system, if nobody is named."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.rlike(p), name) for name, p in ACTORS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("system")))


# The sentences of a trace.
NO_SUMMARY = "Alternate path"
RISK = ("Changing ", " lines ", " may affect ", " behavior.")
NO_EVIDENCE, STANDING_QUESTION = "No source evidence was captured for this trace.", "Which alternate failure paths should be traced before modifying this behavior?"
NO_RISK = "Changing this behavior without source evidence is high risk."


def trace_texts(components: DataFrame, evidence: DataFrame, limit: int = 5) -> DataFrame:
    """(q, alternates, questions, risks) of components (q, ord, type, kind, summary, detail): inferred callouts, gaps or else a standing question,
    and a risk for each of the first four items of evidence (q, ord, path, line_start, line_end)."""
    texts = lambda kind, c: F.slice(F.transform(F.array_sort(F.collect_list(F.when((F.col("type") == "evidence_callout") & (F.col("kind") == kind) & (c != ""), F.struct("ord", c.alias("t"))))), lambda x: x["t"]), 1, limit)
    s, d = F.coalesce("summary", F.lit("")), F.coalesce("detail", F.lit(""))
    asked = components.groupBy("q").agg(texts("inferred", F.when(s != "", s).otherwise(NO_SUMMARY)).alias("alternates"), texts("gap", F.when(s != "", s).otherwise(d)).alias("gaps"))
    where = F.when(F.col("line_start").isNotNull() & F.col("line_end").isNotNull(), F.concat(F.lit(RISK[1]), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))).otherwise("")
    risk = F.concat(F.lit(RISK[0]), "path", where, F.lit(RISK[2]), places.trace_role(F.col("path")), F.lit(RISK[3]))
    few = evidence.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("ord"))).filter("k <= 4")
    risks = few.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", risk.alias("t")))), lambda x: x["t"]).alias("risks"))
    rows = asked.join(risks, "q", "left")
    none = F.col("risks").isNull()
    standing = F.when(none, NO_EVIDENCE).otherwise(STANDING_QUESTION)
    return rows.select("q", "alternates", F.when(F.size("gaps") > 0, F.col("gaps")).otherwise(F.array(standing)).alias("questions"), F.coalesce("risks", F.array(F.lit(NO_RISK))).alias("risks"))


def condition_evidence(evidence: DataFrame, conditions: DataFrame, limit: int = 4) -> DataFrame:
    """(q, ord, score, place) of evidence (q, ord, path, claim, component, type) for conditions (q, condition): by how many of its terms an item has."""
    terms = F.regexp_extract_all(F.lower(F.coalesce("condition", F.lit(""))), F.lit("[a-z0-9_]{3,}"), F.lit(0))
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    hay = F.lower(F.concat_ws(" ", some("path"), some("claim"), some("component"), some("type")))
    rows = evidence.join(conditions, "q").withColumn("hay", hay).withColumn("score", F.size(F.filter(terms, lambda t: F.contains(F.col("hay"), t)))).filter("score > 0")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "ord"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).select("q", "ord", "score", "place")


def brief_evidence(evidence: DataFrame, limit: int = 12) -> DataFrame:
    """evidence (q, ord, path, line_start, line_end, reason) once per range and reason; the first limit, with (role, place)."""
    rows = first_by(evidence, ["q"], F.struct("path", "line_start", "line_end", "reason"), "ord", limit)
    return rows.withColumn("role", places.file_role(F.col("path")))


def substantive(lines: DataFrame, least: int = 3) -> DataFrame:
    """(key, substantive) of lines (key, line), gutters and all: whether at least three lines are code."""
    bare = F.trim(F.regexp_replace("line", r"^\s*\d+\s+[|:]?\s?", ""))
    code = (bare != "") & ~bare.rlike(r"^(#|//|/\*|\*|--|<!--)") & ~bare.rlike(r"^[\[\](){};,]*$")
    return lines.groupBy("key").agg((F.count_if(code) >= least).alias("substantive"))
