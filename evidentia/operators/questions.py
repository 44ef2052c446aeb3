"""What a question asks for: intent, scope, domains, shapes of its answer, and what it is searched with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V

TERM = r"[a-z_][a-z0-9_]{1,}"
#: Sub-queries that a stage may ask, terms that the code graph is searched by, and prior paths that a question keeps.
STAGE_QUERIES, GRAPH_LIMIT, PRIOR_PATHS = 6, 18, 8


def lowered(text: Column) -> Column:
    """Lower-case text for the fixed patterns, whose words are of ASCII letters: others stand as marks, so that a word may begin or end
    beside them."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^\x00-\x7F]", "·")


def is_overview(low: Column) -> Column:
    """Whether lower-case text asks for an overview of a whole system."""
    return reduce(lambda a, p: a | low.rlike(p), V.OVERVIEW, low.rlike(V.END_TO_END) & low.rlike(V.WALK))


def wants_support(low: Column) -> Column:
    return low.rlike(V.SUPPORTING)


def terms(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def _any(words: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, wanted)))


def classify(questions: DataFrame) -> DataFrame:
    """questions (q, text[, has_story]) with (intent, scope, confidence, shapes, domains, hints, needs_context, retelling).

    Each intent sums the points of the rules that match. The largest wins, the first of equal ones; 0.45, 0.08 for each point
    and 0.04 for each ahead of the next are its confidence, at most 0.95. Without a point, behaviour is explained, at 0.35.
    """
    own = questions if "has_story" in questions.columns else questions.withColumn("has_story", F.lit(False))
    rows = own.withColumn("low", lowered(F.col("text"))).withColumn("words", terms(F.col("low")))
    low, words = F.col("low"), F.col("words")
    overview = is_overview(low)
    counted = F.size(F.array_except(words, F.array(*map(F.lit, V.QUESTION_STOPWORDS))))
    n_tokens = F.size(F.filter(words, lambda w: ~w.isin(*V.QUESTION_STOPWORDS)))
    points: dict[str, list[Column]] = {i: [] for i in V.INTENTS}
    for intent, n, pattern in V.INTENT_PATTERNS:
        points[intent].append(F.when(low.rlike(pattern), n).otherwise(0))
    for intent, n, wanted in V.INTENT_TERMS:
        points[intent].append(F.when(_any(words, wanted), n).otherwise(0))
    points["locate_source"].append(F.when(F.array_contains(words, V.FIND) | low.rlike(V.FIND_PATTERN), 2).otherwise(0))
    points["explain_behavior"].append(F.when(overview, 5).otherwise(0))
    follow = F.when(F.col("has_story") & n_tokens.between(1, 6), 1).otherwise(0)
    points["explain_behavior"].append(follow)
    points["explain_role"].append(follow)
    total = [F.struct((-reduce(lambda a, b: a + b, p)).alias("neg"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, (k, p) in enumerate(points.items())]
    rows = rows.withColumn("best", F.array_sort(F.array(*total))).withColumn("top", -F.col("best")[0]["neg"]).withColumn("next", -F.col("best")[1]["neg"])
    top = F.col("top")
    confidence = F.when(top <= 0, 0.35).otherwise(F.least(F.lit(0.95), 0.45 + top * 0.08 + F.greatest(F.lit(0), top - F.col("next")) * 0.04))
    scope = (
        F.when(overview, "system").when(low.rlike(V.FILE_SCOPE) | _any(words, ("file", "path", "function", "class", "symbol")), "file")
        .when(F.col("has_story") | low.rlike(V.FEATURE_SCOPE), "feature").when(low.rlike(V.SYSTEM_SCOPE), "system").when(counted <= 4, "prior_story").otherwise("feature")
    )
    matched = F.array_compact(F.array(*[F.when(low.rlike(p), F.struct(F.lit(name).alias("name"), F.lit(hint).alias("hint"))) for name, p, hint in V.DOMAINS]))
    rows = rows.withColumn("intent", F.when(top > 0, F.col("best")[0]["name"]).otherwise("explain_behavior")).withColumn("matched", matched)
    kept = [c for c in own.columns if c not in ("low", "words")]
    retelling = low.rlike(V.VISUAL + "|" + V.CHILD + "|" + V.RETELLING)
    needs = F.col("has_story") | low.rlike(r"\b(this|that|it|those|they|fit|fits|relate|related)\b")
    return rows.select(
        *kept, "intent", scope.alias("scope"), F.round(confidence, 2).alias("confidence"), _shapes(F.col("intent"), low).alias("shapes"),
        F.transform("matched", lambda m: m["name"]).alias("domains"), F.transform("matched", lambda m: m["hint"]).alias("hints"), needs.alias("needs_context"), retelling.alias("retelling"),
    )


def _shapes(intent: Column, low: Column) -> Column:
    """The shapes of an answer in the order of preference."""
    code, callout, figure, sequence = "annotated_code_excerpt", "evidence_callout", "mermaid_figure", "sequence_diagram"
    several = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    drawn, asked = low.rlike(V.SHOWS_FIGURE), low.rlike(V.SHOWS_CODE)
    shape = F.when(low.rlike(V.SEQUENCE), sequence).otherwise(figure)
    return (
        F.when(intent == "locate_source", several(code, callout))
        .when(drawn & asked, several(shape, code, callout))
        .when(drawn, several(shape, callout, code))
        .when(intent == "show_code", several(code, callout, figure))
        .when(intent == "simulate_change", several(figure, callout))
        .when(intent == "verify_understanding", several(callout))
        .when(intent == "compare", several(callout, figure))
        .when(intent == "plan_change", several(callout, code))
        .when(low.rlike(V.UI_ANSWER), several(figure, code, callout))
        .when(low.rlike(V.API_ANSWER), several(sequence, code, callout))
        .when(low.rlike(V.FLOW_ANSWER), several(figure, callout, code))
        .otherwise(several(callout, code, figure))
    )


def wants_coverage(intent: Column, scope: Column, shapes: Column) -> Column:
    """Whether an answer needs evidence of several files: interfaces, and behaviour of a feature or system."""
    return F.array_contains(shapes, "sequence_diagram") | ((intent == "explain_behavior") & scope.isin("feature", "system"))


def synthesis_mode(intent: Column, shapes: Column, n_evidence: Column, fast: Column, text: Column) -> Column:
    """lean without evidence, or for a short question on the fast path that asks for a place only; else full."""
    place = intent == "locate_source"
    return F.when(n_evidence == 0, "lean").when(place & F.array_contains(shapes, "annotated_code_excerpt"), "full").when(fast & place & (F.length(F.trim(text)) <= 100), "lean").otherwise("full")


def stage_queries(classified: DataFrame, own: DataFrame | None = None, limit: int = STAGE_QUERIES) -> DataFrame:
    """(q, place, text): the sub-queries of classified questions: those of interfaces and of overviews, then own (q, ord, text); once
    each whatever their case and white space."""
    low = lowered(F.col("text"))
    api = F.array_contains("domains", "api") | low.rlike(V.API_QUESTION)
    seeds = F.concat(
        F.when(api, F.array(*map(F.lit, V.API_SEEDS))).otherwise(F.array()), F.when(api & low.rlike(V.FAILURE), F.array(F.lit(V.FAILURE_SEED))).otherwise(F.array()),
        F.when((F.col("scope") == "system") & is_overview(low), F.array(*map(F.lit, V.OVERVIEW_SEEDS))).otherwise(F.array()),
    )
    rows = classified.select("q", F.posexplode(seeds).alias("ord", "text"))
    if own is not None:
        rows = rows.unionByName(own.select("q", (F.col("ord") + 1000).alias("ord"), F.trim("text").alias("text")).filter("text <> ''"))
    return first_by(rows, ["q"], F.lower(F.regexp_replace("text", r"\s+", " ")), "ord", limit).select("q", "place", "text")


def first_by(rows: DataFrame, part: list[str], key: Column, order: str, limit: int) -> DataFrame:
    """Of rows with one key inside part the first in order; of those the first limit, with (place)."""
    one = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy(*part, "_key").orderBy(order))).filter("_n = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(order))).filter(F.col("place") <= limit).drop("_key", "_n")


def merge_texts(rows: DataFrame, order: str, text: str, limit: int = STAGE_QUERIES) -> DataFrame:
    """(key, first, copies) of rows: the first limit distinct texts in order, whatever their case and white space; a null text is none."""
    key = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    return rows.filter(F.col(text).isNotNull()).groupBy(key.alias("key")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).orderBy("first").limit(limit)


def graph_terms(tokens: Column, text: Column, profile_terms: Column, limit: int = GRAPH_LIMIT) -> Column:
    """A question's tokens, the terms of the surfaces that it names, and those of its profiles: three letters at least, once each."""
    low = lowered(text)
    named = [F.when(low.rlike(p), F.array(*map(F.lit, ts))).otherwise(F.array()) for p, ts in V.GRAPH_TERMS]
    every = F.concat(F.transform(tokens, F.lower), *named, profile_terms)
    return F.slice(F.filter(F.array_distinct(every), lambda t: F.length(t) >= 3), 1, limit)


def expanded(text: Column, hints: Column) -> Column:
    """A question with its hints on lines behind it."""
    return F.array_join(F.concat(F.array(text), hints), "\n")


def question_context(classified: DataFrame, chapters: DataFrame) -> DataFrame:
    """(q, retrieval, exploration) of classified questions and chapters (q, ord, question, title, paths) of the story before them.

    A follow-up is searched with up to eight paths cited before (for interfaces those of interfaces), not with earlier
    topics. A retelling has no subject of its own: it is searched with the last chapter that has one, and the last three questions and titles.
    """
    some = lambda c: F.coalesce(c, F.lit(""))
    s = chapters.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("ord", some(F.col("question")).alias("question"), some(F.col("title")).alias("title"), "paths"))).alias("s"))
    rows = classified.join(s, "q", "left").withColumn("s", F.coalesce("s", F.array().cast(s.schema["s"].dataType)))
    paths = F.array_distinct(F.filter(F.flatten(F.transform("s", lambda c: c["paths"])), lambda p: F.coalesce(F.trim(p) != "", F.lit(False))))
    api = F.filter("paths", lambda p: F.lower(p).rlike(r"\b(api|endpoint|route|routes|server|handler|request|response|stream|sse|client|browser|frontend|fetch|http|controller)\b|(^|/)(server|routes?|controllers?|handlers?|api|client|frontend|browser|web|public)\b"))
    rows = rows.withColumn("paths", F.slice(paths, 1, 12))
    rows = rows.withColumn("cited", F.array_join(F.slice(F.when(F.array_contains("domains", "api"), api).otherwise(F.col("paths")), 1, PRIOR_PATHS), " "))
    back = F.slice("s", F.greatest(F.lit(1), F.size("s") - 2), F.lit(3))
    filled = lambda *xs: F.array_join(F.filter(F.array(*xs), lambda x: x != ""), "\n")
    kept = lambda name: F.array_join(F.filter(F.transform(back, lambda c: c[name]), lambda x: x != ""), " ")
    plain = lambda c: F.lower(F.trim(c["question"]))
    own = F.filter("s", lambda c: ~(plain(c).rlike(V.STYLE_ONLY) | (plain(c).rlike(V.STYLE) & ~plain(c).rlike(V.SUBJECT))))
    last = F.coalesce(F.try_element_at(own, F.lit(-1)), F.try_element_at("s", F.lit(-1)))
    again = F.col("retelling") & (F.size("s") > 0)
    target = filled(some(last["question"]), some(last["title"]), F.when(F.size("paths") > 0, F.concat(F.lit("Previously cited paths: "), F.array_join("paths", " "))).otherwise(""))
    retold = filled(target, kept("question"), kept("title"), F.col("cited"))
    asked = F.when(F.col("retelling"), retold).otherwise(filled(some(F.col("text")), F.col("cited")))
    retrieval = F.when(F.size("s") == 0, F.col("text")).otherwise(asked)
    return rows.select("q", retrieval.alias("retrieval"), F.when(again & (target != ""), target).otherwise(expanded(F.col("text"), F.col("hints"))).alias("exploration"))
