"""Rewrites of a plan: slots that a question needs and its plan lacks, put in by rules, one rewrite after the other.

A plan is an array of slots on its question's row, and a question's evidence is an array beside it, ranked: both are a few
items. Every rewrite is an expression over the plan that the one before it has left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..functions import text as T
from ..sources.shared import settled
from . import evidence as E
from . import questions as Q
from . import retrieval as R
from . import syntax

SLOTS, MOST_CODE, SPINE = 6, 4, 5
REF = "struct<path:string,line_start:int,line_end:int>"
SLOT = f"struct<id:string,kind:string,intent:string,hints:array<{REF}>>"
CODE, CALLOUT, FIGURE, SEQUENCE = "annotated_code_excerpt", "evidence_callout", "mermaid_figure", "sequence_diagram"
VISUAL = (FIGURE, SEQUENCE)

# Patterns, points and sentences, by which equal questions get equal plans.
ASKS_VISUAL = r"\b(visual|visually|visualize|picture|pictures|diagram|draw|flowchart)\b"
ASKS_FLOW, ASKS_SHOW = r"\b(flow|lifecycle|sequence|process flow|data flow|control flow)\b", r"\b(show|give|map|walk|trace|reason|understand)\b"
ASKS_SEQUENCE = r"\b(sequence|request|response|api|endpoint|route|client|server|browser|frontend|backend|stream|streaming|sse|websocket|event)\b"
ASKS_CODE = (
    r"\b(show|see|display|open|include|give)\b.*\b(code|source|html|css|markup|stylesheet|styles?|file|files)\b",
    r"\b(more code|much more code|code displayed|show me the code|show me code|show the code)\b",
)
ASKS_MUCH = r"\b(much more code|more code|more source|more files|code displayed)\b"
ASKS_API = r"\b(apis?|endpoints?|routes?|requests?|responses?|sse|streams?|streaming)\b"
ASKS_USAGE = r"\b(use|used|usage|called|caller|client|frontend|browser|consume|consumed)\b"
CODE_RATIO, OVERLAP_RATIO = 0.5, 0.6
INTENTS = {
    "visual": "Show the implementation flow visually before the supporting source excerpts.",
    "spine": "Map the architecture spine from entrypoint through orchestration, data boundaries, and user-facing output.",
    "layer": "Show the {layer} layer in {path} as a checkable part of the architecture spine.",
    "code": "Show the load-bearing source in {path} so the flow can be checked against code.",
    "api-flow": "Show the API boundary from caller through route handling, response transport, and state effects.",
    "api-route-handler": "Show the endpoint registration and handler entrypoint that receive API requests.",
    "api-request-contract": "Show how the API request shape is validated or normalized before handler work begins.",
    "named-contract": "Show the endpoint-specific {name} request shape and how it is validated before handler work begins.",
    "api-caller-usage": "Show where the API is called or consumed by the client side of the application.",
    "api-caller-gap": "Call out that the retrieved evidence did not include a caller or client usage site for the API.",
    "api-response-state": "Show how the API sends responses or streams events and records cache, trace, or storage side effects.",
    "named": "Show {name}, which is named in the question and carries part of the requested flow.",
    "supporting-actors": "Explain the dependency, manifest, and configuration actors that shape this implementation.",
}
ROUTES = (r"(?i)\bapp\.(?:get|post|put|patch|delete|use)\s*\(", r"(?i)\brouter\.(?:get|post|put|patch|delete|use)\s*\(", r"\bregister[A-Z]\w*Routes?\b")
#: Facets of an interface: terms, patterns of the content, of the path, of a path and a content that tell against it.
FACETS = {
    "route_handler": {
        "terms": ("api", "endpoint", "route", "handler", "server", "controller"),
        "content": (*ROUTES, r"(?i)['\"`]/api/"),
        "path": r"(?i)(^|/)(server|routes?|controllers?|handlers?|api)\b",
    },
    "request_contract": {
        "terms": ("request", "body", "query", "params", "schema", "validation", "contract"),
        "content": (r"\bwithRequest\s*\(", r"\b(?:body|query|params)Schema\b", r"\bz\.object\s*\(", r"(?i)\b(?:validate|validation|parse|safeParse)\b"),
        "path": r"(?i)(^|/)(contracts?|schemas?|validation|validators?|server|routes?)\b",
        "avoid_content": ROUTES,
    },
    "caller_usage": {
        "terms": ("client", "frontend", "browser", "fetch", "caller", "usage"),
        "content": (r"\bfetch\s*\(", r"\bapiFetch\s*\(", r"\bEventSource\s*\(", r"(?i)['\"`]/api/"),
        "path": r"(?i)(^|/)(public|client|frontend|browser|web|ui|app)\b",
        "avoid_path": r"(?i)(^|/)(server|routes?|controllers?|handlers?)\b",
    },
    "response_or_state": {
        "terms": ("response", "stream", "sse", "event", "cache", "persist", "save", "storage", "trace", "story"),
        "content": (r"\bstreamSSE\s*\(", r"\bwriteSSE\s*\(", r"\bc\.json\s*\(", r"(?i)\b(?:save|persist|cache|storage|store|trace|story|abort|error)\b"),
        "path": r"(?i)(^|/)(server|routes?|storage|store|cache|trace|story|runtime)\b",
    },
}
CONTRACT_NAME, CONTRACT_PARTS = r"(?i)(?:schema|contract|validator)$", ("body", "params", "query")
NAMED_PARTS = r"(?i)(?:^|_)(?:file|path|store|index|remove|create|render|handle|watch|sync|search|embed|chunk)(?:_|$)"


# ---- slots and plans


def _ref(x: Column) -> Column:
    return F.struct(x["path"].alias("path"), x["line_start"].cast("int").alias("line_start"), x["line_end"].cast("int").alias("line_end"))


def slot(id_: Column, kind: str | Column, intent: Column, hints: Column) -> Column:
    return F.struct(id_.alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), intent.alias("intent"), hints.cast(f"array<{REF}>").alias("hints")).cast(SLOT)


def is_visual(x: Column) -> Column:
    return F.coalesce(x["kind"].isin(*VISUAL), F.lit(False))


def unique_id(ids: Column, base: Column) -> Column:
    """base, or base with the first free number behind it."""
    tries = F.array(base, *[F.concat(base, F.lit(f"-{k}")) for k in range(2, 21)])
    return F.filter(tries, lambda t: ~F.array_contains(ids, t))[0]


def ids_of(plan: Column) -> Column:
    return F.transform(plan, lambda x: F.coalesce(x["id"], F.lit("")))


def _last(flags: Column) -> Column:
    """The place, from 0, of the last true one; -1 without one."""
    found = F.array_position(F.reverse(flags), F.lit(True))
    return F.when(found > 0, F.size(flags) - found).otherwise(F.lit(-1)).cast("int")


def add(plan: Column, new: Column, front: bool = False, protect: bool = False, limit: int = SLOTS) -> Column:
    """plan with a slot behind it or in front. A full plan gives up its last callout, else its last slot, with protect none that is
    drawn; where none can go, and where the id is taken, it stays as it is."""
    callout = _last(F.transform(plan, lambda x: F.coalesce(x["kind"] == CALLOUT, F.lit(False))))
    other = _last(F.transform(plan, lambda x: ~is_visual(x) if protect else F.lit(True)))
    at = F.when(callout >= 0, callout).otherwise(other)
    grown = F.concat(F.array(new), plan) if front else F.concat(plan, F.array(new))
    swapped = F.concat(F.array(new), F.filter(plan, lambda x, i: i != at)) if front else F.transform(plan, lambda x, i: F.when(i == at, new).otherwise(x))
    return F.when(F.array_contains(ids_of(plan), new["id"]), plan).when(F.size(plan) < limit, grown).when(at < 0, plan).otherwise(swapped)


def _shared(a: Column, b: Column) -> Column:
    """Whether two ranges of lines meet."""
    return (a["line_start"] <= b["line_end"]) & (b["line_start"] <= a["line_end"])


def covers(plan: Column, ref: Column, name: Column | None = None) -> Column:
    """Whether an excerpt of the plan has lines of ref already; with a name, one whose intent names it."""
    whole = lambda h: F.struct(F.coalesce(h["line_start"], ref["line_start"]).alias("line_start"), F.coalesce(h["line_end"], ref["line_end"]).alias("line_end"))
    meets = lambda h: (h["path"] == ref["path"]) & F.coalesce(_shared(whole(h), ref), F.lit(True))
    tells = lambda x: F.lit(True) if name is None else F.contains(F.lower(F.coalesce(x["intent"], x["id"])), F.lower(name))
    return F.exists(plan, lambda x: (x["kind"] == CODE) & F.coalesce(F.exists(x["hints"], meets), F.lit(False)) & F.coalesce(tells(x), F.lit(False)))


def _code_count(plan: Column) -> Column:
    return F.size(F.filter(plan, lambda x: x["kind"] == CODE))


def _when(plan: Column, condition: Column, new: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), new).otherwise(plan)


def distinct_paths(items: Column) -> Column:
    """The first item of each path, in order."""
    paths = F.transform(items, lambda x: x["path"])
    return F.filter(items, lambda x, i: F.array_position(paths, x["path"]) == i + 1)


def path_diverse(items: Column, limit: int) -> Column:
    """The first item of each path, then the others, in order."""
    paths = F.transform(items, lambda x: x["path"])
    again = F.filter(items, lambda x, i: F.array_position(paths, x["path"]) < i + 1)
    return F.slice(F.concat(distinct_paths(items), again), 1, limit)


# ---- evidence of a question


def packets(items: DataFrame, questions: DataFrame) -> DataFrame:
    """(q, items): a question's evidence (q, ord, tool, path, line_start, line_end, similarity, content) as an array in the order of
    its rank, each with what the rewrites ask of it. A question's evidence is a few items; the contents stay outside."""
    ranked = E.full_score(items, questions)
    own = F.col("path")
    diverse = E.layer_diverse(ranked.filter(~places.is_supporting(own)), 2**31 - 1).select("q", "ord", F.col("place").alias("spread"))
    # a hit among the words of the question that tell something
    tokens = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z0-9_]{2,}"), F.lit(0)), lambda t: ~t.isin(*T.STOPWORDS))
    hay = F.lower(F.concat(own, F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, 3000)))
    lines = F.filter(T.lines(F.coalesce("content", F.lit(""))), lambda x: ~F.trim(x).rlike(r"^$|^(?:#|//|/\*|\*|--|<!--)|^[{}()\[\],;]+$"))
    rows = ranked.join(diverse, ["q", "ord"], "left").join(questions.select("q", "text"), "q")
    rows = rows.withColumn("shares", F.exists(tokens(F.coalesce("text", F.lit(""))), lambda t: F.contains(hay, t)))
    item = F.struct("rank", "ord", "tool", "path", "line_start", "line_end", "score", places.is_supporting(own).alias("supporting"), (F.size(lines) >= 3).alias("substantive"), places.layer(own).alias("layer"), F.coalesce(places.family(own), F.lit("")).alias("family"), "spread", "shares")
    return rows.groupBy("q").agg(F.array_sort(F.collect_list(item)).alias("items"))


def facet_score(path: Column, content: Column, facet: dict, identifiers: Column | None = None) -> Column:
    """How well an item shows a facet of an interface: 4 points for its path, 0.75 for each term, 5 for any of its patterns, 14 or 4 for
    defining or mentioning one of identifiers; 3 and 6 less for a path and a content that tell against it."""
    hay = F.lower(F.concat(path, F.lit("\n"), F.substring(content, 1, 4000)))
    score = F.when(path.rlike(facet["path"]), 4.0).otherwise(0.0)
    if "avoid_path" in facet:
        score = score - F.when(path.rlike(facet["avoid_path"]), 3.0).otherwise(0.0)
    any_of = lambda patterns: F.greatest(*[content.rlike(p).cast("int") for p in patterns]) > 0
    if "avoid_content" in facet:
        score = score - F.when(any_of(facet["avoid_content"]), 6.0).otherwise(0.0)
    for term in facet["terms"]:
        score = score + F.when(F.contains(hay, F.lit(term)), 0.75).otherwise(0.0)
    score = score + F.when(any_of(facet["content"]), 5.0).otherwise(0.0)
    if identifiers is not None:
        plain = lambda n: F.replace(n, F.lit("$"), F.lit("\\$"))
        defines = F.exists(identifiers, lambda n: F.rlike(content, F.concat(F.lit(r"\b(?:export\s+)?(?:const|let|var|function|class)\s+"), plain(n), F.lit(r"\b"))))
        mentions = F.exists(identifiers, lambda n: F.rlike(content, F.concat(F.lit(r"\b"), plain(n), F.lit(r"\b"))))
        score = score + F.when(defines, 14.0).when(mentions, 4.0).otherwise(0.0)
    return score


def contract_identifiers(content: Column) -> Column:
    """Names of schemas bound at a route, of bodies before parameters before queries; four at most."""
    part = F.regexp_extract(content, r"(?s)(?=\bwithRequest\s*\()(.{1,1200})", 1)
    pattern = r"\b(body|query|params)\s*:\s*([A-Za-z_$][\w$]*)"
    kinds, names = (F.regexp_extract_all(part, F.lit(pattern), F.lit(k)) for k in (1, 2))
    order = F.array(*map(F.lit, CONTRACT_PARTS))
    bound = F.transform(F.arrays_zip(kinds.alias("k"), names.alias("n")), lambda x: F.struct((F.array_position(order, x["k"]) - 1).cast("int").alias("p"), x["n"].alias("n")))
    direct = F.regexp_extract(part, r"\bwithRequest\s*\(\s*([A-Za-z_$][\w$]*)", 1)
    every = F.filter(F.concat(bound, F.array(F.struct(F.lit(0).alias("p"), direct.alias("n")))), lambda x: x["n"].rlike(CONTRACT_NAME))
    all_names = F.transform(every, lambda x: x["n"])
    first = F.filter(every, lambda x, i: F.array_position(all_names, x["n"]) == i + 1)
    placed = F.transform(first, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["n"].alias("n")))
    return F.transform(F.slice(F.array_sort(placed), 1, 4), lambda x: x["n"])


def facets(items: DataFrame, questions: DataFrame) -> DataFrame:
    """(q, route_handler, request_contract, caller_usage, response_or_state, identifiers): the best item of each facet, a struct of
    path and lines, null without one; three times the facet's points and three times those of the question's subject decide, then
    the first. Supporting files show none. The contract is looked for by the names that are bound at the chosen route."""
    rows = items.filter(~places.is_supporting(F.col("path"))).join(questions.select("q", "text"), "q").withColumn("body", F.coalesce("content", F.lit("")))
    lines = F.filter(T.lines(F.col("body")), lambda x: ~F.trim(x).rlike(r"^$|^(?:#|//|/\*|\*|--|<!--)|^[{}()\[\],;]+$"))
    rows = rows.filter(F.size(lines) >= 3).withColumn("subject", E.subject_score(F.col("path"), F.col("body"), F.col("similarity"), E.evidence_tokens(F.col("text"))))

    def best(df: DataFrame, name: str, identifiers: Column | None = None, *more: Column) -> DataFrame:
        own = df.withColumn("_f", facet_score(F.col("path"), F.col("body"), FACETS[name], identifiers)).filter("_f > 0")
        value = F.struct(F.round(F.col("_f") * 3 + F.col("subject") * 3, 6), -F.col("ord"))
        return own.groupBy("q").agg(F.max_by(_ref({c: F.col(c) for c in ("path", "line_start", "line_end")}), value).alias(name), *[F.max_by(m, value).alias("_content") for m in more])

    route = best(rows, "route_handler", None, F.col("body")).select("q", "route_handler", contract_identifiers(F.col("_content")).alias("identifiers"))
    none = F.array().cast("array<string>")
    out = questions.select("q").join(route, "q", "left").withColumn("identifiers", F.coalesce("identifiers", none))
    known = rows.join(out.select("q", "identifiers"), "q")
    out = out.join(best(known, "request_contract", F.col("identifiers")), "q", "left")
    for name in ("caller_usage", "response_or_state"):
        out = out.join(best(rows, name), "q", "left")
    return out.select("q", *FACETS, "identifiers")


def named_terms(text: Column) -> Column:
    """Identifiers that a question names: all in backticks, then words that look like code; eight at most, without stopwords."""
    ticked = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"`([^`]+)`"), F.lit(1)), lambda t: F.regexp_extract_all(t, F.lit(r"[A-Za-z_$][\w$]{2,}"), F.lit(0))))
    words = F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_$][\w$]{2,}\b"), F.lit(0)), lambda w: w.rlike(r"[A-Z_$]") | w.rlike(NAMED_PARTS))
    every = F.filter(F.concat(ticked, words), lambda w: ~F.lower(w).isin(*T.STOPWORDS))
    low = F.transform(every, F.lower)
    return F.slice(F.filter(every, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), 1, 8)


def named_refs(items: DataFrame, questions: DataFrame) -> DataFrame:
    """(q, named): array of (name, path, line_start, line_end) of definitions in the evidence of what a question names, in its order: those
    of files that were read and of long excerpts first, 25 lines from the definition."""
    asked = questions.select("q", F.posexplode(named_terms(F.coalesce("text", F.lit("")))).alias("place", "name"))
    own = items.filter(~places.is_supporting(F.col("path"))).withColumn("lang", places.language(F.col("path")))
    lines = own.select("q", "tool", "path", "lang", "line_start", "line_end", F.posexplode(T.lines(F.coalesce("content", F.lit("")))).alias("i", "raw"))
    shown = F.regexp_extract("raw", r"^\s*(\d+)\s{2}", 1)
    at = F.when(shown != "", shown.cast("int")).otherwise(F.coalesce("line_start", F.lit(1)) + F.col("i"))
    found = lines.withColumn("s", syntax.symbol(F.trim(F.regexp_replace("raw", r"^\s*\d+\s{2}", "")), F.col("lang"))).filter("s is not null").withColumn("at", at)
    weight = F.when(F.col("tool") == "read_file", 5.0).otherwise(0.0) + F.greatest(F.lit(0.0), (F.col("line_end") - F.col("line_start") + 1) / 25)
    rows = found.withColumn("weight", F.coalesce(weight, F.lit(0.0))).join(asked.withColumn("low", F.lower("name")), ["q"]).filter(F.lower("s.name") == F.col("low"))
    best = rows.groupBy("q", "place", "name").agg(F.max_by(F.struct("path", "at"), F.struct("weight", -F.col("at"))).alias("b"))
    one = F.struct("place", "name", F.col("b.path").alias("path"), F.col("b.at").alias("line_start"), (F.col("b.at") + 24).alias("line_end"))
    return best.groupBy("q").agg(F.array_sort(F.collect_list(one)).alias("named"))


# ---- rewrites; each takes and gives rows with the column plan


def drop_overlaps(rows: DataFrame) -> DataFrame:
    """Of excerpts whose first hints share 0.6 of the smaller range the first stays."""
    first = lambda x: F.try_element_at(x["hints"], F.lit(1))
    whole = lambda r: F.coalesce(r["path"].isNotNull() & (r["line_end"] >= r["line_start"]), F.lit(False))
    span = lambda r: r["line_end"] - r["line_start"] + 1

    def taken(kept: Column, x: Column) -> Column:
        share = lambda a, b: F.greatest(F.lit(0), F.least(a["line_end"], b["line_end"]) - F.greatest(a["line_start"], b["line_start"]) + 1) / F.least(span(a), span(b))
        return F.exists(kept, lambda k: (k["kind"] == CODE) & whole(first(k)) & (first(k)["path"] == first(x)["path"]) & (share(first(k), first(x)) >= OVERLAP_RATIO))

    step = lambda kept, x: F.when((x["kind"] == CODE) & whole(first(x)) & F.coalesce(taken(kept, x), F.lit(False)), kept).otherwise(F.concat(kept, F.array(x)))
    return rows.withColumn("plan", F.aggregate("plan", F.array().cast(f"array<{SLOT}>"), step))


def supporting_actors(rows: DataFrame) -> DataFrame:
    """A callout of the first four supporting files for questions that want them, where no slot has one; in a full plan in the last place."""
    plan, low = F.col("plan"), F.lower(F.coalesce("text", F.lit("")))
    helps = F.slice(F.array_sort(F.transform(F.filter("items", lambda x: x["supporting"]), lambda x: F.struct(x["ord"].alias("ord"), _ref(x).alias("ref")))), 1, 4)
    held = F.exists(plan, lambda x: F.coalesce(F.exists(x["hints"], lambda h: places.is_supporting(h["path"])), F.lit(False)))
    new = slot(F.lit("supporting-actors"), CALLOUT, F.lit(INTENTS["supporting-actors"]), F.transform(helps, lambda x: x["ref"]))
    put = F.concat(F.slice(plan, 1, F.least(F.size(plan), F.lit(SLOTS - 1))), F.array(new))
    return rows.withColumn("plan", _when(plan, Q.wants_support(low) & (F.size(helps) > 0) & ~held, put))


def overview(rows: DataFrame) -> DataFrame:
    """For an overview of a system: a figure of its spine first, then excerpts of up to three files of the spine, then the rest. The spine
    is the best evidence of the hubs (column hubs, paths in order) and of each layer, five paths at most."""
    plan, low = F.col("plan"), F.lower(F.coalesce("text", F.lit("")))
    primary = F.filter("items", lambda x: ~x["supporting"])
    of_hubs = F.filter(F.transform("hubs", lambda h: F.try_element_at(F.filter(primary, lambda x: x["path"] == h), F.lit(1))), lambda x: x.isNotNull())
    spread = F.array_sort(F.transform(F.filter(primary, lambda x: x["spread"] <= SPINE), lambda x: F.struct(x["spread"].alias("spread"), x.alias("x"))))
    rows = rows.withColumn("spine", F.slice(distinct_paths(F.concat(of_hubs, F.transform(spread, lambda s: s["x"]))), 1, SPINE))
    drawn = F.try_element_at(F.filter(plan, is_visual), F.lit(1))
    figure = slot(F.coalesce(drawn["id"], unique_id(ids_of(plan), F.lit("architecture-spine"))), FIGURE, F.lit(INTENTS["spine"]), F.transform("spine", _ref))
    named = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(T.basename(x["path"]), r"\.[^.]+$", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rows = rows.withColumn("figure", figure)

    def step(state: Column, x: Column) -> Column:
        shows = F.try_element_at(F.filter(plan, lambda p: (p["kind"] == CODE) & F.coalesce(F.exists(p["hints"], lambda h: h["path"] == x["path"]), F.lit(False))), F.lit(1))
        fresh = unique_id(F.concat(ids_of(plan), F.array(F.col("figure.id")), ids_of(state)), F.concat(F.lit("overview-"), F.when(named(x) != "", named(x)).otherwise("source")))
        intent = F.replace(F.replace(F.lit(INTENTS["layer"]), F.lit("{layer}"), x["layer"]), F.lit("{path}"), x["path"])
        return F.concat(state, F.array(slot(F.coalesce(shows["id"], fresh), CODE, intent, F.array(_ref(x)))))

    shown = F.aggregate(F.slice(F.filter("spine", lambda x: x["substantive"]), 1, 3), F.array().cast(f"array<{SLOT}>"), step)
    rows = rows.withColumn("shown", shown)
    rest = F.filter(plan, lambda p: ~is_visual(p) & ~F.array_contains(ids_of(F.col("shown")), F.coalesce(p["id"], F.lit(""))))
    whole = F.slice(F.concat(F.array("figure"), "shown", rest), 1, SLOTS)
    return rows.withColumn("plan", _when(plan, (F.col("scope") == "system") & Q.is_overview(low) & (F.size("spine") > 0), whole)).drop("spine", "figure", "shown")


def _drawn_hints(items: Column) -> Column:
    primary = F.filter(items, lambda x: ~x["supporting"])
    return F.transform(path_diverse(F.when(F.size(primary) > 0, primary).otherwise(items), 4), _ref)


def requested_visual(rows: DataFrame) -> DataFrame:
    """A figure or sequence in front, where one is asked for and none is planned."""
    plan, low, shape = F.col("plan"), F.lower(F.coalesce("text", F.lit(""))), F.try_element_at("shapes", F.lit(1))
    asked = F.coalesce(shape.isin(*VISUAL), F.lit(False)) | low.rlike(ASKS_VISUAL) | (low.rlike(ASKS_FLOW) & low.rlike(ASKS_SHOW))
    kind = F.when(shape.isin(*VISUAL), shape).when(low.rlike(ASKS_SEQUENCE), SEQUENCE).otherwise(FIGURE)
    hints = _drawn_hints(F.col("items"))
    new = slot(F.when(kind == SEQUENCE, "runtime-sequence").otherwise("implementation-flow"), kind, F.lit(INTENTS["visual"]), hints)
    return rows.withColumn("plan", _when(plan, asked & ~F.exists(plan, is_visual) & (F.size(hints) > 0), add(plan, new, front=True)))


def api(rows: DataFrame) -> DataFrame:
    """For questions of interfaces: a sequence, and excerpts of the route, the request's contract, a caller and the response, where the plan
    does not show them yet; a callout where a caller is asked for and none is known. Takes the columns of facets()."""
    low, base = F.lower(F.coalesce("text", F.lit(""))), F.col("plan")
    asked = F.coalesce(F.array_contains("domains", "api"), F.lit(False)) | low.rlike(ASKS_API)
    some = F.filter(F.array("caller_usage", "route_handler", "request_contract", "response_or_state"), lambda x: x.isNotNull())
    hints = F.when(F.size(some) > 0, F.transform(distinct_paths(some), _ref)).otherwise(_drawn_hints(F.col("items")))

    def put(df: DataFrame, condition: Column, new: Column, front: bool = False) -> DataFrame:
        return df.withColumn("_plan", _when(F.col("_plan"), asked & condition, add(F.col("_plan"), new, front, protect=not front)))

    def fresh(id_: str) -> Column:
        return unique_id(ids_of(F.col("_plan")), F.lit(id_))

    def excerpt(df: DataFrame, facet: str, id_: str, intent: Column) -> DataFrame:
        return put(df, F.col(facet).isNotNull() & ~covers(F.col("_plan"), F.col(facet)), slot(fresh(id_), CODE, intent, F.array(F.col(facet))))

    rows = rows.withColumn("_plan", base)
    rows = put(rows, ~F.exists("_plan", is_visual) & (F.size(hints) > 0), slot(fresh("api-flow"), SEQUENCE, F.lit(INTENTS["api-flow"]), hints), front=True)
    rows = excerpt(rows, "route_handler", "api-route-handler", F.lit(INTENTS["api-route-handler"]))
    first = F.try_element_at("identifiers", F.lit(1))
    contract = F.when(first.isNotNull(), F.replace(F.lit(INTENTS["named-contract"]), F.lit("{name}"), first)).otherwise(INTENTS["api-request-contract"])
    rows = excerpt(rows, "request_contract", "api-request-contract", contract)
    rows = excerpt(rows, "caller_usage", "api-caller-usage", F.lit(INTENTS["api-caller-usage"]))
    gap = slot(F.lit("api-caller-gap"), CALLOUT, F.lit(INTENTS["api-caller-gap"]), F.array().cast(f"array<{REF}>"))
    rows = put(rows, F.col("caller_usage").isNull() & low.rlike(ASKS_USAGE), gap)
    rows = excerpt(rows, "response_or_state", "api-response-state", F.lit(INTENTS["api-response-state"]))
    return rows.withColumn("plan", F.col("_plan")).drop("_plan")


def _wants_code(low: Column) -> Column:
    return low.rlike(ASKS_CODE[0]) | low.rlike(ASKS_CODE[1]) | F.coalesce(F.array_contains("shapes", CODE), F.lit(False))


def named_code(rows: DataFrame) -> DataFrame:
    """Excerpts of what the question names (column named of named_refs), the first three, while the plan has fewer than four excerpts."""
    plan, low = F.col("plan"), F.lower(F.coalesce("text", F.lit("")))
    as_id = lambda n: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(n, "([a-z0-9])([A-Z])", "$1-$2")), "[^a-z0-9]+", "-"), "^-+|-+$", "")

    def step(state: Column, x: Column) -> Column:
        new = slot(unique_id(ids_of(state), F.concat(F.lit("code-"), F.when(as_id(x["name"]) != "", as_id(x["name"])).otherwise("symbol"))), CODE, F.replace(F.lit(INTENTS["named"]), F.lit("{name}"), x["name"]), F.array(_ref(x)))
        return _when(state, (_code_count(state) < MOST_CODE) & ~covers(state, _ref(x), x["name"]), add(state, new, protect=True))

    some = F.slice(F.coalesce("named", F.array().cast("array<struct<place:int,name:string,path:string,line_start:int,line_end:int>>")), 1, 3)
    return rows.withColumn("plan", _when(plan, _wants_code(low), F.aggregate(some, plan, step)))


def requested_code(rows: DataFrame) -> DataFrame:
    """Excerpts of the files that carry the answer: of evidence that no excerpt of the plan shows yet, one for the best file, and one for each
    other file with half of its score that shares a term with the question, or as many as fit where more is asked for; four in all.
    Where surfaces are asked for, one of each family comes first."""
    plan, low = F.col("plan"), F.lower(F.coalesce("text", F.lit("")))
    held = F.flatten(F.transform(F.filter(plan, lambda x: x["kind"] == CODE), lambda x: F.coalesce(x["hints"], F.array().cast(f"array<{REF}>"))))
    shown = lambda x: F.exists(held, lambda h: (h["path"] == x["path"]) & F.coalesce(_shared(h, x), F.lit(True)))
    rows = rows.withColumn("_open", F.filter("items", lambda x: ~F.coalesce(shown(x), F.lit(False)) & ~x["supporting"] & x["substantive"]))
    files = distinct_paths(F.col("_open"))
    top = F.try_element_at(files, F.lit(1))["score"]
    close = F.size(F.filter(F.slice(files, 2, 2**31 - 1), lambda x: (x["score"] >= top * CODE_RATIO) & x["shares"]))
    ceiling = min(MOST_CODE, SLOTS - 1)
    target = F.when(low.rlike(ASKS_MUCH), ceiling).when(F.coalesce(top > 0, F.lit(False)), F.least(F.lit(ceiling), 1 + close)).otherwise(1)
    families = R.surface_families(low)
    leads = F.filter(F.transform(families, lambda f: F.try_element_at(F.filter("_open", lambda x: x["family"] == f), F.lit(1))), lambda x: x.isNotNull())
    surface = F.slice(F.concat(leads, F.array_except("_open", leads)), 1, SLOTS)
    rows = rows.withColumn("_target", target).withColumn("_chosen", F.when(F.size(families) > 0, surface).otherwise(path_diverse(F.col("_open"), SLOTS)))
    named = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(T.basename(x["path"]), r"\.[^.]+$", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")

    def step(state: Column, x: Column) -> Column:
        id_ = unique_id(ids_of(state), F.concat(F.lit("code-"), F.when(named(x) != "", named(x)).otherwise("source")))
        new = slot(id_, CODE, F.replace(F.lit(INTENTS["code"]), F.lit("{path}"), x["path"]), F.array(_ref(x)))
        return _when(state, _code_count(state) < F.col("_target"), add(state, new, protect=True))

    out = F.aggregate("_chosen", plan, step)
    return rows.withColumn("plan", _when(plan, _wants_code(low), out)).drop("_open", "_target", "_chosen")


REWRITES: tuple[Callable[[DataFrame], DataFrame], ...] = (drop_overlaps, supporting_actors, overview, requested_visual, api, named_code, requested_code)


def rewrite(plans: DataFrame, classified: DataFrame, items: DataFrame, hubs: list[str] | None = None) -> DataFrame:
    """(q, plan) of plans (q, plan: array of SLOT) after all rewrites, for classified questions (q, text, scope, shapes, domains) and their
    evidence items (q, ord, tool, path, line_start, line_end, similarity, content). hubs are the paths that most is wired to.
    A question without a plan or without evidence has an empty one."""
    rows = classified.select("q", "text", "scope", "shapes", "domains").join(plans.select("q", F.col("plan").cast(f"array<{SLOT}>").alias("plan")), "q", "left")
    packed, shown, named = packets(items, classified), facets(items, classified), named_refs(items, classified)
    rows = rows.join(packed, "q", "left").join(shown, "q", "left").join(named, "q", "left")
    rows = rows.withColumn("plan", F.coalesce("plan", F.array().cast(f"array<{SLOT}>"))).withColumn("items", F.coalesce("items", F.array().cast(packed.schema["items"].dataType)))
    rows = rows.withColumn("hubs", F.array(*map(F.lit, hubs)) if hubs else F.array().cast("array<string>"))
    rows = settled(rows)  # a row for each question: contents are left behind here
    for change in REWRITES:
        rows = settled(change(rows))
    return rows.select("q", "plan")
